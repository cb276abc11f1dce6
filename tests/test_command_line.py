"""An index written and asked from the command line."""

import pytest

from lawloom.__main__ import main

RECORDS = "doc_id string, content string, part string, section_ref string, seq long"


def test_ingest_then_ask(spark, tmp_path):
    rows = [
        ("a", "Loans under this part are due in May.", "603", "§603.1(a)", 2), ("a", "overwritten", "603", "§603.1(a)", 1),
        ("b", "Grants for students of dance.", "604", "§604.2", 1), ("c", " ", "605", "§605.1", 1), ("d", "Please complete the CAPTCHA", "606", "§606.1", 1),
    ]
    spark.createDataFrame(rows, RECORDS).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([(x, [float(i), 1.0]) for i, x in enumerate("abcd")], "doc_id string, vector array<double>").write.parquet(f"{tmp_path}/v")
    main_ingest = ["ingest", "--records", f"{tmp_path}/r", "--vectors", f"{tmp_path}/v", "--out", f"{tmp_path}/1", "--order", "seq"]
    assert main(main_ingest) == ["loaded: 2", "rejected: 2", "kept_before: 0", "dimension: 2"]
    spark.createDataFrame([("b", "Grants for students of music.", "604", "§604.2", 1)], RECORDS).write.parquet(f"{tmp_path}/r2")
    more = ["ingest", "--records", f"{tmp_path}/r2", "--vectors", f"{tmp_path}/v", "--out", f"{tmp_path}/2", "--previous", f"{tmp_path}/1"]
    assert main(more) == ["loaded: 1", "rejected: 0", "kept_before: 1", "dimension: 2"]
    found = main(["query", "--index", f"{tmp_path}/2", "--top-k", "1", "loans in part 603", "grants for students of music"])
    assert [x.split()[0] for x in found] == ["1.1", "2.1"] and "due in May" in found[0] and "music" in found[1]
    with pytest.raises(SystemExit):
        main(["query", "--index", f"{tmp_path}/2", "--vectors", f"{tmp_path}/v", "x"])
    with pytest.raises(SystemExit):
        main([*main_ingest, "--previous", f"{tmp_path}/1"])
