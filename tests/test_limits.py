"""Token limits against a plain version, bundles and upserts by round trip."""

import json
import re

import pytest
from pyspark.sql import Row

from lawloom.operators import answers, chunks, limits
from lawloom.sources import bundles
from lawloom.streaming import upserts

COUNT = re.compile(r"\w+|[^\w\s]")


def n(t):
    return len(COUNT.findall(t))


def plain_pieces(text, most):
    if n(text) <= most:
        return [text]
    out, lane = [], None
    for i, s in enumerate(x.strip() for x in re.split(r"(?<=[.!?;])\s+|\n+", text) if x.strip()):
        many = n(s) > most
        for w in s.split() if many else [s]:
            if lane == (i if many else -1) and n(out[-1]) + n(w) <= most:
                out[-1] += " " + w
            else:
                out.append(w)
            lane = i if many else -1
    return out


def test_pieces(spark):
    texts = ["", "one two", "a b. c d! e; f g h i j k l m n o p. q", "word " * 30, "x\n\n y.  z? " * 9, "a-b-c-d-e-f-g-h-i tail. end", None]
    rows = [Row(doc_id=i, path=["a"], chunk_id=str(i), part=0, text=t) for i, t in enumerate(texts)]
    for most in (1, 4, 7):
        found = limits.split_oversized(spark.createDataFrame(rows, "doc_id int, path array<string>, chunk_id string, part int, text string"), most).orderBy("doc_id", "part").collect()
        for i, t in enumerate(texts):
            cut = plain_pieces(t or "", most)
            assert [r.text for r in found if r.doc_id == i] == (cut if len(cut) > 1 else [t or ""])


def plain_merge(chunks, least, most):
    runs = []
    for c in chunks:
        if runs and sum(map(n, runs[-1])) < least and sum(map(n, runs[-1])) + n(c) <= most:
            runs[-1].append(c)
        else:
            runs.append([c])
    out = []
    for r in runs:
        if out and sum(map(n, r)) < least and sum(map(n, out[-1] + r)) <= most:
            out[-1] = out[-1] + r
        else:
            out.append(r)
    return ["\n\n".join(r) for r in out]


def test_merge_and_enforce(spark):
    sizes = [3, 9, 1, 12, 2, 2, 5, 11, 1, 1, 8, 40, 3]
    texts = [" ".join(f"w{i}" for i in range(k)) for k in sizes]
    rows = [Row(doc_id=1, path=["a", f"{i:02}"], chunk_id=f"c{i}", part=0, text=t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, path array<string>, chunk_id string, part int, text string")
    found = [r.text for r in limits.merge_under_min(df, 6, 12).orderBy("path", "part").collect()]
    assert found == plain_merge(texts, 6, 12)
    cut = [p for t in texts for p in plain_pieces(t, 12)]
    got = limits.enforce(df, 6, 12).collect()
    assert sorted(r.text for r in got) == sorted(p for t in plain_merge(cut, 6, 12) for p in plain_pieces(t, 12))
    assert all(r.token_count <= 12 for r in got)
    assert limits.enforce(df.where("doc_id < 0")).count() == 0


def test_bundles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"base_chunks": [], "level_chunks": [{"chunk_id": "1", "text": "kept", "section": "s"}, {"chunk_id": "2", "text": "please Complete the CAPTCHA"}, {"chunk_id": "3", "text": " "}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [{"chunk_id": "4", "text": "last"}], "other": 1}))
    (tmp_path / "c.json").write_text("{}")
    rows = bundles.read_bundles(spark, f"{tmp_path}/*.json", "base_chunks")
    assert {(r.chunk_id, r.text) for r in rows.collect()} == {("1", "kept"), ("4", "last")}
    bundles.write_lines(rows.select("chunk_id", "text"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    assert {(r.section, r.n_chunks) for r in bundles.manifest(rows, "section").collect()} == {("s", 1), (None, 1)}


def test_lists_counts_and_errors_of_bundles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"chunk_id": "2", "text": "two"}, {"chunk_id": "1", "text": "one"}, {"chunk_id": "3", "text": "request access"}, {"chunk_id": "4"}]))
    (tmp_path / "b.json").write_text(json.dumps({"level_chunks": [{"chunk_id": "5", "text": "five"}]}))
    rows = bundles.read_bundles(spark, f"{tmp_path}/*.json", strict=True)
    assert [r.chunk_id for r in rows.orderBy("file", "pos").collect()] == ["2", "1", "5"]
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text(json.dumps({"chunks": [{"text": " "}]}))
    counts = {r.file[-6:]: (r.loaded, r.skipped) for r in bundles.bundle_counts(spark, f"{tmp_path}/*.json").collect()}
    assert counts == {"a.json": (2, 2), "b.json": (1, 0), "c.json": (0, 0), "d.json": (0, 1)}
    assert bundles.read_bundles(spark, f"{tmp_path}/*.json").count() == 3
    with pytest.raises(ValueError, match=r"c\.json.*d\.json"):
        bundles.read_bundles(spark, f"{tmp_path}/*.json", strict=True)


def test_upserts_of_a_stream(spark, tmp_path):
    schema = "id string, v int, gone boolean"
    for k, part in enumerate([[("a", 1, False), ("b", 1, False), (" ", 1, False)], [("a", 2, False), ("b", 2, True), ("c", 1, None)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        upserts.upserts(stream, f"{tmp_path}/index", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    found = upserts.latest(spark, f"{tmp_path}/index", ["id"], "v", "gone")
    assert {tuple(r) for r in found.collect()} == {("a", 2), ("c", 1)}


def test_footer(spark):
    row = spark.createDataFrame([("plain", "- 1. x"), ("see §1", "- 1. x"), ("", "- 1. x"), ("plain", None)], "a string, f string")
    assert [r[0] for r in row.select(answers.with_footer(row.a, row.f)).collect()] == ["plain\n\nCitations:\n- 1. x", "see §1", "", "plain"]


def test_no_two_lines_share_a_path(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(700)))], "doc_id long, text string")
    assert chunks.paragraphs(docs).select("path").distinct().count() == 700
