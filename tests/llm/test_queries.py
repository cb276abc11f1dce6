"""Registered queries on awkward tables, and by brute force or the library where SQL can't express them."""

import hashlib
import zlib

import numpy as np
import pytest

from lawloom.llm import bpe, language, mpeg, registry, url_rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, did string, row string"
TEXTS = [None, "", " \n\t", "x", "Plain words here, and a few more of them. " * 9, "Plain words here, and a few more of them. " * 9, "é" * 600, "TAG" * 192, "a " * 3000, "<|endoftext|> it's 12 o'clock  ", "zażółć gęślą jaźń " * 40]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders of tables: awkward rows, and none."""
    out = []
    for some in (True, False):
        at = str(tmp_path_factory.mktemp("tables"))
        rows = [(i, t, ("en", "fr", None)[i % 3], None, None, "d", "r") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", None, None, "d", "r"), (None, TEXTS[4], None, None, None, None, None), (None, None, None, None, None, None, None)]
        spark.createDataFrame(rows if some else [], DOCUMENTS).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, TEXTS[4][:200]), (None, "x"), (2, None)] if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 1), (None, 1, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        pages = [(1, "https://A.example.NET/en/x?q", "<p>One, two. Three."), (2, None, None), (3, "no url", ""), (3, "no url", ""), (None, "x://b.org/fr/" + "d/" * 300, "<p" * 50)]
        spark.createDataFrame(pages if some else [], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
        out.append((at, len(rows) if some else 0, len(pages) if some else 0))
    return out


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_takes_awkward_and_empty_tables(spark, tables, name):
    for at, documents, pages in tables:
        rows = registry.QUERIES[name](spark, at).collect()
        assert len(rows) == (pages if name.startswith(("op6", "op8")) else documents)


def test_audio_as_by_brute_force(spark, tables):
    rows = {r.doc_id: r.asDict() for r in registry.QUERIES["op1_mpeg_audio"](spark, tables[0][0]).collect() if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        want = mpeg.brute(t)
        assert {k: rows[i][k] for k in want} == want
        assert rows[i]["tail_crc32"] == zlib.crc32(((t or "").encode() + b"\xff" * 576)[: want["payload_bytes"]][-32:])


def test_wrong_seek_points_and_other_tables_are_noticed():
    media = bytearray(mpeg.store(bytes(range(256)) * 90))
    assert mpeg.seek_points_agree(mpeg.parse(bytes(media))) and len(mpeg.parse(bytes(media)).rates) == 2
    at = media.find(b"Xing") + 16
    media[at + 50] = 3
    assert not mpeg.seek_points_agree(mpeg.parse(bytes(media)))
    frame = mpeg.HEADS[0] + bytes(2)
    vbri = frame.ljust(36, b"\0") + b"VBRI" + bytes(6) + (4242).to_bytes(4) + (7).to_bytes(4)
    read = mpeg.parse(vbri.ljust(mpeg.FRAMES[0], b"\0") + bytes(media[media.find(mpeg.HEADS[0]) + mpeg.FRAMES[0] :]))
    assert (read.table_bytes, read.table_frames) == (4242, 7)


def test_bpe_as_the_library_has_it(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_padding()
    library.no_truncation()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    for r in registry.QUERIES["op7_transducer_bpe"](spark, tables[0][0]).collect():
        ids = library.encode((TEXTS[r.doc_id] if r.doc_id is not None else None) or "", add_special_tokens=False).ids if r.doc_id is not None else None
        if ids is not None:
            assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()))
            assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False).encode())


def test_url_columns_stay(spark):
    rows = [("https://a.example.net/en/x", "keep", "h", "p", "r", 5)]
    pages = spark.createDataFrame(rows, "url string, action string, at_host string, at_path string, row string, host int")
    got = url_rules.judge(pages, url_rules.rule_table(spark)).first()
    assert (got.action, got.at_host, got.at_path, got.row, got.host, got.rule, got.verdict) == ("keep", "h", "p", "r", "a.example.net", "example.net/en/", "allow")


def test_each_language_is_learned_however_few_texts_it_has(spark):
    rows = [(f"lang{k:03}", f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)} " * 6) for k in range(320) for _ in range(3)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string"), per_language=1)
    assert len(model.languages) == 320


def test_language_scores_as_by_brute_force():
    """``predict`` by its definition: mean weight of a text's n-grams, bias, temperature, softmax."""
    rng = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"], rng.normal(size=(3, 1 << language.BITS)).astype(np.float32), rng.normal(size=3), 0.7)
    texts = [t for t in TEXTS if t]
    best, score = model.predict(texts)
    for t, b, s in zip(texts, best, score, strict=True):
        features, _ = language.grams([t])
        z = np.array([model.weights[j][features].astype(float).mean() + model.bias[j] for j in range(3)]) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert b == p.argmax() and abs(s - p.max()) < 1e-6


