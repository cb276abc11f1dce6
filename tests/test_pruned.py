"""The best few of a saved keyword index by bounds of blocks, against scores of all documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lawloom.operators import bm25, segments

RARE = ("quokka", "zephyr", "obelisk")


def corpus(rng, n):
    """Zipf-like texts of very different lengths; rare words come once or often in a few of them."""
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(n):
        text = rng.choices(words, weights, k=int(2 ** rng.uniform(0, 8)))
        if rng.random() < 0.03:
            text += [rng.choice(RARE)] * rng.randint(1, 5)
        rows.append((i, " ".join(text)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "w0"), (n + 3, "w0")]


def shown(found):
    return sorted((r.question_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_DOCS", 8)
    monkeypatch.setattr(segments, "FILE_DOCS", 1000)


def test_equals_all_scores(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    rows = corpus(rng, 700)
    path = str(tmp_path / "k")
    schema = "doc_id long, text string"
    segments.add(spark.createDataFrame(rows[:500], schema), path, "doc_id", "text")
    segments.add(spark.createDataFrame([], schema), path, "doc_id", "text")
    segments.add(spark.createDataFrame([*rows[500:], *[(i, "w1 quokka") for i in range(0, 90, 3)]], schema), path, "doc_id", "text")
    segments.remove(spark.createDataFrame([(i,) for i in range(0, 700, 7)], "doc_id long"), path, "doc_id")
    live = dict(rows) | {i: "w1 quokka" for i in range(0, 90, 3)}
    docs = spark.createDataFrame([(k, t) for k, t in live.items() if k % 7 or k >= 700], schema)
    asked = [(1, "w0 w1 quokka"), (2, "w0"), (3, "zephyr obelisk zephyr w3 w40"), (4, "unknown"), (5, ""), (6, None), (7, "unknown w59 w2")]
    questions = spark.createDataFrame(asked, "question_id long, question string")
    for compacted in (False, True):
        if compacted:
            segments.compact(spark, path, "doc_id")
        scores = bm25.search(questions, docs, "doc_id", "text", None).cache()
        for top_k, least in ((5, 2.5), (2000, 0.0)) if compacted else ((1, 0.0), (5, 0.0)):
            want = scores.where((F.col("score") >= least) & (F.col("rank") <= top_k))
            assert shown(segments.search(questions, path, "doc_id", top_k, least, bounded=True)) == shown(want)
    with pytest.raises(ValueError, match="best few"):
        segments.search(questions, path, "doc_id", None, bounded=True)


def test_bounds_close_blocks(spark, tmp_path, small_blocks):
    """Blocks that can't hold one of the best aren't unpacked, and grades of length that have none of the others aren't read."""
    rows = corpus(random.Random(9), 3000)
    path = str(tmp_path / "k")
    segments.add(spark.createDataFrame(rows, "doc_id long, text string"), path, "doc_id", "text")
    questions = spark.createDataFrame([(1, "quokka w0 w1")], "question_id long, question string")
    want = segments.search(questions, path, "doc_id", None).where("rank <= 3")
    asked = []
    opened = segments._opened
    segments._opened = lambda packed, blocks: asked.append((opened(packed, blocks), blocks)) or asked[-1][0]
    try:
        got = segments.search(questions, path, "doc_id", 3, bounded=True)
        assert shown(got) == shown(want)
    finally:
        segments._opened = opened
    read, blocks = asked[-1]
    stored = spark.read.parquet(f"{path}/segment-1/postings")
    terms = [r.term for r in blocks.select("term").distinct().collect()]
    assert blocks.count() < stored.where(stored.term.isin(terms)).count() / 4
    buckets = [r.b for r in blocks.select(segments._bucket(blocks.term).alias("b")).distinct().collect()]
    of_terms = stored.where(stored.bucket.isin(buckets))
    assert read.count() < of_terms.count() and len(read.inputFiles()) <= len(of_terms.inputFiles())
