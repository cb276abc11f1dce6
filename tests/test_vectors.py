"""Scoped search of vectors against a plain version, saved and not."""

import random

import numpy as np
import pytest

from lawloom.operators import vectors

SCHEMA = "vec_id string, vector array<float>, node string, part string"


def plain(queries, rows, k, scopes):
    out = set()
    for qid, q, *own in queries:
        if q is None:
            continue
        live = [r for r in rows if r[1] is not None]
        branch, fits = len(scopes), live
        for i in range(len(scopes)):
            same = [r for r in live if own[i] and r[2 + i] == own[i]]
            if same:
                branch, fits = i, same
                break
        unit = lambda v: np.float32(v).astype(float) / max(np.linalg.norm(np.float32(v).astype(float)), 1e-300)
        best = sorted((-round(float(unit(q) @ unit(r[1])), 6), r[0]) for r in fits)[:k]
        out |= {(qid, key, branch, n) for n, (_, key) in enumerate(best, 1)}
    return out


def rows(n, seed):
    r = random.Random(seed)
    # A third of all rows have one part; some have neither scope, some no vector, and vectors come again.
    vector = lambda: None if r.random() < 0.05 else [float(r.randrange(-2, 3)) for _ in range(4)]
    return [(f"v{i:04}", vector(), r.choice([None, "", f"n{r.randrange(9)}"]), "hot" if i % 3 == 0 else r.choice(["", "p1", "p2", None])) for i in range(n)]


@pytest.mark.parametrize("few", [True, False])
def test_scopes(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(vectors, "BROADCAST_SCOPES", 100 if few else 0)
    have, ask = rows(400, 1), [(i, v, n if i % 4 else "gone", p) for i, (_, v, n, p) in enumerate(rows(60, 2))]
    found = vectors.nearest(spark.createDataFrame(ask, "question_id int, vector array<float>, node string, part string"), spark.createDataFrame(have, SCHEMA), 5, scopes=("node", "part"))
    assert {(r.question_id, r.vec_id, r.branch, r["rank"]) for r in found.collect()} == plain(ask, have, 5, ("node", "part"))


def test_a_saved_table_opens_what_is_asked_for(spark, tmp_path):
    have = rows(300, 3)
    path = f"{tmp_path}/vectors"
    vectors.save(spark.createDataFrame(have, SCHEMA), path, "vec_id", "part")
    schema = "question_id int, vector array<float>, part string"
    for parts in (["p1", "hot"], ["p1", "", None, "gone"]):
        ask = [(i, [1.0, -2.0, 0.5, float(i)], p) for i, p in enumerate(parts)]
        found = vectors.nearest_saved(spark.createDataFrame(ask, schema), path, 4, "vec_id", "part")
        want = plain([(i, v, p) for i, v, p in ask], [(k, v, p) for k, v, _, p in have], 4, ("part",))
        assert {(r.question_id, r.vec_id, r.branch, r["rank"]) for r in found.collect()} == want
        scans = [line for line in found._jdf.queryExecution().toString().split("\n") if "FileScan" in line]
        whole = [line for line in scans if "PartitionFilters: []" in line]
        # Without a question that needs all of them, no scan reads every folder.
        assert bool(scans) and bool(whole) == (len(parts) > 2)


def test_no_rows(spark):
    asks, none = "question_id int, vector array<float>, part string", "vec_id long, vector array<float>, part string"
    one = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a")], asks)
    assert vectors.nearest(one, spark.createDataFrame([], none), 3, scopes=("part",)).count() == 0
    assert vectors.nearest(spark.createDataFrame([], asks), spark.createDataFrame([(1, [1.0, 2.0], "a")], none), 3, scopes=("part",)).count() == 0
