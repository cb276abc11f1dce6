"""Openings found block by block equal those of one pass over each key, and no key is gathered."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.plans.queries import table
from lawloom.streaming import spacing


def one_pass(rows, gap):
    out, by = [], {}
    for key, us, order in sorted(rows):
        by.setdefault(key, []).append((us, order))
    for key, all_ in by.items():
        opening = spacing._openings(np.array([u for u, _ in all_], np.int64), gap, None)
        seen = set()
        for (us, order), o in zip(all_, opening.tolist(), strict=True):
            out.append((key, order, o not in seen, us - o))
            seen.add(o)
    return sorted(out)


@pytest.mark.parametrize(("seconds", "strict", "span"), [(10, True, 2), (10, False, 3), (7, True, 1024)])
def test_same_as_one_pass(spark, monkeypatch, seconds, strict, span):
    """Dense and sparse keys, ties, times before 1970, gaps of exactly the length, long pauses."""
    monkeypatch.setattr(spacing, "SPAN", span)
    rng = random.Random(seconds + span)
    rows, n = [], 0
    for key, steps in {"dense": (0, 1, 1, 2), "exact": (5, 10), "sparse": (9, 10, 11, 500), "hot": (0, 0, 0, 1)}.items():
        at = -200
        for _ in range(150):
            at += rng.choice(steps)
            rows.append((key, at * 1_000_000 + rng.choice((0, 0, 1)), n))
            n += 1
    df = spark.createDataFrame([*rows, (None, 5, 1), ("dense", None, 2)], "k string, us long, n long").withColumn("ts", F.timestamp_micros("us"))
    got = sorted(tuple(r) for r in spacing.spaced(df.select("k", "n", "ts"), "k", "ts", "n", seconds, strict).collect())
    assert got == one_pass(rows, spacing._gap(seconds, strict))
    assert spacing.spaced(df.where("false").select("k", "n", "ts"), "k", "ts", "n", seconds, strict).count() == 0


def test_no_key_is_gathered(spark):
    plan = spacing.spaced(table(spark, "/root/testdata/sf0.001", "events"), "event_type", "ts", "event_id", spacing.CACHE_SECONDS, True)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
