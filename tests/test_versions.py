"""Versions of chunks against a plain fold, day after day."""

import random

from pyspark.sql import functions as F

from lawloom.operators import versions


def plain(days):
    """key -> its versions [content, from, to]."""
    out = {}
    for day, (complete, writes) in enumerate(days):
        last = {}
        for key, text, gone, seq in sorted(writes, key=lambda w: w[3]):
            last[key] = (text, gone)
        for key, (text, gone) in last.items():
            kept = out.setdefault(key, [])
            holds = kept and kept[-1][2] is None
            if holds and (gone or kept[-1][0] != text):
                kept[-1][2] = day
                holds = False
            if not gone and not holds:
                kept.append([text, day, None])
        for key, kept in out.items():
            if complete and key not in last and kept[-1:] and kept[-1][2] is None:
                kept[-1][2] = day
    return [(*key, *v) for key, kept in out.items() for v in kept]


def test_days_of_changes_equal_a_plain_fold(spark):
    rng = random.Random(7)
    schema = "namespace string, chunk_id string, text string, gone boolean, seq int"
    days = []
    for day in range(6):
        writes = [((rng.choice("ab"), f"c{rng.randint(0, 9)}"), rng.choice((None, "", "x", "y")), rng.random() < 0.2, k) for k in range(14 if day != 3 else 0)]
        days.append((day % 2 == 1, writes))
    key = lambda v: [repr(x) for x in v]
    history = None
    for day, (complete, writes) in enumerate(days):
        batch = spark.createDataFrame([(*k, t, g, s) for k, t, g, s in writes] + [(None, "c1", "z", False, 9), (" ", "c1", "z", False, 9)], schema)
        if history is None:
            history = versions.begin_versions(batch, ["namespace", "chunk_id"], ["text"], F.lit(0))
        history = versions.merge_versions(history, batch, ["namespace", "chunk_id"], ["text"], F.lit(day), "seq", complete, "gone")
        history = spark.createDataFrame(history.collect(), history.schema)
        got = sorted((tuple(r) for r in history.drop("content_hash").collect()), key=key)
        assert got == sorted(plain(days[: day + 1]), key=key)
    held = versions.versions_at(history, F.lit(2)).select("namespace", "chunk_id", "text").collect()
    assert sorted(map(tuple, held), key=key) == sorted(((a, b, t) for a, b, t, begun, ended in plain(days) if begun <= 2 and (ended is None or ended > 2)), key=key)
