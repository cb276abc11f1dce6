"""What near-duplicate detection leaves to the driver: it keeps a record of every task, so a run may not have very many."""

import random

from lawloom.llm import language, minhash
from lawloom.llm.components import components, merged

PARTITIONS = 24
NO_MERGING = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def text(rng, n=40):
    return " ".join(str(rng.randrange(10**6)) for _ in range(n))


def test_tasks_of_a_run(spark):
    """Families that need further turns: chains of near copies, whose ends aren't alike, and copies."""
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        words = text(rng, 120).split()
        for k in range(8):
            words[15 * k] = str(rng.randrange(10**6))
            rows += [" ".join(words)] * (1 + k % 2)
    rows = [(i, t) for i, t in enumerate([*rows, *(text(rng) for _ in range(40)), None, ""])]
    before = {k: spark.conf.get(k) for k in NO_MERGING}
    try:
        for k, v in NO_MERGING.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("near", "near")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == minhash.brute(rows, 5, 80)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))
    assert 0 < tasks < 70 * PARTITIONS


def test_merged(spark):
    """Links between components: those with labels, new nodes, links to itself, none."""
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    labels = components(frame([(5, 9), (9, 12), (3, 4), (20, 21)]))
    want = {5: 5, 9: 5, 12: 5, 3: 3, 4: 3, 20: 20, 21: 20}
    assert {r.node: r.comp for r in labels.collect()} == want
    one = merged(labels, frame([(3, 3)]))
    assert sorted((r.node, r.comp) for r in one.collect()) == sorted(want.items())
    two = merged(one, frame([(5, 3), (20, 30), (41, 40), (3, 5)]))
    assert sorted((r.node, r.comp) for r in two.collect()) == [(3, 3), (4, 3), (5, 3), (9, 3), (12, 3), (20, 20), (21, 20), (30, 20), (40, 40), (41, 40)]


def test_sample_is_released(spark, monkeypatch):
    released = []
    monkeypatch.setattr(language.common, "release", lambda: released.append(True))
    docs = spark.createDataFrame([("one two", "en"), ("uno dos", "es")], "text string, lang string")
    assert language.fit(docs).languages == ["en", "es"] and released
