"""Cache and cooldown in one state: golden lines, a plain pass, tables against streams."""

import random

import pytest
from pyspark.sql import functions as F

from lawloom.operators import asking
from lawloom.streaming import answering

SCHEMA = "n long, s long, question string, who string, forced boolean, fails boolean"


def plain(rows):
    """The reference order of things, one request after another: scope -> state."""
    out, last, cache = {}, {}, {}
    for n, s, question, who, forced, fails in sorted(rows, key=lambda r: (r[1], r[0])):
        who, q = (who or "").strip() or "default", " ".join((question or "").lower().split())
        if (who, q) in cache and s - cache[who, q][0] <= 1800:
            out[n] = ("hit", None, cache[who, q][1])
        elif not forced and who in last and s - last[who] < 45:
            out[n] = ("skipped", 45 - (s - last[who]), None)
        else:
            last[who] = s
            if not fails:
                cache[who, q] = (s, n)
            out[n] = ("called", None, n)
    return out


def judged(frame):
    return {r.n: (r.outcome, r.retry_after, r.source) for r in frame.collect()}


def timed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))


COLUMNS = ("n", "ts", "question", "who", "forced", "fails")


def test_golden_lines(spark):
    rows = [(i, s, q, None, False, False) for i, (s, q) in enumerate([(1000, "Q1"), (1020, " q1 "), (1030, "q2"), (1045, "q2"), (2800, "q1"), (2801, "q1")])]
    got = judged(answering.decide(timed(spark, rows), *COLUMNS))
    assert [got[i][0] for i in range(6)] == ["called", "hit", "skipped", "called", "hit", "called"] and got[2][1] == 15 and got[4][2] == 0


def many(seed, n=1500):
    """Dense and sparse callers, ties, forced and failing calls, pauses around the limits, times before 1970."""
    rng = random.Random(seed)
    rows, at = [], dict.fromkeys(("a", " b ", None, "long"), -9000)
    for i in range(n):
        who = rng.choice([*at])
        at[who] += rng.choice((0, 1, 20, 44, 45, 46)) if who != "long" else rng.choice((45, 1800, 1801, 9000))
        rows.append((i, at[who], rng.choice(("What  is x", "what is X", "y", "z", None, "w", "v")), who, rng.random() < 0.05, rng.random() < 0.2))
    return rows


@pytest.mark.parametrize("block", [1800, answering.BLOCK_SECONDS])
def test_blocks_equal_one_pass(spark, monkeypatch, block):
    monkeypatch.setattr(answering, "BLOCK_SECONDS", block)
    rows = many(block)
    frame = timed(spark, [*rows, (9999, None, "q", "a", None, None)])
    assert judged(answering.decide(frame, *COLUMNS)) == plain(rows)
    assert answering.decide(frame.limit(0), *COLUMNS).count() == 0


def dense(n=9000):
    """A request every few seconds, as many questions as the cooldown lets through while an answer holds: what a block begins with is never forgotten."""
    rng = random.Random(n)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice((0, 5, 10))
        rows.append((i, at, f"Q{rng.randrange(40)}", "a" if i % 50 else f"b{i}", i % 11 == 0, i % 7 == 0))
    return rows


@pytest.mark.parametrize("make", [dense, lambda: many(9, 3000)], ids=["dense", "many"])
def test_few_turns(spark, monkeypatch, make):
    """However states depend on those before, there are few passes, not one for each block, and outcomes are those of one pass."""
    monkeypatch.setattr(answering, "BLOCK_SECONDS", 900)
    cuts, cut = [], answering.cut
    monkeypatch.setattr(answering, "cut", lambda df: cuts.append(1) or cut(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = make()
        assert judged(answering.decide(timed(spark, rows).repartition(8), *COLUMNS)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 3 < len(cuts) <= 2 + 2 * 4


def test_normal_questions(spark):
    rows = [(1, 0, "q 1", None, False, False), (2, 50, None, None, False, False), (3, 60, "q 1", None, False, False), (4, 100, "", None, False, False)]
    got = judged(answering.decide(timed(spark, rows), *COLUMNS, normal=True))
    assert got == plain(rows) and got[4] == ("hit", None, 2)


def test_stream_equals_table(spark, tmp_path):
    spark.conf.set(*answering.STATE_STORE)
    rows = sorted(many(5, 600), key=lambda r: (r[1], r[0]))
    for k in range(3):
        timed(spark, rows[k * 200 : k * 200 + 200]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = answering.decide_stream(stream, *COLUMNS).writeStream.format("memory").queryName("answering").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert judged(spark.table("answering")) == plain(rows)
    spark.conf.unset(answering.STATE_STORE[0])


def test_answers_over_time(spark):
    """A failed call is asked again by the next one, a hit has the words of its call, skipped ones list what was found."""
    asked = spark.createDataFrame(
        [(1, 0, "Loan?"), (2, 50, "loan?"), (3, 60, " LOAN?"), (4, 70, "other"), (5, 200, "nothing"), (6, 300, "fails")], "question_id long, s long, question string"
    ).withColumn("asked_at", F.timestamp_seconds("s"))
    known = asked.where("question_id <> 5").select("question_id", F.lit("d").alias("doc_id"), F.lit("Content.").alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("node_id", "section_ref", "source_name", "source_type", "source_url", "authority_level")], F.lit(1).alias("rank"))
    model = lambda a: a.select("question_id", F.when(~F.col("question_id").isin(1, 6), F.concat(F.lit("See § 1 by "), F.col("question_id").cast("string"))).alias("answer"))
    got = {r.question_id: r for r in asking.answer_over_time(asked, known, model).collect()}
    assert [got[i].outcome for i in range(1, 7)] == ["called", "called", "hit", "skipped", "out_of_scope", "called"]
    assert got[2].answer == got[3].answer == "See § 1 by 2" and got[4].retry_after == 25
    assert not got[1].by_model and got[1].answer == got[6].answer == got[4].answer and got[2].by_model and got[3].by_model
