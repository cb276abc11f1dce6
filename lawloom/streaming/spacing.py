"""Requests spaced in time: the answer cache and the cooldown, over tables and streams.

Both are one recurrence for each key.  A request opens if it comes more than
(or at least) so many seconds after the last that opened; opening remembers its
time.  With the cache, opening is a miss, and a hit does not refresh the entry.
With the cooldown, opening is a model call, and others wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut as _cut

#: Seconds an answer stays valid, and between two model calls.
CACHE_SECONDS = 1800
COOLDOWN_SECONDS = 45


def micros(ts: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))")


def _openings(at: np.ndarray, gap: int, last: int | None) -> np.ndarray:
    """For ascending times, that of the last opening, its own included; ``gap`` in microseconds reopens."""
    out = np.empty(len(at), np.int64)
    i = 0 if last is None else int(np.searchsorted(at, last + gap))
    out[:i] = last or 0
    while i < len(at):
        to = int(np.searchsorted(at, at[i] + gap))
        out[i:to] = at[i]
        i = max(to, i + 1)
    return out


def _gap(seconds: int, strict: bool) -> int:
    return seconds * 1_000_000 + strict


def spaced(rows: DataFrame, key: str, ts: str, order: str, seconds: int, strict: bool) -> DataFrame:
    """``rows`` with ``opened`` and ``elapsed_us`` since the last opening (0 for one that opens).

    Of requests at one time the one with the least ``order`` opens.  A request
    that follows the one before it by the whole gap always opens; rows without
    a time or a key are no requests and are left out.  Each key's time is cut
    into blocks as long as the gap, so that a block has one opening at most,
    and the next opening after a time lies in the next block or begins a later
    one.  Which times open is found by following these links from the sure
    openings, twice as far in each round.  No task takes more of a key at once
    than a block, and of the list of blocks SPAN of them.
    """
    gap = max(1, _gap(seconds, strict))
    timed = rows.withColumn("us", micros(ts)).where(F.col("us").isNotNull() & F.col(key).isNotNull())
    timed = timed.select(F.col(key).alias("key"), F.col(order).alias("order"), "us", F.expr(f"us - pmod(us, {gap}L)").alias("block"))
    times = timed.select("key", "block", "us").distinct()
    blocks = _neighbours(times.groupBy("key", "block").agg(F.min("us").alias("least"), F.max("us").alias("most")), gap)
    blocks = _cut(blocks.select("key", "block", "least", F.coalesce(F.col("least") - F.col("before") >= gap, F.lit(True)).alias("sure"), "after"))
    # The first time behind a block and the one that follows it.
    following = blocks.select("key", (F.col("block") - gap).alias("block"), F.lit(True).alias("near"), F.col("after").alias("later"))
    past = blocks.join(following, ["key", "block"], "left").select("key", "block", F.when(F.col("near"), F.col("later")).otherwise(F.col("after")).alias("past"))

    # In each block, its times and those of the block before by one gap later, from the last on: the least time seen so far is the next opening.
    both = times.select("key", "block", F.col("us").alias("at"), F.lit(False).alias("asks")).unionByName(times.select("key", (F.col("block") + gap).alias("block"), (F.col("us") + gap).alias("at"), F.lit(True).alias("asks")))
    w = Window.partitionBy("key", "block").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    links = both.withColumn("to", F.min(F.when(~F.col("asks"), F.col("at"))).over(w)).where("asks").select("key", (F.col("block") - gap).alias("block"), (F.col("at") - gap).alias("us"), "to")
    links = links.join(past, ["key", "block"]).select("key", "us", F.coalesce("to", "past").alias("to")).where("to is not null")
    sure = blocks.where("sure").select("key", F.col("least").alias("us"))
    # A link to a sure opening tells nothing new, and no run of requests goes on behind it.
    links = _cut(links.join(sure.withColumnRenamed("us", "to"), ["key", "to"], "left_anti").select("key", "us", "to"))
    opened = _cut(sure)
    while not links.isEmpty():
        further = links.join(opened, ["key", "us"], "left_semi").select("key", F.col("to").alias("us"))
        opened = _cut(opened.unionByName(further).distinct())
        links = _cut(links.join(links.select("key", F.col("us").alias("to"), F.col("to").alias("then")), ["key", "to"]).select("key", "us", F.col("then").alias("to")))

    opened = opened.select("key", F.expr(f"us - pmod(us, {gap}L)").alias("block"), F.col("us").alias("own"))
    earlier = opened.select("key", (F.col("block") + gap).alias("block"), F.col("own").alias("earlier"))
    found = timed.join(opened, ["key", "block"], "left").join(earlier, ["key", "block"], "left")
    found = found.withColumn("opening", F.when(F.col("own") <= F.col("us"), F.col("own")).otherwise(F.col("earlier")))
    w = Window.partitionBy("key", "opening").orderBy("us", "order")
    return found.select(F.col("key").alias(key), F.col("order").alias(order), (F.row_number().over(w) == 1).alias("opened"), (F.col("us") - F.col("opening")).alias("elapsed_us"))


#: Blocks of the gap's length in one span of the list of blocks.
SPAN = 1024


def _neighbours(blocks: DataFrame, length: int) -> DataFrame:
    """``blocks`` (key, block, least, most) with the last time ``before`` and the first one ``after`` each, null at the ends of a key.

    Neighbours are sought within spans of SPAN blocks, and of spans in spans of
    these, until a key has few.
    """
    span = length * SPAN
    w = Window.partitionBy("key", "span").orderBy("block")
    blocks = blocks.withColumn("span", F.expr(f"block - pmod(block, {span}L)"))
    blocks = blocks.withColumn("before", F.lag("most").over(w)).withColumn("after", F.lead("least").over(w))
    spans = _cut(blocks.groupBy("key", F.col("span").alias("block")).agg(F.min("least").alias("least"), F.max("most").alias("most")))
    if (spans.groupBy("key").count().agg(F.max("count").alias("n")).first().n or 0) > SPAN:
        spans = _neighbours(spans, span)
    else:
        w = Window.partitionBy("key").orderBy("block")
        spans = spans.withColumn("before", F.lag("most").over(w)).withColumn("after", F.lead("least").over(w))
    spans = spans.select("key", F.col("block").alias("span"), F.col("before").alias("b"), F.col("after").alias("a"))
    return blocks.join(spans, ["key", "span"]).withColumn("before", F.coalesce("before", "b")).withColumn("after", F.coalesce("after", "a")).drop("span", "a", "b")


def spaced_stream(rows: DataFrame, key: str, ts: str, order: str, seconds: int, strict: bool) -> DataFrame:
    """The same for a stream, with the last opening of each key as its state.

    ``key`` must be a string and ``order`` a long.  Requests of one batch are
    put in order; a request that comes in a later batch than a newer one is
    judged against the state it finds.
    """
    gap = _gap(seconds, strict)

    def step(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["us", order])
        at = rows["us"].to_numpy()
        last = state.get[0] if state.exists else None
        opening = _openings(at, gap, last)
        if len(at):
            state.update((int(opening[-1]),))
        new = (np.diff(opening, prepend=opening[:1] - 1) != 0) & (opening != (last if last is not None else -(1 << 62)))
        yield pd.DataFrame({key: name[0], order: rows[order].to_numpy(), "opened": new, "elapsed_us": at - opening})

    timed = rows.select(key, order, micros(ts).alias("us")).where(F.col("us").isNotNull() & F.col(key).isNotNull())
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, {order} long, opened boolean, elapsed_us long", "last long", "append", "NoTimeout")
