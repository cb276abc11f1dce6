"""Token limits of chunks: oversized chunks are split, small ones merged with their siblings.

Chunks are rows (doc_id, path, chunk_id, part, text): ``path`` an array of
labels whose length is the depth, ``part`` the number of a split piece, 0 for a
whole chunk.  Null texts count as empty.  A split works inside its row, without
a shuffle; a merge gathers the children of one parent of one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import OUTER_WHITE, blank, word_tokens

#: Where a sentence or line ends, and white space.
SEGMENT_END = r"(?<=[.!?;])[\s\p{Z}]+|\n+"
WHITE = r"[\s\p{Z}]+"


def token_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def pieces(text: Column, most: int) -> Column:
    """A text as pieces of at most ``most`` tokens: whole sentences and lines while they fit.

    A sentence of more tokens is cut between words and shares no piece with
    others; a single word is never cut.
    """
    strip = lambda s: F.regexp_replace(s, OUTER_WHITE, "")
    segments = F.filter(F.transform(F.split(blank(text), SEGMENT_END), strip), lambda s: s != "")

    def item(lane: Column, s: Column) -> Column:
        return F.struct(lane.cast("int").alias("lane"), token_count(s).alias("tokens"), s.alias("text"))

    def items(s: Column, i: Column) -> Column:
        # The words of an overlong sentence have a lane of their own.
        return F.when(token_count(s) > most, F.transform(F.split(s, WHITE), lambda w: item(i, w))).otherwise(F.array(item(F.lit(-1), s)))

    def close(a: Column) -> Column:
        return F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        joins = (a["held"] != "") & (a["lane"] == x["lane"]) & (a["tokens"] + x["tokens"] <= most)
        return F.struct(
            F.when(joins, a["out"]).otherwise(close(a)).alias("out"), F.when(joins, F.concat(a["held"], F.lit(" "), x["text"])).otherwise(x["text"]).alias("held"),
            F.when(joins, a["tokens"] + x["tokens"]).otherwise(x["tokens"]).alias("tokens"), x["lane"].alias("lane"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("tokens"), F.lit(-1).alias("lane"))
    return F.aggregate(F.flatten(F.transform(segments, items)), start, step, close)


def split_oversized(chunks: DataFrame, most: int) -> DataFrame:
    """``chunks`` with those of more than ``most`` tokens as parts, and ``part_label``, '' for a chunk that stays whole."""
    cut = chunks.withColumn("cut", F.when(token_count(F.col("text")) > most, pieces(F.col("text"), most)))
    parts = F.when(F.size("cut") > 1, F.col("cut")).otherwise(F.array(blank(F.col("text"))))
    rows = cut.withColumn("n_parts", F.size(parts)).select("doc_id", "path", "chunk_id", "part", "n_parts", F.posexplode(parts).alias("i", "text"))
    number, several = F.col("i") + 1, F.col("n_parts") > 1
    return rows.select(
        "doc_id", "path",
        F.when(several, F.concat("chunk_id", F.lit("::part"), number.cast("string"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(several, number).otherwise(F.col("part")).alias("part"), "text",
        F.when(several, F.format_string("(part %d/%d)", number, "n_parts")).otherwise("").alias("part_label"),
    )


GROUP = "struct<id:string,tokens:int,n:int,start:int>"


def _packed(items: Column, joins: Callable[[Column, Column], Column], name: Callable[[Column], Column]) -> Column:
    """Runs of ``items``: an item joins the run before it where ``joins`` says so, and ``name`` gives the run's new id."""

    def close(a: Column) -> Column:
        return F.when(a["held"]["n"] > 0, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        h = a["held"]
        ok = (h["n"] > 0) & joins(h, x)
        longer = F.struct(name(h["id"]).alias("id"), (h["tokens"] + x["tokens"]).alias("tokens"), (h["n"] + x["n"]).alias("n"), h["start"].alias("start"))
        return F.struct(F.when(ok, a["out"]).otherwise(close(a)).alias("out"), F.when(ok, longer).otherwise(x).cast(GROUP).alias("held"))

    none = F.struct(F.lit("").alias("id"), F.lit(0).alias("tokens"), F.lit(0).alias("n"), F.lit(0).alias("start"))
    return F.aggregate(items, F.struct(F.array().cast(f"array<{GROUP}>").alias("out"), none.cast(GROUP).alias("held")), step, close)


def merge_under_min(chunks: DataFrame, least: int, most: int) -> DataFrame:
    """(doc_id, path, chunk_id, part, n_members, token_count, text): small siblings merged in the order of their paths.

    First a run below ``least`` tokens takes the next sibling, then a run below
    ``least`` goes to the run before it; no merged run has more than ``most``.
    """
    sized = chunks.withColumn("tokens", token_count(F.col("text")))
    order = F.array_sort(F.collect_list(F.struct("path", "part", "chunk_id", "tokens", blank(F.col("text")).alias("text"))))
    kin = sized.groupBy("doc_id", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("parent"), F.size("path").alias("depth")).agg(order.alias("kin"))
    each = F.transform("kin", lambda x, i: F.struct(x["chunk_id"].alias("id"), x["tokens"].alias("tokens"), F.lit(1).alias("n"), (i + 1).alias("start")).cast(GROUP))
    fits = lambda h, x: h["tokens"] + x["tokens"] <= most
    first = _packed(each, lambda h, x: (h["tokens"] < least) & fits(h, x), lambda i: i)
    named = F.transform(first, lambda g: g.withField("id", F.when(g["n"] > 1, F.concat(g["id"], F.lit("+"), (g["n"] - 1).cast("string"))).otherwise(g["id"])).cast(GROUP))
    runs = _packed(named, lambda h, x: (x["tokens"] < least) & fits(h, x), lambda i: F.concat(i, F.lit("+1")))
    rows = kin.select("doc_id", "kin", F.explode(runs).alias("run"))
    members = F.slice("kin", F.col("run.start"), F.col("run.n"))
    texts = F.transform(F.filter(members, lambda x: x["text"].rlike(r"\S")), lambda x: x["text"])
    head = F.element_at(members, 1)
    return rows.select(
        "doc_id", head["path"].alias("path"), F.col("run.id").alias("chunk_id"), head["part"].alias("part"), F.col("run.n").alias("n_members"), F.col("run.tokens").alias("token_count"),
        F.when(F.col("run.n") > 1, F.array_join(texts, "\n\n")).otherwise(head["text"]).alias("text"),
    )


def enforce(chunks: DataFrame, least: int = 200, most: int = 1400) -> DataFrame:
    """Split, merge and split again; (doc_id, path, chunk_id, part, part_label, text, token_count), in no order."""
    merged = merge_under_min(split_oversized(chunks, most), least, most)
    return split_oversized(merged, most).withColumn("token_count", token_count(F.col("text")))
