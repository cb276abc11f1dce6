"""Chunks of sections: paragraph paths, level chunks, depth statistics and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import WORDS, Codec
from ..functions.text import OUTER_WHITE, blank, clean_text, word_tokens

#: Fixed value: the labels before a paragraph's text.
MARKERS = r"^((?:\([^)]+\)\s*)+)"


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, path, text): the lines of a document, two labels deep: a to z for each five of them, then a1 to z1 and so on, so that no two lines share a path."""
    lines = docs.select("doc_id", F.posexplode(F.split(blank(F.col("text")), "\n")).alias("pos", "text"))
    block = F.floor(F.col("pos") / 5).cast("int")
    label = F.concat(F.char(F.lit(97) + block % 26), F.when(block >= 26, F.floor(block / 26).cast("string")).otherwise(""))
    return lines.select("doc_id", "pos", F.array(label, (F.col("pos") % 5 + 1).cast("string")).alias("path"), "text")


def level_chunks(rows: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, depth, n_members, text, path_label, parent_path): each path and its ancestors with the text below them, in order."""
    up = rows.where(F.col("text") != "").select("doc_id", "pos", "text", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path"))
    grouped = up.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return grouped.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join("path", "/")).alias("chunk_id"), F.size("path").alias("depth"), "n_members", "text", F.array_join("path", " > ").alias("path_label"), F.slice("path", F.lit(1), F.size("path") - 1).alias("parent_path"))


def depth_score(median: Column, n: Column) -> Column:
    """How far the median size at a depth is from the best one, with penalties for small, large and single chunks; lower is better."""
    return F.abs(median - 800) + F.when(median < 200, 500).otherwise(0) + F.when(median > 1500, 700).otherwise(0) + F.when(n == 1, 100).otherwise(0)


def depth_stats(chunks: DataFrame) -> DataFrame:
    """Per document and depth: chunks, mean, median and the score of the depth (lower is better)."""
    sized = chunks.select("doc_id", "depth", F.size(word_tokens(F.col("text"))).alias("tokens")).where("tokens > 0")
    stats = sized.groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.median("tokens").alias("median"), F.avg("tokens").alias("mean"))
    return stats.withColumn("score", depth_score(F.col("median"), F.col("n")))


def best_depth(stats: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("score", "depth")
    return stats.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def with_overlap(rows: DataFrame, n: int = 20, *keep: str, codec: Codec = WORDS) -> DataFrame:
    """Each chunk with its neighbours' positions, its place, the last ``n`` tokens of the one before, and the columns ``keep``.

    Tokens are those of ``codec``; what they give as text has no outer white space.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    # Of each chunk only the tail goes to its neighbour.
    tokens = rows.withColumn("_tokens", codec.encode(F.col("text")))
    tail = F.slice("_tokens", F.greatest(F.size("_tokens") - n, F.lit(0)) + 1, n)
    placed = tokens.withColumn("_tail", tail).select(
        "doc_id", "pos",
        F.lag("pos").over(w).alias("prev_pos"), F.lead("pos").over(w).alias("next_pos"),
        F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("total_chunks"), F.lag("_tail").over(w).alias("_before"), *keep,
    )
    before = F.coalesce("_before", F.array().cast(placed.schema["_before"].dataType))
    shown = F.regexp_replace(codec.decode(before), OUTER_WHITE, "")
    return placed.withColumn("overlap_text", shown).select("doc_id", "pos", "prev_pos", "next_pos", "total_chunks", "overlap_text", F.size(before).alias("overlap_tokens"), (F.col("overlap_text") != "").alias("has_overlap"), *keep)


def merge_small_siblings(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(doc_id, path, pos, chunk_id, path_label, n_members, member_ids, token_count, text): siblings below ``least`` tokens on average, packed in order.

    A buffer below ``least`` takes the next sibling while both have at most
    ``most`` tokens.  Parents whose children are large enough keep them.  What
    is folded is the children of one parent of one document.  Without a
    ``chunk_id`` of their own, ``rows`` are named by document, path and place.
    The label of several siblings says how many were merged.
    """
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join("path", "/"), F.col("pos").cast("string"))
    sized = rows.withColumns({"tokens": F.size(word_tokens(F.col("text"))), "chunk_id": F.col("chunk_id") if "chunk_id" in rows.columns else name})
    parent = F.slice("path", F.lit(1), F.size("path") - 1).alias("parent")
    kin = sized.groupBy("doc_id", parent).agg(F.array_sort(F.collect_list(F.struct("path", "pos", "chunk_id", "tokens", "text"))).alias("kin"), F.avg("tokens").alias("mean"))

    def step(a, x):
        joins = (a["n"] > 0) & (F.col("mean") < least) & (a["held"] < least) & (a["held"] + x["tokens"] <= most)
        n = F.when(joins, a["n"]).otherwise(a["n"] + 1)
        return F.struct(n.alias("n"), F.when(joins, a["held"] + x["tokens"]).otherwise(x["tokens"]).alias("held"), F.concat(a["out"], F.array(n)).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))
    number = F.aggregate("kin", start, step, lambda a: a["out"])
    each = kin.select("doc_id", "parent", F.inline(F.arrays_zip("kin", number.alias("number"))))
    packed = each.groupBy("doc_id", "parent", "number").agg(F.array_sort(F.collect_list("kin")).alias("kin"))
    first, n = F.col("kin")[0], F.size("kin")
    texts = F.transform(F.filter("kin", lambda x: x["text"].rlike(r"\S")), lambda x: x["text"])
    total = F.aggregate("kin", F.lit(0), lambda a, x: a + x["tokens"])
    name = F.when(n > 1, F.concat(first["chunk_id"], F.lit("+"), (n - 1).cast("string"))).otherwise(first["chunk_id"])
    label = F.concat(F.array_join(first["path"], " > "), F.when(n > 1, F.concat(F.lit(" (merged "), n.cast("string"), F.lit(" siblings)"))).otherwise(""))
    return packed.select(
        "doc_id", first["path"].alias("path"), first["pos"].alias("pos"), name.alias("chunk_id"), label.alias("path_label"), n.alias("n_members"),
        F.transform("kin", lambda x: x["chunk_id"]).alias("member_ids"), total.alias("token_count"), F.array_join(texts, "\n\n").alias("text"),
    )


def base_chunks(chunks: DataFrame) -> DataFrame:
    """Of each document the chunks at its best depth; where no chunk has tokens, those at its deepest."""
    # Windows in place of joins: the chunks of a document are read once.
    level = Window.partitionBy("doc_id", "depth")
    tokens = F.when(F.size(word_tokens(F.col("text"))) > 0, F.size(word_tokens(F.col("text"))))
    scored = chunks.withColumn("_tokens", tokens).withColumns({"_median": F.median("_tokens").over(level), "_n": F.count("_tokens").over(level)})
    # A depth without tokens has no score, and comes after all others, the deepest first.
    rank = F.struct(F.coalesce(depth_score(F.col("_median"), F.col("_n")), F.lit(float("inf"))).alias("score"), F.when(F.col("_n") > 0, F.col("depth")).otherwise(-F.col("depth")).alias("depth"))
    best = F.abs(F.min(rank).over(Window.partitionBy("doc_id"))["depth"])
    return scored.withColumn("_best", best).where("depth = _best").drop("_tokens", "_median", "_n", "_best")


def paragraph_ids(rows: DataFrame, by: str, section: str, pos: str, text: str) -> DataFrame:
    """``rows`` with cleaned ``text`` and a ``node_id``; paragraphs of no text go.

    Labels before a text, as in ``(a)(1) ...``, stand in its id.  The first
    paragraph without labels has the section's own id, later ones their
    ``pos``, which counts all paragraphs of a ``by`` from 1.
    """
    cleaned = rows.withColumn(text, clean_text(F.col(text))).where(F.col(text) != "")
    own, labels = F.concat(F.lit("p-"), section), F.regexp_replace(F.regexp_extract(text, MARKERS, 1), r"\)\s+", ")")
    lead = F.min(F.when(labels == "", F.col(pos))).over(Window.partitionBy(by))
    later = F.concat(own, F.lit("(p"), F.col(pos).cast("string"), F.lit(")"))
    return cleaned.withColumn("node_id", F.when(labels != "", F.concat(own, labels)).when(F.col(pos) == lead, own).otherwise(later))


def readable(rows: DataFrame, by: str, heading: str, pos: str, text: str) -> DataFrame:
    """(by, body): heading, then each paragraph under its id, with blank lines between; what is gathered is one section."""
    line = F.concat(F.when(blank(F.col("node_id")) != "", F.concat(F.lit("["), F.col("node_id"), F.lit("]\n"))).otherwise(""), blank(F.col(text)), F.lit("\n\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), line.alias("line"))))
    out = rows.groupBy(by, heading).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("_lines"))
    head = F.when(blank(F.col(heading)) != "", F.concat(F.col(heading), F.lit("\n\n"))).otherwise("")
    return out.select(by, F.concat(head, "_lines").alias("body"))


def base_summary(chunks: DataFrame, by: str, tokens: str = "token_count") -> DataFrame:
    """Chunks of each ``by``, and the least, most and mean (cut to a whole number) of the token counts above 0; 0 without any."""
    some = F.when(F.col(tokens) > 0, F.col(tokens))
    out = [F.count(F.lit(1)).alias("n"), F.min(some).alias("min_tokens"), F.max(some).alias("max_tokens"), F.floor(F.sum(some) / F.count(some)).alias("mean_tokens")]
    return chunks.groupBy(by).agg(*out).fillna(0, ["min_tokens", "max_tokens", "mean_tokens"])


def target_section(paragraphs: DataFrame, by: str, section: str = "section", pos: str = "pos") -> DataFrame:
    """The section that most paragraphs of each ``by`` name; among equal ones the first seen.  Null sections don't count."""
    counted = paragraphs.where(F.col(section).isNotNull()).groupBy(by, section).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return counted.withColumn("_k", best).where("_k = 1").select(by, section, "n")


def rollup(chunks: DataFrame, section: str, depth: str, text: str) -> DataFrame:
    """(section, depth, level, n, chars, tokens, min_tokens, max_tokens): sums for each section and depth (level 0), each section (1) and all (3).

    Null sections are a section of their own; ``level`` tells them from the sums over all.
    """
    sized = chunks.select(F.col(section).alias("section"), F.col(depth).alias("depth"), F.char_length(blank(F.col(text))).alias("chars"), F.size(word_tokens(F.col(text))).alias("tokens"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens")]
    return sized.rollup("section", "depth").agg(F.grouping_id().alias("level"), *sums)
