"""Sections cut into the chunks that are embedded: tree, depth, merging, limits and overlap in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import WORDS, Codec
from ..functions.text import blank, section_ref
from . import chunks, limits, trees


def logical_chunks(rows: DataFrame, least: int = 200, most: int = 1400, overlap: int = 200, codec: Codec = WORDS) -> DataFrame:
    """(doc_id, section, pos, chunk_id, prev_chunk_id, next_chunk_id, total_chunks, path, path_label, section_ref, token_count, overlap_tokens, text).

    ``rows`` are paragraphs (doc_id, section, n, node_id, text).  Each section
    is cut at its best depth, siblings below ``least`` tokens are merged, none
    keeps more than ``most``, and then each takes the last ``overlap`` tokens of
    the one before in front, which may lead beyond ``most``.  A document
    without text has no chunks.  The overlap and the counts shown are in tokens of
    ``codec``; limits and depths are in words and signs, whatever the codec.
    """
    base = chunks.base_chunks(trees.level_chunks(rows, "doc_id", "section")).withColumn("pos", F.col("seq"))
    merged = chunks.merge_small_siblings(base.select("doc_id", "path", "pos", "chunk_id", "text"), least, most)
    cut = limits.enforce(merged.select("doc_id", "path", "chunk_id", F.col("pos").alias("part"), "text"), least, most)
    section = rows.groupBy("doc_id").agg(F.min("section").alias("section"))
    order = Window.partitionBy("doc_id").orderBy(F.size("path"), "path", "part", "chunk_id")
    placed = cut.withColumn("pos", F.row_number().over(order))
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    placed = placed.withColumns({"prev_chunk_id": F.lag("chunk_id").over(by_pos), "next_chunk_id": F.lead("chunk_id").over(by_pos)})
    out = chunks.with_overlap(placed, overlap, "chunk_id", "path", "part_label", "prev_chunk_id", "next_chunk_id", "text", codec=codec).join(section, "doc_id")
    text = F.when(F.col("has_overlap"), F.concat("overlap_text", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    label = F.trim(F.concat(F.array_join("path", " > "), F.lit(" "), "part_label"))
    return out.select(
        "doc_id", "section", "pos", "chunk_id", "prev_chunk_id", "next_chunk_id", "total_chunks", "path", label.alias("path_label"),
        section_ref(F.col("section"), F.col("path")).alias("section_ref"), codec.count(text).alias("token_count"),
        "overlap_tokens", text.alias("text"),
    )


def with_sources(rows: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """``rows`` with the fields of ``sources`` (one row for each ``by``) in place of their own, where those are not blank."""
    fields = [c for c in sources.columns if c != by]
    joined = rows.join(sources.select(by, *[F.col(c).alias(f"_new_{c}") for c in fields]), by, "left")
    own = {c: blank(F.col(c)) if c in rows.columns else F.lit("") for c in fields}
    return joined.withColumns({c: F.when(F.trim(blank(F.col(f"_new_{c}"))) != "", F.col(f"_new_{c}")).otherwise(own[c]) for c in fields}).drop(*[f"_new_{c}" for c in fields])


def chunk_report(placed: DataFrame) -> DataFrame:
    """(doc_id, report): the chunks of each document for readers, in order, with sizes and neighbours."""
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    size = lambda c: F.col(c).cast("string")
    line = F.concat(
        F.lit("=== BASE CHUNK "), size("pos"), F.lit(" ===\nchunk_id: "), F.col("chunk_id"), F.lit("\npath: "), F.col("path_label"),
        F.lit("\nchars: "), F.char_length("text").cast("string"), F.lit("\n\ntokens: "), size("token_count"), F.lit("\n\noverlap_tokens: "), size("overlap_tokens"),
        F.lit("\nprev_chunk_id: "), name("prev_chunk_id"), F.lit("\nnext_chunk_id: "), name("next_chunk_id"), F.lit("\n\n"), F.trim("text"), F.lit("\n\n"),
    )
    lines = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return placed.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("report"))
