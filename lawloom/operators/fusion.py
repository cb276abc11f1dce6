"""Reciprocal rank fusion, rule-based reranking and the relevance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.text import blank, infer_part, rank_tokens

RRF_K, GATE = 60, 0.23
#: What the authority of a source adds to a score.
AUTHORITY = (("statute", 0.06), ("regulation", 0.05), ("sub_regulatory", 0.02), ("high", 0.05), ("medium", 0.03), ("low", 0.01))


def fuse(*ranked: DataFrame, key: str) -> DataFrame:
    """(question_id, key, rrf, base): reciprocal ranks summed over the lists, and divided by each question's best."""
    rows = ranked[0].select("question_id", key, "rank")
    for more in ranked[1:]:
        rows = rows.unionByName(more.select("question_id", key, "rank"))
    summed = rows.groupBy("question_id", key).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("rrf"))
    return summed.withColumn("base", F.col("rrf") / F.max("rrf").over(Window.partitionBy("question_id")))


def overlap(question: Column, text: Column) -> Column:
    """Share of the question's tokens that a text has."""
    asked = rank_tokens(question)
    return F.size(F.array_intersect(asked, rank_tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def final_score(question: Column, ref: Column, content: Column, url: Column, authority: Column, base: Column) -> Column:
    """The score without what a paragraph, part or citation in the question adds."""
    whole = F.concat_ws(" ", blank(ref), blank(content))
    early = F.concat_ws(" ", blank(ref), F.substring(blank(content), 1, 500))
    known = F.lit(0.0)
    for name, value in AUTHORITY:
        known = F.when(F.lower(F.trim(blank(authority))) == name, F.lit(value)).otherwise(known)
    meta = F.when(blank(url) != "", F.lit(0.02)).otherwise(0.0) + known
    long = F.when(F.char_length(blank(content)) > 2600, F.least((F.char_length(blank(content)) - 2600) / 10000, F.lit(0.08))).otherwise(0.0)
    return F.lit(0.70) * base + F.lit(0.25) * overlap(question, whole) + F.lit(0.05) * overlap(question, early) + meta - long


def asked_score(question: Column, ref: Column, content: Column, node: Column, part: Column) -> Column:
    """What a paragraph, part or citation in the question adds to a record's score; 0 if it names none."""
    cited, asked, hint = intent.citation_ref(question), F.lower(intent.explicit_node_id(question)), intent.part_hint(question)
    low_ref, low_text, low_node = F.lower(blank(ref)), F.lower(blank(content)), F.lower(blank(node))
    tight = F.replace(F.concat(low_text, low_ref), F.lit(" "), F.lit(""))
    named = F.contains(low_text, cited) | F.contains(low_ref, cited)
    citation = F.when(cited == "", 0.0).when(named, 0.07).when(F.contains(tight, F.replace(cited, F.lit(" "), F.lit(""))), 0.05).otherwise(0.0)
    explicit = F.when(low_node == asked, 0.35).when(F.contains(low_text, asked) | F.contains(low_ref, asked), 0.10).otherwise(0.0)
    explicit = explicit - F.when(F.contains(low_ref, F.lit("merged")), 0.05).otherwise(0.0)
    in_part = F.when(hint == "", 0.0).when(blank(part) == hint, 0.22).otherwise(-0.08)
    return citation + F.when(asked == "", 0.0).otherwise(explicit) + in_part


def rerank(matches: DataFrame, top_k: int = 10) -> DataFrame:
    """The best ``top_k`` of each question by ``final``, rounded to six places; ties go to the smaller doc_id.

    ``matches`` has question, base, section_ref, content, node_id, source_url,
    authority_level and part; a blank part is inferred from the others.
    """
    q, ref, content, node, url, authority, part = (F.col(c) for c in ("question", "section_ref", "content", "node_id", "source_url", "authority_level", "part"))
    score = final_score(q, ref, content, url, authority, F.col("base")) + asked_score(q, ref, content, node, infer_part(part, ref, node, url))
    order = Window.partitionBy("question_id").orderBy(F.desc("final"), "doc_id")
    return matches.withColumn("final", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def part_scope(ranked: DataFrame, question: str = "question", part: str = "part") -> DataFrame:
    """Only records of the part that a question names, if it has any of them; else all of its records."""
    fits = (intent.part_hint(F.col(question)) != "") & (blank(F.col(part)) == intent.part_hint(F.col(question)))
    some = F.max(fits.cast("int")).over(Window.partitionBy("question_id"))
    return ranked.withColumns({"_fits": fits, "_some": some}).where("_fits or _some = 0").drop("_fits", "_some")


def gate(ranked: DataFrame, final: str = "final") -> DataFrame:
    """All rows of a question whose best final score reaches GATE, none of the others."""
    best = F.max(final).over(Window.partitionBy("question_id"))
    return ranked.withColumn("best", best).where(F.col("best") >= GATE).drop("best")
