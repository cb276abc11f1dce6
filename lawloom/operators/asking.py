"""From questions to gated records, and from those to cited answers, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent
from ..functions.text import blank, infer_part, search_text
from ..streaming import answering
from . import answers, bm25, fusion, segments, vectors
from .lineage import cut

#: What a question's lists hold at least; keyword candidates for each record asked for.
LEAST_EXACT, LEAST_CANDIDATES, KEYWORD_FACTOR = 3, 20, 4
#: Fused candidates that are reranked for each record asked for: both lists are merged for twice as many records, and a merge keeps twice what it is asked for.
FUSED_FACTOR = 4
#: So many fused candidates are sent to every task, so that records' texts stay where they are; more are joined by a shuffle.
BROADCAST_CANDIDATES = 200_000


def in_namespace(rows: DataFrame, namespace: str, column: str = "namespace") -> DataFrame:
    """Rows of a namespace; a blank one is ``default``, in the table as in the parameter."""
    own = F.coalesce(F.nullif(F.trim(blank(F.col(column))), F.lit("")), F.lit("default"))
    return rows.where(own == (namespace.strip() or "default"))


def semantic_query(questions: DataFrame, records: DataFrame, embedded: DataFrame, top_k: int = 10, namespace: str | None = None, keywords: str | None = None) -> DataFrame:
    """The best ``top_k`` records of each question, with ``base``, ``final`` and ``rank``.

    ``questions`` has question_id, question and vector; ``records`` doc_id,
    content, node_id, part, section_ref, source_name, source_url and
    authority_level; ``embedded`` doc_id and vector.  Small talk, and questions
    whose best record stays under the gate, have no rows.

    The vector list takes records of the paragraph that a question names, else
    of its part, else all; the keyword list leaves out records of other parts.
    A question or record without a vector is searched by its words alone.  Ids
    may have any type.  With ``namespace``, only records of it are searched, and
    counted in the statistics of words.  ``keywords`` is the folder of a saved
    keyword index (``segments``), which is read in place of the records' texts;
    its statistics are those of all that it holds.
    """
    if namespace is not None:
        records = in_namespace(records, namespace)
        embedded = embedded.join(records.select("doc_id"), "doc_id", "left_semi")
    asked = questions.where(~intent.is_small_talk(F.col("question")))
    q = F.col("question")
    scoped = asked.select("question_id", "vector", intent.explicit_node_id(q).alias("node"), intent.part_hint(q).alias("part"))
    known = records.select("doc_id", blank(F.col("node_id")).alias("node"), blank(F.col("part")).alias("part"))
    candidates = max(top_k * 3, LEAST_CANDIDATES)
    near = vectors.nearest(scoped, embedded.join(known, "doc_id"), candidates, key="doc_id", scopes=("node", "part"))
    near = near.where((F.col("branch") > 0) | (F.col("rank") <= max(top_k, LEAST_EXACT)))

    part = infer_part(F.col("part"), F.col("section_ref"), F.col("node_id"), F.col("source_url"))
    full = records.withColumn("part", part)
    words = search_text(F.col("section_ref"), F.col("node_id"), F.col("source_name"), F.col("part"), F.col("content"))
    if keywords is None:
        found = bm25.search(asked, records.select("doc_id", words.alias("words")), "doc_id", "words", None).drop("rank")
    else:
        found = segments.search(asked, keywords, "doc_id", None, within=records.select("doc_id")).drop("rank")
    hinted = asked.select("question_id", intent.part_hint(q).alias("hint"))
    in_part = found.join(full.select("doc_id", "part").hint("shuffle_hash"), "doc_id").join(hinted, "question_id").where("hint = '' or part = '' or part = hint")
    keyword = bm25.ranked(in_part, "doc_id", max(top_k * KEYWORD_FACTOR, LEAST_CANDIDATES))

    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("rrf", 8)), "doc_id")
    fused = fusion.fuse(keyword, near, key="doc_id").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top_k * FUSED_FACTOR).drop("_k")
    # A few rows for each question; without their lineage, nobody after this computes the searches again.
    fused = cut(fused)
    fused = F.broadcast(fused) if fused.count() <= BROADCAST_CANDIDATES else fused
    matches = fused.join(full, "doc_id").join(asked.select("question_id", "question"), "question_id")
    return fusion.gate(fusion.rerank(matches, top_k))


def scoped(matches: DataFrame) -> DataFrame:
    """``matches`` of the part that a question names, where it has any of them, ranked anew without gaps."""
    kept = fusion.part_scope(matches)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def answer(questions: DataFrame, matches: DataFrame, complete: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, answer, out_of_scope, by_model): one row for each question.

    ``matches`` is what ``semantic_query`` gives, with source_name and
    source_type.  ``complete`` takes (question_id, question, context) of the
    questions in scope and gives (question_id, answer).  Sources that it names
    by number are replaced by their citations, and citations are added where it
    has none.  Without it, or where its answer is null, the answer lists the
    first citations; a question without a match gets the unknown answer.
    """
    matches = cut(matches)
    cited = answers.citations(matches)
    listed = answers.retrieval_answers(questions, cited).withColumnRenamed("answer", "listed")
    out = listed.join(matches.select("question_id").distinct().withColumn("_in", F.lit(True)), "question_id", "left")
    if complete is None:
        return out.select("question_id", F.col("listed").alias("answer"), F.col("_in").isNull().alias("out_of_scope"), F.lit(False).alias("by_model"))
    asked = questions.select("question_id", "question").join(answers.contexts(matches), "question_id")
    said = complete(asked).select("question_id", F.col("answer").alias("said"))
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"])
    sources = cited.groupBy("question_id").agg(by_rank.alias("cited")).join(answers.footers(cited), "question_id")
    ready = said.join(sources, "question_id").where("said is not null")
    ready = ready.select("question_id", answers.with_footer(answers.fill_placeholders(F.col("said"), F.col("cited")), F.col("footer")).alias("ready"))
    out = out.join(ready, "question_id", "left")
    return out.select("question_id", F.coalesce("ready", "listed").alias("answer"), F.col("_in").isNull().alias("out_of_scope"), F.col("ready").isNotNull().alias("by_model"))


def answer_over_time(requests: DataFrame, matches: DataFrame, complete: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(question_id, answer, outcome, retry_after, by_model) of requests (question_id, question, asked_at, and scope, forced if there are such columns).

    ``outcome`` is called, hit or skipped as ``streaming.answering`` has it, or
    out_of_scope for a request without a match, which neither the cache nor the
    cooldown sees.  A hit has the words of the call that it goes back to, with
    its own matches' citations where those have none; a skipped request, and one
    whose call gives null, lists its first citations.

    Which calls there are depends on which of them fail, so calls are made in
    turns: of a turn's calls those not made yet are, and those that fail are known
    as such in the next.
    """
    has = lambda c: c if c in requests.columns else None
    within = requests.join(matches.select("question_id").distinct(), "question_id", "left_semi")
    said = cut(requests.sparkSession.createDataFrame([], "question_id long, said string"))
    while True:
        failed = said.where("said is null").select("question_id", F.lit(True).alias("_fails"))
        judged = cut(answering.decide(within.join(failed, "question_id", "left"), "question_id", "asked_at", "question", has("scope"), has("forced"), "_fails"))
        due = cut(judged.where(F.col("outcome") == answering.CALLED).select("question_id").join(said, "question_id", "left_anti"))
        if due.isEmpty():
            break
        asked = requests.join(due, "question_id", "left_semi").select("question_id", "question").join(answers.contexts(matches), "question_id")
        new = due.join(complete(asked).select("question_id", F.col("answer").alias("said")), "question_id", "left")
        said = cut(said.unionByName(new))
    spoken = judged.join(said.withColumnRenamed("question_id", "source"), "source")
    spoken = spoken.select("question_id", F.col("said").alias("answer"))
    out = answer(requests, matches, lambda asked: asked.select("question_id").join(spoken, "question_id"))
    outcome = F.when(F.col("out_of_scope"), "out_of_scope").otherwise(F.col("outcome"))
    return out.join(judged, "question_id", "left").select("question_id", "answer", outcome.alias("outcome"), "retry_after", "by_model")
