"""Keyword search: BM25 over an inverted index, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_tokens

K1, B = 1.5, 0.75
#: So many terms of questions are sent to every task; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: From a text to its terms; every search takes another in its place, an Arrow function too.
Tokenizer = Callable[[Column], Column]


def postings(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """(key, term, tf, dl): one row for each term of each document."""
    tokens = docs.select(key, tokenizer(F.col(text)).alias("tokens"))
    return tokens.select(key, F.explode("tokens").alias("term"), F.size("tokens").alias("dl")).groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """One row: the number of documents, empty ones too, and their mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.size(tokenizer(F.col(text))).cast("double")), F.lit(0.0)).alias("avgdl"))


def idf(n_docs, df):
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_stats(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """(term, df, idf) over all documents."""
    df = postings(docs, key, text, tokenizer).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(corpus_stats(docs, text, tokenizer))).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def _terms(questions: DataFrame, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    return questions.select("question_id", F.explode(tokenizer(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _few(terms: DataFrame) -> bool:
    return terms.count() <= BROADCAST_TERMS


def _wanted(terms: DataFrame, few: bool) -> DataFrame:
    wanted = terms.select("term").distinct()
    return F.broadcast(wanted) if few else wanted


def search(questions: DataFrame, docs: DataFrame, key: str, text: str, top_k: int | None = 10, min_score: float = 0.0, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """(question_id, key, score, rank) of the best documents for each question (question_id, question).

    A term that a question repeats counts each time.  Ties go to the smaller key.
    Scores below ``min_score`` are left out.  ``tokenizer`` makes terms of texts and
    questions.

    Texts are dealt by their key and meet the questions' terms there, so that
    what a document scores is summed, and each task's best are chosen, before
    anything travels again.  How many documents have a term is counted apart,
    from each text's distinct terms.
    """
    terms = _terms(questions, tokenizer)
    few = _few(terms)
    wanted = _wanted(terms, few)
    dealt = docs.select(key, F.col(text).alias("_text"))
    dealt = dealt.repartition(key) if few else dealt
    tokens = dealt.select(key, tokenizer(F.col("_text")).alias("tokens"))
    asked = tokens.select(key, F.explode("tokens").alias("term"), F.size("tokens").alias("dl")).join(wanted, "term", "left_semi")
    # Terms that nobody asks for go before anything is grouped.
    asked = asked.groupBy(key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = docs.select(F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _scored(terms, asked, df, corpus_stats(docs, text, tokenizer), key, top_k, min_score, few)


def weighed(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """``terms`` of questions with idf and avgdl; ``df`` counts documents of each term, ``stats`` is one row of the corpus."""
    weights = df.crossJoin(F.broadcast(stats))
    weights = weights.select("term", idf(F.col("n_docs"), F.col("df")).alias("idf"), F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")).alias("avgdl"))
    return terms.join(weights, "term")


def contribution(tf: Column, dl: Column) -> Column:
    """What a term of ``weighed`` gives a document of ``dl`` words that has it ``tf`` times: more for a greater ``tf``, less for a greater ``dl``."""
    return F.col("qtf") * F.col("idf") * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * dl / F.col("avgdl")), F.lit(1e-9))


def _scored(terms: DataFrame, asked: DataFrame, df: DataFrame, stats: DataFrame, key: str, top_k: int | None, min_score: float, few: bool) -> DataFrame:
    """The ranked scores of postings ``asked`` for questions' ``terms``; ``df`` counts documents of each term, ``stats`` is one row of the corpus."""
    own = weighed(terms, df, stats)
    matched = asked.join(F.broadcast(own) if few else own, "term")
    scored = matched.groupBy("question_id", key).agg(F.sum(contribution(F.col("tf"), F.col("dl"))).alias("score")).where((F.col("score") > 0) & (F.col("score") >= min_score))
    return ranked(scored, key, top_k)


def _of_postings(terms: DataFrame, found: DataFrame, stats: DataFrame, key: str, top_k: int | None, min_score: float, few: bool) -> DataFrame:
    """``_scored`` for saved postings of the terms that are asked for."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _scored(terms, found.repartition(key) if few else found, df, stats, key, top_k, min_score, few)


def ranked(scored: DataFrame, key: str, top_k: int | None = 10) -> DataFrame:
    """``scored`` with the rank in its question; filters that leave the statistics alone come before it."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 6)), F.col(key))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def save_index(docs: DataFrame, key: str, text: str, path: str, tokenizer: Tokenizer = search_tokens) -> None:
    """Writes the postings, ordered by term so that a search reads few row groups, and the length of every document."""
    postings(docs, key, text, tokenizer).repartitionByRange("term", key).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    docs.select(key, F.size(tokenizer(F.col(text))).alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")


def search_index(questions: DataFrame, path: str, key: str, top_k: int | None = 10, min_score: float = 0.0, removed: DataFrame | None = None, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """What ``search`` gives, from a saved index; the keys in ``removed`` count as never added."""
    found, lengths = (questions.sparkSession.read.parquet(f"{path}/{part}") for part in ("postings", "lengths"))
    if removed is not None:
        found, lengths = (x.join(removed.select(key), key, "left_anti") for x in (found, lengths))
    terms = _terms(questions, tokenizer)
    stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))
    few = _few(terms)
    return _of_postings(terms, found.join(_wanted(terms, few), "term", "left_semi"), stats, key, top_k, min_score, few)
