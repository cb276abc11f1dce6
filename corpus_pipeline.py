"""From documents to token ids: five stages, each a DataFrame over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm import bpe, common, decontaminate, language, minhash, repeats
from lawloom.llm.packed import key_columns

#: A document stays if its language is known with this probability at least.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no clear language, go."""
    seen = language.identify(docs.select(*COLUMNS), language.fit(docs))
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the first stays."""
    found = minhash.near_duplicates(docs)
    kept = found.where("first").select("did", "th").distinct()
    rows = docs.select(*COLUMNS).withColumns(key_columns("doc_id", "text"))
    return rows.join(kept, ["did", "th"]).dropDuplicates(["did", "th"]).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a 200-byte string covers which starts elsewhere too go; the rest of the text stays."""
    out = repeats.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    found = decontaminate.find(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("overlaps") == 0).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and whether they decode to the text."""
    path = bpe.default_vocabulary()
    encoded = bpe.encode(docs.select(*COLUMNS), bpe.build_lexicon(docs, path), path)
    out = bpe.decode(encoded, path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("benchmark_decontamination", decontaminate_documents),
    ("bpe_encoding", encode_tokens),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py compares each with a brute-force version, the library or the model's own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
    return docs
