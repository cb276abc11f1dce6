"""An index on disk: checked records with their vectors, and the postings of keyword search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, is_blocked, search_text
from . import segments

WORDS = ("section_ref", "node_id", "source_name", "part", "content")
COUNTS = "loaded long, rejected long, kept_before long, dimension int"


def _last_written(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row for each key, whole: the last by ``order`` (of equal ones the greatest); without it ``_unclear`` says that a key has different rows."""
    columns = [c for c in rows.columns if c != key]
    row = F.struct(*columns)
    best = F.max(F.struct(F.col(order).alias("o"), row.alias("r")))["r"] if order else F.max(row)
    unclear = F.lit(False) if order else F.max(row) != F.min(row)
    return rows.groupBy(key).agg(best.alias("_r"), unclear.alias("_unclear")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns], "_unclear")


def ingest(records: DataFrame, embedded: DataFrame, path: str, previous: str | None = None, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """Writes ``records`` and ``embedded`` (key, vector) as a new index under ``path``; one row of counts.

    Records without content or with the marks of a blocked page are rejected and
    counted.  Every other record needs a vector, and all vectors, those of
    ``previous`` too, one dimension: an error otherwise.  Keys of ``previous``,
    another index, stay unless new records, not rejected, have them.

    Of repeated keys the last write stands, by the column ``order`` of
    ``records``; where ``embedded`` has it too, a record goes with the vector of
    its own write.  Without ``order``, rows that repeat a key must be equal.  The
    counts are taken while the one table is written; they are removed first and
    written last, so that an index without them isn't whole, whatever stopped it.
    """
    spark = records.sparkSession
    segments.delete(spark, f"{path}/counts")
    read, checked, kept = Observation(), Observation(), Observation()
    rejected = (F.trim(blank(F.col("content"))) == "") | is_blocked(F.col("content"))
    marked = records.withColumn("_rejected", rejected).observe(read, F.count_if("_rejected").alias("rejected"))
    paired = [key, order] if order and order in embedded.columns else [key]
    own = embedded.where(F.col("vector").isNotNull()).groupBy(*paired).agg(F.max("vector").alias("vector"), (F.max("vector") != F.min("vector")).alias("_two"))
    whole = marked.where("not _rejected").drop("_rejected").join(own, paired, "left")
    good = _last_written(whole, key, order)
    size = F.size("vector")
    good = good.observe(
        checked, F.count(F.lit(1)).alias("loaded"), F.count_if(F.col("vector").isNull()).alias("bare"),
        F.count_if(F.col("_unclear") | F.coalesce("_two", F.lit(False))).alias("unclear"), F.min(size).alias("least"), F.max(size).alias("most"),
    ).drop("_unclear", "_two")
    if previous:
        spark.read.parquet(f"{previous}/counts")
        old = spark.read.parquet(f"{previous}/records").join(good.select(key), key, "left_anti")
        good = good.unionByName(old.observe(kept, F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most")), allowMissingColumns=True)
    good.write.mode("overwrite").parquet(f"{path}/records")
    found, before = checked.get, kept.get if previous else {"n": 0, "least": None, "most": None}
    if found["unclear"]:
        raise ValueError(f"{found['unclear']} keys have different rows, and no order says which is the last")
    if found["bare"]:
        raise ValueError(f"{found['bare']} records have no vector")
    sizes = {x for x in (found["least"], found["most"], before["least"], before["most"]) if x is not None}
    if len(sizes) > 1:
        raise ValueError(f"vectors of {min(sizes)} to {max(sizes)} dimensions")
    written = spark.read.parquet(f"{path}/records")
    words = search_text(*[F.col(c) if c in written.columns else F.lit("") for c in WORDS])
    segments.delete(spark, f"{path}/keywords")
    segments.add(written.select(key, words.alias("words")), f"{path}/keywords", key, "words")
    counts = spark.createDataFrame([(found["loaded"], read.get["rejected"], before["n"], max(sizes, default=0))], COUNTS)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return spark.read.parquet(f"{path}/counts")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, vectors) of an index; an error if it isn't whole."""
    spark.read.parquet(f"{path}/counts")
    rows = spark.read.parquet(f"{path}/records")
    key = rows.columns[0]
    return rows.drop("vector"), rows.select(key, "vector")
