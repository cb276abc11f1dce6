"""An index that a stream keeps up to date: batches are appended, and the newest row of a key stands.

Each batch has its own folder, ``batch=N``, which a repeated batch overwrites,
so that an index is the same however often a batch is tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def upserts(rows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer of the stream ``rows`` to ``folder``; start() begins."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, folder: str, keys: list[str], order: str, deleted: str | None = None) -> DataFrame:
    """The row of each key from its last batch, and in that batch with the largest ``order``.

    Rows whose ``keys`` are null or blank are skipped.  Where ``deleted`` holds
    for a key's last row, the key is gone.
    """
    rows = spark.read.option("basePath", folder).parquet(folder)
    for k in keys:
        rows = rows.where(F.trim(F.col(k).cast("string")) != "")
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(order))
    rows = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
