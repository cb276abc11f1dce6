"""Chunk bundles as JSON: reading with its order of fallbacks, blocked rows, counts and errors, and writing.

A bundle is one JSON value in a file: an object with arrays ``base_chunks``,
``level_chunks`` and ``chunks``, any of which may be missing, or a list of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, is_blocked

CHUNK = "chunk_id string, section string, path array<string>, path_label string, section_ref string, text string, source_url string, authority_level string"
#: The order of the arrays.
FALLBACK = ("level_chunks", "base_chunks", "chunks")


def _chunks(spark: SparkSession, path: str, source: str, chunk: str) -> DataFrame:
    """(file, pos, the fields of ``chunk``): all chunks of the array that each bundle gives; ``pos`` orders those of one file."""
    fields = [f.strip() for f in chunk.split(",")]
    names = [f.split()[0] for f in fields]
    arrays = [f"{k} array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields)}>>" for k in FALLBACK]
    # A list at the top gives one row for each of its chunks.
    raw = spark.read.schema(", ".join([*arrays, *(f for f in fields if f.split()[0] not in FALLBACK)])).json(path, multiLine=True)
    order = FALLBACK if source == "auto" else (source, *[k for k in FALLBACK if k != source])
    listed = F.when(F.greatest(*[F.col(n).isNotNull() for n in names]), F.array(F.struct(*names)))
    taken = F.coalesce(*[F.when(F.size(k) > 0, F.col(k)) for k in order], listed)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_row"), F.posexplode(taken).alias("pos", "chunk"))
    return rows.select("file", (F.col("_row") + F.col("pos")).alias("pos"), "chunk.*")


def _usable(text: Column) -> Column:
    return (F.trim(blank(text)) != "") & ~is_blocked(text)


def bundle_counts(spark: SparkSession, path: str, source: str = "auto", chunk: str = CHUNK) -> DataFrame:
    """(file, loaded, skipped): of every file under ``path`` how many chunks can be used and how many are blocked or without text; zeros for one without chunks."""
    kept = _usable(F.col("text"))
    found = _chunks(spark, path, source, chunk).groupBy("file").agg(F.count_if(kept).alias("loaded"), F.count_if(~kept).alias("skipped"))
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    tail = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = files.withColumn("_f", tail(F.col("file"))).join(found.withColumn("_f", tail(F.col("file"))).drop("file"), "_f", "left")
    return both.select("file", F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def read_bundles(spark: SparkSession, path: str, source: str = "auto", chunk: str = CHUNK, strict: bool = False) -> DataFrame:
    """(file, pos, the fields of ``chunk``): the chunks of each bundle under ``path``; ``pos`` orders those of one file.

    ``source`` names the array to take; where it is ``auto``, missing or empty,
    the first of FALLBACK that is not empty is taken, else a list at the top.
    Blocked chunks and chunks without text go.  A file without chunks gives no
    rows, or with ``strict`` an error, as does one of which no chunk is left.
    """
    if strict:
        bare = bundle_counts(spark, path, source, chunk).where("loaded = 0").select("file").limit(5).collect()
        if bare:
            raise ValueError("no chunks in " + ", ".join(sorted(r.file for r in bare)))
    return _chunks(spark, path, source, chunk).where(_usable(F.col("text")))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; fields without a value are left out."""
    rows.write.mode("overwrite").json(path)


def write_parts(rows: DataFrame, path: str, part: str = "part") -> None:
    """A folder of Parquet for each part."""
    rows.write.mode("overwrite").partitionBy(part).parquet(path)


def manifest(rows: DataFrame, part: str = "part") -> DataFrame:
    """Per part: its chunks, sections and characters."""
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("section").alias("n_sections"), F.sum(F.char_length(blank(F.col("text")))).alias("n_chars"))
