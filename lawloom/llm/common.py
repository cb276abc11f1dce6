"""Helpers that the operators of this folder share.

Text is handled as the UTF-8 bytes of whole Arrow batches: one byte buffer and
the documents' offsets in it.  Hashes of words, windows and segments come from
prefix sums of a polynomial modulo 2**64, so each costs a few vector passes.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vector pass takes; bounds a worker's memory.
SLICE_BYTES = 1 << 19
#: Rows of one Arrow batch: whole texts can be long.
BATCH_ROWS = 1000

SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local session without one gets its own.

    On a cluster a folder of one machine would lose data, so there a missing name is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lawloom-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder: for texts and sketches, of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def kept_at(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, of which ``forget`` removes what ``written`` wrote for ``table``."""
    df.written_to = table.written_to
    return df


def forget(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote for ``tables``, which nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replaced(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new``, which is written and in whose place ``old`` stood."""
    if old is not None:
        forget(old)
    return new


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of DataFrames that are gone: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null texts count as empty."""
    return df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))


def remainder(column, divisor: int):
    """crc32 of a value's text modulo ``divisor``; a null id counts as ''."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "utf-8")) % divisor


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts sum to about ``limit`` bytes; a longer text comes alone.

    ``last`` says that a task ends with them; functions of small groups deny it.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    if last:
        release()


def release() -> None:
    """Gives a worker's unused memory back: Spark keeps workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, n + n // 8)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        have = (both[0], both[1])
        if size <= 1 << 20:
            _powers[base] = have
    return have


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int, light: bool = False) -> np.ndarray:
        """Of the windows that start at 0, 1, ...; none if the sequence is shorter.

        ``light`` spares the scrambling; the high bits are good all the same.
        """
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = (self.sums[size:] - self.sums[:n]) * self.down[:n]
        return out * np.uint64(0x9E3779B97F4A7C15) if light else mix(out)


def byte_table(word: bytes | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (all but white space, or those given), and their values."""
    inside = np.ones(256, bool) if word is None else np.zeros(256, bool)
    inside[list(SPACES if word is None else word)] = word is not None
    values = BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return inside, values


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and hash of each word; words never cross documents."""
    flags = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, flags[:-1]
        after[-1], after[:-1] = False, flags[1:]
        before &= ~first[:-1]
        after &= ~first[1:]
    start = np.flatnonzero(flags & ~before)
    end = np.flatnonzero(flags & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    hashes = Rolling(values[data]).ranges(start, end) + (end - start).astype(np.uint64)
    return start, end, doc, hashes


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]
