"""Positions and hashes on their way through a shuffle.

Millions of small records travel as one binary row for each slice and bucket.
Numbers are stored as byte planes, so that the shuffle's compression removes
their leading zeros.  The number of buckets follows the size of the texts; a
bucket therefore stays small however many documents there are.
"""

from __future__ import annotations

import io
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Characters of text for each bucket.
BUCKET_CHARS = 20_000_000
LAST_ID = (1 << 63) - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, smallest bytes first; planes of zeros at the end are left out.  Arrays of bytes stay bytes."""
    out = io.BytesIO()
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype == np.uint8:
            out.write(np.array([len(a), 0], "<u4").tobytes() + a.tobytes())
            continue
        width = 1 if not len(a) else max(1, (int(a.max()).bit_length() + 7) // 8)
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out.write(np.array([len(a), width], "<u4").tobytes())
        out.write(planes.T.tobytes())
    return out.getvalue()


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``, as unsigned 64-bit numbers, or as bytes."""
    out, at = [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<u4", 2, at).tolist()
        if not width:
            out.append(np.frombuffer(data, np.uint8, n, at + 8))
            at += 8 + n
            continue
        planes = np.frombuffer(data, np.uint8, n * width, at + 8).reshape(width, n)
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = planes.T
        out.append(a.view("<u8").ravel())
        at += 8 + n * width
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(a.astype(np.int64), prepend=0)


def key_columns(id_column: str, text: str) -> dict:
    """did and th, which identify a document: a null id counts as the largest; ``th`` tells texts of one id apart."""
    return {
        "did": F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)),
        "th": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))),
    }


def keyed(docs: DataFrame, id_column: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(did, th, text), and the columns of ``carry`` in a struct ``rest`` if there are any."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rest = [F.struct(*carry).alias("rest")] if carry else []
    return docs.select(*[c.alias(k) for k, c in key_columns(id_column, text).items()], body, *rest)


def bucket_bits(docs: DataFrame, text: str = "text") -> int:
    """Bits of a hash that number the buckets, by the size of all texts."""
    total = docs.agg(F.sum(F.length(text)).alias("n")).first().n or 0
    return max(4, int(np.ceil(np.log2(max(1, total / BUCKET_CHARS)))))


#: What was found, packed by buckets of documents: few rows, however many documents a task has.
FOUND = "shelf int, data binary"


def shelves(bits: int, did: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The bucket of each document."""
    return (mix(did.astype(np.uint64) ^ mix(th.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def found_rows(bits: int, did: np.ndarray, th: np.ndarray, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Packed rows of entries by their documents' shelves; ``doc`` indexes ``did`` and ``th``."""
    if not len(doc):
        return []
    shelf = shelves(bits, did, th)[doc]
    order = np.lexsort((doc, shelf))
    shelf = shelf[order]
    edges = np.concatenate(([0], np.flatnonzero(shelf[1:] != shelf[:-1]) + 1, [len(doc)]))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[a:b]
        docs, place = np.unique(doc[at], return_inverse=True)
        out.append((int(shelf[a]), pack(did[docs].astype(np.uint64), th[docs].astype(np.uint64), steps(place), *(c[at] for c in columns))))
    return out


def found_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shelf": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


#: Entries on their way to a bucket, and results that only pass through it (``found``).
ENTRIES = "bucket int, shelf int, found boolean, data binary"


def entry_rows(bits: int, found: list[tuple[int, bytes]], sent: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n, m = len(found), len(sent)
    rows = [*found, *sent]
    return pa.record_batch({
        "bucket": pa.array([r[0] for r in rows], pa.int32()),
        "shelf": pa.array([r[0] for r in found] + [0] * m, pa.int32()),
        "found": pa.array([True] * n + [False] * m, pa.bool_()),
        "data": pa.array([r[1] for r in rows], pa.binary()),
    })


def entries(table: pa.Table) -> list[list[np.ndarray]]:
    """The packed entries of a bucket."""
    return [unpack(x.as_py()) for x in table.filter(pa.compute.invert(table["found"]))["data"]]


def passed(table: pa.Table, rows: list[tuple[int, bytes]]) -> pa.Table:
    """Results that were on their way, and those of this bucket."""
    out = found_table(rows)
    return pa.concat_tables([out, table.filter(table["found"]).select(["shelf", "data"]).cast(out.schema)])


def _merge(table: pa.Table) -> pa.Table:
    """All that was found for the documents of a shelf, one row for each document."""
    by: dict[int, list[list[np.ndarray]]] = {}
    for x in table["data"]:
        p = unpack(x.as_py())
        by.setdefault(len(p), []).append(p)
    out: dict[tuple[int, int], list[bytes]] = {}
    for parts in by.values():
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        did, th = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
        doc = np.concatenate([np.cumsum(p[2].astype(np.int64)) + s for p, s in zip(parts, shift[:-1], strict=True)])
        columns = [np.concatenate([p[k] for p in parts]) for k in range(3, len(parts[0]))]
        order = np.lexsort((th[doc], did[doc]))
        d, t = did[doc][order], th[doc][order]
        edges = np.concatenate(([0], np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1, [len(d)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out.setdefault((int(d[a]), int(t[a])), []).append(pack(*(c[order[a:b]] for c in columns)))
    keys = [*out]
    return pa.table({"did": pa.array([k[0] for k in keys], pa.int64()), "th": pa.array([k[1] for k in keys], pa.int64()), "parts": pa.array([*out.values()], pa.list_(pa.binary()))})


def by_document(rows: DataFrame) -> DataFrame:
    """(did, th, parts): what was found for each document, of a size that its own text bounds."""
    return rows.groupBy("shelf").applyInArrow(_merge, "did long, th long, parts array<binary>")


def groups(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys by number, in order of appearance, and how many there are."""
    codes, uniques = pd.factorize(keys)
    return codes, len(uniques)
