"""Substring dedup by fixed-block anchors, over words.

The reference blocks of a document are its non-overlapping runs of BLOCK words;
every window of SPAN = 2 * BLOCK - 1 words contains one of them whole.  All
rolling windows of BLOCK words of all documents probe the blocks; a hit in
another document makes its place a candidate.  Candidates are then extended: the
SPAN-word windows around them are compared, and consecutive equal ones make the
maximal exact repeat.  A window counts as a repeat if a document with a smaller
id has it too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packed import ENTRIES, FOUND, LAST_ID, bucket_bits, by_document, entries, entry_rows, found_rows, groups, keyed, pack, passed, steps, unpack

BLOCK = 7
SPAN = 2 * BLOCK - 1


class _Words:
    """The words of a slice: their documents, places in them, and window hashes."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, self.offsets = common.utf8(batch.column("text"))
        _, _, self.doc, hashes = common.words(self.data, self.offsets, *common.byte_table())
        self.roll = common.Rolling(hashes, common.BASES[1])
        self.first = np.searchsorted(self.doc, np.arange(batch.num_rows))
        self.place = np.arange(len(self.doc)) - self.first[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        self.did, self.th = (batch.column(k).to_numpy().astype(np.int64) for k in ("did", "th"))

    def windows(self, size: int) -> np.ndarray:
        """Where a window of ``size`` words starts."""
        n = len(self.doc) - size + 1
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _places(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ascending places as differences; a document's first stands as it is."""
    out = place.copy()
    same = doc[1:] == doc[:-1]
    out[1:][same] -= place[:-1][same]
    return out


def _unfold(doc: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places that ``_places`` wrote."""
    sums = np.cumsum(places)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    base = sums[first] - places[first]
    return sums - np.repeat(base, np.diff(np.append(first, len(doc))))


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of a slice without repeated ones, which get the same result."""
    keys = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in ("did", "th")])
    return batch.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))


def _split(bits: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Entries by the high bits of their hashes; each bucket's in their order."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def _probe(bits: int):
    """All rolling windows of BLOCK words to their buckets; those that start a reference block are marked by their place.

    A hash that a slice has in two documents, once as a block, makes candidates
    on the spot, and the bucket gets it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=2 * common.SLICE_BYTES):
            w = _Words(_once(batch))
            at = w.windows(BLOCK)
            if not len(at):
                continue
            h = w.roll.ranges(at, at + BLOCK)
            code, n = groups(h)
            did = w.did[w.doc[at]]
            low, high = np.full(n, LAST_ID), np.full(n, -LAST_ID)
            twice = (np.bincount(code, minlength=n) > 1)[code]
            np.minimum.at(low, code[twice], did[twice])
            np.maximum.at(high, code[twice], did[twice])
            block = np.zeros(n, bool)
            block[code[w.place[at] % BLOCK == 0]] = True
            settled = ((low < high) & block)[code]
            first = np.zeros(n, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            send = ~settled
            send[first[code[settled]]] = True
            send = np.flatnonzero(send)
            sent = []
            for b, order in _split(bits, h[send]):
                k = send[order]
                docs, place = np.unique(w.doc[at[k]], return_inverse=True)
                # The low half of the hash tells windows of a bucket apart well enough for candidates.
                small = h[k] & np.uint64(0xFFFFFFFF)
                sent.append((b, pack(w.did[docs].astype(np.uint64), w.th[docs].astype(np.uint64), steps(place), _places(place, w.place[at[k]]), small, settled[k].astype(np.int64))))
            found = found_rows(bits, w.did, w.th, w.doc[at[settled]], w.place[at[settled]])
            yield entry_rows(bits, found, sent)

    return run


def _meet(table: pa.Table, bits: int) -> pa.Table:
    """One bucket: windows of BLOCK words that another document has too, one of them as a block."""
    out = []
    parts = entries(table)
    if parts:
        did, th, doc, place = _documents(parts)
        h = np.concatenate([p[4] for p in parts]).astype(np.uint32)
        settled = np.concatenate([p[5] for p in parts]) > 0
        del parts
        code, n = groups(h)
        del h
        low, high = np.full(n, LAST_ID), np.full(n, -LAST_ID)
        more = (np.bincount(code, minlength=n) > 1)[code]
        np.minimum.at(low, code[more], did[doc[more]])
        np.maximum.at(high, code[more], did[doc[more]])
        block, several = np.zeros(n, bool), low < high
        block[code[settled | (place % BLOCK == 0)]] = True
        several[code[settled]] = True
        hit = (several & block)[code] & ~settled
        out = found_rows(bits, did, th, doc[hit], place[hit])
    return passed(table, out)


def _documents(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """did and th of the documents; each entry's document and place in it."""
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    did, th = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
    doc = np.concatenate([np.cumsum(p[2].astype(np.int64)) + s for p, s in zip(parts, shift[:-1], strict=True)])
    place = np.concatenate([_unfold(np.cumsum(p[2].astype(np.int64)), p[3].astype(np.int64)) for p in parts])
    return did, th, doc, place


def _marks(batch: pa.RecordBatch, w: _Words) -> np.ndarray:
    """Words of the slice that the places in ``parts`` name."""
    out = np.zeros(len(w.doc) + 1, bool)
    for i, parts in enumerate(batch.column("parts")):
        for part in parts.values or ():
            out[unpack(part.as_py())[0].astype(np.int64) + w.first[i]] = True
    return out[:-1]


def _extend(bits: int):
    """SPAN-word windows around candidates to their buckets; where a slice has a smaller document with it, it is a repeat already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=2 * common.SLICE_BYTES):
            batch = _once(batch)
            w = _Words(batch)
            at = w.windows(SPAN)
            sums = np.concatenate(([0], np.cumsum(_marks(batch, w))))
            at = at[sums[at + BLOCK] > sums[at]]  # a candidate starts at one of the first BLOCK words
            if not len(at):
                continue
            h = w.roll.ranges(at, at + SPAN)
            code, n = groups(h)
            did = w.did[w.doc[at]]
            low = np.full(n, LAST_ID)
            np.minimum.at(low, code, did)
            repeat = did > low[code]
            found = found_rows(bits, w.did, w.th, w.doc[at[repeat]], w.place[at[repeat]])
            send = np.flatnonzero(~repeat)
            sent = []
            for b, order in _split(bits, h[send]):
                k = send[order]
                docs, place = np.unique(w.doc[at[k]], return_inverse=True)
                sent.append((b, pack(w.did[docs].astype(np.uint64), w.th[docs].astype(np.uint64), steps(place), _places(place, w.place[at[k]]), h[k])))
            yield entry_rows(bits, found, sent)

    return run


def _confirm(table: pa.Table, bits: int) -> pa.Table:
    """One bucket: SPAN-word windows that a document with a smaller id has too."""
    out = []
    parts = entries(table)
    if parts:
        did, th, doc, place = _documents(parts)
        code, n = groups(np.concatenate([p[4] for p in parts]))
        low = np.full(n, LAST_ID)
        np.minimum.at(low, code, did[doc])
        hit = did[doc] > low[code]
        out = found_rows(bits, did, th, doc[hit], place[hit])
    return passed(table, out)


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, kept, n_words, n_removed) for each row of ``docs``.

    A word is removed if a window of SPAN words covers it whose words, in order,
    also start in a document with a smaller id.  Null texts have no words; a
    null id counts as the largest, and rows of one id (repeated ones too) take
    nothing from each other.  ``kept`` has the other words joined by one space;
    ``th`` tells texts of one id apart.
    """
    rows = keyed(docs, id_column, text)
    bits = bucket_bits(docs, text)
    candidates = rows.mapInArrow(_probe(bits), ENTRIES).groupBy("bucket").applyInArrow(lambda table: _meet(table, bits), FOUND)
    hits = rows.join(by_document(candidates), ["did", "th"]).mapInArrow(_extend(bits), ENTRIES)
    repeats = by_document(hits.groupBy("bucket").applyInArrow(lambda table: _confirm(table, bits), FOUND))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            kept, total, removed = [], [], []
            for text, parts in zip(batch.column("text"), batch.column("parts"), strict=True):
                # bytes.split() without argument knows just the six ASCII white-space characters.
                words = text.as_py().encode().split()
                total.append(len(words))
                if parts.is_valid and len(parts.values):
                    edge = np.zeros(len(words) + 1, np.int64)
                    for part in parts.values:
                        at = unpack(part.as_py())[0].astype(np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + SPAN, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                names=["did", "th", "kept", "n_words", "n_removed"],
            )

    out = rows.join(repeats, ["did", "th"], "left").select("did", "th", "text", "parts")
    out = out.mapInArrow(strip, "did long, th long, kept string, n_words long, n_removed long")
    return out.select(F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "th", "kept", "n_words", "n_removed")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the kept text of each row, straight from the definition, for tests."""
    words = [(t or "").encode().split() for _, t in rows]
    ids = [LAST_ID if i is None else i for i, _ in rows]
    least: dict[tuple, int] = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - SPAN + 1):
            key = tuple(w[k : k + SPAN])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - SPAN + 1):
            if least[tuple(w[k : k + SPAN])] < i:
                gone[k : k + SPAN] = [True] * SPAN
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out
