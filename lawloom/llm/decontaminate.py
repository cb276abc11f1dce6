"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some tokens of a span, so that a hash agrees although tokens
at the other positions differ.  The hashes of test items and of training texts
meet in an equi-join; of the training side only those travel that a filter of
fixed size lets pass, which holds every hash of the items.  A document and an
item that share a hash are then verified: on each diagonal on which a seed hits,
the longest stretch of aligned tokens is sought that allows substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed masks over spans of tokens: 1 is compared, 0 ignored.  One of them hits every overlap that the rule below allows.
MASKS = ("1111011", "1101000111", "11001111", "111111", "1110100011")
SPAN = max(map(len, MASKS))
#: An overlap has this many tokens at least (or all of a shorter item's), of which this part agree.
LEAST_TOKENS, AGREEMENT = 13, 0.8
#: Bits of the filter, three for each hash of an item: what is broadcast has this size at most, however many items there are.
FILTER_BITS = 24

WORD_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of letters, digits and non-ASCII characters of the lower-cased texts."""
    _, _, doc, hashes = common.words(*common.utf8(pc.utf8_lower(texts)), *common.byte_table(WORD_BYTES))
    return hashes, doc


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Of each position where the mask's span begins, in a sequence of tokens; spans may cross documents."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(0, n), len(mask), np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out += hashes[i : i + n] * np.uint64(factor)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return common.mix(out)


def masks_of(n: int) -> list[str]:
    """The masks for an item of ``n`` tokens: one shorter than the longest span is sought as it stands."""
    return list(MASKS) if n >= SPAN else ["1" * n] if n else []


def _marked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's seeds, told apart from those of other masks."""
    return seeds(hashes, mask) ^ common.mix(np.array([int(mask, 2) << 8 | len(mask)], np.uint64))


def item_tokens(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(iid, item_id, tokens, seeds) for each different item; those without id or token are left out."""
    rows = benchmark.where(F.col(item).isNotNull() & (F.length(text) > 0)).select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    rows = rows.withColumn("iid", F.xxhash64("item_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            hashes, doc = tokens(batch.column("text"))
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            found = [np.unique(np.concatenate([_marked(h, m) for m in masks_of(len(h))])).view(np.int64) if len(h) else np.zeros(0, np.int64) for h in own]
            out = pa.record_batch({"iid": batch.column("iid"), "item_id": batch.column("item_id"), "tokens": pa.array([h.tobytes() for h in own], pa.binary()), "seeds": pa.array(found, pa.list_(pa.int64()))})
            yield out.filter(pa.array([len(h) > 0 for h in own], pa.bool_()))

    return rows.select("iid", "item_id", "text").mapInArrow(run, "iid long, item_id long, tokens binary, seeds array<long>")


#: From which bit on a hash's three places in the filter are read.
SHIFTS = (0, 20, 40)


def _place(hashes: np.ndarray, shift: int) -> np.ndarray:
    return (hashes << np.uint64(shift)) >> np.uint64(64 - FILTER_BITS)


def passing(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where in ``hashes`` those are that the filter lets pass."""
    at = None
    for shift in SHIFTS:
        place = _place(hashes if at is None else hashes[at], shift)
        ok = np.flatnonzero((filter_bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        at = ok if at is None else at[ok]
    return at


def hash_filter(items: DataFrame) -> np.ndarray:
    """A bit array of fixed size in which all seeds of ``items`` have their bits; its 64-bit words are put together by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("seeds").flatten().to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_place(hashes, k) for k in SHIFTS])).astype(np.int64)
            yield pa.record_batch({"word": pa.array(at >> 6), "bits": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    words = items.select("seeds").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out.view(np.uint8)


def longest_overlap(equal: np.ndarray, least: int) -> tuple[int, int]:
    """The longest stretch, the first of equal ones, of which AGREEMENT agree and that starts and ends with agreeing tokens.

    (0, 0) if it has fewer than ``least`` tokens.
    """
    at = np.flatnonzero(equal)
    if not len(at) or at[-1] - at[0] + 1 < least:
        return 0, 0
    # A stretch qualifies if five times its agreeing tokens are four times its length at least: sums of whole numbers.
    agree, all_ = round(AGREEMENT * 100), 100
    sums = np.concatenate(([0], np.cumsum(np.where(equal, all_ - agree, -agree))))
    ends = at + 1
    # For each start the last end that keeps the sum: suffix maxima of the ends' sums are descending.
    highest = np.maximum.accumulate(sums[ends][::-1])[::-1]
    k = np.searchsorted(-highest, -sums[at], "right") - 1
    length = np.where(k >= 0, ends[np.maximum(k, 0)] - at, 0)
    best = int(length.argmax())
    return (int(at[best]), int(at[best] + length[best])) if length[best] >= least else (0, 0)


def overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """The longest verified overlap of a document's tokens with an item's, the first of equal ones: (tokens, first, last + 1); zeros if there is none."""
    hit = np.zeros(len(doc) + len(item), bool)  # by diagonal
    for mask in masks_of(len(item)):
        one, two = seeds(doc, mask), seeds(item, mask)
        order = np.argsort(two, kind="stable")
        low, high = np.searchsorted(two[order], one, "left"), np.searchsorted(two[order], one, "right")
        for p in np.flatnonzero(high > low).tolist():
            hit[p - order[low[p] : high[p]] + len(item)] = True
    best = (0, 0, 0)
    for d in (np.flatnonzero(hit) - len(item)).tolist():
        a, b = max(0, -d), min(len(item), len(doc) - d)
        s, e = longest_overlap(item[a:b] == doc[a + d : b + d], min(LEAST_TOKENS, len(item)))
        if e - s > best[0] or (e - s == best[0] > 0 and a + d + s < best[1]):
            best = (e - s, a + d + s, a + d + e)
    return best


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "overlaps") -> DataFrame:
    """``docs`` with the verified overlaps with test items added or replaced.

    ``out`` is an array of (item_id, n_tokens, first, last): the longest overlap
    with each item, in tokens of the document, ``last`` excluded.  It is empty
    for null and empty texts and without test items.  Whole texts are compared;
    repeated rows get equal results, and all rows and other columns stay.  Test
    items without id or token are ignored; an item of fewer tokens than
    LEAST_TOKENS counts only as a whole, and one shorter than the masks' spans
    only if all tokens agree.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    items = common.cut(item_tokens(benchmark, item, item_text))
    shared = spark.sparkContext.broadcast(hash_filter(items))
    short = [r.n for r in items.select((F.length("tokens") / 8).cast("int").alias("n")).where(F.col("n") < SPAN).distinct().collect()]  # SPAN - 1 lengths at most
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = {"k1": F.xxhash64(body), "k2": F.xxhash64(F.lit(out), body)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in common.slices(batches):
            hashes, doc = tokens(batch.column("text"))
            places, found = [], []
            for mask in masks:
                h = _marked(hashes, mask)
                at = passing(bits, h)
                at = at[doc[at] == doc[at + len(mask) - 1]]
                places.append(doc[at])
                found.append(h[at])
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            of, h = np.concatenate(places), np.concatenate(found)
            order = np.argsort(of, kind="stable")
            near, starts = np.unique(of[order], return_index=True)
            lists = [np.unique(x).view(np.int64) for x in np.split(h[order], starts[1:])] if len(near) else []
            raw = [hashes[bounds[d] : bounds[d + 1]].tobytes() for d in near.tolist()]
            own = batch.select(["k1", "k2"]).take(pa.array(near, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(raw, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["k1", "k2", "tokens", "seeds"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(k) for k in ("tokens", "item_tokens"))
            rows = [overlap(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(one, two, strict=True)]
            n, first, last = (pa.array([r[k] for r in rows], pa.int32()) for k in range(3))
            whole = pa.RecordBatch.from_arrays([*batch.select(["k1", "k2", "item_id"]).columns, n, first, last], names=["k1", "k2", "item_id", "n_tokens", "first", "last"])
            yield whole.filter(pc.greater(n, 0))

    near = docs.select(*[c.alias(k) for k, c in keys.items()], body.alias("text")).mapInArrow(scan, "k1 long, k2 long, tokens binary, seeds array<long>")
    near = common.written(near.dropDuplicates(["k1", "k2"]))
    met = near.select("k1", "k2", F.explode("seeds").alias("seed")).join(items.select("iid", F.explode("seeds").alias("seed")), "seed").select("k1", "k2", "iid").distinct()
    pairs = met.join(items.select("iid", "item_id", F.col("tokens").alias("item_tokens")), "iid").join(near.select("k1", "k2", "tokens"), ["k1", "k2"])
    found = pairs.select("k1", "k2", "item_id", "tokens", "item_tokens").mapInArrow(verify, "k1 long, k2 long, item_id long, n_tokens int, first int, last int")
    # Two items of one id count as one, by the longer overlap.
    best = found.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("n_tokens", (-F.col("first")).alias("f"), "last")).alias("m"))
    entry = F.struct("item_id", F.col("m.n_tokens").alias("n_tokens"), (-F.col("m.f")).cast("int").alias("first"), F.col("m.last").alias("last"))
    # Written, so that Spark knows its size: where it is small, the documents aren't shuffled.
    lists = common.written(best.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(entry)).alias("found")))
    common.forget(near)
    # The rows travel as one struct, so that none of their names can clash.
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])
    empty = F.array().cast(lists.schema["found"].dataType)
    return rows.join(lists, ["k1", "k2"], "left").select("row.*", F.coalesce("found", empty).alias(out))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        F.col("overlaps.item_id").alias("item_ids"),
        F.coalesce(F.array_max("overlaps.n_tokens"), F.lit(0)).alias("longest_overlap"),
    )


def brute(texts: list[str | None], items: list[tuple[int, str]]) -> list[list[tuple[int, int, int, int]]]:
    """Of each text the (item_id, n_tokens, first, last) straight from the rule, for tests: every diagonal, every stretch."""
    cut = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ")
    out = []
    for t in texts:
        doc, found = [w for w in cut(t) if w], {}
        for i, raw in items:
            own = [w for w in cut(raw) if w]
            best = (0, 0, 0)
            for d in range(-len(own) + 1, len(doc)) if own else ():
                a, b = max(0, -d), min(len(own), len(doc) - d)
                equal = [own[k] == doc[k + d] for k in range(a, b)]
                for s in range(len(equal)):
                    for e in range(s + 1, len(equal) + 1):
                        n, same = e - s, sum(equal[s:e])
                        enough = same == n == len(own) if len(own) < SPAN else n >= min(LEAST_TOKENS, len(own)) and same * 100 >= n * round(AGREEMENT * 100)
                        if enough and equal[s] and equal[e - 1] and (-n, a + d + s) < (-best[0], best[1]):
                            best = (n, a + d + s, a + d + e)
            if best[0] and best[0] > found.get(i, (0,))[0]:
                found[i] = best
        out.append(sorted((i, *b) for i, b in found.items()))
    return out
