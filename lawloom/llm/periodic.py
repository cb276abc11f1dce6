"""Runs of repeated word groups, found by minimizers on several scales.

Inside a run of period p, the least hashes of windows of up to p words repeat at
distance p.  On each scale, windows twice as long as on the one before, minima
with equal words beside them are paired, and each pair's stretch of agreement is
extended to both sides.  Minima that lie close together with the same words
belong to one run of a small period: they are taken as one progression, so that
two progressions give as many distances as they have members together, not their
product.  Periods too short for any window are found by comparing the words with
those so many places further on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has so many words at least, and twice its period.
LEAST_WORDS = 12
#: Words whose hashes are put in order as one, and windows of the first scale.
GRAM, FIRST = 8, 8
#: Longest period that is scanned directly: the first scale has all periods from its window's words on.
DIRECT = FIRST + GRAM - 2
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _grams(values: np.ndarray) -> np.ndarray:
    """A hash of each GRAM neighbours."""
    n = len(values) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(GRAM if n > 0 else 0):
        out += values[k : k + n] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    return common.mix(out)


def _extent(roll: common.Rolling, n: int, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How far the sequence agrees from ``a`` and ``b`` (> a) on, to the right (1) or to the left of them (-1)."""
    out = np.zeros(len(a), np.int64)
    most = n - b if way > 0 else a
    step = 1 << int(most.max()).bit_length() if len(a) else 0
    while step := step >> 1:
        at = np.flatnonzero(out + step <= most)
        x, y = a[at] + way * out[at], b[at] + way * out[at]
        x, y = (x, y) if way > 0 else (x - step, y - step)
        same = roll.ranges(x, x + step) == roll.ranges(y, y + step)
        out[at[same]] += step
    return out


def _pairs(place: np.ndarray, key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which equal keys stand, distances of this scale only.

    ``key`` tells ``size`` // 2 neighbours of a place.  Places with one key that are at most
    an eighth of ``size`` apart lie in one run of so small a period and make one
    cluster; two of its members tell nothing that the small period doesn't.
    """
    low, high = size + GRAM - 1, 2 * size + GRAM - 1
    order = np.lexsort((place, key))
    place, key = place[order], key[order]
    gap = np.diff(place)
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (gap * 8 > size)))) if len(place) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(place))
    first, last, name = place[new], place[end - 1], key[new]
    step = np.zeros(len(new), np.int64)
    several = np.flatnonzero(end - new > 1)
    for c in several.tolist():
        step[c] = np.gcd.reduce(gap[new[c] : end[c] - 1])
    places, distances = [], []
    for t in range(1, len(new)):
        a = np.flatnonzero((name[t:] == name[:-t]) & (first[t:] - last[:-t] < high))
        if not len(a):
            break
        b = a + t
        base, by = first[b] - last[a], np.maximum(np.gcd(step[a], step[b]), 1)
        begin, stop = -(-np.maximum(low - base, 0) // by), np.minimum(last[b] - first[a], high - 1) - base
        count = np.maximum(stop // by - begin + 1, 0)
        row = np.repeat(np.arange(len(a)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
        p = base[row] + k * by[row]
        places.append(np.maximum(first[a][row], first[b][row] - p))
        distances.append(p)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *distances])


def find_runs(values: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run in ``values``, by start, then period.

    ``values`` are word hashes; texts are told apart by a value between them that
    stands nowhere else, and ``longest`` is the length of the longest text.
    """
    starts, ends, periods = [], [], []

    def add(s: np.ndarray, e: np.ndarray, p: np.ndarray) -> None:
        ok = e - s >= np.maximum(2 * p, LEAST_WORDS)
        starts.append(s[ok])
        ends.append(e[ok])
        periods.append(p[ok])

    for p in range(1, min(DIRECT, longest // 2) + 1):
        s, e = common.runs(values[p:] == values[:-p])
        add(s, e + p, np.full(len(s), p))
    grams = _grams(values) if longest >= 2 * (FIRST + GRAM - 1) else np.zeros(0, np.uint64)
    roll = common.Rolling(grams)
    size, least = 1, np.arange(len(grams))
    while 2 * (size + GRAM - 1) <= longest or size < FIRST:
        if size >= FIRST:
            at = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
            half = size // 2
            right, left = at[at + half <= len(grams)], at[at >= half]
            seeds = [_pairs(right, roll.ranges(right, right + half), size), _pairs(left, roll.ranges(left - half, left), size)]
            m, p = (np.concatenate([x[k] for x in seeds]) for k in (0, 1))
            if len(m):
                s = m - _extent(roll, len(grams), m, m + p, -1)
                e = m + _extent(roll, len(grams), m, m + p, 1)
                add(s, e + p + GRAM - 1, p)
        if len(least) <= size:
            break
        # The first of two least hashes: minima of windows twice as long.
        one, two = least[:-size], least[size:]
        least = np.where(grams[one] <= grams[two], one, two)
        size *= 2
    s, e, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, periods))
    # A stretch that a multiple of its period gave too counts once.
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    once = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1]))) if len(s) else np.zeros(0, bool)
    s, e, p = s[once], e[once], p[once]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


#: From the number of words of each text and their ids: the word that stands at each place, or None where it is its own.
Rewrite = Callable[[str, int], np.ndarray | None]


def collapse(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``docs`` with n_words, runs and collapsed added or replaced.

    ``runs`` are the maximal stretches of a text's words with a smallest period
    that they hold twice at least, of LEAST_WORDS words or more, by start, then
    period.  ``collapsed`` has the words, joined by one space, that no run
    contains after its first period.  Null and empty texts have no words, no
    runs and an empty ``collapsed``.  Runs never cross texts, whole texts are
    taken, repeated rows get equal results and other columns stay as they are.
    ``rewrite`` may give another order of a text's words, by its id (null: '').
    """
    added = ["n_words", "runs", "collapsed"]
    kept = [F.col(c) for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), body)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            _, _, doc, hashes = common.words(*common.utf8(batch.column("text")), *common.byte_table())
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            n = np.diff(first)
            ids = batch.column("id").to_pylist()
            order = [rewrite(i, k) if rewrite else None for i, k in zip(ids, n.tolist(), strict=True)]
            for d, o in enumerate(order):
                if o is not None:
                    hashes[first[d] : first[d + 1]] = hashes[first[d] : first[d + 1]][o]
            # One value after each text that stands nowhere else, whatever the words are.
            ends = first[1:] + np.arange(1, batch.num_rows + 1) - 1
            values = np.empty(len(hashes) + batch.num_rows, np.uint64)
            own = np.ones(len(values), bool)
            own[ends] = False
            values[own] = hashes | np.uint64(1)
            values[ends] = np.arange(batch.num_rows, dtype=np.uint64) * np.uint64(2)
            s, e, p = find_runs(values, int(n.max(initial=0)))
            begin = np.concatenate(([0], ends[:-1] + 1))
            of = np.searchsorted(begin, s, "right") - 1
            bounds = np.searchsorted(of, np.arange(batch.num_rows + 1))
            gone = np.zeros(len(values) + 1, np.int64)
            np.add.at(gone, s + p, 1)
            np.add.at(gone, e, -1)
            stays = np.cumsum(gone)[:-1] == 0
            texts = []
            for d, t in enumerate(batch.column("text")):
                words = t.as_py().encode().split()
                if order[d] is not None:
                    words = [words[k] for k in order[d].tolist()]
                if bounds[d + 1] > bounds[d]:
                    words = compress(words, stays[begin[d] : ends[d]].tolist())
                texts.append(b" ".join(words))
            struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (s - begin[of], e - s, p)], names=["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), struct).cast(run_type)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), found, pa.array(texts, pa.binary()).cast(pa.string())], names=["row", *added])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ADDED}")
    return out.select("row.*", *added).drop("_")


def planted(i: str, n: int) -> np.ndarray | None:
    """The order of words that the query's contract asks for: one text in ten goes on with a period of its own."""
    h = zlib.crc32(i.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse(common.table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.l").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.l) div -best.p").alias("exponent_milli"), digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


def brute(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run straight from the definition, for tests."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= LEAST_WORDS:
                found.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(i: int | None, text: str | None, rewrite: Rewrite | None = planted) -> tuple:
    """n_runs, the best run's four values and both digests, for tests."""
    words = (text or "").encode().split()
    order = rewrite("" if i is None else str(i), len(words)) if rewrite else None
    words = words if order is None else [words[k] for k in order]
    runs = brute(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))
