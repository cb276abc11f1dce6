"""Near-duplicate documents by HyperMinHash, with exact links and components.

Each set of word shingles gets REGISTERS registers: the least hash of the
register's share of the shingles, kept as its leading-zero count and a few
mantissa bits.  Bands of registers are join keys.  Pairs that share a key are
estimated (equal registers, corrected for accidental equality), then verified
on their full shingle sets.  Links make components.

No pair of a group is listed needlessly.  Shingles that only one document has
can't be shared, so their number bounds what a document may have in common with
any other; most documents that share a key by chance go out by that bound.
Members of a key are then compared with a few pivots; pairs of one component
need no link of their own; the few that are left outside are estimated, and
verified, against the rest of their family in chunks of bounded size, and only
links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, merged
from .packed import LAST_ID, groups, keyed

#: Registers of a sketch, and the mantissa bits that each keeps.
REGISTERS, MANTISSA = 128, 10
#: A pair is verified if its estimate is within this many standard errors of the threshold, at least.
DEVIATIONS = 6.0
#: Turns in which each key's members are compared with one of them.
PIVOTS = 2
#: Characters of text on each side of one comparison of a component with its outsiders: at most, and where at most CHUNKS are needed.
CHUNK_CHARS, SMALL_CHARS, CHUNKS = 8_000_000, 100_000, 24


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each document the sorted hashes of its distinct shingles; fewer words make one shingle, none an empty set."""
    _, _, doc, hashes = common.words(data, offsets, *common.byte_table(lower=True))
    roll = common.Rolling(hashes, common.BASES[1])
    n = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(n + 1))
    windows = roll.windows(size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            out.append(roll.ranges(np.array([a]), np.array([b])) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set: for each register 0 if it has no hash, else 1 + leading zeros and mantissa of the least."""
    out = np.zeros(REGISTERS, np.uint16)
    bits = REGISTERS.bit_length() - 1
    share = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1]))) if len(share) else share
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits, which a double holds exactly
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(53 - length, 53)
    mantissa = ((rest << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - MANTISSA)
    out[share[first]] = 1 + (zeros << MANTISSA) + mantissa.astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of sketches (rows of ``a`` and ``b``) and its standard error.

    Registers that differ may get equal codes: their leading zeros agree once
    in three times, and the mantissas once in 2**MANTISSA; that share is taken off.
    """
    filled = (a > 0) | (b > 0)
    n = np.maximum(filled.sum(-1), 1)
    equal = (filled & (a == b)).sum(-1) / n
    accident = 1 / 3 / (1 << MANTISSA)
    j = np.clip((equal - accident) / (1 - accident), 0, 1)
    return j, np.sqrt(np.maximum(j * (1 - j), 0.1 * 0.9) / n)


def band_counts(size: int, percent: int) -> int:
    """Bands for pairs whose smaller set has ``size`` shingles: -1 none but equal sets, 0 all but one shingle.

    Such a pair differs in at most (100 - percent) / percent * size shingles, and
    each spoils one band at most; with more bands than that, one agrees.  It gives
    no key if it is empty: 20 shared and 5 differing shingles lie so in 8 bands with
    a chance of 1.7e-5.
    """
    most = (100 - percent) * size // percent
    if most == 0:
        return -1
    if most == 1:
        return 0
    return 8 if most <= 5 else 16 if most <= 14 else 32


def band_keys(hashes_sum: int, members: np.ndarray | None, sketch: np.ndarray, size: int, percent: int) -> list[int]:
    """The join keys of one set, for each way in which a partner of an allowed size may look for it."""
    keys: list[int] = []
    least = -(-percent * size // 100)
    for way in sorted({band_counts(m, percent) for m in {least, size, *range(least, min(size, least + 64))}}):
        if way == 0 and members is not None:
            # Without any one shingle, and as it stands.
            sums = np.append(np.uint64(hashes_sum) - common.mix(members), np.uint64(hashes_sum))
            keys += common.mix(sums ^ np.uint64(0xD1B54A32D192ED03)).view(np.int64).tolist()
        elif way > 0:
            rows = sketch.reshape(way, -1).astype(np.uint64)
            some = np.flatnonzero(rows.any(1))
            factors = np.multiply.accumulate(np.full(rows.shape[1], common.BASES[0] | 1, np.uint64))
            h = common.mix((rows[some] * factors).sum(1, dtype=np.uint64) + np.uint64(1))
            keys += common.mix(h ^ ((some + 1 + 64 * way).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64).tolist()
    return list(dict.fromkeys(keys))


SKETCH = "did long, th long, n int, s1 long, s2 long, sketch binary, keys array<long>"


def sketches(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """did, th, number of shingles, two sums that identify the set, its registers and join keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingles(*common.utf8(batch.column("text")), size)
            n, s1, s2, sketch, keys = [], [], [], [], []
            for s in sets:
                total = int(common.mix(s).sum(dtype=np.uint64))
                n.append(len(s))
                s1.append(total)
                s2.append(int(common.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                r = registers(s)
                sketch.append(r.tobytes())
                keys.append(band_keys(total, s if len(s) < 64 else None, r, len(s), percent) if len(s) else [])
            as_long = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("th"), pa.array(n, pa.int32()), *as_long, pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["did", "th", "n", "s1", "s2", "sketch", "keys"],
            )

    return rows.mapInArrow(run, SKETCH)


def lone_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(nid, alone): how many shingles of a document no other one of ``texts`` (nid, text) has; none is left out as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = shingles(*common.utf8(batch.column("text")), size)
            nid = np.repeat(batch.column("nid").to_numpy(), [len(x) for x in sets])
            yield pa.record_batch({"nid": pa.array(nid), "h": pa.array(np.concatenate(sets).view(np.int64))})

    each = texts.select("nid", "text").mapInArrow(run, "nid long, h long")
    # The least id of one is its id: no join goes back from a frequent shingle to those that have it.
    once = each.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("nid").alias("nid")).where("k = 1")
    return once.groupBy("nid").agg(F.count(F.lit(1)).cast("int").alias("alone"))


def possible(na, nb, ma, mb, percent: int):
    """Whether sets of ``na`` and ``nb`` shingles, of which at most ``ma`` and ``mb`` can be shared, may be similar enough."""
    return (F.least(ma, mb) * (100 + percent) >= (na + nb) * percent) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)


#: Two nodes, and the component of each.
PAIR = ("a", "b", "ca", "cb")


def _likely(pairs: DataFrame, small: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, ca, cb) whose sizes and estimate allow a link; ``small`` has nid, n, m and sketch."""
    both = pairs.join(small.toDF("a", "na", "ma", "sa"), "a").join(small.toDF("b", "nb", "mb", "sb"), "b")
    both = both.where(possible(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sa", "sb"))
            j, error = estimate(a, b)
            yield batch.select([*PAIR]).filter(pa.array(j + DEVIATIONS * error >= percent / 100))

    return both.select(*PAIR, "sa", "sb").mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): the components of those of ``pairs`` whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(common.slices(batches, "ta", last=False), "tb"):
            one, two = (shingles(*common.utf8(batch.column(k)), size) for k in ("ta", "tb"))
            ok = []
            for x, y in zip(one, two, strict=True):
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("ca"), "b": batch.column("cb")}).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.select("ca", "cb", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, small: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between different components that share a key, at least one for each pair of them that has any.

    ``members`` has (key, nid, comp), ``small`` (nid, n, m, sketch).  In each
    key, those outside its largest component are its outsiders; outsiders join
    the family of that component and meet all of it and each other.  Pairs whose
    sizes, shared shingles and estimate allow a link are verified on their full
    sets.  Both sides of a family come in chunks of bounded size.
    """
    by = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = by.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("m.comp").alias("family"))
    family = common.written(members.join(main, "key").select("family", "nid", "comp").distinct())
    sized = family.join(texts.select("nid", F.length("text").cast("long").alias("chars")), "nid")
    outer = F.when(F.col("comp") != F.col("family"), F.col("chars")).otherwise(0)
    chunks = lambda c: F.greatest(F.least(F.ceil(c / SMALL_CHARS), F.lit(CHUNKS)), F.ceil(c / CHUNK_CHARS), F.lit(1)).cast("long")
    sums = sized.groupBy("family").agg(chunks(F.sum(outer)).alias("outer"), chunks(F.sum("chars")).alias("all"))
    base = family.join(sums, "family").join(texts.select("nid", "text"), "nid").join(small, "nid")
    part = lambda n: F.pmod(F.xxhash64("nid"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["family", "o", "c", "outside", "nid", "comp", "n", "m", "sketch", "text"]
    left = base.where("comp <> family").withColumn("o", part(F.col("outer"))).withColumn("c", each(F.col("all"))).withColumn("outside", F.lit(True))
    right = base.withColumn("c", part(F.col("all"))).withColumn("o", each(F.col("outer"))).withColumn("outside", F.lit(False))

    def compare(table: pa.Table) -> pa.Table:
        outside = table["outside"].to_numpy(zero_copy_only=False)
        comp, n, m = (table[k].to_numpy().astype(np.int64) for k in ("comp", "n", "m"))
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets: list[np.ndarray] = []
        for batch in common.slices(iter(table.select(["text"]).to_batches()), last=False):
            sets += shingles(*common.utf8(batch.column("text")), size)
        code, total = groups(np.concatenate(sets))
        at = np.concatenate(([0], np.cumsum(n)))
        flag = np.zeros(total, bool)
        two = np.flatnonzero(~outside)
        a, b = [], []
        for i in np.flatnonzero(outside).tolist():
            ok = (np.minimum(m[two], m[i]) * (100 + percent) >= (n[two] + n[i]) * percent) & (np.minimum(n[two], n[i]) * 100 >= np.maximum(n[two], n[i]) * percent)
            near = two[ok & (comp[two] != comp[i])]
            if len(near):
                j, error = estimate(sketch[near], sketch[i])
                near = near[j + DEVIATIONS * error >= percent / 100]
            if not len(near):
                continue
            own = code[at[i] : at[i + 1]]
            flag[own] = True
            both = np.array([np.count_nonzero(flag[code[at[j] : at[j + 1]]]) for j in near.tolist()])
            flag[own] = False
            linked = near[100 * both >= percent * (n[near] + n[i] - both)]
            # One link for each component will do.
            for j in linked[np.unique(comp[linked], return_index=True)[1]].tolist():
                a.append(min(comp[i], comp[j]))
                b.append(max(comp[i], comp[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = common.written(left.select(*columns).unionByName(right.select(*columns)).groupBy("family", "o", "c").applyInArrow(compare, "a long, b long"))
    common.forget(family)
    return found


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys in which more than one component is left, with the ``comp`` that they have now."""
    marked = members.drop("comp").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
    left = marked.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return marked.join(left, "key")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(did, th, doc_id, n_shingles, component_id, kept, first) for each row of ``docs``.

    Documents are linked if their sets of ``size``-word shingles (A-Z
    lower-cased; fewer words make one shingle) have a Jaccard similarity of
    ``percent`` in a hundred.  ``component_id`` is the smallest id reachable.
    Null and empty texts are linked with nothing and keep their own id.  A null
    id counts as the largest and shows as null; repeated rows share their
    results.  ``did`` and ``th`` identify the row's document for joins, and
    ``first`` holds for the one document of its group that has the least of both.
    """
    rows = keyed(docs, id_column, text)
    every = common.written(sketches(rows, size, percent))
    # Equal sets make one node; its row with the smallest id stands for it.
    least = F.min(F.struct("did", "th", "n", "sketch", "keys")).alias("r")
    nodes = common.written(every.where("n > 0").groupBy("s1", "s2").agg(least).select("s1", "s2", "r.*", F.monotonically_increasing_id().alias("nid")))
    keys = nodes.select("nid", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    in_keys = common.written(keys.join(shared, "key").select("key", "nid", "k"))
    # A document whose keys many others have is near the middle of its group.
    central = in_keys.groupBy("nid").agg(F.sum("k").alias("degree"))
    texts = central.join(nodes.select("nid", "did", "th", "n"), "nid").join(rows, ["did", "th"])
    # Repeated rows of one document would repeat its text.
    texts = common.written(texts.groupBy("nid").agg(*[F.first(c).alias(c) for c in ("degree", "n", "text")]))
    m = F.col("n") - F.coalesce("alone", F.lit(0))
    partners = texts.select("nid", "degree", "n").join(lone_shingles(texts, size), "nid", "left").withColumn("m", m)
    partners = common.written(partners.where(F.col("m") * 100 >= F.col("n") * percent).select("nid", "degree", "n", "m"))
    # Members of keys, each a component of its own.
    members = common.written(in_keys.join(partners.select("nid", "degree"), "nid").select("key", "nid", "degree", F.col("nid").alias("comp")))
    small = common.written(nodes.select("nid", "sketch").join(partners.select("nid", "n", "m"), "nid").select("nid", "n", "m", "sketch"))
    common.forget(in_keys, partners)

    labels = None
    tested: list[DataFrame] = []
    for turn in range(PIVOTS):
        # First the most central of each key, then any other of another component.
        by = F.col("degree") if labels is None else F.xxhash64("nid", F.lit(turn))
        pivot = members.groupBy("key").agg(F.max(F.struct(by.alias("by"), "nid", "comp")).alias("p")).select("key", F.col("p.nid").alias("pivot"), F.col("p.comp").alias("other"))
        sides = [("nid", "pivot", "comp", "other"), ("pivot", "nid", "other", "comp")]
        one, two = (F.struct(*[F.col(c).alias(k) for k, c in zip(PAIR, side, strict=True)]) for side in sides)
        pairs = members.join(pivot, "key").where("comp <> other").select(F.when(F.col("nid") < F.col("pivot"), one).otherwise(two).alias("pair")).select("pair.*").distinct()
        for before in tested:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = common.written(_likely(pairs, small, percent))
        found = _verified(pairs, texts.select("nid", "text"), size, percent)
        labels = common.replaced(labels, components(found) if labels is None else merged(labels, found))
        tested.append(pairs)
        members = common.replaced(members, common.written(_open(members, labels)))
        common.sweep(docs.sparkSession)
    found = _across(members, small, texts, size, percent)
    labels = common.replaced(labels, merged(labels, found))
    common.forget(texts, small, members, found, *tested)

    named = nodes.select("s1", "s2", "did", "th", F.col("nid").alias("node")).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min(F.struct("did", "th")).alias("least"))
    result = named.join(smallest, "comp").select("s1", "s2", "least")
    out = every.select("did", "th", "n", "s1", "s2").join(result, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("least.did")).otherwise(F.col("did"))
    first = (F.col("n") == 0) | (F.struct("did", "th") == F.col("least"))
    visible = lambda c: F.when(c < LAST_ID, c)
    return out.select("did", "th", visible(F.col("did")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), visible(own).alias("component_id"), (own == F.col("did")).alias("kept"), first.alias("first"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"), size=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def brute(rows: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), by comparing all sets that share a shingle; for tests with distinct ids."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    having: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        common_count: dict[int, int] = {}
        for x in s:
            for j in having[x]:
                if j < i:
                    common_count[j] = common_count.get(j, 0) + 1
        for j, k in common_count.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}
