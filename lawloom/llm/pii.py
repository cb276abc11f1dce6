"""Personal data, and terms that reveal it by what they stand beside.

E-mail addresses, IP addresses, card and phone numbers are the protected
entities.  Of every other term the corpus tells how much it discloses of one:
the pointwise mutual information of the two, as a share of the entity's own
information, 1 where the term stands nowhere but beside it.  A word occurrence
is the event: it lies in an entity's context if at most CONTEXT words are
between.  Terms over the threshold are generalised to what they share with
others of their first letters, where that tells little enough, else removed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import hash_filter, passing

#: Fixed order of the kinds; ``term`` is what the method adds.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words to each side of an entity that are its context.
CONTEXT = 16
#: From this share of an entity's information on a term discloses it.
DISCLOSURE = 0.9
#: A term and an entity must meet between so many different pairs of neighbours: copies of one passage are no evidence.
SUPPORT = 3
#: Width of the confidence bound under which the share of a term's occurrences beside the entity is taken.
WIDTH = 2.0
#: Code points of a term's general form.
GENERAL = 3

TERM_BYTES = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + bytes(range(128, 256))

#: The letters of a local part, what follows it, and the other kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(_DOUBLED[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(kind's number, start, end, normal form) of a text's personal data, by start, then kind; each kind leftmost and without overlaps.

    Each pattern is read in one pass: a local part is sought backwards from its
    sign, no further than to the sign before.
    """
    out = []
    free = 0
    for m in AT.finditer(text) if "@" in text else ():
        before = text[free : m.start()]
        local = len(before) - len(before.rstrip(LOCAL))
        if local:
            out.append((0, m.start() - local, m.end(), text[m.start() - local : m.end()].lower()))
        free = m.end() if local else m.start() + 1
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) < 4 and int(p) < 256 for p in parts):
            out.append((1, m.start(), m.end(), ".".join(parts)))
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m.group()) if m.end() - m.start() >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end(), digits))
    for m in PHONE.finditer(text) if "+" in text else ():
        digits = _DIGITS.sub("", m.group())
        if 10 <= len(digits) <= 15:
            out.append((3, m.start(), m.end(), digits))
    return sorted(out, key=lambda x: (x[1], x[0]))


class _Terms:
    """The terms of a slice of texts: where they are, their hashes, those of their general forms, and which entities cover or neighbour."""

    def __init__(self, batch: pa.RecordBatch, seek: bool = True):
        data, self.offsets = common.utf8(batch.column("text"))
        self.start, self.end, self.doc, self.hash = common.words(data, self.offsets, *common.byte_table(TERM_BYTES, lower=True))
        self.points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.first_point = np.searchsorted(self.points, self.offsets)
        point = np.searchsorted(self.points, self.start)
        cut = np.minimum(self.points[np.minimum(point + GENERAL, len(self.points) - 1)], self.end)
        _, values = common.byte_table(lower=True)
        self.general = common.mix(common.Rolling(values[data]).ranges(self.start, cut) ^ np.uint64(GENERAL))
        #: Whether the general form has fewer letters than the term.
        self.longer = cut < self.end
        self.entities = [entities(t) for t in batch.column("text").to_pylist()] if seek else []
        self.covered = np.zeros(len(self.start), bool)
        #: First and last + 1 of the terms that each entity covers.
        self.spans: list[list[tuple[int, int]]] = []
        for d, found in enumerate(self.entities):
            at = self.first_point[d] + np.array([[e[1], e[2]] for e in found], np.int64).reshape(-1, 2)
            from_byte, to_byte = self.points[at[:, 0]], self.points[at[:, 1]]
            a, b = np.searchsorted(self.end, from_byte, "right"), np.searchsorted(self.start, to_byte)
            self.spans.append(list(zip(a.tolist(), b.tolist(), strict=True)))
            for x, y in self.spans[-1]:
                self.covered[x:y] = True

    def place(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points at which terms start and end in their texts."""
        base = self.first_point[self.doc[terms]]
        return np.searchsorted(self.points, self.start[terms]) - base, np.searchsorted(self.points, self.end[terms]) - base


def _entity_hash(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "little")


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, general, beside, n): of each term in an entity's context, how often it stands there between the same neighbours."""
    for batch in common.slices(batches):
        t = _Terms(batch)
        bounds = np.searchsorted(t.doc, np.arange(batch.num_rows + 1))
        near: set[tuple[int, int]] = set()
        for d, found in enumerate(t.entities):
            low, high = int(bounds[d]), int(bounds[d + 1])
            for (kind, _, _, value), (x, y) in zip(found, t.spans[d], strict=True):
                c = _entity_hash(kind, value)
                near.update((c, k) for k in (*range(max(low, x - CONTEXT), x), *range(y, min(high, y + CONTEXT))) if not t.covered[k])
        if not near:
            continue
        c = np.array([x[0] for x in near], np.uint64)
        k = np.array([x[1] for x in near], np.int64)
        left = np.where((k > 0) & (t.doc[k - 1] == t.doc[k]), t.hash[k - 1], np.uint64(0))
        after = np.minimum(k + 1, len(t.doc) - 1)
        right = np.where((k + 1 < len(t.doc)) & (t.doc[after] == t.doc[k]), t.hash[after], np.uint64(0))
        beside = common.mix(left) + right
        columns = np.stack((c, t.hash[k], t.general[k], beside, t.longer[k].astype(np.uint64)), axis=1)
        rows, n = np.unique(columns, axis=0, return_counts=True)
        longs = [pa.array(np.ascontiguousarray(rows[:, j]).view(np.int64)) for j in range(4)]
        yield pa.RecordBatch.from_arrays([*longs, pa.array(rows[:, 4] > 0), pa.array(n, pa.int64())], names=["entity", "term", "general", "beside", "longer", "n"])


def revealing_terms(texts: DataFrame) -> DataFrame:
    """(term, removed, disclosure): hashes of the terms of ``texts`` that reveal an entity, over all of them.

    ``removed`` is false where the general form discloses less than the
    threshold of each entity that the term reveals.
    """
    spark = texts.sparkSession
    met = texts.mapInArrow(_contexts, "entity long, term long, general long, beside long, longer boolean, n long")
    met = met.groupBy("entity", "term", "general", "longer", "beside").agg(F.sum("n").alias("n"))
    met = common.written(met.groupBy("entity", "term", "general", "longer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("support")))
    likely = met.where(F.col("support") >= SUPPORT)
    shared = spark.sparkContext.broadcast(hash_filter(likely.select(F.array("term", "general").alias("seeds"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in common.slices(batches):
            t = _Terms(batch, seek=False)
            found = [(h[passing(bits, h)], kind) for h, kind in ((t.hash, 0), (t.general, 1))]
            for h, kind in found:
                keys, n = np.unique(h, return_counts=True)
                yield pa.record_batch({"kind": pa.array(np.full(len(keys), kind), pa.int32()), "key": pa.array(keys.view(np.int64)), "n": pa.array(n, pa.int64())})
            yield pa.record_batch({"kind": pa.array([2], pa.int32()), "key": pa.array([0], pa.int64()), "n": pa.array([len(t.hash)], pa.int64())})

    counts = common.written(texts.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = float(counts.where("kind = 2").agg(F.sum("n").alias("n")).first().n or 1)
    of = lambda kind, name: counts.where(f"kind = {kind}").select(F.col("key").alias(name), F.col("n").alias(f"{name}_n"))
    by_entity = met.groupBy("entity").agg(F.sum("n").cast("double").alias("entity_n"))
    by_general = met.groupBy("entity", "general").agg(F.sum("n").cast("double").alias("both_n"))
    seen = likely.join(of(0, "term"), "term").join(of(1, "general"), "general").join(by_entity, "entity").join(by_general, ["entity", "general"])
    # The share of the term's occurrences that lie beside the entity, at the lower end of Wilson's interval.
    n, z = F.greatest(F.col("term_n"), F.col("n")).cast("double"), WIDTH * WIDTH
    p = F.col("n") / n
    least = (p + z / (2 * n) - WIDTH * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    own = F.log(F.lit(total) / F.col("entity_n"))
    # 1 - (information that is left) / (information of the entity), as PMI = own + log(share).
    share = lambda x: F.when(own > 0, 1 + F.log(F.greatest(x, F.lit(1e-300))) / own).otherwise(0.0)
    wide = ~F.col("longer") | (share(F.least(F.col("both_n") / F.col("general_n"), F.lit(1.0))) >= DISCLOSURE)
    seen = seen.select("term", share(least).alias("disclosure"), wide.alias("wide")).where(F.col("disclosure") >= DISCLOSURE)
    out = common.written(seen.groupBy("term").agg(F.max("wide").alias("removed"), F.max("disclosure").alias("disclosure")))
    common.forget(met, counts)
    return out


SPANS = "array<struct<kind: string, start: int, end: int, action: string>>"


def find(docs: DataFrame, text: str = "text", out: str = "spans", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (the columns of ``carry``, else all) with an array of (kind, start, end, action) added or replaced.

    Spans are in code points, the end excluded, by start, then kind as in KINDS.
    ``action`` is mask for personal data, and generalise or remove for terms that
    reveal it; terms inside personal data are left to it.  The statistics are
    those of all texts in ``docs``, of which equal neighbourhoods count once as
    evidence.  Null and empty texts have no spans, repeated rows get equal
    results, and whole texts are read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    terms = revealing_terms(docs.select(body))
    shared = docs.sparkSession.sparkContext.broadcast(hash_filter(terms.select(F.array("term").alias("seeds"))))
    kept = [c for c in carry or docs.columns if c != out]
    keys = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(out), body).alias("k2")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), *keys, body)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in common.slices(batches):
            t = _Terms(batch)
            at = passing(bits, t.hash)
            at = at[~t.covered[at]]
            a, b = t.place(at)
            bounds = np.searchsorted(t.doc[at], np.arange(batch.num_rows + 1))
            flat = [e for found in t.entities for e in found]
            edges = np.cumsum([0, *map(len, t.entities)])
            own = pa.StructArray.from_arrays([pa.array([e[j] for e in flat], pa.int32()) for j in range(3)], names=["kind", "start", "end"])
            near = pa.StructArray.from_arrays([pa.array(t.hash[at].view(np.int64)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["term", "start", "end"])
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), x) for e, x in ((edges, own), (bounds, near))]
            yield pa.RecordBatch.from_arrays([*batch.select(["row", "k1", "k2"]).columns, *lists], names=["row", "k1", "k2", "base", "near"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, k1 long, k2 long, base array<struct<kind: int, start: int, end: int>>, near array<struct<term: long, start: int, end: int>>"
    seen = common.written(rows.mapInArrow(scan, schema))
    hits = seen.where(F.size("near") > 0).select("k1", "k2", "near").dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("near").alias("x"))
    hits = hits.select("k1", "k2", "x.*").join(terms, "term")
    entry = F.struct(F.lit(len(KINDS) - 1).alias("kind"), "start", "end", "removed")
    # No more than its own words come together for a text.  Written, so that Spark knows how small it is.
    lists = common.written(hits.groupBy("k1", "k2").agg(F.collect_list(entry).alias("terms")))
    none = F.array().cast("array<struct<kind: int, start: int, end: int, removed: boolean>>")
    base = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("boolean").alias("removed")))
    bare, other = seen.where(F.size("near") == 0), seen.where(F.size("near") > 0)
    joined = other.join(lists, ["k1", "k2"], "left").select("row", "base", F.coalesce("terms", none).alias("terms")).unionByName(bare.select("row", "base", none.alias("terms")))
    ordered = F.array_sort(F.transform(F.concat(base, "terms"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["removed"].alias("removed"))))
    action = lambda x: F.when(x["removed"].isNull(), "mask").when(x["removed"], "remove").otherwise("generalise")
    named = F.transform(ordered, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), action(x).alias("action")))
    return joined.select("row.*", named.alias(out)).drop("_")


def sanitised(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``text`` with its personal data masked, and terms generalised or removed; of spans that overlap the first stands."""
    out, at = [], 0
    for kind, start, end, action in spans:
        if start >= at:
            out += [text[at:start], {"mask": f"[{kind.upper()}]", "remove": "", "generalise": text[start : start + GENERAL] + "…"}[action]]
            at = end
    return "".join(out) + text[at:]


def sanitise(found: DataFrame, text: str = "text", spans: str = "spans", out: str = "sanitised") -> DataFrame:
    """``found`` with ``out`` added or replaced: the text without what ``find`` found; '' for null texts."""
    kept = [F.col(c) for c in found.columns if c != out]
    rows = found.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(spans).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            done = [sanitised(t, [(s["kind"], s["start"], s["end"], s["action"]) for s in x or ()]) for t, x in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(done, pa.string())], names=["row", out])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, `{out}` string").select("row.*", out).drop("_")


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"), carry=("doc_id",))
    lines = lambda kept: F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != KINDS[-1])
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS[:-1]]
    return found.select("doc_id", *counts, F.sha2(lines(base).cast("binary"), 256).alias("base_sha256"), lines(F.col("spans")).alias("spans"))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(texts: list[str | None]) -> list[list[tuple[str, int, int, str]]]:
    """The spans of each text straight from the patterns and the definition of disclosure, for tests."""

    def holds(kind: str, found: str) -> str | None:
        digits = re.sub("[^0-9]", "", found)
        if kind == "email":
            return found.lower()
        if kind == "ip":
            return ".".join(str(int(x)) for x in found.split(".")) if all(int(x) <= 255 for x in found.split(".")) else None
        if kind == "phone":
            return digits if 10 <= len(digits) <= 15 else None
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
        return digits if 14 <= len(digits) <= 19 and total % 10 == 0 else None

    low = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    base, words = [], []
    for t in texts:
        spans = [(KINDS.index(k), m.start(), m.end(), value) for k, pattern in BASE.items() for m in re.finditer(pattern, t or "") if (value := holds(k, m.group())) is not None]
        base.append(sorted(spans, key=lambda s: (s[1], s[0])))
        words.append([(m.start(), m.end(), low(m.group())) for m in re.finditer("[A-Za-z0-9\x80-\U0010ffff]+", t or "")])
    both: dict[tuple, int] = {}
    beside: dict[tuple, set] = {}
    of_entity: dict[tuple, int] = {}
    with_general: dict[tuple, int] = {}
    of_term: dict[str, int] = {}
    of_general: dict[str, int] = {}
    inside = [[any(s[1] < e and a < s[2] for s in spans) for a, e, _ in w] for spans, w in zip(base, words, strict=True)]
    for spans, w, covered in zip(base, words, inside, strict=True):
        near = set()
        for kind, a, e, value in spans:
            at = [k for k, x in enumerate(w) if x[0] < e and a < x[1]]
            x = at[0] if at else sum(k[1] <= a for k in w)
            y = at[-1] + 1 if at else x
            near |= {((kind, value), k) for k in (*range(max(0, x - CONTEXT), x), *range(y, min(len(w), y + CONTEXT))) if not covered[k]}
        for c, k in near:
            term = w[k][2]
            both[c, term] = both.get((c, term), 0) + 1
            of_entity[c] = of_entity.get(c, 0) + 1
            with_general[c, term[:GENERAL]] = with_general.get((c, term[:GENERAL]), 0) + 1
            beside.setdefault((c, term), set()).add((w[k - 1][2] if k else "", w[k + 1][2] if k + 1 < len(w) else ""))
        for _, _, term in w:
            of_term[term] = of_term.get(term, 0) + 1
            of_general[term[:GENERAL]] = of_general.get(term[:GENERAL], 0) + 1
    total = sum(of_term.values())
    verdict: dict[str, bool] = {}
    for (c, term), k in both.items():
        n, z, own = of_term[term], WIDTH * WIDTH, math.log(total / of_entity[c])
        p = k / n
        least = (p + z / (2 * n) - WIDTH * math.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
        if len(beside[c, term]) >= SUPPORT and own > 0 and 1 + math.log(least) / own >= DISCLOSURE:
            g = with_general[c, term[:GENERAL]] / of_general[term[:GENERAL]]
            verdict[term] = verdict.get(term, False) or len(term) <= GENERAL or 1 + math.log(g) / own >= DISCLOSURE
    out = []
    for spans, w, covered in zip(base, words, inside, strict=True):
        found = [(k, a, e, "mask") for k, a, e, _ in spans]
        found += [(4, a, e, "remove" if verdict[x] else "generalise") for (a, e, x), c in zip(w, covered, strict=True) if x in verdict and not c]
        out.append([(KINDS[k], a, e, action) for k, a, e, action in sorted(found, key=lambda s: (s[1], s[0]))])
    return out
