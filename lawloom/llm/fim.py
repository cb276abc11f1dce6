"""Fill-in-middle: documents cut at two unit boundaries and put together anew.

The boundaries of all units of a slice of texts are one compressed set of code
point offsets, in containers of 2**16 offsets: a sorted array where few are
set, a bitmap where many are, and runs where they lie side by side.  Containers
keep how many offsets come before them, so a cut after the k-th unit is a
search over these counts and a selection inside one container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Marks before prefix, suffix and middle; texts that hold one stay plain.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred: from which a document stays plain, and under which the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
ADDED = "n_units long, form string, prefix_chars long, middle_chars long, output string"

LOW_BITS = 16
BITMAP_WORDS = (1 << LOW_BITS) // 64
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


class BoundarySet:
    """Ascending numbers, each once, by containers of their high bits; ``select`` finds the k-th."""

    def __init__(self, values: np.ndarray):
        high = values >> LOW_BITS
        edges = np.concatenate(([0], np.flatnonzero(high[1:] != high[:-1]) + 1, [len(values)])) if len(values) else np.zeros(1, np.int64)
        self.keys = high[edges[:-1]]
        #: Numbers before each container, and of all.
        self.before = edges
        self.containers = [_container((values[a:b] & ((1 << LOW_BITS) - 1)).astype(np.uint16)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The numbers at ``ranks``, counted from 0."""
        out = np.empty(len(ranks), np.int64)
        at = np.searchsorted(self.before, ranks, "right") - 1
        for c in np.unique(at).tolist():
            mine = np.flatnonzero(at == c)
            out[mine] = (int(self.keys[c]) << LOW_BITS) + _select(self.containers[c], ranks[mine] - self.before[c])
        return out


def _container(low: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The smallest of three forms: (kind, numbers, counts before each part of them)."""
    ends = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
    runs = len(ends) + 1
    if 4 * runs < min(2 * len(low), 8 * BITMAP_WORDS):
        first = np.concatenate(([0], ends + 1))
        return "run", low[first], first
    if 2 * len(low) <= 8 * BITMAP_WORDS:
        return "array", low, np.zeros(0, np.int64)
    bits = np.zeros(1 << LOW_BITS, np.uint8)
    bits[low] = 1
    packed = np.packbits(bits, bitorder="little").view("<u8")
    return "bitmap", packed, np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))


def _select(container: tuple[str, np.ndarray, np.ndarray], ranks: np.ndarray) -> np.ndarray:
    kind, numbers, before = container
    if kind == "array":
        return numbers[ranks].astype(np.int64)
    part = np.searchsorted(before, ranks, "right") - 1
    if kind == "run":
        return numbers[part].astype(np.int64) + ranks - before[part]
    bits = np.unpackbits(numbers[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return part * 64 + (np.cumsum(bits, axis=1) <= (ranks - before[part])[:, None]).sum(1)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, BoundarySet]:
    """Of UTF-8 texts: the byte of each code point, the first code point and the units before each text, and the boundaries.

    A unit is a run of ASCII letters or any other code point.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(at, offsets)
    letter = np.append(_LETTERS[data[at]], False)
    begins = np.zeros(len(at) + 1, bool)
    begins[first] = True
    ends = np.flatnonzero(~(letter[:-1] & letter[1:] & ~begins[1:])) + 1
    return np.append(at, len(data)), first, np.searchsorted(ends, first, "right"), BoundarySet(np.concatenate(([0], ends)))


def transform(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars and output added or replaced.

    Both cuts, and the form, come from the SHA-256 of ``seed:id``, so a row's
    result depends on nothing but its id and text; repeated rows get equal
    results, and a null id counts as ''.  A null text counts as empty, and empty
    texts and those that hold one of MARKS stay plain, with null lengths.  Whole
    texts are taken, however long; other columns stay as they are.
    """
    added = [c.split()[0] for c in ADDED.split(", ")]
    kept = [F.col(c) for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("row"), F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            data, offsets = common.utf8(batch.column("text"))
            byte, first, before, boundaries = units(data, offsets)
            n = np.diff(before)
            draws = np.array([np.frombuffer(hashlib.sha256(f"{seed}:{i}".encode()).digest(), ">u4", 4) for i in batch.column("id").to_pylist()], np.int64)
            cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
            chars = boundaries.select((before[:-1, None] + cuts).ravel()).reshape(-1, 2)
            raw = data.tobytes()
            forms, outputs = [], []
            for d, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                whole = raw[a:z]
                if not whole or draws[d, 2] % 100 >= PLAIN_FROM or any(m.encode() in whole for m in MARKS):
                    forms.append("plain")
                    outputs.append(whole)
                    continue
                x, y = byte[chars[d]].tolist()
                forms.append("spm" if draws[d, 3] % 100 < SUFFIX_FIRST else "psm")
                outputs.append(assemble(raw[a:x], raw[x:y], raw[y:z], forms[-1]))
            plain = np.array([f == "plain" for f in forms], bool)
            lengths = (chars[:, 0] - first[:-1], chars[:, 1] - chars[:, 0])
            columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), *(pa.array(x, pa.int64(), mask=plain) for x in lengths), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", *added])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ADDED}")
    return out.select("row.*", *added).drop("_")


def assemble(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    p, s, m = (x.encode() for x in MARKS)
    return b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: no part of it holds a mark, so the marks are where it splits."""
    part = F.split(output, "|".join(MARKS))
    at = lambda k: F.coalesce(F.try_element_at(part, F.lit(k)), F.lit(""))
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(F.concat(at(2), at(4), at(3)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS unit FROM t),
d AS (SELECT *, len(unit) AS n, ('0x' || h[1:8])::BIGINT % (len(unit) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(unit) + 1) AS c2,
             ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM u),
p AS (SELECT doc_id, text, n,
             CASE WHEN text = '' OR h3 >= {PLAIN_FROM} OR {" OR ".join(f"contains(text, '{m}')" for m in MARKS)} THEN 'plain' WHEN h4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(unit[1:least(c1, c2)], '') AS a, array_to_string(unit[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(unit[greatest(c1, c2) + 1:], '') AS c FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def brute(i: int | None, text: str | None, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """n_units, form, prefix_chars, middle_chars and output straight from the rule, for tests."""
    import re

    text = text or ""
    unit = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= PLAIN_FROM:
        return len(unit), "plain", None, None, text
    x, y = sorted((h[0] % (len(unit) + 1), h[1] % (len(unit) + 1)))
    prefix, middle, suffix = ("".join(unit[a:b]) for a, b in ((0, x), (x, y), (y, None)))
    if h[3] % 100 < SUFFIX_FIRST:
        return len(unit), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(unit), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"
