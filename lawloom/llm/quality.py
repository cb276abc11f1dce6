"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of each whole text are transformed (log, square root) to be nearer
to normal.  Spark sums the classes' first and second moments over all learnable
documents; covariances are shrunk to the pooled one and to its diagonal, and
their Cholesky factors are cached.  A score is the logistic function of the
calibrated difference of the log densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop", "symbol", "bar", "bang",
    "space", "lines", "distinct_words", "same_as_before", "word_end_symbol", "top_word", "distinct_lines",
)
#: Parts of the pooled covariance, and of its diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
RIDGE = 1e-4

_UPPER, _LOWER, _DIGIT, _STOP, _SYMBOL, _BAR, _BANG, _SPACE, _LINE = range(9)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL, np.uint8)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT), (b".,;:'\"()-?", _STOP), (b"|", _BAR), (b"!", _BANG), (b" \t\r\x0b\x0c", _SPACE), (b"\n", _LINE)):
        kinds[list(chars)] = kind
    kinds[128:] = _LOWER
    return kinds


KINDS = _kinds()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document; all zero for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    kinds = KINDS[data]
    counts = np.bincount(doc_of_byte * 9 + kinds, minlength=9 * n).reshape(n, 9)
    start, end, doc, hashes = common.words(data, offsets, *common.byte_table())
    words = np.bincount(doc, minlength=n)
    codes, _ = pd.factorize(mixed := common.mix(hashes ^ (doc.astype(np.uint64) << np.uint64(40))))
    del mixed
    first = np.zeros(len(codes), bool)
    first[np.unique(codes, return_index=True)[1]] = True
    distinct = np.bincount(doc[first], minlength=n)
    often = np.bincount(codes, minlength=1)
    top = np.zeros(n, np.int64)
    if len(codes):
        np.maximum.at(top, doc[first], often[codes[first]])
    same = np.zeros(n)
    if len(doc) > 1:
        same = np.bincount(doc[1:], weights=(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
    odd_end = np.bincount(doc, weights=np.isin(kinds[end - 1], (_SYMBOL, _BAR, _BANG)) if len(end) else None, minlength=n)
    inside = np.ones(256, bool)
    inside[10] = False
    _, _, line_doc, line_hash = common.words(data, offsets, inside, common.BYTE_VALUES)
    lines = np.bincount(line_doc, minlength=n)
    line_codes = common.mix(line_hash ^ (line_doc.astype(np.uint64) << np.uint64(40)))
    first_line = np.zeros(len(line_codes), bool)
    first_line[np.unique(line_codes, return_index=True)[1]] = True
    distinct_lines = np.bincount(line_doc[first_line], minlength=n)

    def part(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.sqrt(x / np.maximum(of, 1))

    letters = counts[:, _UPPER] + counts[:, _LOWER]
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(size / np.maximum(words, 1)),
        part(counts[:, _UPPER], letters), part(counts[:, _DIGIT], size), part(counts[:, _STOP], size), part(counts[:, _SYMBOL], size),
        part(counts[:, _BAR], size), part(counts[:, _BANG], size), part(counts[:, _SPACE], size), part(counts[:, _LINE], size),
        np.log1p(distinct) / np.maximum(np.log1p(words), 1e-9) * (words > 0), part(same, words), part(odd_end, words), part(top, words), part(distinct_lines, lines),
    ]
    return np.column_stack(columns).astype(np.float64)


def add_statistics(docs: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """``docs`` with the array of FEATURES added or replaced; a null text counts as empty."""
    docs = docs.drop(out)
    schema = docs.select("*", F.array(F.lit(0.0)).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            x = statistics(*common.utf8(batch.column(text)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1; ``slope`` and ``shift`` calibrate."""

    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, priors included."""
        out = []
        for mean, inverse, constant in zip(self.means, self.inverse, self.constant, strict=True):
            y = (x - mean) @ inverse.T
            out.append(constant - 0.5 * (y * y).sum(1))
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.shift, -36, 36)))


def moments(labelled: DataFrame, features: str, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products of each class, added up by Spark; the driver gets a few rows."""
    d = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate(([len(z)], z.sum(0), (z.T @ z).ravel()))
        at = np.tile(np.arange(sums.shape[1], dtype=np.int32), 2)
        yield pa.record_batch({"c": pa.array(np.repeat(np.array([0, 1], np.int32), sums.shape[1])), "at": pa.array(at), "v": pa.array(sums.ravel())})

    rows = labelled.select(features, F.col(label).cast("int")).mapInArrow(add, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.c == c:
                v[r.at] = r.v
        out[c] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return out


def fit(labelled: DataFrame, features: str = "features", label: str = "quality") -> Discriminant:
    """Learns from rows whose label is 0 or 1.

    If a class has fewer rows than two, the model's score is the share of class
    1 (one half without any row) for every text.
    """
    d = len(FEATURES)
    m = moments(labelled.where(F.col(label).isin(0, 1) & F.col(features).isNotNull()), features, label)
    n = np.array([m[c][0] for c in (0, 1)])
    if n.min() < 2:
        share = (n[1] + 1) / (n.sum() + 2)
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    means = np.array([m[c][1] / n[c] for c in (0, 1)])
    scatter = [m[c][2] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / (n.sum() - 2)
    inverse, constant = [], []
    for c in (0, 1):
        own = scatter[c] / (n[c] - 1)
        s = (1 - TO_POOLED) * own + TO_POOLED * pooled
        s = (1 - TO_DIAGONAL) * s + np.diag(TO_DIAGONAL * np.diag(pooled) + RIDGE)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverse), np.array(constant))


def calibrate(model: Discriminant, labelled: DataFrame, features: str = "features", label: str = "quality") -> Discriminant:
    """Fits slope and shift of the log-density difference by Newton steps on a histogram that Spark counts."""
    if not model.inverse.any():
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.arcsinh(shared.value.difference(batch.column(0).flatten().to_numpy().reshape(-1, d)))
            yield pa.record_batch({"y": batch.column(1), "z": pa.array(np.round(z * 8).astype(np.int32))})

    rows = labelled.where(F.col(label).isin(0, 1) & F.col(features).isNotNull()).select(features, F.col(label).cast("int")).mapInArrow(bins, "y int, z int").groupBy("y", "z").count().collect()
    z = np.array([r.z / 8 for r in rows])
    y = np.array([r.y for r in rows], float)
    w = np.array([r["count"] for r in rows], float)
    prior = np.array([1.0, 0.0])
    theta = prior.copy()
    x = np.column_stack([z, np.ones(len(z))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (p - y)) + 0.1 * (theta - prior)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - step / max(1.0, 2 * np.abs(step).max())
    model.slope, model.shift = float(max(theta[0], 1e-3)), float(theta[1])
    return model


def score(docs: DataFrame, model: Discriminant, features: str = "features", out: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1 added or replaced; every row gets one."""
    docs = docs.drop(out)
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column(features).flatten().to_numpy().reshape(-1, d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", held_out=None, threshold: float = 0.7) -> DataFrame:
    """Learns from ``labels`` (doc_id, quality) and scores every row of ``docs`` (doc_id and ``text``).

    Returns doc_id, held_out, score and predicted.  Rows where ``held_out`` (a
    condition on doc_id) holds are never learned from.  Of several labels of a
    document the largest counts; labels that are null or not 0 or 1 count as
    none.  Null and empty texts get a score too; repeated rows get equal ones.
    """
    held = F.lit(False) if held_out is None else held_out
    rows = common.cut(add_statistics(docs.select("doc_id", text), text).select("doc_id", "features"))
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    learned = rows.where(~held).join(known, "doc_id")
    model = calibrate(fit(learned), learned)
    scored = score(rows, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return classify(docs, labels, held_out=common.remainder(F.col("doc_id"), 4) == 2)
