"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Spark counts the document frequencies of hashed n-grams over every learnable
document.  The model is trained with follow-the-regularised-leader and elastic
net on a bounded sample, and a temperature fitted on a held-back part of it
calibrates the probabilities.  Scoring is one weight lookup for each n-gram.
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

#: Hashed features, and the n-gram lengths.
BITS = 16
SIZES = (1, 2, 3)
#: About this many sampled documents of each language are trained on: it bounds the driver's part.
PER_LANGUAGE = 1200
#: TF-IDF weights sum to about this in a document.
SCALE = 20.0
UNKNOWN = "und"

#: ASCII characters that are no letters count as one space.
_ASCII = np.array([ord(c.lower()) if c.isalpha() else 32 for c in map(chr, range(128))], np.uint32)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every n-gram of every text, and the bounds of each text's features."""
    texts = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _ASCII[np.minimum(points, 127)], points)
    offsets = np.cumsum([0, *map(len, texts)])
    if len(points):
        # Runs of spaces become one.
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        keep[offsets[:-1]] = True
        points, offsets = points[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]
    n = len(points)
    out = np.empty((n, len(SIZES)), np.int32)
    h = np.zeros(n, np.uint32)
    last = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    for k in range(max(SIZES)):
        ahead = np.zeros(n, np.uint32)
        ahead[: max(0, n - k)] = points[k:]
        # Past the end of a text, the shorter n-gram simply counts again.
        h = np.where(last > k, (h ^ ahead) * np.uint32(0x9E3779B1) + np.uint32(k + 1), h)
        if k + 1 in SIZES:
            x = h ^ (h >> np.uint32(15))
            out[:, SIZES.index(k + 1)] = (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    return out.ravel(), offsets * len(SIZES)


@dataclass
class Model:
    """Weights of hashed features (idf folded in), one column for each language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's likeliest language, and its calibrated probability."""
        features, bounds = grams(texts)
        size = np.diff(bounds)
        z = np.empty((len(texts), len(self.languages)))
        for j in range(len(self.languages)):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[j][features], dtype=np.float64)))
            z[:, j] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(size, 1) + self.bias[j]
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by FTRL-proximal; rows are (features, values), the bias is the last feature."""
    n = (1 << BITS) + 1
    z, g2 = np.zeros((n, n_labels)), np.zeros((n, n_labels))

    def weights(f: np.ndarray | slice) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(g2[f])) / alpha + l2)
        return np.where(np.abs(zf) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, v = rows[i]
            w = weights(f)
            p = softmax((v @ w)[None])[0]
            p[labels[i]] -= 1
            g = v[:, None] * p
            more = g * g
            z[f] += g - (np.sqrt(g2[f] + more) - np.sqrt(g2[f])) / alpha * w
            g2[f] += more
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search."""
    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2

    def loss(t: float) -> float:
        return float(-np.log(softmax(z / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(feature, df) over all of ``docs``; each task sends one row for a feature at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, np.int64)
        for batch in common.slices(batches, text):
            features, bounds = grams(batch.column(text).to_pylist())
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(bounds))
            pairs = pd.unique(doc << BITS | features)
            seen += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
        found = np.flatnonzero(seen)
        yield pa.record_batch({"feature": pa.array(found.astype(np.int32)), "df": pa.array(seen[found])})

    return docs.select(text).mapInArrow(count, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def _sample(docs: DataFrame, text: str, label: str, idf: np.ndarray, per_language: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list[str]]:
    draw = F.pmod(F.xxhash64(text), F.lit(1 << 20)) / float(1 << 20)
    docs = docs.select(F.col(label).alias("label"), F.col(text).alias("text"), draw.alias("draw"))
    # One row for each language; its least draw is always taken, so that each has a text.  Written, so that Spark
    # knows the size and, where it is small, joins it without shuffling the texts.
    shares = common.written(docs.groupBy("label").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("part"), F.min("draw").alias("least")))
    languages = sorted(r.label for r in shares.select("label").collect())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            features, bounds = grams(batch.column("text").to_pylist())
            fs, vs = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                f, n = np.unique(features[a:b], return_counts=True)
                fs.append(f.astype(np.uint16).tobytes())
                vs.append((n / max(1, b - a)).astype(np.float32).tobytes())
            yield pa.record_batch({"label": batch.column("label"), "f": pa.array(fs, pa.binary()), "v": pa.array(vs, pa.binary())})

    # Equal texts are drawn together; the bound holds for distinct ones and a common text counts once.
    drawn = docs.join(shares, "label").where("draw < part or draw = least").select("label", "text").distinct()
    got = drawn.mapInArrow(vectors, "label string, f binary, v binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.f), bytes(r.v)))
    rows, labels = [], []
    for r in got:
        f = np.frombuffer(r.f, np.uint16).astype(np.int64)
        v = np.frombuffer(r.v, np.float32) * idf[f] * SCALE
        rows.append((np.append(f, 1 << BITS), np.append(v, 1.0)))
        labels.append(languages.index(r.label))
    return rows, np.array(labels, np.int64), languages


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from all rows of ``docs`` with a label and a text.

    Without any such row the model knows only ``und``.
    """
    model = _fitted(docs, text, label, per_language)
    common.release()  # the sample, so that the driver's Python stays small for what follows
    return model


def _fitted(docs: DataFrame, text: str, label: str, per_language: int) -> Model:
    docs = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).cast("string").alias(text), F.col(label).cast("string").alias(label))
    n = docs.count()
    found = document_frequencies(docs, text).toPandas()  # at most 65,536 rows
    df = np.zeros(1 << BITS)
    df[found["feature"].to_numpy(np.int64)] = found["df"].to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1
    rows, labels, languages = _sample(docs, text, label, idf, per_language)
    if not languages:
        return Model([UNKNOWN], np.zeros((1, 1 << BITS), np.float32), np.zeros(1), 1.0)
    held = np.arange(len(rows)) % 5 == 4
    w, bias = train_ftrl([r for r, h in zip(rows, held, strict=True) if not h], labels[~held], len(languages))
    full = np.vstack([w, bias])
    z = np.array([v @ full[f] for (f, v), h in zip(rows, held, strict=True) if h]).reshape(-1, len(languages))
    t = temperature(z, labels[held]) if len(z) else 1.0
    return Model(languages, np.ascontiguousarray((w * idf[:, None] * SCALE).T, np.float32), bias, t)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added or replaced.

    A text that is null or has no letter is ``und`` with score 0.  Whole texts
    are read; every row is scored alone and keeps its other columns.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.languages, object)
        for batch in common.slices(batches, text):
            best, score = model.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.mapInArrow(run, schema)
    return out.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letters, F.col("score")).otherwise(0.0)})


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.remainder(F.col("doc_id"), 5) == 0
    model = fit(docs.where(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
