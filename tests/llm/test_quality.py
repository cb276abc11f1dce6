"""The registered quality query against plain densities and the condition of its calibration."""

import zlib

import numpy as np
import pyarrow as pa

from lawloom.llm import common, quality, registry

SF = "/root/testdata/sf0.01"


def plain_difference(x, learned, y):
    """Log density of class 1 less that of class 0 from numpy's own covariances and determinants."""
    own = {c: learned[y == c] for c in (0, 1)}
    n = {c: len(own[c]) for c in (0, 1)}
    covariance = {c: np.cov(own[c], rowvar=False) for c in (0, 1)}
    pooled = sum((n[c] - 1) * covariance[c] for c in (0, 1)) / (n[0] + n[1] - 2)
    density = {}
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * covariance[c] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_DIAGONAL) * s + np.diag(quality.TO_DIAGONAL * np.diag(pooled) + quality.RIDGE)
        z = x - own[c].mean(0)
        density[c] = np.log(n[c] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (z * np.linalg.solve(s, z.T).T).sum(1)
    return density[1] - density[0]


def test_scores_are_those_of_plain_densities(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality in (0, 1)}
    got = {r.doc_id: r for r in registry.QUERIES["op4_discriminant_quality"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    ids = sorted(docs)
    # Each text by itself: statistics take nothing from their neighbours in a batch.
    x = np.concatenate([quality.statistics(*common.utf8(pa.array([docs[i]], pa.string()))) for i in ids])
    known = np.array([i in labels and zlib.crc32(str(i).encode()) % 4 != 2 for i in ids])
    y = np.array([labels.get(i, 0) for i in ids])
    z = np.arcsinh(plain_difference(x, x[known], y[known]))
    score = np.array([got[i].score for i in ids])
    inner = np.abs(z) < 12
    slope, shift = np.polyfit(z[inner], np.log(score[inner] / (1 - score[inner])), 1)
    np.testing.assert_allclose(score, 1 / (1 + np.exp(-np.clip(slope * z + shift, -36, 36))), atol=1e-6)
    # Slope and shift minimise the penalised logistic loss over the rows that are learned from, in steps of an eighth.
    step = np.round(z[known] * 8) / 8
    p = 1 / (1 + np.exp(-(slope * step + shift)))
    gradient = np.array([((p - y[known]) * step).sum(), (p - y[known]).sum()]) + 0.1 * (np.array([slope, shift]) - [1.0, 0.0])
    assert np.abs(gradient).max() < 0.05 * known.sum() ** 0.5
    assert all(got[i].predicted == (got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in ids)
