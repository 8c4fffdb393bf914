"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text are transformed (logarithms, square roots of shares), standardised
and held within ``REACH`` standard deviations. Each class has a mean and a covariance that is
shrunk towards the pooled covariance and a multiple of the identity; its Cholesky factor is
computed once and gives both the Mahalanobis distance and the determinant. The score is the
posterior of label 1.

Learning needs sums and sums of products alone, which are gathered from all labelled rows that
are not held out. Null text counts as empty; null labels are passed over; where a document has
several labels the largest counts. With fewer than two rows in either class every score is the
share of label 1, or 0.5 without labels. Repeated rows each get their row; other columns are
ignored, and kept by ``keep_good`` whatever their names. An empty table gives no rows. Long texts
are measured whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_ready, batch, cut, lean, remainder, text_bytes

MARKS = b"#$%&*|~^<>{}[]=+_@\\/"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
ALL = bytes(range(256))
#: Words of plain text that each share is smoothed by, so that a text of few words is no outlier.
SMOOTH = 20
#: Standard deviations beyond which a statistic counts as this far.
REACH = 4.0


def without(kept: bytes) -> bytes:
    """All other bytes, for translate() to delete."""
    return bytes(set(ALL) - set(kept))


NOT_MARKS, NOT_UPPER, NOT_LOWER, NOT_DIGITS, NOT_BEYOND = map(without, (MARKS, UPPER, LOWER, DIGITS, bytes(range(128, 256))))

STATISTICS = ["length", "word length", "marks", "bars", "shouts", "upper case", "digits", "other letters", "distinct words", "common word", "repeated lines", "line length", "stops", "longest word"]


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    count = lambda gone: len(text.translate(None, gone))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    upper, lower = count(NOT_UPPER), count(NOT_LOWER)
    m, letters = n + SMOOTH, upper + lower + 5 * SMOOTH
    return [
        math.log1p(n),
        math.log((sum(map(len, words)) + 6 * SMOOTH) / m),
        math.log1p(10 * count(NOT_MARKS) / m),
        math.log1p(10 * text.count(b"|") / m),
        math.log1p(10 * text.count(b"!") / m),
        math.sqrt((upper + 0.1 * SMOOTH) / letters),
        math.sqrt(count(NOT_DIGITS) / (size + 6 * SMOOTH)),
        math.sqrt(count(NOT_BEYOND) / (size + 6 * SMOOTH)),
        math.log(len(counts) + SMOOTH) / math.log(m),
        math.sqrt((max(counts.values()) - 1) / m),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 5)),
        math.log1p(n / max(1, len(lines))),
        math.log1p(10 * (text.count(b".") + text.count(b",") + 0.15 * SMOOTH) / m),
        math.log(max(6, *map(len, counts))),
    ]


@dataclass
class Discriminant:
    """Standardisation, and for each class its weight, mean, inverse Cholesky factor and log-determinant."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    classes: list[tuple[float, np.ndarray, np.ndarray, float]] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -REACH, REACH)
        density = []
        for weight, mean, inverse, log_det in self.classes:
            y = (z - mean) @ inverse.T
            density.append(math.log(weight) - 0.5 * log_det - 0.5 * np.einsum("ij,ij->i", y, y))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float) -> Discriminant:
    """From each class's number of rows, sum and sum of products."""
    n = {k: v[0] for k, v in sums.items()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.5
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return Discriminant(prior)
    centre = sum(v[1] for v in sums.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(v[2] for v in sums.values())) / total - centre**2, 0))
    scale[scale < 1e-9] = 1.0
    means, covariances = {}, {}
    for k, (m, s, p) in sums.items():
        mean = s / m
        covariances[k] = (p / m - np.outer(mean, mean)) / np.outer(scale, scale)
        means[k] = (mean - centre) / scale
    pooled = sum(n[k] * covariances[k] for k in n) / total
    d = len(centre)
    classes = []
    for k in (0, 1):
        share = shrink + (1 - shrink) * d / (d + n[k])
        c = (1 - share) * covariances[k] + share * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(c)
        classes.append((n[k] / total, means[k], np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Discriminant(prior, centre, scale, classes)


def measure(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def measured(batches):
        for b in batches:
            yield batch(schema, doc_id=b.column(0), x=[statistics(t.as_py()) for t in b.column(1)])

    arrow_ready(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(lean(measured), "doc_id long, x array<double>")


def learn(measured: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant:
    """A discriminant from all labelled rows whose remainder of crc32(doc_id) is not ``held``."""
    d = len(STATISTICS)
    schema = pa.schema([("k", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def summed(batches):
        held_sums = {}
        for b in batches:
            if not b.num_rows:
                continue
            k, x = np.array(b.column(0)), np.array(b.column(1).flatten()).reshape(-1, d)
            for c in np.unique(k):
                own = x[k == c]
                held_sums[c] = held_sums.get(c, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c, v in held_sums.items():
            yield batch(schema, k=np.full(len(v), c, "int32"), i=np.arange(len(v), dtype="int32"), v=v)

    marked = labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", mod) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("k"))
    rows = measured.join(marked, "doc_id").select("k", "x").mapInArrow(lean(summed), "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    sums = {}
    for k in {r.k for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.k == k:
                v[r.i] = r.v
        sums[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return fit(sums, shrink, ridge)


def score_measured(measured: DataFrame, model: Discriminant) -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(model)
    d = len(STATISTICS)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches):
        for b in batches:
            x = np.array(b.column(1).flatten()).reshape(-1, d)
            yield batch(schema, doc_id=b.column(0), score=shared.value.score(x))

    return measured.mapInArrow(lean(scored), "doc_id long, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id and score of every document."""
    measured = cut(measure(documents))
    return score_measured(measured, learn(measured, labels, mod, held))


def keep_good(documents: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, least: float = 0.7) -> DataFrame:
    """The documents whose score is ``least`` or more, with their own columns."""
    model = learn(measure(documents), labels, mod, held)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def good(batches):
        for b in batches:
            x = np.array([statistics((t.as_py() or "").encode()) for t in b.column("text")]).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(shared.value.score(x) >= least))

    return documents.mapInArrow(lean(good), documents.schema)
