"""Document quality by regularised quadratic discriminant analysis.

A text becomes FEATURES, statistics on scales where they are about normal: logarithms of counts, arcsines of the square
roots of shares. Each class has a mean and a covariance, from sums over all labelled training rows that are added up by
a distributed aggregate; only these sums come to the driver. A class's covariance is shrunk to the pooled one by
`pool` and then to a multiple of the identity by `ridge`, in units of the pooled deviations. A score is the
logistic function of the difference of the classes' log densities, Mahalanobis distances through the inverse of each
class's Cholesky factor, which is found once, plus the log odds of the classes.

Defined cases: a null text counts as empty, and an empty text has features like any other (all zero). Labels other than
0 and 1, null ids and labels without a document don't train; repeated labels count as often as they occur. With fewer
than two rows of a class every score is the share of class 1 (0.5 with no rows). A null id is never held out. An empty
table gives an empty result. Columns beyond id, text and label are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import held_out, map_arrow, saved, table

FEATURES = [
    "log_words", "log_lines", "mean_word", "deviation_word", "longest_word", "symbols", "capitals", "digits", "marks", "stops",
    "letters", "capitalised", "distinct", "commonest", "short_words", "dup_lines", "log_line_length", "repeats", "pipes", "shouted",
]

_CLASSES = [re.compile(p) for p in (r"[#*$%&<>]+", r"[A-ZÀ-ÖØ-Þ]+", r"[0-9]+", r"[!?;:\"'()\[\]{}=+/\\@^~_`-]+", r"[.,]+", r"[^\W\d_]+")]


def _share(k: float, n: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, k / n)))) if n else 0.0


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    sizes = np.fromiter(map(len, words), np.float64, n)
    symbols, upper, digits, marks, stops, letters = (sum([len(x) for x in c.findall(text)]) for c in _CLASSES)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    count = Counter(words)
    thirds = Counter(zip(words, words[1:], words[2:]))
    again = sum(c for c in thirds.values() if c > 1)
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), float(np.log(sizes.mean())), float(np.log1p(sizes.std())), float(np.log(sizes.max())),
        _share(symbols, chars), _share(upper, letters), _share(digits, chars), _share(marks, chars), _share(stops, chars),
        _share(letters, chars), _share(sum(w[0].isupper() for w in words), n), _share(len(count), n), _share(max(count.values()), n), _share(np.count_nonzero(sizes <= 3), n),
        _share(len(lines) - len(set(lines)), len(lines)), float(np.log1p(chars / max(len(lines), 1))), _share(again, max(n - 2, 1)), _share(text.count("|"), n), _share(sum(w.isupper() for w in words), n),
    ]


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): x is the array of FEATURES."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of rows (x, label) and for each label: the number, the sum of x and the sum of x times its transpose."""
    size = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((size + 1, size + 1)) for k in (0, 1)}
        for batch in batches:
            x, label = _matrix(batch.column(0)), np.asarray(batch.column(1))
            x = np.hstack([np.ones((len(x), 1)), x])
            for k in held:
                held[k] += x[label == k].T @ x[label == k]
        for k, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, k), pa.int32()), pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["label", "at", "value"])

    found = map_arrow(rows.select("x", "label"), run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = {k: np.zeros((size + 1) ** 2) for k in (0, 1)}
    for r in found:
        sums[r["label"]][r["at"]] = r["value"]
    shaped = {k: s.reshape(size + 1, size + 1) for k, s in sums.items()}
    return {k: (s[0, 0], s[0, 1:], s[1:, 1:]) for k, s in shaped.items()}


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes, and their log odds."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = 0.2, ridge: float = 0.02):
        n = {k: s[0] for k, s in sums.items()}
        self.share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.parts: list[tuple[np.ndarray, np.ndarray, float]] = []
        if min(n.values()) < 2:
            return
        mean = {k: s[1] / s[0] for k, s in sums.items()}
        scatter = {k: s[2] - s[0] * np.outer(mean[k], mean[k]) for k, s in sums.items()}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1] - 2)
        deviation = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(deviation, deviation)
        for k in (0, 1):
            cov = ((1 - pool) * scatter[k] / (n[k] - 1) + pool * pooled) / unit
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky((cov + cov.T) / 2)
            self.parts.append((mean[k], np.linalg.inv(factor) / deviation, 2 * float(np.log(np.diag(factor)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of x."""
        if not self.parts:
            return np.full(len(x), self.share)
        density = [-0.5 * ((((x - mean) @ inverse.T) ** 2).sum(1) + volume) for mean, inverse, volume in self.parts]
        odds = density[1] - density[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **options: float) -> Discriminant:
    """The discriminant of featured() rows with labels."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    return Discriminant(moments(rows.join(marks, "doc_id")), **options)


def classify(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of featured() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_arrow(rows.select("doc_id", "x"), run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(featured(table(spark, sf_dir, "documents")), "quality-features")
    labels = table(spark, sf_dir, "labels")
    model = fit(rows, labels.filter(~held_out(F.col("doc_id"), 3, 1)))
    return classify(rows, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
