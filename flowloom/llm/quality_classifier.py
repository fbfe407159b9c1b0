"""Quality by regularised quadratic discriminant analysis.

Each document gives a vector of transformed statistics. The learning folds' counts, sums and sums of
products per class, over all their labelled rows, are one native aggregate, from which each class gets a mean and
a covariance shrunk towards its diagonal and the pooled covariance. The Cholesky factors of both are
cached; a score is the logistic of the difference of the Gaussian log densities, that is of
Mahalanobis distances and log determinants, plus the log prior ratio.

Defined cases: null and empty texts have the statistics of a text without words and are scored like
any other; texts of any length are read whole; a score equal to the threshold is good; rows with null labels teach nothing; a label table without both classes gives the rate of
good labels as everyone's score (1/2 without labels); repeated rows get one row each; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import runs

NAMES = ("words", "word_length", "symbols", "upper", "bangs", "stops", "digits", "distinct", "shingles", "echoes", "lines", "copied")
THRESHOLD = 0.5
#: Words of usual prose added to each text's counts, so that ratios of short texts are no extremes.
_PRIOR = 40
_NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_NOT_UPPER = bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_NOT_STOPS = bytes(set(range(256)) - set(b".!?"))
_NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_WIDE_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")


def statistics(text: str | None) -> tuple[float, ...]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    letters = sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = max(n - 2, 0)
    m = n + _PRIOR
    per_word = lambda k, usual=0.0: math.sqrt((k + _PRIOR * usual) / m)
    left = lambda drop: len(raw.translate(None, drop))
    upper = left(_NOT_UPPER) + (len(_WIDE_UPPER.findall(raw)) if not raw.isascii() else 0)
    return (
        math.log1p(n),
        math.log((letters + _PRIOR * 5) / m),
        per_word(left(_NOT_SYMBOLS)),
        per_word(upper, 0.1),
        per_word(raw.count(b"!")),
        per_word(left(_NOT_STOPS), 0.1),
        per_word(left(_NOT_DIGITS)),
        math.log(len(set(words)) + _PRIOR) / math.log(m),
        (len(set(zip(words, words[1:], words[2:]))) + _PRIOR) / (grams + _PRIOR),
        per_word(sum(map(eq, words, words[1:]))),
        math.log((n + _PRIOR) / (len(lines) + 1)),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 10)),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and a double per name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(statistics(t) for _, _, texts in runs(b.column("text")) for t in texts))) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], names=["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in NAMES))


class Model:
    """Priors, means and the inverse Cholesky factors of both classes; without both, a constant."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float) -> None:
        counts = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
        self.flat = None
        d = len(NAMES)
        if min(counts.values()) < 2:
            self.flat = (counts[1] + 0.5) / (sum(counts.values()) + 1)
            return
        means = {c: moments[c][1] / counts[c] for c in (0, 1)}
        covs = {c: moments[c][2] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)}
        pooled = sum(counts[c] * covs[c] for c in (0, 1)) / sum(counts.values())
        self.parts = []
        for c in (0, 1):
            weak = min(0.9, shrink + d / counts[c])
            target = 0.5 * np.diag(np.diag(covs[c])) + 0.5 * pooled
            cov = (1 - weak) * covs[c] + weak * target + 1e-6 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            offset = math.log(counts[c] / sum(counts.values())) - np.log(np.diag(factor)).sum()
            self.parts.append((means[c], np.linalg.inv(factor), offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        bad, good = (offset - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, offset in self.parts)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = 0.02) -> Model:
    """stats: with_statistics; labels(doc_id, quality) of the learning folds. Two rows of sums reach the driver."""
    y = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    rows = (
        stats.join(y, "doc_id").groupBy("y")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{x}") for x in NAMES], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}_{j}") for i, j in pairs])
        .collect()
    )
    moments = {}
    for r in rows:
        product = np.zeros((len(NAMES), len(NAMES)))
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p_{i}_{j}"]
        moments[r["y"]] = (r["n"], np.array([r[f"s_{x}"] for x in NAMES]), product)
    return Model(moments, shrink)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    stats = common.stage(spark, with_statistics(docs), "statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in NAMES])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").filter(~common.held_out("doc_id"))
    found = score(spark, common.table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
QUERIES = {"op10_quality_classifier": op10_quality_classifier}
