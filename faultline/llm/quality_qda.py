"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Fitting is one grouped aggregation over labelled rows: count, sums and sums of
products per class. A class covariance is shrunk towards the pooled one and its
diagonal:

    (1 - POOL - DIAG) * own + POOL * pooled + DIAG * diag(pooled) + FLOOR * I

Its Cholesky factor L is computed once and kept with the model; a text's score is
the logistic of log p(x | 1) - log p(x | 0) + log prior odds, where log p is
-|L^-1 (x - mean)|^2 / 2 - sum(log diag L).

Cases: null text is empty; empty texts have a score; null labels are left out;
repeated labels of a document count each; if a class has no labelled row the
score is the share of class 1 among labels, or 0.5; an empty table gives an
empty result. Language, source, ids and labels are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged
from .text_stats import text_stats

POOL, DIAG, FLOOR = 0.2, 0.1, 1e-3
ACCEPT = 0.7
#: Words and lines added below the shares of repeats, and of distinct words, so that those of a short text tell little. Of five
#: settings from 1 to 80 these lost fewest good rows (0 of 2555) in five folds of the learning rows of sf0.1; held-out rows took no part.
REPEAT_WORDS, DISTINCT_WORDS, REPEAT_LINES = 80, 40, 8
FEATURES = ("words", "word_length", "symbols", "bangs", "repeats", "dup_lines", "distinct", "upper", "digits")


def features(text: Column) -> Column:
    """The transformed statistics of a text as an array<double>, in the order of FEATURES."""
    s = text_stats(text, more=True)

    def build(s: Column) -> Column:
        words = s["n_words"] + F.lit(1.0)
        chars = s["n_chars"] + F.lit(20.0)
        return F.array(
            F.log(words),
            F.log((s["word_chars"] + 5) / words),
            F.log(s["n_symbols"] / words + 0.02),
            F.log(s["n_bangs"] / words + 0.02),
            F.sqrt(s["n_repeat_words"] / (s["n_words"] + float(REPEAT_WORDS))),
            F.sqrt(s["n_dup_lines"] / (s["n_lines"] + float(REPEAT_LINES))),
            (s["n_distinct"] + DISTINCT_WORDS) / (s["n_words"] + float(DISTINCT_WORDS)),
            F.log((s["n_upper"] + 0.4) / chars),
            F.sqrt(s["n_digits"] / chars),
        )

    return let(s, build)


@dataclass
class Qda:
    """Means, Cholesky factors and log prior odds; constant is the score where a class is missing."""

    means: list
    factors: list
    log_odds: float
    constant: float | None = None

    def __post_init__(self):
        # The triangles are inverted once, with the model; scoring multiplies.
        self.inverses = [np.linalg.inv(f) for f in self.factors]
        self.log_roots = [float(np.log(np.diag(f)).sum()) for f in self.factors]

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        away = (x - self.means[k]) @ self.inverses[k].T
        return -0.5 * (away**2).sum(1) - self.log_roots[k]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.5)
        odds = self.log_density(x, 1) - self.log_density(x, 0) + self.log_odds
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per class of (label, x): rows, sums and sums of products. Two rows reach the driver."""
    d = len(FEATURES)
    at = lambda i: F.col("x")[i]
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(d)]
    products = [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out = {}
    for r in rows.filter("label in (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        out[int(r["label"])] = (r["n"], np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def fit(rows: DataFrame, pool: float = POOL, diag: float = DIAG, floor: float = FLOOR) -> Qda:
    """The model of labelled rows (label, x)."""
    found = moments(rows)
    if len(found) < 2:
        return Qda([], [], 0.0, constant=float(next(iter(found))) if found else 0.5)
    means = [found[k][1] / found[k][0] for k in (0, 1)]
    own = [found[k][2] / found[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
    n = [found[k][0] for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    shrunk = [(1 - pool - diag) * c + pool * pooled + diag * np.diag(np.diag(pooled)) + floor * np.eye(len(c)) for c in own]
    return Qda(means, [np.linalg.cholesky(c) for c in shrunk], float(np.log(n[1] / n[0])))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with held_out and score, which replace columns of these names; statistics are computed once and written."""
    keep = docs.columns if keep is None else keep
    name = next(n for n in ("_x" * k for k in range(1, 99)) if n not in docs.columns)
    rows = staged(docs.select(*keep, features(F.col(text_col)).alias(name)), "features")
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("label")).filter(F.col("label").isNotNull() & ~held_out(F.col("_id")))
    model = fit(rows.select(F.col(id_col).alias("_id"), F.col(name).alias("x")).join(known, "_id").select("label", "x"))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return rows.withColumns({"held_out": held_out(F.col(id_col)), "score": score(name)}).drop(name)
