"""Quality classifier by Bradley-Terry pairwise ranking (operator 1).

A document's worth is a weighted sum of features of its text. Of a pair with one
good and one bad document the good one is preferred; weights come from the
logistic loss on the pairs' feature differences. A quantile of the fitted scores
is the threshold, chosen where it parts the labels best.

Cost: the model is fitted on a bounded sample of labelled rows (6,000 of each
class at most, first by hash; 60,000 pairs); every document is scored in one pass
without a shuffle. Labels, language, source and id are never features.

Defined results: null and empty texts have all features 0 and get a score as any
other; without both classes among the labels every score is 0.5; null ids give
held_out null; repeated rows give a row each; an empty table an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slackline.llm import textstats
from slackline.llm.frames import map_texts
from slackline.llm.labelled import fold, training_sample

PAIRS = 60_000
FOLDS, HELD_OUT = 3, 1


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters, words and lines; no feature grows with length but its logarithm."""
    c = dict(zip(textstats.FIELDS, textstats.counts(text), strict=True))
    n, lines, letters = max(c["n_words"], 1), max(c["n_lines"], 1), max(c["n_letters"], 1)
    soft = lambda x: np.sqrt(min(max(x, 0.0), 4.0))
    return np.array([
        min(np.log1p(c["n_words"]) / 10, 1.0), c["n_words"] < 10, soft(c["n_symbols"] / n), soft(c["n_dup_lines"] / lines),
        soft(c["n_repeat_words"] / n), soft(c["n_upper"] / letters), soft(c["n_digits"] / n), soft(c["n_exclaim"] / n), soft(c["n_pipes"] / n),
        soft(c["n_stops"] / n), soft(c["n_commas"] / n), c["n_short_words"] / n, c["n_long_words"] / n, min(c["word_chars"] / n / 10, 3.0),
        c["n_top_word"] / n, soft(c["n_distinct_words"] / n), min(n / lines / 100, 3.0),
    ], float)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, text: str | None) -> float:
        odds = float(self.worth(features(text)) - self.threshold)
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 7, ridge: float = 1e-3) -> np.ndarray:
    """Weights w that minimise mean log(1 + exp(-w.(g - b))) over preference pairs, by Newton steps."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how surprising each preference still is
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def quantile_threshold(good: np.ndarray, bad: np.ndarray, steps: int = 999) -> float:
    """The quantile of all scores that parts good from bad best, each class counting alike; of
    several that do, the middle one."""
    levels = np.quantile(np.concatenate([good, bad]), np.linspace(0.001, 0.999, steps))
    right = (good[None, :] >= levels[:, None]).mean(1) + (bad[None, :] < levels[:, None]).mean(1)
    best = levels[right >= right.max() - 1e-12]
    return float((best.min() + best.max()) / 2)


def fit_ranker(x: np.ndarray, label: np.ndarray) -> Ranker:
    width = x.shape[1]
    if not len(x) or label.min() == label.max():
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    w = bradley_terry(z[label == 1], z[label == 0])
    worth = z @ w
    return Ranker(mean, scale, w, quantile_threshold(worth[label == 1], worth[label == 0]))


def train(documents: DataFrame, labels: DataFrame, allowed: Column) -> Ranker:
    sample = training_sample(documents, labels, "quality", allowed)
    field = T.StructField("x", T.ArrayType(T.DoubleType()))
    rows = map_texts(sample, "text", [field], lambda: lambda t: (features(t).tolist(),), ["doc_id", "label"]).collect()  # at most 2 * SAMPLE_PER_CLASS ids
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit_ranker(np.array([r["x"] for r in rows], float).reshape(len(rows), len(features(None))), np.array([r["label"] for r in rows], int))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(documents, labels, ~held_out)
    scored = map_texts(documents, "text", [T.StructField("score", T.DoubleType())], lambda: lambda t: (model.score(t),), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
