"""Quality classifier: a sparse ensemble of rules over text statistics, run as one Spark column expression.

Statistics are built-in functions over whole texts. Small trees are boosted over a bounded, labelled sample; every path
from a root becomes a rule, a conjunction of threshold tests; an L1-penalised logistic fit keeps few of them. What is
kept is compiled into a column, so scoring is a map-only scan that stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.shared import bounded_sample

TRAIN_ROWS = 10_000
TREES = 16
DEPTH = 3
THRESHOLDS = 32
PENALTY = 0.002
STEPS = 400
LEAST_SCORE = 0.3


def _share_left(text: str, removed: str) -> Column:
    """Share of the characters that remain when those of a class are removed."""
    return F.length(F.regexp_replace(text, removed, "")) / F.greatest(F.length(text), F.lit(1))


def with_statistics(rows: DataFrame, text: str = "_text") -> tuple[DataFrame, list[str]]:
    """Add statistics of column ``text`` (not null) as doubles, and name them."""
    rows = rows.withColumn("_words", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.split(text, "\n"))
    n_words = F.greatest(F.size("_words"), F.lit(1))
    repeats = F.zip_with(F.slice("_words", F.lit(2), n_words), F.slice("_words", F.lit(1), n_words),
                         lambda a, b: F.when(a == b, 1).otherwise(0))
    stats = {
        "_s_chars": F.log1p(F.length(text)),
        "_s_words": F.log1p(F.size("_words")),
        "_s_word_length": F.length(text) / n_words,
        "_s_distinct": F.size(F.array_distinct("_words")) / n_words,
        "_s_repeated": F.aggregate(repeats, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) / n_words,
        "_s_upper": _share_left(text, r"[^\p{Lu}]+"),
        "_s_letters": _share_left(text, r"[^\p{L}]+"),
        "_s_digits": _share_left(text, r"[^0-9]+"),
        "_s_symbols": _share_left(text, r"[\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "_s_marks": _share_left(text, r"[^!?]+"),
        "_s_stops": _share_left(text, r"[^.]+"),
        "_s_lines": F.size("_lines") / n_words,
        "_s_distinct_lines": F.size(F.array_distinct("_lines")) / F.size("_lines"),
    }
    return rows.withColumns({k: v.cast("double") for k, v in stats.items()}).drop("_words", "_lines"), list(stats)


@dataclass(frozen=True)
class Rule:
    """Tests ``(statistic, is_above, threshold)`` that must all hold, and the weight they add."""

    tests: tuple
    weight: float


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule in self.rules:
            holds = F.lit(True)
            for name, above, limit in rule.tests:
                holds = holds & ((F.col(name) > limit) if above else (F.col(name) <= limit))
            total = total + F.when(holds, F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Rules of boosted trees, then weights by an L1-penalised logistic regression (accelerated proximal gradient)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(math.log(share / (1 - share))), ())
    share = y.mean()
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, THRESHOLDS + 2)[1:-1])) for j in range(x.shape[1])]
    above = [x[:, j][:, None] > limits[j] for j in range(x.shape[1])]
    random = np.random.default_rng(0)
    margin, paths = np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        features = random.permutation(x.shape[1])[:max(1, x.shape[1] * 2 // 3)]
        rows = np.flatnonzero(random.random(len(y)) < 0.7)
        _grow(above, limits, features, rows, np.arange(len(y)), y - chance, chance * (1 - chance), (), margin, paths)
    paths = list(dict.fromkeys(paths))
    hold = np.ones((len(y), len(paths)), np.float32)
    for r, path in enumerate(paths):
        for j, up, limit in path:
            hold[:, r] *= (x[:, j] > limit) if up else (x[:, j] <= limit)
    weights, intercept = _lasso(hold, y.astype(np.float32))
    kept = [Rule(tuple((names[j], up, float(limit)) for j, up, limit in paths[r]), float(weights[r]))
            for r in np.flatnonzero(np.abs(weights) > 1e-4)]
    return RuleModel(float(intercept), tuple(kept))


def _grow(above, limits, features, rows, all_rows, gradient, curvature, path, margin, paths):
    """Split ``rows`` where the gain is largest; leaves move ``margin`` of all rows that reach them."""
    best = None
    if len(path) < DEPTH and len(rows) > 1:
        g, h = gradient[rows].sum(), curvature[rows].sum()
        for j in features:
            right = above[j][rows]
            gr, hr = gradient[rows] @ right, curvature[rows] @ right
            gain = gr**2 / (hr + 1) + (g - gr) ** 2 / (h - hr + 1) - g**2 / (h + 1)
            k = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k)
    if best is None:
        step = gradient[rows].sum() / (curvature[rows].sum() + 1)
        margin[all_rows] += 0.5 * step
        return
    _, j, k = best
    for up in (False, True):
        test = (int(j), up, limits[j][k])
        paths.append((*path, test))
        _grow(above, limits, features, rows[above[j][rows, k] == up], all_rows[above[j][all_rows, k] == up],
              gradient, curvature, (*path, test), margin, paths)


def _lasso(hold: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    n, r = hold.shape
    full = np.hstack([hold, np.ones((n, 1), np.float32)])
    weights = np.zeros(r + 1, np.float32)
    probe = np.ones(r + 1, np.float32)
    for _ in range(20):
        probe = full.T @ (full @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * n / float(np.linalg.norm(full @ probe) ** 2)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(STEPS):
        slope = full.T @ (1 / (1 + np.exp(-(full @ ahead))) - y) / n
        new = ahead - step * slope
        new[:r] = np.sign(new[:r]) * np.maximum(np.abs(new[:r]) - step * PENALTY, 0)
        grown = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / grown * (new - weights)
        weights, momentum = new, grown
    return weights[:r], float(weights[r])


def held_out(id_col: str) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> RuleModel:
    """Fit on at most about ``train_rows`` labelled rows, chosen by the hash of their id; rows with a null id or label
    teach nothing. Only the sample's statistics reach the driver (13 numbers a row)."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(
        F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    known = bounded_sample(known, "_id", train_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows, names = with_statistics(texts.join(F.broadcast(known), "_id"))
    # ids order the rows, so the fit doesn't depend on how tasks end
    sample = rows.select("_id", "_label", *names).toPandas().sort_values(["_id", "_label", *names])
    return fit_rules(sample[names].to_numpy(np.float64), (sample["_label"].to_numpy() > 0).astype(np.float64), names)


def score_quality(docs: DataFrame, model: RuleModel, *, text_col: str = "text") -> DataFrame:
    """``_row`` (the whole input row) and ``score``; a null text counts as empty, repeated rows are scored row by row."""
    rows, _ = with_statistics(docs.select(F.struct("*").alias("_row"), F.coalesce(text_col, F.lit("")).alias("_text")))
    return rows.select("_row", model.score().alias("score"))
