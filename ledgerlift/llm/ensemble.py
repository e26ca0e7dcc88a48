"""A sparse rule ensemble for quality: tree paths over text statistics, weighed by a lasso, compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .rules import BLANKS, SYMBOLS, words_of
from .store import label_sample, text_of

#: One condition of a rule: statistic, whether it must be above the threshold, threshold.
Condition = tuple[str, bool, float]


@dataclass
class Ensemble:
    """Rules as tuples of conditions, with their weights and an intercept."""

    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float


def statistics(docs: DataFrame, keep: list[Column], text_column: str = "text") -> tuple[DataFrame, list[str]]:
    """The kept columns and the statistics of each text, and the names of the statistics. JVM only; null is empty."""
    text = F.col("__text")
    rows = docs.select(*keep, text_of(docs, text_column).alias("__text"))
    kept = [c for c in rows.columns if c != "__text"]
    size = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    rows = rows.select(
        *kept, words_of(text).alias("__words"), lines.alias("__lines"), F.length(F.translate(text, BLANKS, "")).alias("__chars"),
        *[size(signs).alias(name) for name, signs in (
            ("__symbols", SYMBOLS), ("__digits", "0123456789"), ("__stops", ".!?"), ("__shouts", "!"), ("__commas", ",;:"),
            ("__capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("__braces", "(){}[]=_/\\@"))])
    words = F.greatest(F.size("__words"), F.lit(1))
    chars = F.greatest(F.col("__chars"), F.lit(1))
    n_lines = F.greatest(F.size("__lines"), F.lit(1))
    named = {
        "words": F.size("__words"), "word_length": F.col("__chars") / words, "symbols": F.col("__symbols") / words,
        "digits": F.col("__digits") / chars, "stops": F.col("__stops") / words, "shouts": F.col("__shouts") / words,
        "commas": F.col("__commas") / words, "capitals": F.col("__capitals") / chars, "braces": F.col("__braces") / chars,
        "line_words": F.size("__words") / n_lines, "distinct_words": F.size(F.array_distinct("__words")) / words,
        "distinct_lines": F.size(F.array_distinct("__lines")) / n_lines,
    }
    return rows.select(*kept, *[c.cast("double").alias(f"s_{n}") for n, c in named.items()]), [f"s_{n}" for n in named]


def _grow(x: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, at: np.ndarray, path: tuple, depth: int, leaf: int, out: list, value: np.ndarray) -> None:
    """Split the rows ``at`` where the squared error of the target falls most; note the path of every node but the root."""
    if path:
        out.append(path)
    value[at] = target[at].mean()
    if depth == 0 or len(at) < 2 * leaf:
        return
    best = (1e-9, None, None)
    y, total = target[at], target[at].sum()
    for j, thresholds in enumerate(cuts):
        if not len(thresholds):
            continue
        slot = np.searchsorted(thresholds, x[at, j], side="left")  # x <= thresholds[k] exactly if slot <= k
        n = np.cumsum(np.bincount(slot, minlength=len(thresholds) + 1))[:-1]
        s = np.cumsum(np.bincount(slot, y, minlength=len(thresholds) + 1))[:-1]
        fits = (n >= leaf) & (len(at) - n >= leaf)
        if not fits.any():
            continue
        gain = np.where(fits, s ** 2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(at) - n, 1) - total ** 2 / len(at), -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, thresholds[k])
    if best[1] is None:
        return
    _, j, t = best
    above = x[at, j] > t
    for side, rows in ((False, at[~above]), (True, at[above])):
        _grow(x, cuts, target, rows, (*path, (j, side, float(t))), depth - 1, leaf, out, value)


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute-value penalty, by accelerated proximal steps; the intercept is free."""
    n, k = x.shape
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.concatenate([(x - mean) / spread, np.ones((n, 1))], 1)
    step = 4 * n / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w = np.zeros(k + 1)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -40, 40))) - y) / n
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    raw = w[:-1] / spread
    return raw, float(w[-1] - (raw * mean).sum())


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, most: int = 20_000, trees: int = 24, depth: int = 3,
        penalty: float = 0.001, seed: int = 5, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Ensemble:
    """Learn from at most ``most`` labelled rows that satisfy ``keep``; the bound is what the driver holds.

    Small trees are boosted on seeded halves of the rows. The path to each of their nodes is a rule; rules that cover
    the same rows count once. A lasso keeps the useful ones. With one label only, or none, the score is a constant:
    the share of label 1.
    """
    sample = label_sample(labels, keep, most, id_column, label_column)
    rows = docs.join(F.broadcast(sample), docs[id_column] == sample["_id"]).select(docs[text_column].alias("text"), sample["label"], sample["_id"])
    stats, names = statistics(rows, [rows["label"], rows["_id"]])
    data = stats.toPandas().sort_values(["_id", *names]).drop_duplicates(names + ["label"])
    x, y = data[names].to_numpy(float), data["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 60))) for j in range(x.shape[1])]
    random = np.random.default_rng(seed)
    paths: list[tuple] = []
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        half = np.sort(random.permutation(len(y))[:max(1, len(y) // 2)]) if len(y) > 200 else np.arange(len(y))
        own: list[tuple] = []
        _grow(x, cuts, residual, half, (), depth, max(5, len(half) // 500), own, np.zeros(len(y)))
        paths += own
        leaves = [p for p in own if not any(q[:len(p)] == p and len(q) > len(p) for q in own)]
        for p in leaves:
            held = _covers(x, p)
            if held.any():
                prob = 1 / (1 + np.exp(-margin[held]))
                margin[held] += 0.4 * (y[held] - prob).sum() / ((prob * (1 - prob)).sum() + 1.0)
    columns, rules, seen = [], [], set()
    for p in dict.fromkeys(paths):
        held = _covers(x, p)
        if held.tobytes() not in seen and 0 < held.sum() < len(y):
            seen.add(held.tobytes())
            columns.append(held.astype(float))
            rules.append(p)
    if not rules:
        share = y.mean()
        return Ensemble([], [], float(np.log(share / (1 - share))))
    weights, intercept = _lasso(np.stack(columns, 1), y, penalty)
    used = [i for i in range(len(rules)) if abs(weights[i]) > 1e-6]
    return Ensemble([tuple((names[j], side, t) for j, side, t in rules[i]) for i in used], [float(weights[i]) for i in used], intercept)


def _covers(x: np.ndarray, path: tuple) -> np.ndarray:
    held = np.ones(len(x), bool)
    for j, side, t in path:
        held &= (x[:, j] > t) if side else (x[:, j] <= t)
    return held


def compiled(model: Ensemble) -> Column:
    """The score as one column expression over the statistics."""
    total = F.lit(model.intercept)
    for rule, weight in zip(model.rules, model.weights):
        held = reduce(lambda a, b: a & b, [(F.col(name) > t) if side else (F.col(name) <= t) for name, side, t in rule])
        total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: Ensemble, keep: list[str], text_column: str = "text") -> DataFrame:
    """The kept columns and ``score``, between 0 and 1; a null or empty text is scored by its statistics, all 0."""
    stats, _ = statistics(docs, [docs[c] for c in keep], text_column)
    return stats.select(*keep, compiled(model).alias("score"))
