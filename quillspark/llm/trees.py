"""Small decision trees: fitted with numpy on a bounded set of labelled rows, scored as Spark columns.

A tree is a leaf's value or (feature, cut, left, right); rows with feature <= cut go left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model may be fitted on; all of them are held by the driver.
MAX_LABELLED = 20_000
#: Every fourth row is held out for calibration and the threshold.
HELD_OUT = 4


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, least: int, choose=None):
    """Least-squares tree of y with weights w; leaves are weighted means. choose: gives the features to try at a node."""
    total, mass = float((w * y).sum()), float(w.sum())
    value = total / mass if mass else 0.0
    best = None
    if depth and len(y) >= 2 * least:
        for f in choose() if choose else range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, s, m = x[order, f], np.cumsum((w * y)[order]), np.cumsum(w[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
            if len(at):
                gain = s[at] ** 2 / np.maximum(m[at], 1e-12) + (total - s[at]) ** 2 / np.maximum(mass - m[at], 1e-12)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None or best[0] <= total * value + 1e-9:
        return value
    _, f, cut = best
    left = x[:, f] <= cut
    return (f, cut, grow(x[left], y[left], w[left], depth - 1, least, choose), grow(x[~left], y[~left], w[~left], depth - 1, least, choose))


def score(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, score(a, x), score(b, x))


def column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, a, b = tree
    return F.when(features[f] <= F.lit(cut), column(a, features)).otherwise(column(b, features))


@dataclass
class Model:
    """trees: summed. A row is taken where slope * sum + shift, a calibrated logit, is at least cut."""

    names: list[str]
    trees: list
    slope: float
    shift: float
    cut: float
    precision: float
    recall: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(score(t, x) for t in self.trees)

    def logit(self, features: dict[str, Column]) -> Column:
        cols = [features[n].cast("double") for n in self.names]
        total = F.lit(0.0)
        for t in self.trees:
            total = total + column(t, cols)
        return total * F.lit(self.slope) + F.lit(self.shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic calibration, by Newton's steps on smoothed labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = p - t, p * (1 - p) + 1e-9
        m = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def calibrated(names: list[str], trees: list, x: np.ndarray, y: np.ndarray, precision: float) -> Model:
    """The least threshold, of even odds or more, at which held-out rows are taken with the precision asked for."""
    model = Model(names, trees, 1.0, 0.0, 0.0, 0.0, 0.0)
    raw = model.raw(x)
    model.slope, model.shift = platt(raw, y)
    z = model.slope * raw + model.shift
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order])
    share = right / np.arange(1, len(y) + 1)
    last = np.r_[z[order][1:] < z[order][:-1], True]
    fit = np.flatnonzero((share >= precision) & last & (z[order] >= 0))
    k = int(fit[-1]) if len(fit) else 0
    below = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    model.cut, model.precision, model.recall = float((z[order][k] + below) / 2), float(share[k]), float(right[k] / max(1, y.sum()))
    return model


def boosted(names, x, y, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: int = 10, precision: float = 0.99) -> Model:
    """Gradient boosting of the logistic loss."""
    held = np.arange(len(y)) % HELD_OUT == 0
    a, t = x[~held], y[~held]
    z, trees = np.zeros(len(t)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        h = np.maximum(p * (1 - p), 1e-6)
        tree = grow(a, (t - p) / h, h, depth, least)
        tree = scaled(tree, rate)
        z = np.clip(z + score(tree, a), -12, 12)
        trees.append(tree)
    return calibrated(names, trees, x[held], y[held], precision)


def scaled(tree, by: float):
    return (tree[0], tree[1], scaled(tree[2], by), scaled(tree[3], by)) if isinstance(tree, tuple) else max(-4.0, min(4.0, tree)) * by


def forest(names, x, y, trees: int = 24, depth: int = 6, least: int = 4, precision: float = 0.99, seed: int = 5) -> Model:
    """Random forest: bootstrap rows, a random part of the features at each node."""
    rng = np.random.Generator(np.random.PCG64(seed))
    held = np.arange(len(y)) % HELD_OUT == 0
    a, t = x[~held], y[~held]
    some = max(2, round(x.shape[1] ** 0.5) + 1)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(t), len(t))
        grown.append(scaled(grow(a[rows], t[rows], np.ones(len(t)), depth, least, lambda: rng.choice(x.shape[1], some, replace=False)), 1 / trees))
    return calibrated(names, grown, x[held], y[held], precision)


def labelled(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of df(label, *names), at most MAX_LABELLED rows."""
    rows = df.select("label", *names).limit(MAX_LABELLED).collect()
    return np.array([[float(r[n]) for n in names] for r in rows]), np.array([float(r["label"]) for r in rows])
