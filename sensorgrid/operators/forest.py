"""Small regression trees for the per-timestamp fits.

One timestamp has one training row per station, far too few for a distributed
fit, while there are many timestamps. Spark spreads the timestamps; these
helpers fit one of them with numpy. A fitted ensemble is a dict of flat arrays
so that it travels as plain columns.
"""

from __future__ import annotations

import numpy as np

LEAF = -1


def fit_forest(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int, max_depth: int, seed: int
) -> dict[str, list]:
    """Bagged trees, each split looking at a third of the features."""
    rng = np.random.default_rng(seed)
    tried = max(1, int(np.ceil(x.shape[1] / 3)))
    trees = []
    for _ in range(n_trees):
        drawn = rng.poisson(weight).astype(float)
        trees.append(_grow(x, y, drawn if drawn.any() else weight, max_depth, tried, rng))
    return _pack(trees, np.full(n_trees, 1.0 / n_trees))


def fit_boosted(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int, max_depth: int, seed: int,
    rate: float = 0.1,
) -> dict[str, list]:
    """Squared-loss boosting: a full first tree, then `rate` times trees on the gradient."""
    rng = np.random.default_rng(seed)
    trees, shares = [], []
    fitted = np.zeros(len(y))
    for i in range(n_trees):
        goal = y if i == 0 else 2.0 * (y - fitted)
        tree = _grow(x, goal, weight, max_depth, x.shape[1], rng)
        trees.append(tree)
        shares.append(1.0 if i == 0 else rate)
        fitted += shares[-1] * _descend(_pack([tree], [1.0]), x)
    return _pack(trees, shares)


def predict(model: dict[str, list], x: np.ndarray) -> np.ndarray:
    """Ensemble output for every row of `x`."""
    return _descend(model, x)


def _grow(x, y, w, max_depth, tried, rng) -> list[tuple]:
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        total = w[rows].sum()
        mean = float((w[rows] * y[rows]).sum() / total)
        nodes.append((LEAF, 0.0, at, at, mean))
        if depth < max_depth and len(rows) > 1 and x.shape[1]:
            cut = _best_cut(x[rows], y[rows], w[rows], tried, rng)
            if cut is not None:
                feature, threshold = cut
                low = x[rows, feature] <= threshold
                left = add(rows[low], depth + 1)
                right = add(rows[~low], depth + 1)
                nodes[at] = (feature, threshold, left, right, mean)
        return at

    add(np.flatnonzero(w > 0), 0)
    return nodes


def _best_cut(x, y, w, tried, rng):
    """(feature, threshold) with the largest drop of the weighted squared error."""
    features = rng.permutation(x.shape[1])[:tried]
    order = np.argsort(x[:, features], axis=0, kind="stable")
    xs = np.take_along_axis(x[:, features], order, axis=0)
    ws = w[order]
    count = np.cumsum(ws, axis=0)
    total = np.cumsum(ws * y[order], axis=0)
    left_n, left_s = count[:-1], total[:-1]
    right_n, right_s = count[-1] - left_n, total[-1] - left_s
    gain = left_s**2 / left_n + right_s**2 / right_n - total[-1] ** 2 / count[-1]
    gain[xs[:-1] == xs[1:]] = -np.inf
    row, col = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[row, col] > 1e-12:
        return None
    return int(features[col]), float((xs[row, col] + xs[row + 1, col]) / 2)


def _pack(trees: list[list[tuple]], shares) -> dict[str, list]:
    starts = np.cumsum([0] + [len(t) for t in trees[:-1]])
    flat = [
        (f, t, int(left + s), int(right + s), v)
        for s, tree in zip(starts, trees)
        for f, t, left, right, v in tree
    ]
    feature, threshold, left, right, value = map(list, zip(*flat))
    return {
        "feature": feature, "threshold": threshold, "lower": left, "upper": right,
        "value": value, "root": [int(s) for s in starts], "share": [float(s) for s in shares],
    }


def _descend(model: dict[str, list], x: np.ndarray) -> np.ndarray:
    feature, threshold = np.asarray(model["feature"]), np.asarray(model["threshold"])
    lower, upper = np.asarray(model["lower"]), np.asarray(model["upper"])
    rows = np.arange(len(x))[:, None]
    at = np.tile(np.asarray(model["root"]), (len(x), 1))
    while x.shape[1]:
        split = feature[at]
        if (split == LEAF).all():
            break
        goes_low = x[rows, np.maximum(split, 0)] <= threshold[at]
        at = np.where(split == LEAF, at, np.where(goes_low, lower[at], upper[at]))
    return np.asarray(model["value"])[at] @ np.asarray(model["share"])
