"""Learners in numpy: boosted trees over histograms, ridge logistic regression, isotonic and sigmoid calibration.

They take the rows of one task. The learners of an Estimator are also made `over` sums that something else gathers from parts of the rows, by the same steps."""

from __future__ import annotations

import numpy as np


class Prepared:
    """Median imputation and standardisation, learned from the rows that a model is fitted on."""

    def __init__(self, x: np.ndarray):
        with np.errstate(all="ignore"):
            self.fill = np.nan_to_num(np.nanmedian(np.where(np.isfinite(x), x, np.nan), 0)) if len(x) else np.zeros(x.shape[1])
        filled = self._filled(x)
        self._scaled(filled.mean(0), filled.std(0))

    @classmethod
    def over(cls, fill: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> Prepared:
        self = cls.__new__(cls)
        self.fill = fill
        self._scaled(mean, deviation)
        return self

    def _scaled(self, mean, deviation):
        self.mean, self.scale = mean, np.where(deviation > 0, deviation, 1.0)

    def _filled(self, x):
        return np.where(np.isfinite(x), x, self.fill)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._filled(x) - self.mean) / self.scale


class Logistic:
    """Ridge of strength 1 on all but the intercept, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 2000):
        self._fit(x.shape[1], lambda w: self.sums(w, x, y), rounds)

    @classmethod
    def over(cls, m: int, summed, rounds: int = 2000) -> Logistic:
        """summed(w): the sums of all rows at the weights w of m columns and the intercept."""
        self = cls.__new__(cls)
        self._fit(m, summed, rounds)
        return self

    @staticmethod
    def sums(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of these rows."""
        x = np.hstack([x, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y)

    def _fit(self, m, summed, rounds):
        self.w, shrink = np.zeros(m + 1), np.ones(m + 1)
        shrink[-1] = 1e-9
        for _ in range(rounds):
            curve, slope = summed(self.w)
            step = np.linalg.solve(curve + np.diag(shrink), slope + shrink * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.w, -35, 35)))


class Boosted:
    """Gradient-boosted trees of a fixed depth on the log loss, split by histograms of at most `bins` quantile bins."""

    #: Levels of a tree; the step and the ridge of its leaves; rows that a side of a split has at least; bins of a column; trees at most.
    DEPTH, STEP, RIDGE, LEAST, BINS, TREES = 3, 0.05, 1.0, 20, 255, 200
    #: Parts of one in which gradients are counted where sums are made over parts of the rows: such sums are exact, in any order, for up to 2^29 rows.
    FIXED = 1 << 24

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 200, depth: int = DEPTH, step: float = STEP, ridge: float = RIDGE, least: int = LEAST, bins: int = BINS):
        n, m = x.shape
        self.depth, self.trees = depth, []
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
        binned, width = self._binned(x), bins + 1
        flat = binned + np.arange(m) * width
        self.start = self._odds(y.mean() if n else 0.5)
        f = np.full(n, self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)  # within the level
            splits = []
            for level in range(depth):
                k = 1 << level
                at = (node[:, None] * (m * width) + flat).ravel()
                sums = [np.bincount(at, np.repeat(w, m), k * m * width).reshape(k, m, width) for w in (grad, hess, np.ones(n))]
                splits.append(self._split(sums, ridge, least))
                node = self._next(node, binned, splits[-1])
            leaves = 1 << depth
            value = -step * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + ridge)
            self.trees.append((splits, value))
            f += value[node]

    @classmethod
    def over(cls, edges: list[np.ndarray], rate: float, rounds: int, summed) -> Boosted:
        """The trees of rows whose columns have these edges and whose mean outcome is rate. summed(model, splits): the sums (see `sums`) of all
        rows under the model's trees so far, at the next level of a tree that begins with splits."""
        self = cls.__new__(cls)
        self.depth, self.trees, self.edges, self.start = cls.DEPTH, [], edges, cls._odds(rate)
        for _ in range(rounds):
            splits: list = []
            for _ in range(self.depth):
                sums = summed(self, splits) / np.array([cls.FIXED, cls.FIXED, 1.0])[:, None, None, None]
                splits.append(self._split(sums, cls.RIDGE, cls.LEAST))
            at = np.arange(len(splits[-1][0]))
            columns, cut = sums[:2, at, splits[-1][0]], splits[-1][1]  # of each node, the column that it was split by
            left = (columns * (np.arange(columns.shape[2]) <= cut[:, None])).sum(2)
            grad, hess = np.stack([left, columns.sum(2) - left], 2).reshape(2, -1)
            self.trees.append((splits, -cls.STEP * grad / (hess + cls.RIDGE)))
        return self

    @classmethod
    def sums(cls, splits: list, binned: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Gradients, curvatures (both in whole parts of one) and rows by node, column and bin, of these rows with the scores f."""
        m, width = binned.shape[1], cls.BINS + 1
        k = 1 << len(splits)
        p = 1 / (1 + np.exp(-f))
        weights = [np.rint(w * cls.FIXED) for w in (p - y, p * (1 - p))]
        node = cls._leaf(splits, binned) * width
        out = np.empty((3, k, m, width))
        for j in range(m):
            at = node + binned[:, j]
            for i, w in enumerate((*weights, None)):
                out[i, :, j] = np.bincount(at, w, k * width).reshape(k, width)
        return out

    @staticmethod
    def _odds(rate) -> float:
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        return float(np.log(rate / (1 - rate)))

    @staticmethod
    def _split(sums, ridge, least) -> tuple[np.ndarray, np.ndarray]:
        """(column, last bin of the left side) of each node of a level."""
        g, h, c = (w.cumsum(2) for w in sums)
        k, _, width = g.shape
        gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
        gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
        gain[(c < least) | (ct - c < least)] = -1.0
        best = gain.reshape(k, -1).argmax(1)
        feature, cut = best // width, best % width
        return feature, np.where(gain.reshape(k, -1)[np.arange(k), best] > 1e-12, cut, width)  # no split: all to the left

    @staticmethod
    def _next(node, binned, split) -> np.ndarray:
        feature, cut = split
        return 2 * node + (binned[np.arange(len(binned)), feature[node]] > cut[node])

    @classmethod
    def _leaf(cls, splits, binned) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        for split in splits:
            node = cls._next(node, binned, split)
        return node

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def raised(self, f: np.ndarray, binned: np.ndarray, first: int = 0) -> np.ndarray:
        """The scores f with what the trees from the first on add."""
        for splits, value in self.trees[first:]:
            f = f + value[self._leaf(splits, binned)]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raised(np.full(len(x), self.start), self._binned(x))))


class Isotonic:
    """Monotone least squares by pooling adjacent violators; between its steps linear, beyond them constant."""

    def __init__(self, s: np.ndarray, y: np.ndarray):
        levels, back = np.unique(s, return_inverse=True)
        blocks: list[list[float]] = []  # mean, weight, first, last
        for level, mean, weight in zip(levels, np.bincount(back, y) / np.bincount(back), np.bincount(back)):
            blocks.append([mean, weight, level, level])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b, a = blocks.pop(), blocks.pop()
                blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
        self.x = np.array([v for b in blocks for v in (b[2], b[3])])
        self.y = np.array([b[0] for b in blocks for _ in range(2)])

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.x, self.y)


class Sigmoid:
    """Logistic curve of the score's log-odds."""

    def __init__(self, s: np.ndarray, y: np.ndarray):
        self.fit = Logistic(self._odds(s), y)

    @staticmethod
    def _odds(s):
        s = np.clip(s, 1e-6, 1 - 1e-6)
        return np.log(s / (1 - s))[:, None]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return self.fit.score(self._odds(s))


class Estimator:
    """Imputation, scaling and a learner of a kind: logistic or gbm."""

    def __init__(self, kind: str, x: np.ndarray, y: np.ndarray, rounds: int = 2000):
        if kind not in ("logistic", "gbm"):
            raise ValueError(f"unknown estimator: {kind}")
        self.prepared = Prepared(x)
        x = self.prepared(x)
        self.model = Logistic(x, y, rounds) if kind == "logistic" else Boosted(x, y, min(rounds, Boosted.TREES))

    @classmethod
    def over(cls, prepared: Prepared, model: Logistic | Boosted) -> Estimator:
        self = cls.__new__(cls)
        self.prepared, self.model = prepared, model
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(self.prepared(x))
