"""Learners for bounded batches: a histogram booster whose trees are appended, a small perceptron, a ridge."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Tree:
    """Nodes by row: feature (-1 at a leaf), threshold, children, value."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        feature, threshold, left, right = map(np.array, (self.feature, self.threshold, self.left, self.right))
        while (inner := feature[node] >= 0).any():
            at = node[inner]
            low = x[inner, feature[at]] <= threshold[at]
            node[inner] = np.where(low, left[at], right[at])
        return np.array(self.value)[node]


class Booster:
    """Gradient boosting on binned features, leaf by leaf in the order of gain; ``extend`` fits further trees to the gradients
    of all that are there, so that a model grows without being fitted anew."""

    def __init__(self, task: str, leaves: int = 31, least: int = 20, bins: int = 32):
        self.task, self.leaves, self.least, self.bins = task, leaves, least, bins
        self.trees: list[Tree] = []
        self.start = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Values, or probabilities of class 1."""
        return self.raw(x) if self.task == "regression" else sigmoid(self.raw(x))

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int, rate: float, l2: float) -> Booster:
        self.trees = []
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if self.task != "regression" else 0.0
        self.start = float(y.mean()) if self.task == "regression" else float(np.log(p / (1 - p)))
        return self.extend(x, y, trees, rate, l2)

    def extend(self, x: np.ndarray, y: np.ndarray, trees: int, rate: float, l2: float) -> Booster:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        score = self.raw(x)
        for _ in range(trees):
            if self.task == "regression":
                g, h = score - y, np.ones(len(y))
            else:
                p = sigmoid(score)
                g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            tree, leaf_rows = self._grow(codes, cuts, g, h, rate, l2)
            for node, rows in leaf_rows:
                score[rows] += tree.value[node]
            self.trees.append(tree)
        return self

    def _grow(self, codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rate: float, l2: float) -> tuple[Tree, list]:
        tree, width = Tree(), self.bins
        offset = np.arange(codes.shape[1]) * width
        usable = np.array([np.arange(width) < len(c) for c in cuts])

        def best(rows: np.ndarray) -> tuple[float, int, int]:
            if len(rows) < 2 * self.least:
                return 0.0, -1, -1
            at = (codes[rows] + offset).ravel()
            size = codes.shape[1] * width
            many = codes.shape[1]
            sums = [np.bincount(at, np.repeat(v, many), size).reshape(-1, width).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gt, ht = g[rows].sum(), h[rows].sum()
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < self.least) | (len(rows) - nl < self.least) | ~usable] = 0.0
            k = int(gain.argmax())
            return float(gain.flat[k]), k // width, k % width

        root = tree.add()
        open_ = [(best(np.arange(len(g))), root, np.arange(len(g)))]
        done = []
        while open_ and len(open_) + len(done) < self.leaves:
            k = max(range(len(open_)), key=lambda i: open_[i][0][0])
            (gain, f, b), node, rows = open_.pop(k)
            if gain <= 1e-9:
                done.append((node, rows))
                break
            low = codes[rows, f] <= b
            tree.feature[node], tree.threshold[node] = f, float(cuts[f][b])
            for side, part in (("left", rows[low]), ("right", rows[~low])):
                child = tree.add()
                getattr(tree, side)[node] = child
                open_.append((best(part), child, part))
        done += [(node, rows) for _, node, rows in open_]
        for node, rows in done:
            tree.value[node] = -rate * float(g[rows].sum() / (h[rows].sum() + l2))
        return tree, done

    def rows(self) -> list[tuple[int, int, int, float, int, int, float]]:
        """The model as table rows: tree_id, node_id, feature, threshold, left, right, value."""
        return [(t, i, *node) for t, tree in enumerate(self.trees) for i, node in enumerate(zip(tree.feature, tree.threshold, tree.left, tree.right, tree.value, strict=True))]


class Perceptron:
    """Two hidden layers, warm-started: ``extend`` goes on from the weights that are there."""

    def __init__(self, task: str, sizes: tuple[int, int] = (64, 32), seed: int = 0):
        self.task, self.sizes, self.rng, self.w = task, sizes, np.random.default_rng(seed), None

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k, (w, b) in enumerate(self.w):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if k < len(self.w) - 1 else z)
        return out

    def extend(self, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.01) -> Perceptron:
        if self.w is None:
            shape = (x.shape[1], *self.sizes, 1)
            self.w = [[self.rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)] for a, b in zip(shape[:-1], shape[1:], strict=True)]
            self.m = [[np.zeros_like(p) for p in layer] for layer in self.w]
            self.v = [[np.zeros_like(p) for p in layer] for layer in self.w]
            self.t = 0
            self.mid, self.scale = (float(y.mean()), float(y.std() + 1e-6)) if self.task == "regression" else (0.0, 1.0)
        for _ in range(rounds):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), 64):
                part = order[at : at + 64]
                layers = self._forward(x[part])
                out = layers[-1][:, 0]
                target = (y[part] - self.mid) / self.scale
                back = ((out if self.task == "regression" else sigmoid(out)) - target)[:, None] / len(part)
                self.t += 1
                for k in range(len(self.w) - 1, -1, -1):
                    grads = (layers[k].T @ back + 1e-4 * self.w[k][0], back.sum(axis=0))
                    back = (back @ self.w[k][0].T) * (layers[k] > 0)
                    for i, grad in enumerate(grads):
                        self.m[k][i] = 0.9 * self.m[k][i] + 0.1 * grad
                        self.v[k][i] = 0.999 * self.v[k][i] + 0.001 * grad**2
                        self.w[k][i] = self.w[k][i] - rate * (self.m[k][i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k][i] / (1 - 0.999**self.t)) + 1e-8)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = self._forward(x)[-1][:, 0]
        return out * self.scale + self.mid if self.task == "regression" else sigmoid(out)


class Ridge:
    """Least squares with a penalty, refitted on each batch; classes through a sigmoid of the centred score."""

    def __init__(self, task: str, l2: float = 1.0):
        self.task, self.l2 = task, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        target = y if self.task == "regression" else 2 * y - 1
        self.mid, self.top = x.mean(axis=0), float(target.mean())
        c = x - self.mid
        self.b = np.linalg.solve(c.T @ c + self.l2 * np.eye(c.shape[1]), c.T @ (target - self.top))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mid) @ self.b + self.top
        return z if self.task == "regression" else sigmoid(z)
