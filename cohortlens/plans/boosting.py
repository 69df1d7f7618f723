"""Second-order gradient boosting over quantile bins.

Rows are turned into one byte a feature once and written to the shared folder.  A
pass over them sums gradients, Hessians and row counts of the logistic loss by
(node, feature, bin); the sums are shuffled, nothing else, and each (node, feature)
finds its best split where its sums meet.  The driver sees one candidate split for
each node and feature.

Trees grow leaf-wise: always the leaf of the largest gain is split, until
``max_leaves``.  One pass evaluates the children of all leaves that would be split
by what is known so far, so a tree takes about as many passes as it is deep, and the
result is the same as splitting one leaf at a time.

For a node with sums G and H of its rows' weighted gradients and Hessians: leaf value
-G / (H + reg_lambda), gain 1/2 (GL^2 / (HL + l) + GR^2 / (HR + l) - G^2 / (H + l))
(Chen and Guestrin 2016).  Missing values go to the side of the larger gain, learned
for each split; ties go to the smaller feature, then threshold, then missing to the left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import fresh_path

#: Bins of present values; bin 0 holds missing ones.
BINS = 64
#: Trees after which the rows' margins are written anew, so that a pass applies at most this many.
REWRITE = 10


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int  # bins 1 .. bin go left
    missing_left: bool
    left: tuple[float, float]  # sums of gradients and Hessians
    right: tuple[float, float]


@dataclass
class Tree:
    """Nodes by number, the root 0; a node without split is a leaf."""

    splits: dict[int, Split] = field(default_factory=dict)
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        at = np.zeros(len(binned), dtype=np.int64)
        for n in sorted(self.children):  # parents have smaller numbers than their children
            own = np.flatnonzero(at == n)
            s, (left, right) = self.splits[n], self.children[n]
            b = binned[own, s.feature]
            at[own] = np.where(np.where(b == 0, s.missing_left, b <= s.bin), left, right)
        return at

    def margins(self, binned: np.ndarray) -> np.ndarray:
        leaf = np.zeros(max(self.values) + 1)
        for n, v in self.values.items():
            leaf[n] = v
        return leaf[self.nodes(binned)]


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 1 + (number of edges below x) of every value, 0 where it is missing."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(e, x[:, j], side="left"))
    return out


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, feature: int, reg_lambda: float, min_child_weight: float,
               min_rows: int) -> Split | None:
    """The best split of one node by one feature from its sums by bin (bin 0: missing); None where no side may be that small."""
    total, best = (g.sum(), h.sum()), None
    whole = total[0] ** 2 / (total[1] + reg_lambda)
    for missing_left in (True, False):
        gl, hl, nl = (np.cumsum(v[1:])[:-1] + (v[0] if missing_left else 0) for v in (g, h, n))
        gr, hr, nr = total[0] - gl, total[1] - hl, n.sum() - nl
        ok = (nl >= min_rows) & (nr >= min_rows) & (hl >= min_child_weight) & (hr >= min_child_weight)
        if not ok.any():
            continue
        gain = np.where(ok, 0.5 * (gl ** 2 / np.maximum(hl + reg_lambda, 1e-300) + gr ** 2 / np.maximum(hr + reg_lambda, 1e-300) - whole), -np.inf)
        i = int(np.argmax(gain))
        if best is None or gain[i] > best.gain:
            best = Split(float(gain[i]), feature, i + 1, missing_left, (float(gl[i]), float(hl[i])), (float(gr[i]), float(hr[i])))
    return best


def plan_leaves(evaluated: dict[int, Split | None], children: dict[int, tuple[int, int]], depth: dict[int, int], max_depth: int,
                max_leaves: int, min_gain: float) -> tuple[list[int], list[int]]:
    """(nodes to split in order, those of them whose children must be evaluated before the order is sure).

    ``children`` names the children of the nodes that were split so far; those of others are unknown.
    """
    def push(n):
        s = evaluated.get(n)
        if s is not None and s.gain > min_gain:
            heapq.heappush(heap, (-s.gain, n))

    heap: list = []
    push(0)
    order, unsure = [], []
    while heap and len(order) < max_leaves - 1:
        _, n = heapq.heappop(heap)
        order.append(n)
        if n in children:
            for c in children[n]:
                push(c)
        elif depth[n] + 1 < max_depth:
            unsure.append(n)
    if len(order) == max_leaves - 1 and unsure and unsure[-1] == order[-1]:
        unsure.pop()  # the last split's children stay leaves
    return order, unsure


class HistogramBooster(Estimator):
    """Boosted trees for labels 0 and 1; the model adds ``score``, the probability of label 1.

    ``weightCol`` (optional) weighs rows: a positive-class weight or balanced class weights.  Rows with
    a label other than 0 and 1 take no part in the fit.  Missing features (null or NaN) are allowed.  A table
    without rows of both classes raises ValueError.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, maxIter: int = 50,
                 stepSize: float = 0.1, maxDepth: int = 3, max_leaves: int | None = None, reg_lambda: float = 1.0, min_gain: float = 0.0,
                 min_child_weight: float = 0.0, min_rows: int = 1, bins: int = BINS):
        super().__init__()
        if not 2 <= bins <= 254:
            raise ValueError("bins must fit in a byte: 2 to 254")
        self.featuresCol, self.labelCol, self.weightCol = featuresCol, labelCol, weightCol
        self.maxIter, self.stepSize, self.maxDepth, self.bins = maxIter, stepSize, maxDepth, bins
        self.max_leaves = max_leaves or 2 ** maxDepth
        self.reg_lambda, self.min_gain, self.min_child_weight, self.min_rows = reg_lambda, min_gain, min_child_weight, min_rows

    def _fit(self, dataset: DataFrame) -> "HistogramBoosterModel":
        weight = F.col(self.weightCol).cast("double") if self.weightCol else F.lit(1.0)
        rows = dataset.where(F.col(self.labelCol).isin(0, 1)).select(
            vector_to_array(F.col(self.featuresCol)).alias("x"), F.col(self.labelCol).cast("double").alias("y"), weight.alias("w"))
        sums = rows.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"), F.max(F.size("x")).alias("d")).first()
        if not sums["w"] or not 0 < sums["p"] < sums["w"]:
            raise ValueError("boosting needs rows of both classes")
        base = float(np.log(sums["p"] / (sums["w"] - sums["p"])))
        edges = self._edges(rows, sums["d"])
        stored = self._stored(rows.mapInPandas(_binner(edges, base), "b binary, y double, w double, m double"))
        trees: list[Tree] = []
        recent: list[Tree] = []
        for i in range(self.maxIter):
            tree = self._grow(stored, recent, sums["d"])
            if not tree.children:
                break  # no split gains anything: nor would one in the next round
            trees.append(tree)
            recent.append(tree)
            if len(recent) == REWRITE and i + 1 < self.maxIter:
                stored = self._stored(stored.mapInPandas(_mover(recent, sums["d"]), "b binary, y double, w double, m double"))
                recent = []
        return HistogramBoosterModel(self.featuresCol, base, edges, trees)

    def _edges(self, rows: DataFrame, d: int) -> list[np.ndarray]:
        """Upper edges of all bins but the last, from sketched quantiles of each feature."""
        names = [f"x{j}" for j in range(d)]
        shares = [i / self.bins for i in range(1, self.bins)]
        found = rows.select(*[F.col("x")[j].alias(c) for j, c in enumerate(names)]).approxQuantile(names, shares, 0.25 / self.bins)
        return [np.unique(np.asarray(f, dtype=np.float64)) for f in found]

    def _stored(self, rows: DataFrame) -> DataFrame:
        path = fresh_path(rows.sparkSession, "binned")
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _candidates(self, rows: DataFrame, recent: list[Tree], tree: Tree, wanted: Sequence[int], d: int) -> dict[int, Split | None]:
        """The best split of every wanted node, from one pass."""
        cells, place = self.bins + 1, {n: i for i, n in enumerate(wanted)}
        limits = (self.reg_lambda, self.min_child_weight, self.min_rows)

        def sums(batches):
            out = np.zeros((3, len(place), d, cells))
            flat = np.arange(d) * cells
            for part in batches:
                b = _bytes(part["b"], d)
                node = tree.nodes(b)
                own = np.array([place.get(n, -1) for n in range(node.max(initial=0) + 1)])[node]
                keep = own >= 0
                b, own, part = b[keep], own[keep], part[keep]
                m = part["m"].to_numpy() + sum((t.margins(b) for t in recent), np.zeros(len(b)))
                p, w = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700))), part["w"].to_numpy()
                at = (own[:, None] * (d * cells) + flat + b).ravel()
                for k, v in enumerate((w * (p - part["y"].to_numpy()), w * p * (1.0 - p), np.ones(len(b)))):
                    out[k] += np.bincount(at, np.repeat(v, d), minlength=out[k].size).reshape(out[k].shape)
            for i in range(len(place)):
                for j in range(d):
                    if out[2, i, j].any():
                        yield pd.DataFrame({"node": [wanted[i]], "feature": [j], "v": [out[:, i, j].ravel()]})

        def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((3, cells))
            for v in part["v"]:
                total += np.asarray(v).reshape(3, cells)
            s = best_split(*total, int(key[1]), *limits)
            return pd.DataFrame([] if s is None else [(key[0], s.feature, s.bin, s.missing_left, s.gain, *s.left, *s.right)],
                                columns=["node", "feature", "bin", "missing_left", "gain", "gl", "hl", "gr", "hr"])

        found = (rows.mapInPandas(sums, "node int, feature int, v array<double>").groupBy("node", "feature")
                 .applyInPandas(split, "node int, feature int, bin int, missing_left boolean, gain double, gl double, hl double, gr double, hr double"))
        best: dict[int, Split | None] = dict.fromkeys(wanted)
        for r in sorted(found.collect(), key=lambda r: (r["node"], -r["gain"], r["feature"])):
            if best[r["node"]] is None:
                best[r["node"]] = Split(r["gain"], r["feature"], r["bin"], r["missing_left"], (r["gl"], r["hl"]), (r["gr"], r["hr"]))
        return best

    def _grow(self, rows: DataFrame, recent: list[Tree], d: int) -> Tree:
        explored = Tree()  # every split tried; the tree itself is the part that the greedy order keeps
        depth, evaluated, n = {0: 0}, {}, 1
        wanted = [0]
        while True:
            evaluated.update(self._candidates(rows, recent, explored, wanted, d))
            order, unsure = plan_leaves(evaluated, explored.children, depth, self.maxDepth, self.max_leaves, self.min_gain)
            if not unsure:
                break
            wanted = []
            for parent in unsure:
                explored.splits[parent], explored.children[parent] = evaluated[parent], (n, n + 1)
                depth[n] = depth[n + 1] = depth[parent] + 1
                wanted += [n, n + 1]
                n += 2
        tree = Tree()
        number = {0: 0}
        for parent in sorted(order):  # children have larger numbers than parents
            s, left = evaluated[parent], 1 + 2 * len(tree.children)
            tree.splits[number[parent]], tree.children[number[parent]] = s, (left, left + 1)
            for c, own, sums in zip(explored.children.get(parent, (None, None)), (left, left + 1), (s.left, s.right)):
                number[c] = own
                tree.values[own] = -self.stepSize * sums[0] / max(sums[1] + self.reg_lambda, 1e-300)
            tree.values.pop(number[parent], None)
        return tree


def _bytes(column: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, d)


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.array([*column], dtype=np.float64).reshape(-1, d)


def _binner(edges: Sequence[np.ndarray], base: float):
    def run(batches):
        for part in batches:
            b = to_bins(_matrix(part["x"], len(edges)), edges)
            yield pd.DataFrame({"b": [r.tobytes() for r in b], "y": part["y"], "w": part["w"], "m": base})
    return run


def _mover(trees: Sequence[Tree], d: int):
    def run(batches):
        for part in batches:
            b = _bytes(part["b"], d)
            yield part.assign(m=part["m"].to_numpy() + sum((t.margins(b) for t in trees), np.zeros(len(b))))
    return run


class HistogramBoosterModel(Model):
    def __init__(self, featuresCol: str = "features", base: float = 0.0, edges: Sequence[np.ndarray] = (), trees: Sequence[Tree] = ()):
        super().__init__()
        self.featuresCol, self.base, self.edges, self.trees = featuresCol, base, list(edges), list(trees)

    def score(self, features: Column) -> Column:
        base, edges, trees = self.base, self.edges, self.trees

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            b = to_bins(_matrix(x, len(edges)), edges)
            m = base + sum((t.margins(b) for t in trees), np.zeros(len(b)))
            return pd.Series(1.0 / (1.0 + np.exp(-np.clip(m, -700, 700))))

        return run(features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("score", self.score(vector_to_array(F.col(self.featuresCol))))
