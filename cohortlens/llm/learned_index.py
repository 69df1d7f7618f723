"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (``SAMPLE`` vectors by a hash of the id) is drawn. On two
   thirds of it, the graph of each vector's nearest neighbours is cut into
   equal parts: spectral bisection at the median, again and again, each cut
   mended by swapping the vectors that gain most.
2. A small network learns the part of a vector (and of its neighbours) from the
   vector. It deals out every row of the table: its likeliest partition.
3. On the last third of the sample, recall against brute force tells how many
   of the likeliest partitions a query must visit for ``TARGET``.
4. Each query is sent to those partitions and ranked there by its exact
   distances. Large partitions are cut into shards, many queries into blocks.

Nulls and edges: rows without id, and vectors that are null, empty, zero or hold
null or non-finite components, take no part, nor do those whose dimension isn't the commonest one
of the sample. Candidates with the query's own id are left out; of repeated
rows of one id the smallest vector counts. A query visits partitions enough to
meet k candidates where the table has as many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectors
from cohortlens.llm.common import written

SAMPLE, NEIGHBOURS, HIDDEN, TARGET = 6144, 10, 64, 0.95
#: The most partitions (the sample has 48 vectors for each).
MOST = 128
QUERIES, SHARD = 4096, 250_000


def neighbour_graph(points: np.ndarray, k: int) -> np.ndarray:
    """Symmetric 0/1 matrix: i and j are joined if one is among the k nearest of the other."""
    n = len(points)
    k = min(k, n - 1)
    joined = np.zeros((n, n), dtype=np.float32)
    square = (points**2).sum(axis=1)
    for at in range(0, n, 512):
        d = square - 2 * points[at: at + 512] @ points.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        if k > 0:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            joined[np.arange(at, at + len(d))[:, None], near] = 1
    return np.maximum(joined, joined.T)


def bisect(joined: np.ndarray, rng: np.random.Generator, rounds: int = 100, swaps: int = 10) -> np.ndarray:
    """Halves of a graph: True for the n // 2 vertices of one side, with few edges between."""
    n = len(joined)
    scale = 1 / np.sqrt(np.maximum(joined.sum(axis=1), 1))
    trend, v = 1 / scale / np.linalg.norm(1 / scale), rng.normal(size=n).astype(np.float32)
    for _ in range(rounds):  # second eigenvector of the lazy walk
        v = v - trend * (trend @ v)
        v = v / max(np.linalg.norm(v), 1e-12)
        v = v + scale * (joined @ (scale * v))
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v * scale, kind="stable")[: n // 2]] = True
    cut = joined[side][:, ~side].sum()
    for _ in range(swaps):
        sign = np.where(side, 1.0, -1.0).astype(np.float32)
        gain = -sign * (joined @ sign)  # edges across less edges inside
        a, b = np.nonzero(side)[0], np.nonzero(~side)[0]
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        m = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        better = side.copy()
        better[a[:m]], better[b[:m]] = False, True
        now = joined[better][:, ~better].sum()
        if m == 0 or now >= cut:
            break
        side, cut = better, now
    return side


def balanced_parts(joined: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """The part of each vertex: ``parts`` (a power of two) parts of equal size, but for one vertex."""
    label, rng = np.zeros(len(joined), dtype=np.int64), np.random.default_rng(seed)
    for level in range(int(math.log2(parts))):
        halved = 2 * label
        for p in range(1 << level):
            own = np.nonzero(label == p)[0]
            halved[own] += bisect(joined[np.ix_(own, own)], rng)
        label = halved
    return label


@dataclass
class Router:
    """A network with one hidden layer: vector to the odds of each partition (as logits)."""

    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    base: np.ndarray
    probes: int = 1

    def hidden(self, points: np.ndarray) -> np.ndarray:
        return np.maximum(points @ self.first + self.bias, 0)

    def logits(self, points: np.ndarray) -> np.ndarray:
        length = np.sqrt((points**2).sum(axis=1, keepdims=True))
        return self.hidden(points / np.maximum(length, 1e-300)) @ self.second + self.base

    def partitions(self, points: np.ndarray, n: int = 1) -> np.ndarray:
        """The n likeliest partitions of each vector."""
        return np.argsort(-self.logits(points), axis=1, kind="stable")[:, :n]


def train_router(points: np.ndarray, goals: np.ndarray, seed: int = 5, epochs: int = 40, batch: int = 128, rate: float = 0.01) -> Router:
    """Fit logits to the goals (shares of partitions) with Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    d, p = points.shape[1], goals.shape[1]
    router = Router(rng.normal(0, math.sqrt(2 / d) * 3, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, p)), np.zeros(p))
    unit = points / np.maximum(np.sqrt((points**2).sum(axis=1, keepdims=True)), 1e-300)
    names = ("first", "bias", "second", "base")
    mean = {k: np.zeros_like(getattr(router, k)) for k in names}
    power = {k: np.zeros_like(getattr(router, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for at in range(0, len(order), batch):
            x, goal = unit[order[at: at + batch]], goals[order[at: at + batch]]
            h = router.hidden(x)
            z = h @ router.second + router.base
            z = np.exp(z - z.max(axis=1, keepdims=True))
            slope = (z / z.sum(axis=1, keepdims=True) - goal) / len(x)
            back = (slope @ router.second.T) * (h > 0)
            grads = {"first": x.T @ back, "bias": back.sum(axis=0), "second": h.T @ slope, "base": slope.sum(axis=0)}
            step += 1
            for k in names:
                g = grads[k] + 1e-4 * getattr(router, k)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                power[k] = 0.999 * power[k] + 0.001 * g * g
                getattr(router, k)[...] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(power[k] / (1 - 0.999**step)) + 1e-8)
    return router


def learn(sample: np.ndarray, parts: int, k: int = 10, target: float = TARGET) -> Router:
    """Partition the neighbour graph, train the router, and set its probes by recall on vectors it hasn't seen."""
    seen = sample[: max(1, 2 * len(sample) // 3)]
    unseen = sample[len(seen):]
    joined = neighbour_graph(seen, NEIGHBOURS)
    label = balanced_parts(joined, parts)
    own = np.eye(parts)[label]
    goals = own + joined @ own / np.maximum(joined.sum(axis=1, keepdims=True), 1)
    router = train_router(seen, goals / goals.sum(axis=1, keepdims=True))
    router.probes = parts
    if parts > 1 and len(unseen) > k:
        queries = unseen[:512]
        d = (queries**2).sum(axis=1)[:, None] + (unseen**2).sum(axis=1) - 2 * queries @ unseen.T
        d[np.arange(len(queries)), np.arange(len(queries))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        home = router.partitions(unseen)[:, 0]
        visited = router.partitions(queries, parts)
        met = np.argmax(visited[:, :, None] == home[near][:, None, :], axis=1)  # at which visit a neighbour is met
        recall = [(met < m).mean() for m in range(1, parts + 1)]
        router.probes = next(m for m in range(1, parts + 1) if recall[m - 1] >= target)
    return router


class Distances:
    """Minus Euclidean distances of a block of queries."""

    def __init__(self, raw: list):
        self.q = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
        self.square = (self.q**2).sum(axis=1)

    @staticmethod
    def candidates(raw: list):
        c = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
        return c, (c**2).sum(axis=1)

    def guesses(self, start: int, stop: int, chunk):
        c, square = chunk
        guess = 2 * self.q[start:stop] @ c.T - square - self.square[start:stop, None]
        return guess, 1e-9 * (square.max() + self.square[start:stop, None])  # more than rounding can differ by

    @staticmethod
    def worst(guess: np.ndarray) -> float:
        return -np.inf

    def scores(self, rows, cols, chunk, guess):
        out = np.empty(len(rows))
        for at in range(0, len(rows), 65_536):
            some = slice(at, at + 65_536)
            out[some] = -np.sqrt(((self.q[rows[some]] - chunk[0][cols[some]]) ** 2).sum(axis=1))
        return out


def partitions_for(rows: int, taught: int) -> int:
    """About half the square root of the rows (a power of two), with 48 sample vectors or more for each."""
    return 1 << int(math.log2(max(1, min(MOST, math.sqrt(rows) / 2, taught / 48))))


def nearest(table: DataFrame, is_query: Column, k: int = 10, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding",
            sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on _id), the k nearest found and their distances."""
    points = written(vectors.usable(table, id_col, vector_col).where(F.exists("_vec", lambda x: x != 0)), "vectors")
    n = points.count()
    drawn = points.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(1_000_000.0 * min(1.0, sample / max(1, n)))).orderBy("_id").toPandas()
    sizes = drawn["_vec"].map(len)
    dimension = int(sizes.mode().iloc[0]) if len(drawn) else 1
    taught = np.stack(drawn.loc[sizes == dimension, "_vec"].tolist()).astype(float) if len(drawn) else np.ones((1, 1))
    taught = taught[np.random.default_rng(1).permutation(len(taught))]
    parts = partitions_for(n, len(taught))
    router = learn(taught, parts, k, target)
    points = points.where(F.size("_vec") == dimension)

    def deal(router: Router, probes: int, visits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                vecs = np.ascontiguousarray(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), dtype="<f8")
                chosen = router.partitions(vecs, probes if visits else 1)
                ids, raw = np.asarray(b.column(0)), [v.tobytes() for v in vecs]
                rows = np.repeat(np.arange(b.num_rows), chosen.shape[1])
                yield vectors.batch(chosen.reshape(-1), 0 if visits else 1, ids[rows], [raw[i] for i in rows])
        return run

    homes = written(points.mapInArrow(deal(router, 1, False), vectors.ROW), "homes")
    counts = {r["_part"]: r["count"] for r in homes.groupBy("_part").count().collect()}  # one row for each partition
    smallest = np.cumsum(sorted(counts.get(p, 0) for p in range(parts)))
    probes = max(router.probes, int(np.searchsorted(smallest, min(k + 1, smallest[-1]))) + 1)
    visits = written(points.where(is_query).mapInArrow(deal(router, probes, True), vectors.ROW), "visits")
    asked = {r["_part"]: r["count"] for r in visits.groupBy("_part").count().collect()}
    shards = [max(1, math.ceil(counts.get(p, 0) / SHARD)) for p in range(parts)]
    blocks = [max(1, math.ceil(asked.get(p, 0) / QUERIES)) for p in range(parts)]
    first = np.concatenate(([0], np.cumsum(np.multiply(shards, blocks)))).tolist()
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col("_part") + 1).cast("int"))
    laid = lambda rows: rows.withColumns({"_first": of(first[:-1]), "_shards": of(shards), "_blocks": of(blocks)})
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cell = lambda block, shard: F.col("_first") + block * F.col("_shards") + shard
    columns = ["_kind", "_id", "_raw"]
    asking = laid(visits).withColumn("_s", each("_shards")).select(
        cell(F.pmod(F.xxhash64("_id", F.lit(1)), F.col("_blocks")), F.col("_s")).alias("_part"), *columns)
    offered = laid(homes).withColumn("_b", each("_blocks")).select(
        cell(F.col("_b"), F.pmod(F.xxhash64("_id"), F.col("_shards"))).alias("_part"), *columns)
    found = vectors.search(asking.union(offered), first[-1], Distances, k, "double")
    return found.select("query_id", "rank", "vec_id", (-F.col("score")).alias("score"))
