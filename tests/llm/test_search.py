import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import learned_index, topk, vectors

ROWS = "vec_id long, embedding array<float>, label int, rank string, score int"


def table(make, matrix, first=0, extra=()):
    return make([(first + i, [float(x) for x in v], i % 3, "r", i) for i, v in enumerate(matrix)] + list(extra), ROWS)


ODD = [(9000, None, 1, None, None), (9001, [], 1, "r", 1), (9002, [1.0, None, 0.0, 0.0], 1, "r", 1), (9003, [float("nan"), 0.0, 0.0, 0.0], 1, "r", 1),
       (9004, [float("inf"), 0.0, 0.0, 0.0], 1, "r", 1), (None, [1.0, 0.0, 0.0, 0.0], 1, "r", 1)]


def brute_top(ids, matrix, step, k):
    w = np.floor(64 * matrix.astype(np.float32).astype(float)).astype(np.int64)
    out = {}
    for i, q in enumerate(ids):
        if q % step == 0:
            score = w @ w[i]
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[q] = [(int(ids[j]), int(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_top_k_is_exact_with_ties_and_many_parts(make, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (400, 4)).round(1)
    x[100:250] = x[7]  # a large group of equal vectors
    x[3] = 0
    docs = table(make, x, extra=ODD)
    want = brute_top(np.arange(400), x, 20, 20)
    assert found(topk.top_k(docs, F.col("_id") % 20 == 0)) == want
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SHARD", 90)
    monkeypatch.setattr(vectors, "CHUNK", 32)
    monkeypatch.setattr(vectors, "STRETCH", 3)
    assert found(topk.top_k(docs, F.col("_id") % 20 == 0)) == want


def test_top_k_of_few_repeated_and_huge(make):
    twice = make([(0, [0.5, 0.5], 1, "r", 1), (0, [0.5, 0.5], 1, "r", 1), (1, [1.0, 0.0], 1, "r", 1), (3, [0.0, 1.0], 1, "r", 1)], ROWS)
    assert found(topk.top_k(twice, F.col("_id") % 20 == 0)) == {0: [(1, 2048), (3, 2048)]}
    alone = make([(0, [0.5, 0.5], 1, "r", 1)], ROWS)
    assert found(topk.top_k(alone, F.col("_id") % 20 == 0)) == {}
    assert found(topk.top_k(make([], ROWS), F.col("_id") % 20 == 0)) == {}
    big = make([(0, [2.0**24, 1.0], 1, "r", 1), (1, [2.0**26, 1.0], 1, "r", 1), (2, [2.0**60, 3.0], 1, "r", 1)], ROWS)
    got = found(topk.top_k(big, F.col("_id") == 0))
    assert got == {0: [(2, 2**63 - 1), (1, 2**62 + 4096)]}


def test_bisection_is_balanced_and_finds_clusters():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (64, 5)) for c in np.eye(4, 5)])
    label = learned_index.balanced_parts(learned_index.neighbour_graph(points, 5), 4)
    assert sorted(np.bincount(label)) == [64] * 4
    assert all(len(set(label[64 * c: 64 * c + 64])) == 1 for c in range(4))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.25, (6000, 16))).astype(np.float32)
    x[2000:4000] = x[11]  # a third of all rows are equal
    return x


def test_nearest_prunes_and_reaches_the_recall(make, clustered, monkeypatch):
    monkeypatch.setattr(learned_index, "SHARD", 700)
    monkeypatch.setattr(learned_index, "QUERIES", 8)
    got = found(learned_index.nearest(table(make, clustered), F.col("_id") % 100 == 0, sample=1500))
    x, hit = clustered.astype(float), 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(len(d)), d))[:10]
        assert len(got[q]) == 10 and [s for _, s in got[q]] == pytest.approx([d[i] for i, _ in got[q]], rel=1e-12)
        assert [(s, i) for i, s in got[q]] == sorted((s, i) for i, s in got[q])
        hit += sum(s <= d[order[-1]] for _, s in got[q])
    assert hit / 600 >= 0.9
    router = learned_index.learn(clustered.astype(float)[np.random.default_rng(0).permutation(6000)[:1500]], 16)
    assert router.probes <= 8  # of 16: clusters are told apart


def test_nearest_of_few_and_odd(make):
    few = table(make, np.array([[0, 3.0], [0, 1.0], [4, 0.0], [0, 0.0]]), extra=[(r[0], r[1] and r[1][:2], *r[2:]) for r in ODD])
    assert found(learned_index.nearest(few, F.col("_id") == 0)) == {0: [(1, 2.0), (2, 5.0)]}  # the zero vector takes no part
    assert found(learned_index.nearest(make([], ROWS), F.col("_id") == 0)) == {}
    assert found(learned_index.nearest(table(make, np.ones((1, 3))), F.col("_id") == 0)) == {}
    same = table(make, np.ones((30, 3)))
    assert found(learned_index.nearest(same, F.col("_id") == 20)) == {20: [(i, 0.0) for i in range(10)]}
    assert math.isclose(found(learned_index.nearest(table(make, [[1.0, 0.0], [0.0, 1.0]]), F.col("_id") == 0))[0][0][1], math.sqrt(2))


def test_given_vectors_go_through_partitions(spark):
    """Even 500 vectors are dealt to several partitions, and recall against brute force is at least 0.9."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(learned_index.nearest(rows, F.col("_id") % 100 == 0))
    ids, x = zip(*[(r.vec_id, r.embedding) for r in rows.orderBy("vec_id").collect()])
    ids, x = np.array(ids), np.array(x, dtype=float)
    hit = n = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len({i for i, _ in got[q]} & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
        n += 10
    assert hit / n >= 0.9
    assert learned_index.partitions_for(2000, 2000) == 16 and learned_index.partitions_for(500, 500) == 8
