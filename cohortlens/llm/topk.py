"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A row is sparse: its terms and their integer weights. A task turns a chunk of
candidates into posting lists (term -> candidates and weights). For each term
of its queries it scatters query weight x posting weights into dense score
arrays, then keeps each query's best k; the best of all tasks are merged. Every
query meets every candidate.

Nulls and edges: rows without id, and vectors that are null, empty or hold null
or non-finite components, take no part; a row of zeros does, and scores 0. Candidates with the
query's own id are left out; of repeated rows of one id the smallest vector
counts. Fewer than k candidates all come back. Scores are exact: 32-bit sums
where their bound allows, else 64-bit, else Python integers (kept within the
range of a long).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectors
from cohortlens.llm.common import written

#: Queries in a block; candidates in a shard (more shards than that only to keep all cores busy).
QUERIES, SHARD = 4096, 250_000
LONG = np.iinfo(np.int64)


class Accumulator:
    """Scores of a block of sparse queries (int32 terms, then int64 weights, as bytes with a count)."""

    def __init__(self, raw: list):
        self.lists, self.most, self.n = *_postings(raw), len(raw)

    def candidates(self, raw: list):
        lists, most = _postings(raw)
        return lists, most, len(raw)

    def guesses(self, start: int, stop: int, chunk) -> tuple[np.ndarray, int]:
        lists, most, n = chunk
        bound = min(self.most[1] * most[0], self.most[0] * most[1])
        kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
        width = stop - start
        scores = np.zeros((width, n), dtype=kind)
        share = np.empty_like(scores)
        for term, (rows, weights) in lists.items():
            if term not in self.lists:
                continue
            q, w = self.lists[term]
            lo, hi = np.searchsorted(q, (start, stop))
            if 2 * (hi - lo) >= width and 2 * len(rows) >= n:
                # a posting list that holds most of the chunk is added as a whole row, zeros and all
                dense, own = np.zeros(n, dtype=kind), np.zeros(width, dtype=kind)
                dense[rows], own[q[lo:hi] - start] = weights, w[lo:hi]
                np.multiply(own[:, None], dense, out=share)
                scores += share
            elif lo < hi:
                scores[np.ix_(q[lo:hi] - start, rows)] += w[lo:hi].astype(kind)[:, None] * weights.astype(kind)
        if kind is object:
            scores = np.clip(scores, LONG.min, LONG.max)
        return scores, 0

    @staticmethod
    def worst(guess: np.ndarray):
        return LONG.min if guess.dtype == object else np.iinfo(guess.dtype).min

    @staticmethod
    def scores(rows, cols, chunk, guess: np.ndarray) -> np.ndarray:
        return guess if guess.dtype == object else guess.astype(np.int64)


def pack_row(vec: np.ndarray, scale: float) -> bytes:
    """floor(scale x component) of every component, without the zeros."""
    scaled = np.floor(vec * scale)
    terms = np.nonzero(scaled)[0].astype("<i4")
    inside = np.clip(scaled[terms], -(2.0**63), np.nextafter(2.0**63, 0))
    return np.int64(len(terms)).tobytes() + terms.tobytes() + inside.astype("<i8").tobytes()


def _postings(raw: list):
    """(term -> (rows, weights), (largest weight, largest sum of weights in a row))."""
    counts = np.array([int.from_bytes(r[:8], "little") for r in raw], dtype=np.int64)
    terms = np.concatenate([np.frombuffer(r, "<i4", c, 8) for r, c in zip(raw, counts, strict=True)] or [np.zeros(0, "<i4")])
    weights = np.concatenate([np.frombuffer(r, "<i8", c, 8 + 4 * c) for r, c in zip(raw, counts, strict=True)] or [np.zeros(0, "<i8")])
    rows = np.repeat(np.arange(len(raw)), counts)
    order = np.argsort(terms, kind="stable")
    found, starts = np.unique(terms[order], return_index=True)
    by = [(rows[o], weights[o]) for o in np.split(order, starts[1:])] if len(found) else []
    size = np.abs(weights.astype(float))
    sums = np.bincount(rows, size, minlength=len(raw)) if len(raw) else np.zeros(1)
    return dict(zip(found.tolist(), by, strict=True)), (float(size.max(initial=0)), float(sums.max(initial=0)))


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on _id), its best k of all other rows."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [pack_row(v, scale) for v in vectors.rows_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, type=pa.binary())], names=["_id", "_raw"])

    rows = written(vectors.usable(table, id_col, vector_col).mapInArrow(packed, "_id long, _raw binary"), "sparse-rows")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    cores = table.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD), min(2 * cores, math.ceil(n / vectors.CHUNK)))
    blocks = max(1, math.ceil(asked / QUERIES))
    shard, block = F.pmod(F.xxhash64("_id"), F.lit(shards)), F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["_part", "_kind", "_id", "_raw"]
    asking = rows.where(is_query).withColumn("_shard", each(shards)).withColumn("_part", block * shards + F.col("_shard")).withColumn("_kind", F.lit(0).cast("byte"))
    offered = rows.withColumn("_block", each(blocks)).withColumn("_part", F.col("_block") * shards + shard).withColumn("_kind", F.lit(1).cast("byte"))
    dealt = asking.select(*columns).union(offered.select(*columns))
    return vectors.search(dealt, shards * blocks, Accumulator, k, "long").select("query_id", "rank", "vec_id", "score")
