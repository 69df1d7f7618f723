"""What the two searches share: vectors as bytes, and top-k over parts of queries x candidates.

A part has a bounded block of queries and a shard of candidates. Rows are dealt
out by part and sorted so that a task first sees a part's queries and then
streams its candidates by: it holds one block of queries, one chunk of
candidates and the best k so far, whatever the size of the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that are scored at once against a stretch of queries.
CHUNK, STRETCH = 4096, 128
ROW = "_part long, _kind byte, _id long, _raw binary"
FOUND = "query_id long, vec_id long, score {score}"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _vec array<double>): one row for each id whose vector has no null or non-finite component.

    Of repeated rows of one id, the smallest vector counts.
    """
    vec = F.col(vector_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"))
    return own.where(F.col("_id").isNotNull() & (F.size("_vec") > 0) & ~bad).groupBy("_id").agg(F.min("_vec").alias("_vec"))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow list column as arrays of doubles."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.value_lengths()).cumsum()
    return np.split(flat, ends[:-1]) if len(ends) else []


def batch(part: np.ndarray, kind: int, ids: np.ndarray, raw: list) -> pa.RecordBatch:
    """Rows of ROW."""
    return pa.RecordBatch.from_arrays(
        [pa.array(part.astype(np.int64)), pa.array(np.full(len(part), kind, dtype=np.int8)), pa.array(ids.astype(np.int64)), pa.array(raw, type=pa.binary())],
        names=["_part", "_kind", "_id", "_raw"])


def leaders(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of each row that score highest, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -scores, rows)) if scores.dtype != object else np.array(
        sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), dtype=np.int64)
    of = rows[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    return order[nth < k]


class Best:
    """The k best candidates so far of each query in a block."""

    def __init__(self, kernel, ids: np.ndarray, raw: list, k: int):
        self.kernel, self.ids, self.k = kernel(raw), ids, k
        self.rows, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, ids: np.ndarray, raw: list) -> None:
        chunk = self.kernel.candidates(raw)
        for start in range(0, len(self.ids), STRETCH):
            stop = min(start + STRETCH, len(self.ids))
            guess, slack = self.kernel.guesses(start, stop, chunk)
            own = self.ids[start:stop, None] == ids
            if own.any():
                guess[own] = self.kernel.worst(guess)
            if guess.shape[1] > self.k:
                least = np.partition(guess, guess.shape[1] - self.k, axis=1)[:, -self.k, None]
                rows, cols = np.nonzero((guess >= least - slack) & ~own)
            else:
                rows, cols = np.nonzero(~own)
            scores = self.kernel.scores(rows + start, cols, chunk, guess[rows, cols])
            keep = leaders(rows, scores, ids[cols], self.k)
            self.rows = np.concatenate([self.rows, rows[keep] + start])
            self.found = np.concatenate([self.found, ids[cols[keep]]])
            self.scores = scores[keep] if self.scores is None else np.concatenate([self.scores, scores[keep]])
        keep = leaders(self.rows, self.scores, self.found, self.k)
        self.rows, self.found, self.scores = self.rows[keep], self.found[keep], self.scores[keep]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.rows], self.found, self.scores


def search(dealt: DataFrame, parts: int, kernel: Callable, k: int, score: str) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of every query over all its parts.

    ``kernel(raw queries)`` scores chunks of candidates; higher scores are better.
    """
    names = ["query_id", "vec_id", "score"]
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, queries, best, held = None, ([], []), None, ([], [])

        def chunk() -> None:
            nonlocal best, held
            if held[0] and queries[0]:
                best = best or Best(kernel, np.array(queries[0], dtype=np.int64), queries[1], k)
                order = np.argsort(held[0], kind="stable")
                best.add(np.array(held[0], dtype=np.int64)[order], [held[1][i] for i in order])
            held = ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            chunk()
            if best is not None:
                q, found, scores = best.result()
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(list(scores) if scores.dtype == object else scores, type=kind)], names=names)

        for b in batches:
            for p, which, i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    yield from close()
                    part, queries, best, held = p, ([], []), None, ([], [])
                side = held if which else queries
                side[0].append(i)
                side[1].append(raw)
                if len(held[0]) == CHUNK:
                    chunk()
        yield from close()

    found = (dealt.repartition(parts, "_part").sortWithinPartitions("_part", "_kind")
             .mapInArrow(run, FOUND.format(score=score)))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k)
