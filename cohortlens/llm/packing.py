"""Best-fit packing by a configuration linear program over the length histogram.

1. Documents are encoded, ended with ``end_id``, and cut into pieces of at most
   ``capacity`` tokens (the first piece of a cut document takes the rest). The
   pieces are written with their place among the pieces of their length in
   their task.
2. The histogram of lengths (at most ``capacity`` rows) goes to the driver.
   Lengths of ``SMALL`` and more, rounded up to ``GRID`` tokens, make the
   configuration program: the fewest sequences whose configurations cover all
   pieces. Multiplicative weights solve it; the oracle is a knapsack dynamic
   program that fills one sequence with the most valuable classes.
3. Rounding: each configuration is used a whole number of times, with pieces
   of their true lengths and the last gap closed by the longest pieces that
   fit; what is left goes, by length, to the sequence it fits best. All of this works on runs of equal sequences,
   so its size depends on the capacity and not on the number of documents.
4. The number of a piece among all pieces of its length tells its sequence and
   offset. Numbers come from one row for each (task, length).

Nulls and edges: a null text is empty, and an empty text is its end id alone;
repeated rows are packed each; an empty table has an empty plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import written
from cohortlens.llm.encode import Encoder, batches_of

CAPACITY, END_ID = 2048, 0
#: Tokens to which the program's lengths are rounded up; pieces shorter than SMALL only fill gaps.
GRID, SMALL = 16, 256
#: Accuracy of the multiplicative weights and the most rounds they take.
EPSILON, ROUNDS = 0.2, 6000


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The written pieces: _id, piece, start, length, ids_crc32, _task, _nth (and ids, little-endian uint32)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, task, seen = Encoder.shared(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            owners, texts = b["_id"].tolist(), b["_text"].fillna("").tolist()
            done = 0
            for some in batches_of(texts):
                rows = []
                for owner, ids in zip(owners[done: done + len(some)], encoder.ids(some), strict=True):
                    raw = memoryview(np.concatenate([ids, end]).tobytes())
                    for k, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                        own = raw[4 * start: 4 * (start + length)]
                        rows.append((owner, k, start, length, zlib.crc32(own), task, seen[length], *([bytes(own)] if with_ids else [])))
                        seen[length] += 1
                done += len(some)
                out = pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32", "_task", "_nth", *(["ids"] if with_ids else [])])
                out["_id"] = out["_id"].astype(b["_id"].dtype) if b["_id"].notna().all() else pd.array(out["_id"].astype(object).where(out["_id"].notna(), None))
                yield out

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    layout = (f"_id {narrow.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _task int, _nth long"
              + (", ids binary" if with_ids else ""))
    return written(narrow.mapInPandas(run, layout), "pieces")


def fill(values: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """Knapsack by dynamic programming: how many of each class (class k takes k units, k from 1) fill ``room`` best."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for units in range(1, room + 1):
        offers = best[units - 1:: -1][: len(values)] + values[: units]
        k = int(offers.argmax())
        best[units], last[units] = (offers[k], k + 1) if offers[k] > best[units - 1] else (best[units - 1], 0)
    counts = np.zeros(len(values), dtype=np.int64)
    units = room
    while units > 0:
        if last[units]:
            counts[last[units] - 1] += 1
            units -= last[units]
        else:
            units -= 1
    return np.minimum(counts, most)


def solve(need: np.ndarray, room: int, epsilon: float = EPSILON, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """(configurations with how often to use each, a lower bound of the program): need[k - 1] pieces take k units.

    Each class has a weight that falls as it is covered. A round prices a piece
    of a class at weight / need, adds the configuration of the highest price,
    and by so much that its most covered class gains ``epsilon``.
    """
    active = need > 0
    if not active.any():
        return {}, 0.0
    covered, uses, bound = np.zeros(len(need)), defaultdict(float), 0.0
    end = np.log(max(2, active.sum())) / epsilon
    for _ in range(rounds):
        weight = np.where(active, np.exp(covered[active].min() - covered), 0.0)
        price = np.divide(weight, need, out=np.zeros(len(need)), where=active)
        config = fill(price, need, room)
        bound = max(bound, weight.sum() / max(float(config @ price), 1e-300)) if (config < need)[config > 0].all() else bound
        share = np.divide(config, need, out=np.zeros(len(need)), where=active)
        step = epsilon / share.max()
        covered += step * share
        uses[tuple(int(x) for x in config)] += step
        if covered[active].min() >= end:
            break
    least = covered[active].min()
    return {c: u / least for c, u in uses.items()} if least > 0 else dict(uses), bound


class Runs:
    """Runs of equal sequences: how many, what they hold, and how much room is left."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, count: int, held: tuple[tuple[int, int], ...]) -> None:
        if count:
            self.by_room[self.capacity - sum(n * length for n, length in held)].append((count, held))

    def best_fit(self, length: int, n: int) -> None:
        """Put n pieces of one length each where the least room stays."""
        while n:
            room = min((r for r, runs in self.by_room.items() if r >= length and runs), default=None)
            if room is None:
                each = self.capacity // length
                self.add(n // each, ((each, length),))
                if n % each:
                    self.add(1, ((n % each, length),))
                return
            count, held = self.by_room[room].pop()
            each = room // length
            full = min(count, n // each)
            self.add(full, (*held, (each, length)))
            n -= full * each
            if full < count and n and n < each:
                self.add(1, (*held, (n, length)))
                full, n = full + 1, 0
            if full < count:
                self.by_room[room].append((count - full, held))

    def all(self) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
        return [run for room in sorted(self.by_room) for run in self.by_room[room]]


def _rounded(config: list[int], left: dict[int, int], pools: dict[int, list[int]], capacity: int) -> dict[int, int] | None:
    """Pieces of true lengths for a configuration (its classes, longest first), or None where a class has run out.

    The last class only says that a piece fits there: the room that the others
    leave goes to the longest pieces that still fit.
    """
    held: dict[int, int] = defaultdict(int)
    room = capacity
    for k in config[:-1]:
        length = next((x for x in reversed(pools[k]) if left[x] > held[x]), None)
        if length is None:
            return None
        held[length] += 1
        room -= length
    lengths = pools[0]
    at = bisect_right(lengths, room)
    while at:
        length = lengths[at - 1]
        if left[length] > held[length]:
            held[length] += 1
            room -= length
            at = bisect_right(lengths, room, 0, at)
        else:
            at -= 1
    return held


def arrange(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = GRID, small: int = SMALL) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Runs (sequences, ((pieces, length), ...)) that hold every piece of the histogram once."""
    room = capacity // grid
    left = {length: n for length, n in histogram.items() if n}
    pools: dict[int, list[int]] = defaultdict(list, {0: sorted(left)})  # 0: all lengths; k: those of class k
    for length in sorted(left):
        if length >= small and -(-length // grid) <= room:
            pools[-(-length // grid)].append(length)
    need = np.array([sum(left[x] for x in pools[k]) for k in range(1, room + 1)], dtype=np.int64)
    uses, _ = solve(need, room)
    runs = Runs(capacity)
    for counts, use in sorted(uses.items(), key=lambda x: (-x[1], x[0])):
        config = [k + 1 for k in reversed(range(room)) for _ in range(counts[k])]
        times = int(use + 0.5)
        while times and (held := _rounded(config, left, pools, capacity)):
            same = min([times, *(left[length] // n for length, n in held.items())])
            for length, n in held.items():
                left[length] -= same * n
                if not left[length]:
                    for k in (0, -(-length // grid)):
                        if length in pools[k]:
                            pools[k].remove(length)
            runs.add(same, tuple((n, length) for length, n in held.items()))
            times -= same
    for length in sorted(left, reverse=True):
        runs.best_fit(length, left[length])
    return runs.all()


def places(runs: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first number, pieces in a sequence, first sequence, offset), by length and first number."""
    rows, numbered, sequence = [], defaultdict(int), 0
    for count, held in runs:
        offset = 0
        for n, length in held:
            rows.append((length, numbered[length], n, sequence, offset))
            numbered[length] += count * n
            offset += n * length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    cut = pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids)
    each = written(cut.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = places(arrange(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = cut.join(starts, ["_task", "length"]).withColumn("_number", F.col("_nth") + F.col("_start"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = shared.value
        keys = rows[:, 0] << 48 | rows[:, 1]
        for b in batches:
            length, number = b["length"].to_numpy(), b["_number"].to_numpy()
            at = rows[np.searchsorted(keys, length << 48 | number, side="right") - 1]
            nth = number - at[:, 1]
            b = b.drop(columns="_number")
            b["sequence_id"] = at[:, 3] + nth // np.maximum(at[:, 2], 1)
            b["offset"] = at[:, 4] + nth % np.maximum(at[:, 2], 1) * length
            yield b

    columns = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    chosen = numbered.select(*columns, "_number")
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_number") + ", sequence_id long, offset long"
    return chosen.mapInPandas(place, layout).withColumnRenamed("_id", id_col)
