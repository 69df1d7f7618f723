"""Bootstrap replicates as matrices of row weights.

A replicate is a weight for every row, computed where the row lies, so B
replicates cost no copies of rows: each task turns a block of rows into a matrix
of rows x replicates and sends on B running sums only.  What is shuffled is
tasks x B numbers (and, for AUC, the rows once, to sort them by score).

Weights: row key h and replicate b give the draw p_b(h) of a random cubic
polynomial modulo 2^31 - 1 (four-wise independent hashing after Carter and
Wegman), turned into a Poisson count by its inverse distribution function.  SQL
can repeat that; see ``weights_sql``.

``poisson_draws`` takes the counts as they are (sizes vary around n).
``exact_draws`` draws exactly n rows with replacement: Poisson counts of a rate
just below 1 add up to T <= n, and given T they are T uniform draws, so n - T
more uniform draws, about 6 sqrt(n) a replicate, complete it.

Empty tables give no replicates' statistics (AUC NULL, sums 0).  Missing values
count as 0 in sums and take no part in AUC and quantiles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.hashing import HASH_BITS, portable_hash, portable_hash_sql
from cohortlens.operators.resample import row_positions
from cohortlens.session import work_dir

PRIME = (1 << 31) - 1
#: Counts above this have a chance below 2^-31.
MOST = 11
#: Standard deviations that the Poisson total of an exact replicate stays below n, and that brackets of quantiles reach out.
MARGIN = 6.0
#: Most rows and numbers of one matrix block; numbers that are hashed at once: they stay in the processor's cache.
BLOCK, NUMBERS, HASHED = 8192, 1 << 19, 1 << 15
KEY, EXTRA = "_row_key", "_extra"


@dataclass(frozen=True)
class Plan:
    """What a task needs to weigh its rows; with ``original``, column 0 of the matrix is the table as it is."""

    n_replicates: int
    seed: int
    rate: float
    original: bool = False

    @property
    def numbers(self) -> np.ndarray:
        return np.arange(0 if self.original else 1, self.n_replicates + 1)

    def coefficients(self) -> np.ndarray:
        digits = HASH_BITS // 4
        at = lambda b, k: int(hashlib.md5(f"{self.seed}|{b}|{k}".encode()).hexdigest()[:digits], 16) % PRIME
        return np.array([[at(b, k) for b in range(1, self.n_replicates + 1)] for k in range(4)], dtype=np.uint64)

    def cuts(self) -> list[int]:
        term, total, out = math.exp(-self.rate), 0.0, []
        for k in range(MOST + 1):
            total += term
            out.append(min(PRIME, math.floor(total * PRIME)))
            term *= self.rate / (k + 1)
        return out

    def blocks(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Blocks of rows with their weights, rows x replicates."""
        a, cuts = self.coefficients(), self.cuts()
        size = min(BLOCK, max(64, NUMBERS // max(1, len(self.numbers))))
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start:start + size]
                first = int(self.original)
                w = np.ones((len(part), first + a.shape[1]))
                w[:, first:] = _counts(part[KEY].to_numpy(dtype=np.uint64), a, cuts)
                extra = part[EXTRA].to_numpy()
                drawn = [i for i, e in enumerate(extra) if e is not None and len(e)] if a.shape[1] else []
                if drawn:
                    at = np.repeat(drawn, [len(extra[i]) for i in drawn])
                    np.add.at(w, (at, np.concatenate([extra[i] for i in drawn]) - 1 + first), 1.0)
                yield part, w


def _folded(x: np.ndarray, high: np.ndarray) -> None:
    """In place, a smaller number that is the same modulo 2^31 - 1."""
    np.right_shift(x, np.uint64(31), out=high)
    np.bitwise_and(x, np.uint64(PRIME), out=x)
    x += high


def _counts(h: np.ndarray, a: np.ndarray, cuts: Sequence[int]) -> np.ndarray:
    """Poisson counts, row keys x replicates.

    The polynomial's value is folded once a step (it stays below 2^33, so no product passes 64
    bits) and reduced at the end.  Counts above 3 are rare: they alone are looked up.
    """
    n, b = len(h), a.shape[1]
    out = np.empty((n, b), dtype=np.uint8)
    if not b:
        return out
    common, rare = [np.uint32(c) for c in cuts[:3]], np.array(cuts[3:], dtype=np.uint32)
    step = max(1, HASHED // b)
    number, high = np.empty((step, b), dtype=np.uint64), np.empty((step, b), dtype=np.uint64)
    for start in range(0, n, step):
        key = h[start:start + step, None]
        x, t = number[:len(key)], high[:len(key)]
        np.multiply(a[3], key, out=x)
        for k in (2, 1, 0):
            x += a[k]
            _folded(x, t)
            if k:
                x *= key
        _folded(x, t)
        np.subtract(x, np.uint64(PRIME), out=t)  # wraps around where x is reduced already
        small = np.minimum(x, t, out=x).astype(np.uint32)
        w = out[start:start + step]
        np.greater_equal(small, common[0], out=w.view(bool))
        for cut in common[1:]:
            w += small >= cut
        many = np.flatnonzero(small >= rare[0])
        if len(many):
            at = np.unravel_index(many, small.shape)
            w[at] += np.searchsorted(rare, small[at], side="right").astype(np.uint8)
    return out


def weights_sql(key: str, replicate: str, rate: str, seed: int) -> str:
    """DuckDB text of the Poisson count of a row key in a replicate."""
    a = [f"({portable_hash_sql(seed, replicate, str(k))} % {PRIME})" for k in range(4)]
    x = a[3]
    for k in (2, 1, 0):
        x = f"(({x} * {key} + {a[k]}) % {PRIME})"
    terms, cuts = [], []
    for k in range(MOST + 1):
        terms.append(f"pow({rate}, {k}) / {math.factorial(k)}.0")
        cuts.append(f"CAST({x} >= floor(exp(-({rate})) * ({' + '.join(terms)}) * {PRIME}) AS INT)")
    return " + ".join(cuts)


@dataclass(frozen=True)
class Draws:
    """Rows with their key and completing draws, and the plan that weighs them."""

    rows: DataFrame
    plan: Plan
    n: int | None = None

    def with_original(self) -> "Draws":
        return replace(self, plan=replace(self.plan, original=True))


def poisson_draws(df: DataFrame, id_col: str, n_replicates: int, seed: int = 42) -> Draws:
    """Poisson(1) weights by id: rows of one id are drawn together, a null id counts as the empty string."""
    key = portable_hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(PRIME)
    return Draws(df.withColumn(KEY, key).withColumn(EXTRA, F.lit(None).cast("array<int>")), Plan(n_replicates, seed, 1.0))


def exact_draws(df: DataFrame, id_col: str, n_replicates: int, seed: int = 42) -> Draws:
    """Replicates of exactly n draws with replacement from the n rows.

    The positions are written to the shared folder once; each row then has the
    numbers of the replicates (repeated as often as drawn) that drew it as a completing draw.
    """
    spark = df.sparkSession
    work_dir(spark)
    rows = row_positions(df, id_col).withColumn(KEY, portable_hash(seed, "_pos") % F.lit(PRIME)).checkpoint()
    n = rows.count()
    step = MARGIN / math.sqrt(n) if n else 1.0
    rate, bare = 1.0, rows.withColumn(EXTRA, F.lit(None).cast("array<int>"))
    while True:
        rate = max(0.0, rate - step)
        plan = Plan(n_replicates, seed, rate)
        totals = {r["replicate"]: int(r["n"]) for r in replicate_sums(Draws(bare, plan), {"n": F.lit(1)}).collect()}
        if n == 0 or max(totals.values()) <= n:
            break  # (a total above n, less likely than 1 in 10^8, is drawn anew at a lower rate)
    lacking = [(b, n - t) for b, t in totals.items() if t < n]
    if not lacking:
        return Draws(bare, plan, n)
    slots = spark.createDataFrame(lacking, "replicate int, lacking long").select(
        "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lacking") - 1)).alias("slot"))
    place = portable_hash(seed, F.lit("extra"), "replicate", "slot") % F.lit(n)
    extra = slots.groupBy(place.alias("_pos")).agg(F.collect_list("replicate").alias(EXTRA))
    # statistics scan the rows many times: their completing draws are hashed and joined once
    return Draws(rows.join(extra, "_pos", "left").checkpoint(), plan, n)


def exact_draws_ctes(src: str, id_col: str, n_replicates: int, seed: int, p: str) -> str:
    """DuckDB CTEs ending in {p}_draw: the rows of ``src`` with replicate and weight (twin of ``exact_draws``)."""
    return f"""{p}_n AS (SELECT count(*) AS n, greatest(0.0, 1.0 - {MARGIN} / sqrt(CAST(count(*) AS DOUBLE))) AS rate FROM {src}),
{p}_pos AS (SELECT *, row_number() OVER (ORDER BY {portable_hash_sql(0, id_col)}, {id_col}) - 1 AS pos FROM {src}),
{p}_key AS (SELECT pos, {portable_hash_sql(seed, 'pos')} % {PRIME} AS h FROM {p}_pos),
{p}_rep AS (SELECT CAST(replicate AS INT) AS replicate, {', '.join(f"{portable_hash_sql(seed, 'replicate', str(k))} % {PRIME} AS a{k}" for k in range(4))}
  FROM range(1, {n_replicates + 1}) r(replicate)),
{p}_x AS (SELECT pos, replicate, (((((a3 * h + a2) % {PRIME}) * h + a1) % {PRIME}) * h + a0) % {PRIME} AS x FROM {p}_key, {p}_rep),
{p}_cut AS (SELECT k, floor(exp(-rate) * (SELECT sum(pow(rate, i) / gamma(i + 1)) FROM range(0, k + 1) t(i)) * {PRIME}) AS cut
  FROM {p}_n, range(0, {MOST + 1}) c(k)),
{p}_cuts AS (SELECT list(cut ORDER BY k) AS cuts FROM {p}_cut),
{p}_w AS (SELECT pos, replicate, {' + '.join(f'CAST(x >= cuts[{k + 1}] AS BIGINT)' for k in range(MOST + 1))} AS w FROM {p}_x, {p}_cuts),
{p}_t AS (SELECT replicate, sum(w) AS t FROM {p}_w GROUP BY 1),
{p}_e AS (SELECT replicate, unnest(range(0, CAST(n - t AS BIGINT))) AS slot FROM {p}_t, {p}_n),
{p}_all AS (SELECT replicate, pos, w FROM {p}_w WHERE w > 0 UNION ALL
  SELECT replicate, {portable_hash_sql(seed, "'extra'", 'replicate', 'slot')} % (SELECT n FROM {p}_n), 1 FROM {p}_e),
{p}_draw AS (SELECT a.replicate, a.w, s.* FROM (SELECT replicate, pos, sum(w) AS w FROM {p}_all GROUP BY 1, 2) a JOIN {p}_pos s USING (pos))"""


# ------------------------------------------------------------------ statistics
def replicate_sums(draws: Draws, values: Mapping[str, Column]) -> DataFrame:
    """(replicate, one weighted sum for each value); a missing value counts as 0."""
    plan, names = draws.plan, list(values)
    cols = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(values.values())]
    own = [f"v{i}" for i in range(len(names))]

    def run(batches):
        total = np.zeros((len(own), len(plan.numbers)))
        for part, w in plan.blocks(batches):
            total += part[own].to_numpy(dtype=np.float64).T @ w
        yield pd.DataFrame({"replicate": plan.numbers.astype(np.int32), **dict(zip(own, total))})

    parts = draws.rows.select(KEY, EXTRA, *cols).mapInPandas(run, "replicate int, " + ", ".join(f"{c} double" for c in own))
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(n) for c, n in zip(own, names)])


class _Runs:
    """One key's sorted scores of one task: its first run of equal scores, its open last one and what lies between."""

    def __init__(self, b: int):
        self.first = self.last = None  # (score, pos, neg)
        self.mid = np.zeros((3, b))  # positives, negatives, U inside

    def add(self, scores: np.ndarray, positive: np.ndarray, w: np.ndarray) -> None:
        """The next rows: their scores, whether they are positive, and their weights, rows x replicates."""
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        ends = np.r_[starts[1:], len(scores)]
        run = lambda i: (float(scores[starts[i]]), *_sides(positive[starts[i]:ends[i]], w[starts[i]:ends[i]]))
        joined = lambda old, new: (old[0], old[1] + new[1], old[2] + new[2])
        at = 0
        if self.first is None:
            self.first, at = run(0), 1
        elif self.last is None:
            if scores[0] == self.first[0]:
                self.first, at = joined(self.first, run(0)), 1
        elif scores[0] == self.last[0]:
            self.last, at = joined(self.last, run(0)), 1
        if at == len(starts):
            return
        if self.last is not None:
            self._close()
        inner = slice(starts[at], starts[-1])
        if inner.start < inner.stop:
            self._between(starts[at:-1] - inner.start, ends[at:-1] - inner.start, positive[inner], w[inner])
        self.last = run(len(starts) - 1)

    def _between(self, starts: np.ndarray, ends: np.ndarray, positive: np.ndarray, w: np.ndarray) -> None:
        """Whole runs at once: a positive row meets the negatives below its run and half of those inside."""
        pos, before = w[positive], np.zeros((int((~positive).sum()) + 1, w.shape[1]))
        np.cumsum(w[~positive], axis=0, out=before[1:])
        negatives = np.r_[0, np.cumsum(~positive)]
        own = np.repeat(np.arange(len(starts)), ends - starts)[positive]
        low, high = negatives[starts[own]], negatives[ends[own]]
        total = pos.sum(axis=0)
        met = np.einsum("ij,ij->j", pos, before[low])
        if (low != high).any():
            met = 0.5 * (met + np.einsum("ij,ij->j", pos, before[high]))
        self.mid[2] += met + total * self.mid[1]
        self.mid[0] += total
        self.mid[1] += before[-1]

    def _close(self) -> None:
        _, pos, neg = self.last
        self.mid[2] += pos * (self.mid[1] + 0.5 * neg)
        self.mid[0] += pos
        self.mid[1] += neg

    def rows(self, key: str) -> list[tuple]:
        none = np.zeros_like(self.mid[0])
        out = [(key, self.first[0], 0, self.first[1], self.first[2], none)]
        if self.last is not None:
            out += [(key, self.first[0], 1, *self.mid), (key, self.last[0], 0, self.last[1], self.last[2], none)]
        return out


def _sides(positive: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of the positive and of the other rows."""
    pos = positive.astype(np.float64) @ w
    return pos, w.sum(axis=0) - pos


def replicate_auc(draws: Draws, score_col: str, label_col: str, key_col: str | None = None) -> DataFrame:
    """(key, replicate, auc) with tie midranks; NULL where a replicate has one class.

    The rows are sorted by (key, score) over range partitions once, a hot score over
    several of them.  Every task sends, for each key, its first and last run of equal
    scores and the rank sums between; they are put together in order of their scores.
    """
    plan, key = draws.plan, (F.col(key_col).cast("string") if key_col else F.lit(""))
    score, label = F.col(score_col).cast("double"), F.col(label_col)
    rows = (draws.rows.where(score.isNotNull() & ~F.isnan(score) & label.isNotNull())
            .select(key.alias("key"), score.alias("score"), (label == 1).cast("double").alias("y"), KEY, EXTRA))
    rows = rows.repartitionByRange("key", "score", KEY).sortWithinPartitions("key", "score")
    shape = "key string, score double, kind int, pos array<double>, neg array<double>, u array<double>"

    def run(batches):
        at, runs = None, None
        for part, w in plan.blocks(batches):
            keys, scores = part["key"].to_numpy(), part["score"].to_numpy()
            positive = part["y"].to_numpy() == 1
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(keys)]):
                if keys[s] != at:
                    if runs is not None:
                        yield pd.DataFrame(runs.rows(at), columns=["key", "score", "kind", "pos", "neg", "u"])
                    at, runs = keys[s], _Runs(w.shape[1])
                runs.add(scores[s:e], positive[s:e], w[s:e])
        if runs is not None:
            yield pd.DataFrame(runs.rows(at), columns=["key", "score", "kind", "pos", "neg", "u"])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["score", "kind"], kind="stable")
        whole = _Runs(len(plan.numbers))
        total, run_at = np.zeros((3, len(plan.numbers))), None

        def close():
            _, pos, neg = run_at
            total[2] += pos * (total[1] + 0.5 * neg)
            total[0] += pos
            total[1] += neg

        for r in b.itertuples(index=False):
            pos, neg, u = np.asarray(r.pos), np.asarray(r.neg), np.asarray(r.u)
            if r.kind == 0 and run_at is not None and run_at[0] == r.score:
                run_at = (r.score, run_at[1] + pos, run_at[2] + neg)
                continue
            if run_at is not None:
                close()
                run_at = None
            if r.kind == 0:
                run_at = (r.score, pos, neg)
            else:
                total[2] += u + pos * total[1]
                total[0] += pos
                total[1] += neg
        if run_at is not None:
            close()
        pairs = total[0] * total[1]
        auc = [float(u / p) if p > 0 else None for u, p in zip(total[2], pairs)]
        return pd.DataFrame({"key": b["key"].iloc[0], "replicate": plan.numbers.astype(np.int32), "auc": pd.Series(auc, dtype=object)})

    out = rows.mapInPandas(run, shape).groupBy("key").applyInPandas(merge, "key string, replicate int, auc double")
    return out.withColumnRenamed("key", key_col) if key_col else out.drop("key")


def replicate_auc_of_few(draws: Draws, scores: Mapping[str, Sequence[tuple[float, Column]]], label_col: str, key_col: str) -> DataFrame:
    """``replicate_auc`` of several scores at once, each of few values that come with a test which rows have them, in ascending order.

    Each row is weighed once for all of them, and weights are summed by value: replicates x values numbers reach the driver.
    """
    plan, n_keys, ends = draws.plan, len(scores), np.cumsum([0, *[2 * len(v) for v in scores.values()]])
    positive = (F.col(label_col) == 1).cast("int")
    cell = [F.coalesce(F.coalesce(*[F.when(test, F.lit(int(ends[i]) + 2 * j)) for j, (_, test) in enumerate(values)], F.lit(None)) + positive, F.lit(-1)).alias(f"c{i}")
            for i, values in enumerate(scores.values())]

    def run(batches):
        total = np.zeros((ends[-1], len(plan.numbers)))
        for part, w in plan.blocks(batches):
            for i in range(n_keys):
                c = part[f"c{i}"].to_numpy()
                order = np.argsort(c, kind="stable")
                order = order[np.count_nonzero(c < 0):]
                if len(order):
                    starts = np.flatnonzero(np.r_[True, c[order[1:]] != c[order[:-1]]])
                    total[c[order[starts]]] += np.add.reduceat(w[order], starts, axis=0)
        yield pd.DataFrame({"replicate": plan.numbers.astype(np.int32), **{f"v{i}": v for i, v in enumerate(total)}})

    parts = draws.rows.select(KEY, EXTRA, *cell).mapInPandas(run, "replicate int, " + ", ".join(f"v{i} double" for i in range(ends[-1])))
    sums = parts.groupBy("replicate").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(ends[-1])]).orderBy("replicate").toPandas()
    out = []
    for i, (key, values) in enumerate(scores.items()):
        none = np.zeros(len(sums))
        u, pos, neg, at = none.copy(), none.copy(), none.copy(), 0
        while at < len(values):
            tied = [j for j in range(at, len(values)) if values[j][0] == values[at][0]]
            n, p = (sum((sums[f"v{ends[i] + 2 * j + side}"].to_numpy() for j in tied), none) for side in (0, 1))
            u, pos, neg, at = u + p * (neg + 0.5 * n), pos + p, neg + n, at + len(tied)
        out += [(key, int(b), float(v / (m * n)) if m * n > 0 else None) for b, v, m, n in zip(sums["replicate"], u, pos, neg)]
    return draws.rows.sparkSession.createDataFrame(out, f"`{key_col}` string, replicate int, auc double")


# ------------------------------------------------------------------ quantiles
def _known(column: str) -> Column:
    return F.col(f"`{column}`").isNotNull() & ~F.isnan(F.col(f"`{column}`").cast("double"))


def values_at_ranks(draws: Draws, wanted: Mapping[int, tuple[str, np.ndarray]],
                    known_sizes: Mapping[str, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For each key (column, ranks x replicates) the column's value at these 0-based ranks of the drawn, non-missing values.

    Ranks below 0 give -inf and ranks past the end +inf.  A sketch brackets a key's ranks,
    one scan counts every replicate's weight below, at and between the bracket's ends,
    and only the values strictly between, about 6 sqrt(n) on each side, are gathered, sorted
    and searched.  Longer runs of one value cover an end of the bracket, so they aren't gathered.  A
    bracket that misses is widened.  ``known_sizes``: each column's number of non-missing values by replicate,
    where it has been counted already.
    """
    rows, plan = draws.rows, draws.plan
    cols = sorted({c for c, _ in wanted.values()})
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    sizes = known_sizes
    if sizes is None:
        counted = replicate_sums(draws, {c: _known(c) for c in cols}).orderBy("replicate").toPandas()
        sizes = {c: counted[c].to_numpy() for c in cols}
    known = rows.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    out = {k: np.where(r < 0, -np.inf, np.inf) for k, (_, r) in wanted.items()}
    open_keys = {}
    for k, (c, r) in wanted.items():
        inside = (r >= 0) & (r < sizes[c][None, :])
        if inside.any():
            open_keys[k] = inside
    reach = 1.0
    while open_keys:
        shares, n_of = {}, {c: known[f"n{i}"] for i, c in enumerate(cols)}
        err = max(1e-5, min(0.002, 1.0 / math.sqrt(max(1, *n_of.values()))))
        for k, inside in open_keys.items():
            c, r = wanted[k]
            s = (r / np.maximum(1.0, sizes[c][None, :] - 1.0))[inside]
            # fewer rows than ranks: the ends themselves
            slack = reach * (MARGIN * 0.5 / math.sqrt(n_of[c]) + 2.0 * err + 2.0 / n_of[c])
            shares[k] = (max(0.0, float(s.min()) - slack), min(1.0, float(s.max()) + slack))
        probs = sorted({p for pair in shares.values() for p in pair} | {0.0, 1.0})
        numbers = rows.select(*[value[c].alias(f"q{i}") for i, c in enumerate(cols)])
        found = numbers.approxQuantile([f"q{i}" for i in range(len(cols))], probs, err)
        at = {(c, p): q for c, qs in zip(cols, found) for p, q in zip(probs, qs)}
        ends = {k: (at[(wanted[k][0], lo)], at[(wanted[k][0], hi)]) for k, (lo, hi) in shares.items()}
        for k, (lo, hi) in shares.items():
            if lo == 0.0 or hi == 1.0:  # sketches may miss the ends; these bounds hold every value
                ends[k] = (-np.inf if lo == 0.0 else ends[k][0], np.inf if hi == 1.0 else ends[k][1])
        between = {k: (value[wanted[k][0]] > lo) & (value[wanted[k][0]] < hi) for k, (lo, hi) in ends.items()}
        tests = {}
        for k, (lo, hi) in ends.items():
            v = value[wanted[k][0]]
            tests |= {f"{k}<": v < lo, f"{k}[": v == lo, f"{k}=": between[k], f"{k}]": (v == hi) & F.lit(hi > lo)}
        counts = replicate_sums(draws, tests).orderBy("replicate").toPandas()
        search, missed = {}, {}
        for k, inside in open_keys.items():
            r, (lo, hi) = wanted[k][1], ends[k]
            below, low, mid, high = (counts[f"{k}{s}"].to_numpy()[None, :] for s in "<[=]")
            if (inside & ((r < below) | (r >= below + low + mid + high))).any():
                missed[k] = inside
                continue
            out[k] = np.where(inside & (r < below + low), lo, np.where(inside & (r >= below + low + mid), hi, out[k]))
            rest = inside & (r >= below + low) & (r < below + low + mid)
            if rest.any():
                search[k] = np.where(rest, r - below - low, -1).astype(np.int64)
        if search:
            for got in _searched(rows, plan, search, between, {k: value[wanted[k][0]] for k in search}):
                k = got["key"]
                hit = search[k][got["rank"]] >= 0
                out[k][got["rank"]] = np.where(hit, np.asarray(got["value"]), out[k][got["rank"]])
        open_keys, reach = missed, 2.0 * reach
    return out


def _searched(rows: DataFrame, plan: Plan, search: dict[int, np.ndarray], between: dict[int, Column], value: dict[int, Column]) -> list:
    """(key, rank, value array over replicates) of the ranks among the values between the bracket's ends."""
    found = F.filter(F.array(*[F.when(between[k], F.struct(F.lit(k).alias("key"), value[k].alias("value"))) for k in search]), lambda s: s.isNotNull())
    own = rows.select(KEY, EXTRA, F.explode(found).alias("_s")).select(KEY, EXTRA, "_s.key", "_s.value")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        k = int(b["key"].iloc[0])
        ranks = search[k]
        out = np.full(ranks.shape, np.nan)
        before = np.zeros(len(plan.numbers))
        for part, w in plan.blocks([b.sort_values("value", kind="stable")]):
            upto = before + np.cumsum(w, axis=0)
            values = part["value"].to_numpy()
            for i, b_at in zip(*np.nonzero((ranks >= before) & (ranks < upto[-1]))):
                out[i, b_at] = values[np.searchsorted(upto[:, b_at], ranks[i, b_at], side="right")]
            before = upto[-1]
        return pd.DataFrame({"key": k, "rank": range(len(out)), "value": [list(v) for v in out]})

    return own.groupBy("key").applyInPandas(run, "key int, rank int, value array<double>").collect()


def filled_quartiles(draws: Draws, cols: Sequence[str], sizes: np.ndarray, known_sizes: Mapping[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(medians, IQRs) of every column in every replicate, columns x replicates: the median of
    its non-missing values, and the quartile distance of the column with missing values filled by that median.

    ``sizes`` are the replicates' numbers of rows, ``known_sizes`` those of each column's non-missing values.  Without values the median is 0; an undefined or zero IQR is 1.
    """
    if known_sizes is None:
        counted = replicate_sums(draws, {c: _known(c) for c in cols}).orderBy("replicate").toPandas()
        known_sizes = {c: counted[c].to_numpy() for c in cols}
    n = np.stack([known_sizes[c] for c in cols])
    ends = lambda size, p: np.stack([np.floor(p * (size - 1)), np.ceil(p * (size - 1))])
    mix = lambda v, size, p: v[0] + (v[1] - v[0]) * (p * (size - 1) - np.floor(p * (size - 1)))
    none = n == 0
    got = values_at_ranks(draws, {i: (c, np.where(none[i], -1, ends(n[i], 0.5))) for i, c in enumerate(cols)}, known_sizes)
    med = np.stack([np.where(none[i], 0.0, mix(np.where(np.isfinite(got[i]), got[i], 0.0), n[i], 0.5)) for i in range(len(cols))])
    # the value at rank r of the filled column lies between those at r - lost and r of the bare one
    wanted = {}
    for i, c in enumerate(cols):
        for j, p in enumerate((0.25, 0.75)):
            r = ends(sizes, p)
            wanted[2 * i + j] = (c, np.concatenate([r, r - (sizes - n[i])]))
    got = values_at_ranks(draws, wanted, known_sizes)
    quart = lambda i, j: mix(np.maximum(np.minimum(got[2 * i + j][:2], med[i]), got[2 * i + j][2:]), sizes, (0.25, 0.75)[j])
    iqr = np.stack([quart(i, 1) - quart(i, 0) for i in range(len(cols))])
    return med, np.where(none | ~np.isfinite(iqr) | (iqr == 0), 1.0, iqr)
