"""Global ranks, running totals and exact quantiles without a single-task window.

A plain ``Window.orderBy(x)`` (or ``partitionBy(cls)`` with a handful of
classes) moves a whole class to one task.  Every rank here is computed in two
steps instead:

1. rows are cut into ordered *buckets* (leading bits of a uniform hash, or
   bounds from ``percentile_approx`` over the distinct sort keys);
2. a small table of per-bucket totals gives each bucket its starting offset,
   and a window partitioned by (keys, bucket) finishes the rank inside the
   bucket.

The per-bucket table has (number of groups) x (number of buckets) rows and is
the only thing that is broadcast, and only when that product is known to be
small.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.hashing import HASH_BITS
from cohortlens.session import work_dir

DEFAULT_BUCKETS = 256
SMALL_DISTINCT = 1_000_000  # per-group distinct values (tens of MB) handled by one exact aggregate / window
BROADCAST_ROW_LIMIT = 2_000_000


ROWS_PER_BUCKET = 500_000
#: Leading hash bits of the first count; groups that are too large for them take more.
HASH_BUCKET_BITS = 12


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which a NULL key meets a NULL key; the keys come from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_right_{k}" for k in keys])


def buckets_for(n_rows: int, per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = 1 << 20) -> int:
    """Power-of-two bucket count so that each bucket holds about ``per_bucket`` rows."""
    need = max(1, math.ceil(n_rows / per_bucket))
    return min(max_buckets, 1 << (need - 1).bit_length())


def ordered_positions(df: DataFrame, order_col: str, n_parts: int | None = None) -> DataFrame:
    """``_pos`` = 0-based position in ``order_col`` order for any orderable type (unique values).

    Range partitioning gives ordered buckets; the partition sizes give offsets (a
    table with one row per partition); a window inside each partition finishes
    the rank.  The partitioned rows are checkpointed so both uses see one partitioning.
    """
    spark = df.sparkSession
    if n_parts is None:
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work_dir(spark)  # checkpoint folder: the cluster's shared one, or a private one in tests
    # written once to the checkpoint folder: both uses below read the same partition ids
    part = df.repartitionByRange(n_parts, order_col).withColumn("_pid", F.spark_partition_id()).checkpoint()
    sizes = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    wi = Window.partitionBy("_pid").orderBy(order_col)
    out = part.join(F.broadcast(offs), "_pid").withColumn("_pos", F.row_number().over(wi) - 1 + F.col("_off"))
    return out.drop("_pid", "_off")


def count_below(bounds: Column, v: Column, n_bounds: int) -> Column:
    """Number of elements of the sorted array ``bounds`` that are < v, in ~2 sqrt(n) comparisons.

    Blocks of ``m`` bounds: k = number of blocks whose last bound is < v (all their
    bounds are < v), plus the count inside block k.
    """
    m = max(1, math.isqrt(max(n_bounds, 1)))
    if n_bounds <= 2 * m:
        return F.size(F.filter(bounds, lambda x: x < v))
    n_blocks = math.ceil(n_bounds / m)
    lasts = F.transform(F.sequence(F.lit(1), F.lit(n_blocks)),
                        lambda j: F.element_at(bounds, F.least(j * m, F.size(bounds))))
    k = F.size(F.filter(lasts, lambda x: x < v))
    inside = F.size(F.filter(F.slice(bounds, k * m + 1, m), lambda x: x < v))
    # k = n_blocks means every bound is < v (the last block may be partial)
    return F.least(k * m + inside, F.size(bounds))


def maybe_broadcast(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast hint only when the caller can bound the row count."""
    if row_bound is not None and row_bound <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def _bucket_offsets(bucketed: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Per (keys, bucket): exclusive running totals of value_cols over buckets."""
    agg = bucketed.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_bt_{v}") for v in value_cols])
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    out = agg
    for v in value_cols:
        out = out.withColumn(f"_off_{v}", F.coalesce(F.sum(f"_bt_{v}").over(w), F.lit(0)))
    return out


def hash_bucket(h: Column, bits: int) -> Column:
    """Bucket of a uniform ``HASH_BITS``-bit hash: its leading bits (monotone in h)."""
    return F.shiftrightunsigned(h, HASH_BITS - bits) if bits else F.lit(0).cast("bigint")


def rank_by_hash(df: DataFrame, keys: Sequence[str], hash_col: str, id_col: str, rows_per_bucket: int | None = None) -> DataFrame:
    """Add ``_pos`` = 0-based position of each row within ``keys`` ordered by (hash, id).

    Equal to ``row_number() over (partition by keys order by hash, id) - 1``; NULL
    keys are groups of their own.  ``hash_col`` must be a uniform hash of
    ``HASH_BITS`` bits.  One pass counts rows by (keys, leading bits); where the
    fullest cell is over ``rows_per_bucket``, a second one counts with as many
    more bits as it takes, so no window ever holds a large group.
    """
    limit = rows_per_bucket or ROWS_PER_BUCKET
    bits = HASH_BUCKET_BITS
    work_dir(df.sparkSession)  # the counts are read twice: they are written to the shared folder
    while True:
        cell = hash_bucket(F.col(hash_col), bits).alias("_bucket")
        counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
        fullest = counts.agg(F.max("_n")).first()[0] or 0
        if fullest <= limit or bits >= HASH_BITS - 8:
            break
        bits = min(HASH_BITS - 8, bits + max(1, math.ceil(math.log2(fullest / limit))))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = null_safe_join(df.withColumn("_bucket", hash_bucket(F.col(hash_col), bits)), starts, [*keys, "_bucket"])
    w = Window.partitionBy(*keys, "_bucket").orderBy(hash_col, id_col)
    return rows.withColumn("_pos", F.row_number().over(w) - 1 + F.col("_start")).drop("_bucket", "_start")


def counts_before(df: DataFrame, keys: Sequence[str], hash_col: str, id_col: str, tests: Mapping[str, Column],
                  rows_per_bucket: int | None = None) -> DataFrame:
    """For each test a column: how many rows within ``keys`` stand before the row by (hash, id) and pass the test (see ``rank_by_hash``)."""
    limit = rows_per_bucket or ROWS_PER_BUCKET
    bits = HASH_BUCKET_BITS
    work_dir(df.sparkSession)  # the counts are read twice: they are written to the shared folder
    while True:
        cell = hash_bucket(F.col(hash_col), bits).alias("_bucket")
        counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n"), *[
            F.count(F.when(c, 1)).alias(f"_n{i}") for i, c in enumerate(tests.values())]).checkpoint()
        fullest = counts.agg(F.max("_n")).first()[0] or 0
        if fullest <= limit or bits >= HASH_BITS - 8:
            break
        bits = min(HASH_BITS - 8, bits + max(1, math.ceil(math.log2(fullest / limit))))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in range(len(tests))])
    rows = null_safe_join(df.withColumn("_bucket", hash_bucket(F.col(hash_col), bits)), starts, [*keys, "_bucket"])
    w = Window.partitionBy(*keys, "_bucket").orderBy(hash_col, id_col).rowsBetween(Window.unboundedPreceding, -1)
    found = {name: F.count(F.when(c, 1)).over(w) + F.col(f"_start{i}") for i, (name, c) in enumerate(tests.items())}
    return rows.withColumns(found).drop("_bucket", *[f"_start{i}" for i in range(len(tests))])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value_cols: Sequence[str],
    n_buckets: int = DEFAULT_BUCKETS,
    n_groups_bound: int | None = None,
    accuracy: int = 10000,
    keep_bucket: bool = False,
) -> DataFrame:
    """Inclusive running sums ``_cum_<v>`` of value_cols ordered by order_col within keys.

    ``keep_bucket`` keeps the ``_bucket`` column (0 when the group fits one window).

    ``order_col`` must be unique within keys (aggregate to distinct sort keys
    first).  Bucket bounds are approximate percentiles of the distinct keys,
    so each bucket holds about 1/n_buckets of them whatever the row skew.
    """
    # size check: groups with few distinct sort keys finish with one window per group
    if keys:
        max_rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
    else:
        max_rows = df.count()
    if max_rows is not None and max_rows <= SMALL_DISTINCT:
        w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumns({f"_cum_{v}": F.sum(v).over(w) for v in value_cols})
        return out.withColumn("_bucket", F.lit(0)) if keep_bucket else out
    if max_rows:
        # grouped bounds use a two-level search (~2 sqrt(B) comparisons); one group uses a binary search
        cap = 16384 if keys else 65536
        n_buckets = max(n_buckets, min(cap, buckets_for(max_rows, 1_000_000, cap)))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    acc = max(accuracy, 4 * n_buckets)
    approx = F.percentile_approx(F.col(order_col).cast("double"), probs, acc).alias("_bounds")
    if keys:
        bounds = df.groupBy(*keys).agg(approx)
        # a row of bounds is n_buckets wide: the size that counts is rows x width
        wide = None if n_groups_bound is None else n_groups_bound * n_buckets
        b = null_safe_join(df, maybe_broadcast(bounds, wide), list(keys))
        b = b.withColumn("_bucket", count_below(F.col("_bounds"), F.col(order_col).cast("double"), n_buckets - 1))
        b = b.drop("_bounds")
    else:
        # one group: the bounds come back to the driver (n_buckets values) and MLlib's
        # Bucketizer places each row by binary search
        from pyspark.ml.feature import Bucketizer

        row = df.agg(approx).first()
        cuts = sorted({float(x) for x in (row["_bounds"] or []) if math.isfinite(x)})  # NaN has a bucket of its own, the last
        splits = [-math.inf] + cuts + [math.inf]
        if len(splits) < 3:
            b = df.withColumn("_bucket", F.lit(0))
        else:
            b = Bucketizer(splits=splits, inputCol="_ordd", outputCol="_bk", handleInvalid="keep").transform(
                df.withColumn("_ordd", F.col(order_col).cast("double")))
            # bucket = number of cuts <= value: monotone in the value, which is all the offsets need
            b = b.withColumn("_bucket", F.col("_bk").cast("int")).drop("_bk", "_ordd")
    offs = _bucket_offsets(b, keys, value_cols).drop(*[f"_bt_{v}" for v in value_cols])
    obound = None if n_groups_bound is None else n_groups_bound * n_buckets
    b = null_safe_join(b, maybe_broadcast(offs, obound), [*keys, "_bucket"])
    w = Window.partitionBy(*keys, "_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    for v in value_cols:
        b = b.withColumn(f"_cum_{v}", F.sum(v).over(w) + F.col(f"_off_{v}"))
    b = b.drop(*[f"_off_{v}" for v in value_cols])
    return b if keep_bucket else b.drop("_bucket")


def unpivot(df: DataFrame, cols: Sequence[str], id_cols: Sequence[str] = (), value_type: str = "double",
            name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Wide -> long (feature, value) with values cast to one type."""
    casted = df.select(*id_cols, *[F.col(c).cast(value_type).alias(c) for c in cols])
    return casted.unpivot(list(id_cols), list(cols), name_col, value_col)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    n_buckets: int = DEFAULT_BUCKETS,
    n_groups_bound: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles (``quantile_cont`` semantics) for many columns.

    Returns (by..., feature, p, q).  Missing and NaN values are ignored; a column
    without values has no rows.  Tables of at most ``SMALL_DISTINCT`` rows go
    through one shuffle of distinct (feature, value) counts.  Larger ones without
    ``by`` are answered by rank brackets (``bracket_quantiles``), which shuffle only
    the values next to the wanted ranks; with ``by`` by distinct counts, bucket
    bounds and windows inside buckets.  No task holds a whole column, and a value
    repeated in a third of all rows is one row after the first aggregation.
    """
    by = list(by)
    small = df.count() <= SMALL_DISTINCT
    if not by and not small:
        found = bracket_quantiles(df, cols, probs)
        return df.sparkSession.createDataFrame(found, "feature string, p double, q double")
    long = unpivot(df, cols, by).where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = [*by, "feature"]
    vc = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    # so few rows: Spark's exact percentile over the (value, count) table holds at most that many entries per group
    if small:
        arr = F.percentile(F.col("value"), [float(p) for p in probs], F.col("c"))
        res = vc.groupBy(*keys).agg(arr.alias("_qs"))
        pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_qs").alias("q"))
        return res.select(*keys, F.explode(pairs).alias("_z")).select(*keys, "_z.p", "_z.q")
    gb = None if (by or n_groups_bound) else len(cols)
    if n_groups_bound is not None:
        gb = n_groups_bound * len(cols)
    ranked = running_totals(vc, keys, "value", ["c"], n_buckets=n_buckets, n_groups_bound=gb, keep_bucket=True)
    ranked = ranked.withColumn("_start", F.col("_cum_c") - F.col("c")).withColumn("_end", F.col("_cum_c") - 1)
    # rank range of each bucket (groups x buckets rows): lets every target find its bucket first
    ranges = ranked.groupBy(*keys, "_bucket").agg(F.min("_start").alias("_bs"), F.max("_end").alias("_be"))
    totals = vc.groupBy(*keys).agg(F.sum("c").alias("_n"))
    pdf = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    targets = totals.select(*keys, "_n", pdf).withColumn("_pos", F.col("p") * (F.col("_n") - 1))
    targets = targets.select(
        *keys, "p", (F.col("_pos") - F.floor("_pos")).alias("_frac"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("_which"), F.floor("_pos").cast("bigint").alias("_rank")),
            F.struct(F.lit(1).alias("_which"), F.ceil("_pos").cast("bigint").alias("_rank")),
        )).alias("_t"),
    ).select(*keys, "p", "_frac", "_t._which", "_t._rank")
    tb = None if gb is None else gb * len(probs) * 2
    targets = null_safe_join(targets, ranges, keys).where(
        (F.col("_rank") >= F.col("_bs")) & (F.col("_rank") <= F.col("_be"))).drop("_bs", "_be")
    # each distinct value meets only the (at most 2 x probs) targets that fall in its own bucket
    hit = null_safe_join(ranked, maybe_broadcast(targets, tb), [*keys, "_bucket"]).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") <= F.col("_end"))
    )
    res = hit.groupBy(*keys, "p").agg(
        F.max(F.when(F.col("_which") == 0, F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("_which") == 1, F.col("value"))).alias("_hi"),
        F.first("_frac").alias("_frac"),
    )
    return res.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("q"))


#: Accuracy of the sketches that bracket a rank (their error is 1 / accuracy of the rows), values of a bracket that one task
#: may rank, and columns of one scan.
SKETCH_ACCURACY, BRACKET_ROWS, SCAN_COLUMNS = 2000, 1_000_000, 40


def bracket_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int | None = None,
                      limit: int | None = None) -> list[tuple[str, float, float]]:
    """(feature, p, q): exact interpolated quantiles of a large table by rank brackets.

    1. One scan sketches every column around the wanted ranks, which gives each
       a bracket of two values.
    2. One scan counts the values below and inside each bracket.  A bracket that
       misses its ranks is widened; one that still holds more than ``limit`` values
       is sketched again inside and narrowed.
    3. Only the values inside are counted by value, shuffled and ranked: about
       8 / accuracy of the rows for each quantile, a value that is repeated once
       for each task.

    The driver holds two numbers for each (column, p).  Nulls and NaN take no part;
    a column without values has no rows.
    """
    accuracy, limit = accuracy or SKETCH_ACCURACY, limit or BRACKET_ROWS
    found: list[tuple[str, float, float]] = []
    for at in range(0, len(cols), SCAN_COLUMNS):
        found += _brackets(df, list(cols[at: at + SCAN_COLUMNS]), [float(p) for p in probs], accuracy, limit)
    return found


def _brackets(df: DataFrame, cols: list[str], probs: list[float], accuracy: int, limit: int) -> list[tuple[str, float, float]]:
    def value(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x)

    def sketch(x: Column, shares: list[float]) -> Column:
        return F.percentile_approx(x, [min(1.0, max(0.0, v)) for v in shares], accuracy)

    margin = 2.0 / accuracy
    first = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(value(c)).alias(f"n{i}"), sketch(value(c), [v for p in probs for v in (p - margin, p + margin)]).alias(f"s{i}"))]).first()
    # of each (column, p): the two ranks, the bracket, values below and inside it
    state = []
    for i, c in enumerate(cols):
        n = first[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            pos = p * (n - 1)
            state.append({"col": c, "p": p, "lo_rank": math.floor(pos), "hi_rank": math.ceil(pos), "frac": pos - math.floor(pos), "n": n,
                          "low": -math.inf, "high": math.inf, "below": 0, "inside": n, "margin": margin,
                          "try": (first[f"s{i}"][2 * j], first[f"s{i}"][2 * j + 1])})
    while todo := [s for s in state if "try" in s]:
        counted = df.agg(*[e for k, s in enumerate(todo) for e in (
            F.count(F.when(value(s["col"]) < F.lit(s["try"][0]), 1)).alias(f"b{k}"),
            F.count(F.when(value(s["col"]).between(F.lit(s["try"][0]), F.lit(s["try"][1])), 1)).alias(f"i{k}"))]).first()
        again = []
        for k, s in enumerate(todo):
            (low, high), below, inside = s.pop("try"), counted[f"b{k}"], counted[f"i{k}"]
            if below <= s["lo_rank"] and s["hi_rank"] < below + inside:
                stuck = inside >= s["inside"]
                s |= {"low": low, "high": high, "below": below, "inside": inside}
                if inside <= limit or low == high or stuck:
                    continue
            else:
                s["margin"] *= 4  # missed: look wider
                if s["margin"] > 1:
                    continue  # the bracket it had holds the ranks
            again.append(s)
        if again:
            inner = df.agg(*[sketch(F.when(value(s["col"]).between(F.lit(s["low"]), F.lit(s["high"])), value(s["col"])),
                                    [(s["lo_rank"] - s["below"]) / s["inside"] - s["margin"], (s["hi_rank"] + 1 - s["below"]) / s["inside"] + s["margin"]])
                             .alias(f"s{k}") for k, s in enumerate(again)]).first()
            for k, s in enumerate(again):
                s["try"] = (inner[f"s{k}"][0], inner[f"s{k}"][1])
    out = [(s["col"], s["p"], s["low"]) for s in state if s["low"] == s["high"]]
    rest = [s for s in state if s["low"] != s["high"]]
    if rest:
        out += _ranked_inside(df, rest, value)
    return out


def _ranked_inside(df: DataFrame, brackets: list[dict], value) -> list[tuple[str, float, float]]:
    """The quantiles from the values inside the brackets, counted by value."""
    inside = F.array(*[F.when(value(s["col"]).between(F.lit(s["low"]), F.lit(s["high"])), F.struct(F.lit(k).alias("k"), value(s["col"]).alias("value")))
                       for k, s in enumerate(brackets)])
    counts = (df.select(F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("_x")).select("_x.k", "_x.value")
              .groupBy("k", "value").agg(F.count(F.lit(1)).alias("c")))
    upto = Window.partitionBy("k").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = df.sparkSession.createDataFrame([(k, s["lo_rank"] - s["below"], s["hi_rank"] - s["below"]) for k, s in enumerate(brackets)],
                                            "k int, _lo long, _hi long")  # one row for each (column, p)
    ranked = counts.withColumn("_end", F.sum("c").over(upto)).join(F.broadcast(ranks), "k")
    at = lambda r: (F.col(r) < F.col("_end")) & (F.col(r) >= F.col("_end") - F.col("c"))
    rows = ranked.groupBy("k").agg(F.max(F.when(at("_lo"), F.col("value"))).alias("lo"), F.max(F.when(at("_hi"), F.col("value"))).alias("hi")).collect()
    return [(brackets[r["k"]]["col"], brackets[r["k"]]["p"], r["lo"] + (r["hi"] - r["lo"]) * brackets[r["k"]]["frac"]) for r in rows]


def quantile_dict(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """Fitted quantiles as {(feature, p): q}; result size is len(cols) x len(probs)."""
    rows = exact_quantiles(df, cols, probs).collect()
    out = {(c, float(p)): None for c in cols for p in probs}
    for r in rows:
        out[(r["feature"], float(r["p"]))] = r["q"]
    return out
