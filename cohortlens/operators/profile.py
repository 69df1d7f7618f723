"""Profiling and aggregation.

Per-column statistics are fused into one aggregate over all columns (one
scan), or computed on the unpivoted (feature, value) table so that many
columns cost one shuffle.  Only fitted values and report-sized tables
(one row per column or per category) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.ranking import exact_quantiles, unpivot


def _is_missing(df: DataFrame, c: str):
    t = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if t.typeName() in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[int, dict]:
    """(row count, {column: missing count}) in one aggregate."""
    cols = list(cols or df.columns)
    exprs = [F.count(F.lit(1)).alias("__n")]
    exprs += [F.sum(_is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*exprs).first()
    return int(row["__n"]), {c: int(row[f"m{i}"] or 0) for i, c in enumerate(cols)}


def distinct_counts_df(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-missing counts for many columns: (feature, n_distinct).

    Values are unpivoted as strings and de-duplicated with one shuffle
    (map-side combine first), then counted per column.
    """
    cols = list(cols or df.columns)
    # NaN is missing in floating-point columns; the text "NaN" is a value like any other
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    own = df.select(*[(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if c in floats else F.col(f"`{c}`")).alias(c) for c in cols])
    long = unpivot(own, cols, value_type="string").where(F.col("value").isNotNull())
    pairs = long.select("feature", "value").distinct()
    counted = pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, ordinal int")
    return names.join(counted, "feature", "left").select(
        "feature", "ordinal", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct")
    )


def min_max_equal(df: DataFrame, cols: Sequence[str]) -> dict:
    """{column: True if at most one distinct non-missing value} via min == max (one scan)."""
    exprs = []
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        exprs += [F.min(col).alias(f"a{i}"), F.max(col).alias(f"b{i}")]
    row = df.agg(*exprs).first()
    return {c: (row[f"a{i}"] is None) or (row[f"a{i}"] == row[f"b{i}"]) for i, c in enumerate(cols)}


def category_counts_capped(df: DataFrame, cols: Sequence[str], cap: int) -> dict:
    """{column: number of distinct values, or cap + 1 when above cap}.

    An approximate count (HLL, one scan) settles the clearly-high columns;
    exact de-duplication only runs on the remaining low-cardinality columns.
    """
    if not cols:
        return {}
    approx = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.01).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    out, exact = {}, []
    for i, c in enumerate(cols):
        if approx[f"a{i}"] > 2 * cap + 10:
            out[c] = cap + 1
        else:
            exact.append(c)
    if exact:
        for r in distinct_counts_df(df, exact).collect():
            out[r["feature"]] = int(r["n_distinct"])
    return out


def low_card_value_counts(df: DataFrame, cols: Sequence[str], cap: int) -> dict:
    """{column: {value: count}} for string columns with at most ``cap`` categories; None above.

    One HLL scan settles the clearly-high columns; one unpivoted count pass over the
    rest returns at most about (2 cap + 10) values per column to the driver.
    """
    if not cols:
        return {}
    approx = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.01).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    low = [c for i, c in enumerate(cols) if approx[f"a{i}"] <= 2 * cap + 10]
    out: dict = {c: None for c in cols}
    if low:
        long = unpivot(df, low, value_type="string").where(F.col("value").isNotNull())
        rows = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).collect()
        counts: dict = {c: {} for c in low}
        for r in rows:
            counts[r["feature"]][r["value"]] = r["n"]
        for c in low:
            out[c] = counts[c] if len(counts[c]) <= cap else None
    return out


def _dtype_name(t) -> str:
    return t.simpleString()


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: n_missing, pct_missing, dtype, n_distinct, has_missing (one row per column).

    One scan and one shuffle: values are unpivoted as strings (float NaN turned to
    NULL first), counted per (feature, value) with map-side combine, and the
    per-feature missing and distinct counts are read off that table.  An empty
    table has a row for each column: 0 missing and distinct values, NULL percent.
    """
    cols = list(cols or df.columns)
    spark = df.sparkSession
    prepared = df.select(*[
        (F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if df.schema[c].dataType.typeName() in ("double", "float")
         else F.col(f"`{c}`")).cast("string").alias(c) for c in cols])
    long = prepared.unpivot([], cols, "feature", "value")
    pairs = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    per = pairs.groupBy("feature").agg(
        F.sum("c").alias("_n"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    meta = spark.createDataFrame([(c, i, _dtype_name(df.schema[c].dataType)) for i, c in enumerate(cols)],
                                 "feature string, ordinal int, dtype string")
    missing, distinct = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_missing", "n_distinct"))
    return meta.join(per, "feature", "left").select(
        "feature", "ordinal", "dtype",
        missing.alias("n_missing"),
        F.round(F.try_divide(missing * 100.0, F.col("_n")), 6).alias("pct_missing"),
        distinct.alias("n_distinct"),
        (missing > 0).cast("int").alias("has_missing"),
    )


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, q25, q50, q75, max per numeric column; a column without values has count 0 and NULLs."""
    long = unpivot(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    basic = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return names.join(basic, "feature", "left").join(qw, "feature", "left").select(
        "feature", F.coalesce("count", F.lit(0)).alias("count"), *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


def value_counts(df: DataFrame, col: str, include_missing: bool = True, missing_label: str = "<missing>") -> DataFrame:
    """Count and % of all rows per value; missing as its own bucket (or excluded)."""
    v = F.col(col).cast("string")
    base = df.select(F.coalesce(v, F.lit(missing_label)).alias("value") if include_missing else v.alias("value"))
    if not include_missing:
        base = base.where(F.col("value").isNotNull())
    counts = base.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()  # fitted scalar
    return counts.select("value", "n", F.round(F.col("n") * 100.0 / F.lit(total), 6).alias("pct"))


def top_k_others(df: DataFrame, col: str, k: int, others: str = "others") -> DataFrame:
    """Top-k categories by count (ties: smaller value first); the rest pooled as ``others``.

    The top k come from a distributed top-k (``orderBy().limit(k)``: k rows reach the
    driver); all other categories are relabelled in one grouped pass.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = [r[col] for r in counts.orderBy(F.desc("n"), F.asc(col)).limit(k).collect()]
    rank_map = F.create_map(*[x for i, v in enumerate(top) for x in (F.lit(v), F.lit(i + 1))]) if top else None
    in_top = F.col(col).isin(top) if top else F.lit(False)
    label = F.when(in_top, F.col(col).cast("string")).otherwise(F.lit(others))
    rank = F.when(in_top, rank_map[F.col(col)]).otherwise(F.lit(len(top) + 1)) if top else F.lit(1)
    return counts.groupBy(label.alias("category")).agg(F.sum("n").alias("n"), F.min(rank).alias("rank")).select(
        "category", F.col("n").cast("long").alias("n"), F.col("rank").cast("int").alias("rank"))


def iqr_outliers(df: DataFrame, col: str) -> DataFrame:
    """Rows outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR]: bounds, count, %, min, max.

    NaN counts as missing.  Without values (an all-missing column, an empty table)
    there are 0 outliers and all else is NULL.
    """
    q = exact_quantiles(df, [col], [0.25, 0.75]).collect()
    qd = {float(r["p"]): r["q"] for r in q}
    q1, q3 = qd.get(0.25), qd.get(0.75)
    lo, hi = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    x = F.col(col).cast("double")
    x = F.when(~F.isnan(x), x)
    bound = lambda v: F.lit(v).cast("double")
    out = F.coalesce((x < bound(lo)) | (x > bound(hi)), F.lit(False))
    n_out = F.coalesce(F.sum(out.cast("long")), F.lit(0))
    return df.agg(
        F.lit(col).alias("feature"),
        F.round(bound(q1), 6).alias("q1"), F.round(bound(q3), 6).alias("q3"),
        F.round(bound(lo), 6).alias("lower"), F.round(bound(hi), 6).alias("upper"),
        n_out.alias("n_outliers"),
        F.round(F.try_divide(n_out * 100.0, F.count(x)), 6).alias("pct_outliers"),
        F.round(F.min(F.when(out, x)), 6).alias("min_outlier"),
        F.round(F.max(F.when(out, x)), 6).alias("max_outlier"),
    )


def outlier_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, pct_outliers): percent of the values outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR], all columns in one scan."""
    fitted = {(r["feature"], float(r["p"])): r["q"] for r in exact_quantiles(df, cols, [0.25, 0.75]).collect()}
    shares = []
    for c in cols:
        q1, q3 = fitted.get((c, 0.25)), fitted.get((c, 0.75))
        x = F.col(f"`{c}`").cast("double")
        if q1 is None:
            shares.append(F.lit(None).cast("double").alias(c))
            continue
        out = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
        shares.append(F.round(F.try_divide(F.sum(out.cast("long")) * 100.0, F.count(x)), 6).alias(c))
    return df.agg(*shares).unpivot([], list(cols), "feature", "pct_outliers")


def corrected_skewness(x) -> F.Column:
    """Bias-corrected sample skewness (pandas / DuckDB): g1 * sqrt(n(n-1)) / (n-2); NULL for fewer than 3 values or without variance."""
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.min(x) < F.max(x)), F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def skewness_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: corrected skewness and bands (>1 moderate, >2 high); a column without a skewness is NULL and "low"."""
    long = unpivot(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    s = long.groupBy("feature").agg(corrected_skewness(F.col("value")).alias("skew"))
    a = F.abs("skew")
    return s.select(
        "feature", F.round("skew", 6).alias("skewness"),
        F.when(a > 2, "high").when(a > 1, "moderate").otherwise("low").alias("band"),
    )


# Fixed advice thresholds: missing-share bands (percent), few-categories limit,
# rare-category share, outlier share and skewness limit.
ADVICE_MISSING_BANDS = (1.0, 5.0, 10.0, 20.0, 25.0)
ADVICE_FEW_CATEGORIES = 5
ADVICE_RARE_SHARE = 0.01
ADVICE_OUTLIER_PCT = 5.0
ADVICE_SKEW = 1.0


def variable_advice(profile: DataFrame) -> DataFrame:
    """Rule labels over a profile table with columns
    (feature, pct_missing, n_distinct, is_binary, n_rare, pct_outliers, skewness)."""
    m = F.col("pct_missing")
    b1, b5, b10, b20, b25 = ADVICE_MISSING_BANDS
    missing_band = (
        F.when(m > b25, "missing>25%").when(m > b20, "missing>20%").when(m > b10, "missing>10%")
        .when(m > b5, "missing>5%").when(m > b1, "missing>1%").when(m > 0, "missing<=1%").otherwise("complete")
    )
    shape = (
        F.when(F.col("n_distinct") <= 1, "constant")
        .when(F.col("is_binary") == 1, "binary")
        .when(F.col("n_distinct") <= ADVICE_FEW_CATEGORIES, "few_categories")
        .otherwise("many_values")
    )
    return profile.select(
        "feature", missing_band.alias("missing_advice"), shape.alias("shape_advice"),
        F.when(F.coalesce(F.col("n_rare"), F.lit(0)) > 0, 1).otherwise(0).alias("has_rare"),
        F.when(F.coalesce(F.col("pct_outliers"), F.lit(0.0)) > ADVICE_OUTLIER_PCT, 1).otherwise(0).alias("many_outliers"),
        F.when(F.abs(F.coalesce(F.col("skewness"), F.lit(0.0))) > ADVICE_SKEW, 1).otherwise(0).alias("skewed"),
    )


def class_distribution(df: DataFrame, class_col: str, source: DataFrame | None = None,
                       source_class_col: str | None = None, kept: "F.Column | None" = None) -> DataFrame:
    """Count and % per class; with a source, also the source count and retention %.

    With ``kept`` (a row condition on ``df``) the kept table is ``df.where(kept)`` and
    both counts come from one grouped pass over ``df``.
    """
    w = Window.partitionBy()  # over the per-class table (a handful of rows)
    if kept is not None:
        g = df.groupBy(F.col(class_col).alias("class")).agg(
            F.sum(F.coalesce(kept, F.lit(False)).cast("long")).alias("n"), F.count(F.lit(1)).alias("n_source"))
        return g.select("class", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6).alias("pct"), "n_source",
                        F.round(F.col("n") * 100.0 / F.col("n_source"), 6).alias("retention_pct"))
    c = df.groupBy(F.col(class_col).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6))
    if source is None:
        return c
    s = source.groupBy(F.col(source_class_col or class_col).alias("class")).agg(F.count(F.lit(1)).alias("n_source"))
    return c.join(s, "class", "full").select(
        "class", F.coalesce("n", F.lit(0)).alias("n"), "pct",
        F.coalesce("n_source", F.lit(0)).alias("n_source"),
        F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("n_source"), 6).alias("retention_pct"),
    )


def one_active_check(df: DataFrame, indicator_cols: Sequence[str]) -> DataFrame:
    """Rows with exactly one active indicator (valid) and the rest (invalid)."""
    s = sum(F.coalesce(F.col(c), F.lit(0)) for c in indicator_cols)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((s == 1).cast("long")).alias("n_valid"),
        F.sum((s != 1).cast("long")).alias("n_invalid"),
    )


def recount_validation(source_counts: DataFrame, transformed_counts: DataFrame) -> DataFrame:
    """Join two (class, n) tables; difference and PASS/FAIL per class and a total row."""
    j = source_counts.withColumnRenamed("n", "n_source").join(
        transformed_counts.withColumnRenamed("n", "n_transformed"), "class", "full"
    )
    j = j.select(
        F.col("class").cast("string").alias("class"),
        F.coalesce("n_source", F.lit(0)).alias("n_source"),
        F.coalesce("n_transformed", F.lit(0)).alias("n_transformed"),
    )
    tot = j.agg(F.lit("TOTAL").alias("class"), F.sum("n_source").alias("n_source"), F.sum("n_transformed").alias("n_transformed"))
    both = j.unionByName(tot)
    return both.select(
        "class", "n_source", "n_transformed",
        (F.col("n_transformed") - F.col("n_source")).alias("difference"),
        F.when(F.col("n_transformed") == F.col("n_source"), "PASS").otherwise("FAIL").alias("status"),
    )


def proportion_drift(df: DataFrame, class_col: str, split_col: str, tolerance_pp: float = 0.5) -> DataFrame:
    """Class % in all rows, train and test; OK when both within ``tolerance_pp`` points of all (a part without rows: NULL, DRIFT)."""
    g = df.groupBy(F.col(class_col).alias("class")).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.sum((F.col(split_col) == "train").cast("long")).alias("n_train"),
        F.sum((F.col(split_col) == "test").cast("long")).alias("n_test"),
    )
    w = Window.partitionBy()  # per-class table
    p = g.select(
        "class",
        (F.col("n_all") * 100.0 / F.sum("n_all").over(w)).alias("pct_all"),
        F.try_divide(F.col("n_train") * 100.0, F.sum("n_train").over(w)).alias("pct_train"),
        F.try_divide(F.col("n_test") * 100.0, F.sum("n_test").over(w)).alias("pct_test"),
    )
    ok = (F.abs(F.col("pct_train") - F.col("pct_all")) <= tolerance_pp) & (F.abs(F.col("pct_test") - F.col("pct_all")) <= tolerance_pp)
    return p.select(
        "class", *[F.round(c, 6).alias(c) for c in ("pct_all", "pct_train", "pct_test")],
        F.when(ok, "OK").otherwise("DRIFT").alias("status"),
    )


def sample_preserved(df_all: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """n(train) + n(test) == n(all)."""
    tagged = (df_all.select(F.lit("all").alias("_s"))
              .unionByName(train.select(F.lit("train").alias("_s")))
              .unionByName(test.select(F.lit("test").alias("_s"))))
    j = tagged.agg(*[F.sum((F.col("_s") == k).cast("long")).alias(f"n_{k}") for k in ("all", "train", "test")])
    return j.select("n_all", "n_train", "n_test",
                    (F.col("n_train") + F.col("n_test") == F.col("n_all")).cast("int").alias("preserved"))


def target_mean_encode(df: DataFrame, cat_col: str, label_col: str, out_col: str | None = None) -> DataFrame:
    """Category -> mean of label, joined back as a score column."""
    out_col = out_col or f"{cat_col}_te"
    means = df.groupBy(cat_col).agg(F.avg(F.col(label_col).cast("double")).alias(out_col))
    return df.join(means, cat_col, "left")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-missing values with their 1-based position (distributed ordering)."""
    from cohortlens.operators.ranking import ordered_positions

    d = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return ordered_positions(d, "value").withColumn("position", (F.col("_pos") + 1).cast("int")).drop("_pos")


def group_summary(df: DataFrame, group_col: str, value_col: str, flag_col: str) -> DataFrame:
    """Per group: n, mean, max of value and count of flagged rows."""
    return df.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value_col), 6).alias("mean"),
        F.round(F.max(value_col), 6).alias("max"),
        F.sum(F.coalesce(F.col(flag_col).cast("int"), F.lit(0))).cast("long").alias("n_flagged"),
    )


def label_means(df: DataFrame, label_col: str, cols: Sequence[str]) -> DataFrame:
    """Mean of each feature per label."""
    return df.groupBy(label_col).agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in cols])


def selection_frequency(selected: DataFrame, groups: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(fold, feature) selections -> folds per feature; rank within group, first ``top`` flagged."""
    freq = selected.groupBy("feature").agg(F.countDistinct("fold").alias("n_folds"))
    if groups is not None:
        freq = freq.join(groups, "feature", "left")
    else:
        freq = freq.withColumn("group", F.lit("all"))
    w = Window.partitionBy("group").orderBy(F.desc("n_folds"), F.asc("feature"))  # feature-sized table
    r = freq.withColumn("rank", F.row_number().over(w))
    return r.select("group", "feature", "n_folds", "rank", (F.col("rank") <= top).cast("int").alias("in_top"))


def leaderboard(results: DataFrame, score_col: str = "auc") -> DataFrame:
    """Rank (model, algorithm) rows by score: per model and overall; flag best per model."""
    w_model = Window.partitionBy("model").orderBy(F.desc(score_col), F.asc("algorithm"))
    w_all = Window.orderBy(F.desc(score_col), F.asc("model"), F.asc("algorithm"))  # results-sized table
    return results.select(
        "model", "algorithm", F.round(score_col, 6).alias(score_col),
        F.row_number().over(w_model).alias("rank_in_model"),
        F.row_number().over(w_all).alias("rank_overall"),
    ).withColumn("is_best", (F.col("rank_in_model") == 1).cast("int"))


