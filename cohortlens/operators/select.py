"""Row and column selection, schema operators.

Column decisions (drop high-missing, constant, high-cardinality) come from one
profile pass whose result is a list of names; after that the plan is a static
``select``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from cohortlens.operators.profile import category_counts_capped, min_max_equal, missing_counts


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def age_filter(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep rows whose value is in the set (missing rows go)."""
    return df.where(F.col(col).isin(list(values)))


def retention_report(original: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Per kept value: n and % of kept rows, with original size, kept size, removed and retention %.

    One grouped pass gives the per-value counts; the two totals are fitted scalars
    read off that (small, checkpointed) per-value table.
    """
    from cohortlens.session import work_dir

    work_dir(original.sparkSession)
    per = original.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    kept = F.col("value").isin(list(values))
    t = per.agg(F.sum("n").alias("o"), F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("f")).first()
    n_original, n_filtered = int(t["o"] or 0), int(t["f"] or 0)
    return per.where(kept).select(
        "value", "n",
        F.round(F.col("n") * 100.0 / F.lit(n_filtered), 6).alias("pct"),
        F.lit(n_original).cast("long").alias("n_original"), F.lit(n_filtered).cast("long").alias("n_filtered"),
        F.lit(n_original - n_filtered).cast("long").alias("n_removed"),
        F.round(F.lit(n_filtered * 100.0) / F.lit(n_original), 6).alias("retention_pct"),
    )


BLANK_PATTERN = r"^\s*$"


def blank_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Whitespace-only (or empty) strings become NULL in all (or listed) string columns."""
    targets = set(cols) if cols is not None else {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select(*[
        F.when(~_q(c).rlike(BLANK_PATTERN), _q(c)).alias(c) if c in targets else _q(c) for c in df.columns
    ])


def high_missing_columns(df: DataFrame, threshold: float = 0.30) -> list[str]:
    n, miss = missing_counts(df)
    return [c for c in df.columns if n and miss[c] / n > threshold]


def drop_high_missing(df: DataFrame, threshold: float = 0.30) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share is strictly above ``threshold``."""
    dropped = high_missing_columns(df, threshold)
    return df.drop(*dropped), dropped


def drop_constant(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns with at most one distinct non-missing value (min == max, one scan)."""
    cols = list(cols or df.columns)
    flags = min_max_equal(df, cols)
    dropped = [c for c in cols if flags[c]]
    return df.drop(*dropped), dropped


def drop_high_cardinality(df: DataFrame, max_categories: int = 20,
                          cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Drop string columns with more than ``max_categories`` distinct values."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    counts = category_counts_capped(df, list(cols), max_categories)
    dropped = [c for c in cols if counts[c] > max_categories]
    return df.drop(*dropped), dropped


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of each repeated name."""
    names = df.columns
    tmp = [f"_c{i}" for i in range(len(names))]
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(tmp[i]).alias(n))
    return df.toDF(*tmp).select(*keep)


def select_available(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Select the wanted columns that exist; report (column, status) kept/missing/excluded."""
    present = set(df.columns)
    kept = [c for c in wanted if c in present]
    status = [(c, "kept") for c in kept]
    status += [(c, "missing") for c in wanted if c not in present]
    status += [(c, "excluded") for c in df.columns if c not in set(wanted)]
    return df.select(*[_q(c) for c in kept]), status


def status_rows(df: DataFrame, status: Sequence[tuple[str, str]]) -> DataFrame:
    """The report of :func:`select_available` as rows (ordinal, column_name, status)."""
    rows = [(i + 1, c, s) for i, (c, s) in enumerate(status)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, status string")


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the listed columns that are present (absent names are ignored)."""
    return df.drop(*cols)


def replace_in_position(df: DataFrame, replaced: str, new_name: str, expr: Column,
                        drop_also: Sequence[str] = ()) -> DataFrame:
    """The new column takes the position of ``replaced``; ``drop_also`` columns go."""
    out = []
    for c in df.columns:
        if c == replaced:
            out.append(expr.alias(new_name))
        elif c not in drop_also:
            out.append(_q(c))
    return df.select(*out)


def name_rule_expr(name: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """Boolean: the name is excluded by any rule.

    rules keys: ``exact`` (whole name), ``prefix``, ``suffix``, ``contains``
    (substring anywhere) and ``token`` (a whole ``_``-separated token).
    """
    lname = F.lower(name)
    conds = [F.lit(False)]
    for v in rules.get("exact", ()):
        conds.append(lname == v.lower())
    for v in rules.get("prefix", ()):
        conds.append(lname.startswith(v.lower()))
    for v in rules.get("suffix", ()):
        conds.append(lname.endswith(v.lower()))
    for v in rules.get("contains", ()):
        conds.append(lname.contains(v.lower()))
    for v in rules.get("token", ()):
        conds.append(F.array_contains(F.split(lname, "_"), v.lower()))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def candidate_columns(names: DataFrame, rules: Mapping[str, Sequence[str]], name_col: str = "variavel") -> DataFrame:
    """Rows of a name table that no exclusion rule hits."""
    return names.where(~name_rule_expr(F.col(name_col), rules))


def name_excluded(name: str, rules: Mapping[str, Sequence[str]]) -> bool:
    """Python twin of :func:`name_rule_expr` for a schema's column names."""
    n = name.lower()
    return (any(n == v.lower() for v in rules.get("exact", ()))
            or any(n.startswith(v.lower()) for v in rules.get("prefix", ()))
            or any(n.endswith(v.lower()) for v in rules.get("suffix", ()))
            or any(v.lower() in n for v in rules.get("contains", ()))
            or any(v.lower() in n.split("_") for v in rules.get("token", ())))


def candidate_column_list(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> list[str]:
    """Same rules over ``df.columns`` (list algebra on the schema, no job)."""
    return [c for c in df.columns if not name_excluded(c, rules)]


def block_whitelist(names: DataFrame, dictionary: DataFrame, allowed_blocks: Sequence[str],
                    out_of_window: Sequence[str] = (), exclude_exact: Sequence[str] = (),
                    exclude_prefix: Sequence[str] = (), name_col: str = "variavel") -> DataFrame:
    """Names that may be candidates: their dictionary entry (exact name, the last one wins) is in an allowed
    block, they are none of ``exclude_exact``, and in lower case they neither start with one of
    ``exclude_prefix`` nor hold one of ``out_of_window`` anywhere."""
    last = dictionary.groupBy(F.col("variavel").alias("_k")).agg(F.max(F.struct("ordem", "bloco")).alias("_l"))
    name = F.col(name_col)
    keep = F.col("bloco").isin(list(allowed_blocks)) & ~name.isin(list(exclude_exact))
    for v in exclude_prefix:
        keep &= ~F.lower(name).startswith(v.lower())
    for v in out_of_window:
        keep &= ~F.lower(name).contains(v.lower())
    return names.join(last.select("_k", "_l.bloco"), name == F.col("_k")).where(keep).drop("_k")


def dictionary_first(dictionary: DataFrame) -> DataFrame:
    """One dictionary row per lower-cased name: the first by dictionary order.

    A grouped min over (ordem, descricao, bloco) with partial aggregation, so a name
    repeated in a large share of the dictionary is combined map-side.
    """
    first = dictionary.groupBy(F.lower("variavel").alias("_k")).agg(
        F.min(F.struct("ordem", "descricao", "bloco")).alias("_f"))
    return first.select("_k", "_f.descricao", "_f.bloco")


def dictionary_match(names: DataFrame, dictionary: DataFrame, name_col: str = "variavel") -> DataFrame:
    """Case-insensitive match of names to the dictionary; first description wins."""
    first = dictionary_first(dictionary)
    return names.join(first, F.lower(F.col(name_col)) == F.col("_k"), "left").drop("_k")


def feature_groups(names: DataFrame, rules: Sequence[tuple[str, str, str]], fallback: str = "other",
                   name_col: str = "feature") -> DataFrame:
    """Assign each name the group of the first matching rule (kind, pattern, group).

    kind: ``prefix`` | ``contains`` | ``exact``.  Unmatched names get ``fallback``.
    """
    lname = F.lower(F.col(name_col))
    expr = None
    for kind, pat, group in rules:
        p = pat.lower()
        cond = lname.startswith(p) if kind == "prefix" else (lname == p if kind == "exact" else lname.contains(p))
        expr = F.when(cond, group) if expr is None else expr.when(cond, group)
    expr = F.lit(fallback) if expr is None else expr.otherwise(fallback)
    return names.withColumn("group", expr)


def numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Parse to double; failures become NULL."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def binary_cast(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cast listed 0/1 float columns to int."""
    return df.withColumns({c: _q(c).cast("int") for c in cols})


def binary_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose non-missing values are exactly {0, 1} (one scan)."""
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    exprs = []
    for i, c in enumerate(cols):
        x = _q(c)
        exprs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                  F.sum((~x.isin(0, 1)).cast("long")).alias(f"o{i}")]
    if not exprs:
        return []
    row = df.agg(*exprs).first()
    return [c for i, c in enumerate(cols)
            if row[f"a{i}"] == 0 and row[f"b{i}"] == 1 and not (row[f"o{i}"] or 0)]


def detect_binary(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Find columns with exactly the values {0, 1} and cast them to int."""
    found = binary_columns(df, cols)
    return binary_cast(df, found), found


def dataset_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and the count of columns per dtype (one row per dtype)."""
    per = {}
    for f in df.schema:
        per[f.dataType.simpleString()] = per.get(f.dataType.simpleString(), 0) + 1
    items = F.array(*[F.struct(F.lit(k).alias("dtype"), F.lit(v).alias("n_cols_dtype")) for k, v in sorted(per.items())])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.explode(items).alias("d")
    ).select("n_rows", "n_cols", "d.dtype", "d.n_cols_dtype")


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (in all or the listed columns)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def missingness_partition(df: DataFrame, id_col: str, target_cols: Sequence[str]) -> dict[str, DataFrame]:
    """Split columns by 'has any missing' and build three datasets.

    complete: complete feature columns, all rows; incomplete: incomplete
    feature columns + target, complete rows; all: every column, complete rows.
    """
    n, miss = missing_counts(df)
    feats = [c for c in df.columns if c != id_col and c not in target_cols]
    complete_cols = [c for c in feats if miss[c] == 0]
    incomplete_cols = [c for c in feats if miss[c] > 0]
    tgt = list(target_cols)
    return {
        "complete": df.select(id_col, *complete_cols, *tgt),
        "incomplete": complete_cases(df.select(id_col, *incomplete_cols, *tgt)),
        "all": complete_cases(df),
        "complete_cols": complete_cols,
        "incomplete_cols": incomplete_cols,
    }


def sort_report(report: DataFrame, metric: str, id_col: str, ascending: bool = False) -> DataFrame:
    """Order a report table by metric (+ id tie-break) and number the rows.

    For report-sized tables (one row per column/feature/model).  Data-sized
    ordering should use ``orderBy`` (a distributed range sort).
    """
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    w = Window.orderBy(o, F.col(id_col).asc())
    return report.withColumn("position", F.row_number().over(w))
