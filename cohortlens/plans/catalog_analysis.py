"""Registered queries for joins, profiling, splits/resampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.hashing import portable_hash_sql
from cohortlens.operators import align, metrics, profile, recode, replicates, resample, select
from cohortlens.operators.ranking import unpivot
from cohortlens.plans import fixtures as fx
from cohortlens.plans.registry import query
from cohortlens.sources.tables import load, survey


# ------------------------------------------------------------------ SQL helpers
def auc_ctes(src: str, keys: list[str], p: str, w: str = "1") -> str:
    """CTEs {p}_cnt, {p}_cum, {p}_auc computing grouped AUC from (keys, score, label) rows of ``src``
    (each row counted with weight ``w``)."""
    k = ", ".join(keys)
    return f"""{p}_cnt AS (SELECT {k}, CAST(score AS DOUBLE) AS score, sum(CAST({w} AS DOUBLE) * CAST(label AS DOUBLE)) AS pos,
  sum(CAST({w} AS DOUBLE) * (1 - CAST(label AS DOUBLE))) AS neg FROM {src} WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
{p}_cum AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {p}_cnt),
{p}_auc AS (SELECT {k}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  sum(pos * (nb + 0.5 * neg)) AS u1, sum((pos + neg) * (pos + neg) * (pos + neg) - (pos + neg)) AS tie FROM {p}_cum GROUP BY {k})"""


def long_sql(src: str, feats: list[str], extra: list[str]) -> str:
    ex = ", ".join(extra)
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS score, {ex} FROM {src}" for f in feats)


#: Two-sided 95 % Student-t quantiles of 1 to 4 degrees of freedom, from published tables (fixed values).
T_TABLE = {1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 4: 2.7764451052}


def t_values_sql() -> str:
    vals = ", ".join(f"({d}, {t!r})" for d, t in T_TABLE.items())
    return f"tv AS (SELECT * FROM (VALUES {vals}) t(df, t))"


def erfc_sql(x: str) -> str:
    coeffs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1.0 / (1.0 + 0.5 * abs({x})))"
    poly = f"CAST({coeffs[-1]} AS DOUBLE)"
    for c in reversed(coeffs[:-1]):
        poly = f"(CAST({c} AS DOUBLE) + {t} * {poly})"
    ans = f"({t} * exp(-abs({x}) * abs({x}) + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


# ------------------------------------------------------------------ Spark helpers
AUC_FEATS = ["x1", "x2", "peso1", "peso2"]


def fold_auc(spark, sf, feats, extra_keys=()):
    f = fx.folds(spark, sf)
    long = unpivot(f, feats, ["label", "fold", *extra_keys], "double", "feature", "score")
    return metrics.roc_auc(long, "score", "label", [*extra_keys, "feature", "fold"])


FOLD_AUC_CTE = (fx.FOLDS_CTE + ", fl AS (" + long_sql("folds", AUC_FEATS, ["label", "fold"]) + "), "
                + auc_ctes("fl", ["feature", "fold"], "fa"))
SEG_FOLD_AUC_CTE = (fx.FOLDS_CTE + ", sfl AS (" + long_sql("folds", ["x1", "x2"], ["label", "fold", "segmento"]) + "), "
                    + auc_ctes("sfl", ["segmento", "feature", "fold"], "sfa"))


# ======================================================================== 2.4 joins
@query("left_join_feature", """
SELECT s.id_anon, s.x1, f.x2k FROM survey s LEFT JOIN (SELECT id_anon, x2 / 1000 AS x2k FROM survey WHERE prenatal = 'Sim') f
ON s.id_anon = f.id_anon""")
def q_left_join_feature(spark, sf):
    s = survey(spark, sf)
    feat = s.where(F.col("prenatal") == "Sim").select("id_anon", (F.col("x2") / 1000).alias("x2k"))
    return align.left_join_feature(s.select("id_anon", "x1"), feat, "id_anon")


@query("inner_join_ids", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT id_anon FROM survey WHERE prenatal IS NOT NULL)""")
def q_inner_join_ids(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    ids = survey(spark, sf).where(F.col("prenatal").isNotNull()).select(F.col("id_anon").alias("l_orderkey"))
    return align.inner_join_ids(li, ids, "l_orderkey")


@query("align_lookup", f"""
WITH {fx.LABELLED_CTE}
SELECT lab.id_anon, lab.label, o.o_orderstatus, o.o_totalprice FROM lab JOIN orders o ON lab.id_anon = o.o_orderkey
WHERE lab.prenatal IS NOT NULL AND lab.semanas IS NOT NULL""")
def q_align_lookup(spark, sf):
    model = fx.labelled(spark, sf).where(F.col("prenatal").isNotNull() & F.col("semanas").isNotNull()).select("id_anon", "label")
    raw = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id_anon"), "o_orderstatus", "o_totalprice")
    return align.align_lookup(model, raw, "id_anon")


@query("label_lookup", f"""
WITH {fx.DICT_FIRST_SQL}, names AS ({fx.USED_NAMES_SQL} UNION SELECT DISTINCT p_type FROM part)
SELECT n.variavel, COALESCE(d.descricao, n.variavel) AS label FROM names n LEFT JOIN dfirst d ON lower(n.variavel) = d.k""",
       survey_cte=False)
def q_label_lookup(spark, sf):
    names = fx.used_names(spark, sf).union(load(spark, sf, "part").select(F.col("p_type").alias("variavel"))).distinct()
    return align.label_lookup(names, select.dictionary_first(fx.dictionary(spark, sf)))


@query("union_rows", f"WITH {fx.FOLDS_CTE} SELECT id_anon, fold, label FROM folds")
def q_union_rows(spark, sf):
    f = fx.folds(spark, sf).select("id_anon", "fold", "label")
    return align.union_rows(f.where("fold = 0"), f.where("fold <> 0"))


@query("concat_columns", """
SELECT id_anon, x1, x2, CAST(COALESCE(zimc <= -2, false) AS INT) AS desnutrido, CAST(COALESCE(zimc > 3, false) AS INT) AS obeso
FROM survey""")
def q_concat_columns(spark, sf):
    s = survey(spark, sf)
    bins = recode.bin_indicators(s.select("id_anon", "zimc"), "zimc").select("id_anon", "desnutrido", "obeso")
    return align.concat_columns(s.select("id_anon", "x1", "x2"), bins, "id_anon")


@query("union_ids", "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'de'", survey_cte=False)
def q_union_ids(spark, sf):
    return align.union_ids(load(spark, sf, "labels").select("doc_id"),
                           load(spark, sf, "documents").where(F.col("lang") == "de").select("doc_id"))


@query("id_overlap", f"""
WITH {fx.SPLIT_CTE}
SELECT (SELECT count(*) FROM splitted WHERE split = 'train') AS n_train_ids,
  (SELECT count(*) FROM splitted WHERE split = 'test') AS n_test_ids,
  (SELECT count(*) FROM splitted a JOIN splitted b USING (id_anon) WHERE a.split = 'train' AND b.split = 'test') AS n_overlap""")
def q_id_overlap(spark, sf):
    s = fx.split(spark, sf).select("id_anon", "split")
    return align.id_overlap(s.where("split = 'train'"), s.where("split = 'test'"), "id_anon")


@query("id_overlap_leaky", """
WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT doc_id FROM documents WHERE lang = 'de')
SELECT (SELECT count(*) FROM a) AS n_train_ids, (SELECT count(*) FROM b) AS n_test_ids,
  (SELECT count(*) FROM a JOIN b USING (doc_id)) AS n_overlap""", survey_cte=False)
def q_id_overlap_leaky(spark, sf):
    """Two sets that do share ids: the check has to find them."""
    return align.id_overlap(load(spark, sf, "labels").select("doc_id"),
                            load(spark, sf, "documents").where(F.col("lang") == "de").select("doc_id"), "doc_id")


@query("column_set_difference", f"""
WITH {fx.DICT_LAST_SQL}
SELECT variavel FROM ({fx.CASED_NAMES_SQL})
EXCEPT SELECT u.variavel FROM ({fx.CASED_NAMES_SQL}) u JOIN dlast d ON u.variavel = d.variavel
WHERE d.bloco IN ({', '.join(repr(b) for b in fx.ALLOWED_BLOCKS)}) AND {fx.WHITELIST_RULES_SQL}""", survey_cte=False)
def q_column_set_difference(spark, sf):
    names = fx.cased_names(spark, sf)
    kept = select.block_whitelist(names, fx.dictionary(spark, sf), fx.ALLOWED_BLOCKS, **fx.WHITELIST_RULES)
    return align.column_set_difference(names, kept, "variavel")


# ======================================================================== 2.5 profiling
def _mp_sql(src: str, cols: list[str], types: dict) -> str:
    parts = []
    for i, c in enumerate(cols):
        miss = f"count(*) FILTER (WHERE {c} IS NULL)"
        parts.append(
            f"SELECT '{c}' AS feature, {i} AS ordinal, '{types[c]}' AS dtype, {miss} AS n_missing, "
            f"round({miss} * 100.0 / count(*), 6) AS pct_missing, count(DISTINCT {c}) AS n_distinct, "
            f"CAST({miss} > 0 AS INT) AS has_missing FROM {src}")
    return " UNION ALL ".join(parts)


@query("missing_profile", f"WITH b AS (SELECT {fx.survey_blank_select_sql()} FROM survey) "
       + _mp_sql("b", fx.SURVEY_COLS, fx.SURVEY_TYPES))
def q_missing_profile(spark, sf):
    return profile.missing_profile(select.blank_to_null(survey(spark, sf)))


LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                  "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                  "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("missing_profile_lineitem", _mp_sql("lineitem", list(LINEITEM_TYPES), LINEITEM_TYPES), survey_cte=False)
def q_missing_profile_lineitem(spark, sf):
    return profile.missing_profile(load(spark, sf, "lineitem"))


NUM_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem" for c in NUM_LI),
       survey_cte=False)
def q_numeric_profile(spark, sf):
    return profile.numeric_profile(load(spark, sf, "lineitem"), NUM_LI)


@query("value_counts", """
SELECT COALESCE(prenatal, '<missing>') AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM survey), 6) AS pct
FROM survey GROUP BY 1""")
def q_value_counts(spark, sf):
    return profile.value_counts(survey(spark, sf), "prenatal")


@query("top_k_others", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rk FROM c)
SELECT CASE WHEN rk <= 5 THEN source ELSE 'others' END AS category, CAST(sum(n) AS BIGINT) AS n, CAST(min(rk) AS INT) AS rank
FROM r GROUP BY 1""", survey_cte=False)
def q_top_k_others(spark, sf):
    return profile.top_k_others(load(spark, sf, "documents"), "source", 5)


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'l_extendedprice' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper,
  CAST(count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS BIGINT) AS n_outliers,
  round(count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) * 100.0 / count(l_extendedprice), 6) AS pct_outliers,
  round(min(l_extendedprice) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi), 6) AS min_outlier,
  round(max(l_extendedprice) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi), 6) AS max_outlier
FROM lineitem, b GROUP BY q1, q3, lo, hi""", survey_cte=False)
def q_iqr_outliers(spark, sf):
    return profile.iqr_outliers(load(spark, sf, "lineitem"), "l_extendedprice")


def _skew_sql(src, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(skewness({c}), 6) AS skewness, CASE WHEN abs(skewness({c})) > 2 THEN 'high' "
        f"WHEN abs(skewness({c})) > 1 THEN 'moderate' ELSE 'low' END AS band FROM {src}" for c in cols)


SKEW_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("skewness_check", "WITH e AS (SELECT value FROM events) " + _skew_sql("lineitem", SKEW_COLS)
       + " UNION ALL " + _skew_sql("e", ["value"]), survey_cte=False)
def q_skewness_check(spark, sf):
    li = profile.skewness_check(load(spark, sf, "lineitem"), SKEW_COLS)
    ev = profile.skewness_check(load(spark, sf, "events"), ["value"])
    return li.unionByName(ev)


ADVICE_NUM = ["semanas", "tempo", "peso1", "peso2", "alto_missing", "x1", "x2", "zimc"]
ADVICE_CAT = ["regiao", "segmento", "serie", "parto", "prenatal", "tempo_medida", "em_branco", "constante"]


def advice_profile(spark, sf):
    b = select.blank_to_null(survey(spark, sf))
    cols = ADVICE_NUM + ADVICE_CAT
    mp = profile.missing_profile(b, cols).select("feature", "pct_missing", "n_distinct")
    total = b.count()
    cat = unpivot(b, ADVICE_CAT, value_type="string").where(F.col("value").isNotNull())
    rare = (cat.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("feature").agg(F.sum((F.col("n") / F.lit(float(total)) < profile.ADVICE_RARE_SHARE).cast("int")).alias("n_rare")))
    skew = profile.skewness_check(b, ADVICE_NUM).select("feature", "skewness")
    outliers = profile.outlier_shares(b, ADVICE_NUM)
    binary = set(select.binary_columns(b, ADVICE_NUM))
    is_bin = F.col("feature").isin(list(binary)).cast("int") if binary else F.lit(0)
    return (mp.join(rare, "feature", "left").join(skew, "feature", "left").join(outliers, "feature", "left")
            .withColumn("is_binary", is_bin))


def _advice_sql():
    b1, b5, b10, b20, b25 = profile.ADVICE_MISSING_BANDS
    rows = []
    for c in ADVICE_NUM + ADVICE_CAT:
        miss = f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)"
        if c in ADVICE_CAT:
            rare = (f"(SELECT count(*) FROM (SELECT {c} FROM b WHERE {c} IS NOT NULL GROUP BY {c} "
                    f"HAVING count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE) < {profile.ADVICE_RARE_SHARE}))")
            skew = "CAST(NULL AS DOUBLE)"
            binf = "0"
            out = "0.0"
        else:
            rare = "0"
            skew = f"skewness({c})"
            binf = f"CAST(min({c}) = 0 AND max({c}) = 1 AND count(*) FILTER (WHERE {c} NOT IN (0, 1)) = 0 AS INT)"
            q1, q3 = f"(SELECT quantile_cont({c}, 0.25) FROM b)", f"(SELECT quantile_cont({c}, 0.75) FROM b)"
            out = (f"count(*) FILTER (WHERE {c} < {q1} - 1.5 * ({q3} - {q1}) OR {c} > {q3} + 1.5 * ({q3} - {q1})) * 100.0 / count({c})")
        rows.append(f"SELECT '{c}' AS feature, round({miss}, 6) AS pm, count(DISTINCT {c}) AS nd, {rare} AS nr, "
                    f"{skew} AS sk, {binf} AS ib, {out} AS po FROM b")
    u = " UNION ALL ".join(rows)
    return f"""WITH b AS (SELECT {fx.survey_blank_select_sql()} FROM survey), p AS ({u})
SELECT feature,
  CASE WHEN pm > {b25} THEN 'missing>25%' WHEN pm > {b20} THEN 'missing>20%' WHEN pm > {b10} THEN 'missing>10%'
       WHEN pm > {b5} THEN 'missing>5%' WHEN pm > {b1} THEN 'missing>1%' WHEN pm > 0 THEN 'missing<=1%' ELSE 'complete' END AS missing_advice,
  CASE WHEN nd <= 1 THEN 'constant' WHEN ib = 1 THEN 'binary' WHEN nd <= {profile.ADVICE_FEW_CATEGORIES} THEN 'few_categories'
       ELSE 'many_values' END AS shape_advice,
  CASE WHEN COALESCE(nr, 0) > 0 THEN 1 ELSE 0 END AS has_rare,
  CASE WHEN COALESCE(round(po, 6), 0) > {profile.ADVICE_OUTLIER_PCT} THEN 1 ELSE 0 END AS many_outliers,
  CASE WHEN abs(COALESCE(round(sk, 6), 0)) > {profile.ADVICE_SKEW} THEN 1 ELSE 0 END AS skewed FROM p"""


@query("variable_advice", _advice_sql())
def q_variable_advice(spark, sf):
    return profile.variable_advice(advice_profile(spark, sf))


_BIN_SUM = ("CAST(COALESCE(zimc <= -2, false) AS INT) + CAST(COALESCE(zimc > -2 AND zimc <= 2, false) AS INT) + "
            "CAST(COALESCE(zimc > 2 AND zimc <= 3, false) AS INT) + CAST(COALESCE(zimc > 3, false) AS INT)")


@query("one_active_check", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_BIN_SUM} = 1) AS n_valid, count(*) FILTER (WHERE {_BIN_SUM} <> 1) AS n_invalid
FROM survey""")
def q_one_active_check(spark, sf):
    s = recode.bin_indicators(survey(spark, sf), "zimc")
    return profile.one_active_check(s, list(recode.BIN_NAMES))


@query("recount_validation", f"""
WITH src AS (SELECT CAST(CASE WHEN zimc <= -2 THEN 0 WHEN zimc <= 2 THEN 1 WHEN zimc <= 3 THEN 2 ELSE 3 END AS VARCHAR) AS class,
  count(*) AS n FROM survey GROUP BY 1),
j AS (SELECT class, CAST(n AS BIGINT) AS n_source, CAST(n AS BIGINT) AS n_transformed FROM src),
a AS (SELECT * FROM j UNION ALL SELECT 'TOTAL', CAST(sum(n_source) AS BIGINT), CAST(sum(n_transformed) AS BIGINT) FROM j)
SELECT class, n_source, n_transformed, n_transformed - n_source AS difference,
  CASE WHEN n_transformed = n_source THEN 'PASS' ELSE 'FAIL' END AS status FROM a""")
def q_recount_validation(spark, sf):
    s = survey(spark, sf)
    rule = F.when(F.col("zimc") <= -2, 0).when(F.col("zimc") <= 2, 1).when(F.col("zimc") <= 3, 2).otherwise(3)
    src = s.groupBy(rule.cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    t = recode.indicators_to_class(recode.bin_indicators(s, "zimc"))
    tr = t.groupBy(F.col("classe").cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return profile.recount_validation(src, tr)


@query("proportion_drift", f"""
WITH {fx.SPLIT_CTE},
g AS (SELECT classe AS class, count(*) AS n_all, count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'test') AS n_test FROM splitted GROUP BY 1),
p AS (SELECT class, n_all * 100.0 / sum(n_all) OVER () AS pa, n_train * 100.0 / sum(n_train) OVER () AS ptr,
  n_test * 100.0 / sum(n_test) OVER () AS pte FROM g)
SELECT class, round(pa, 6) AS pct_all, round(ptr, 6) AS pct_train, round(pte, 6) AS pct_test,
  CASE WHEN abs(ptr - pa) <= 0.5 AND abs(pte - pa) <= 0.5 THEN 'OK' ELSE 'DRIFT' END AS status FROM p""")
def q_proportion_drift(spark, sf):
    return profile.proportion_drift(fx.split(spark, sf), "classe", "split", 0.5)


@query("sample_preserved", f"""
WITH {fx.SPLIT_CTE}
SELECT count(*) AS n_all, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  CAST(count(*) FILTER (WHERE split = 'train') + count(*) FILTER (WHERE split = 'test') = count(*) AS INT) AS preserved
FROM splitted""")
def q_sample_preserved(spark, sf):
    s = fx.split(spark, sf).select("id_anon", "split")
    return profile.sample_preserved(s, s.where("split = 'train'"), s.where("split = 'test'"))


@query("target_mean_encode", f"""
WITH {fx.LABELLED_CTE}
SELECT id_anon, segmento, round(avg(CAST(label AS DOUBLE)) OVER (PARTITION BY segmento), 6) AS segmento_te FROM lab""")
def q_target_mean_encode(spark, sf):
    t = profile.target_mean_encode(fx.labelled(spark, sf).select("id_anon", "segmento", "label"), "segmento", "label")
    return t.select("id_anon", "segmento", F.round("segmento_te", 6).alias("segmento_te"))


@query("distinct_values", """
SELECT serie AS value, CAST(row_number() OVER (ORDER BY serie) AS INT) AS position FROM (SELECT DISTINCT serie FROM survey WHERE serie IS NOT NULL)""")
def q_distinct_values(spark, sf):
    return profile.distinct_values(survey(spark, sf), "serie")


@query("group_summary", f"""
WITH {fx.LABELLED_CTE}
SELECT parto, count(*) AS n, round(avg(x2), 6) AS mean, round(max(x2), 6) AS max, CAST(sum(label) AS BIGINT) AS n_flagged
FROM lab GROUP BY parto""")
def q_group_summary(spark, sf):
    return profile.group_summary(fx.labelled(spark, sf), "parto", "x2", "label")


@query("label_means", f"""
WITH {fx.LABELLED_CTE}
SELECT label, round(avg(x1), 6) AS mean_x1, round(avg(x2), 6) AS mean_x2, round(avg(peso1), 6) AS mean_peso1 FROM lab GROUP BY label""")
def q_label_means(spark, sf):
    return profile.label_means(fx.labelled(spark, sf), "label", ["x1", "x2", "peso1"])


SEL_FEATS = ["x1", "x2", "peso1", "peso2", "semanas", "tempo"]
SEL_GROUP_RULES = [("prefix", "peso", "anthropometric"), ("prefix", "x", "economic")]


@query("selection_frequency", f"""
WITH {fx.FOLDS_CTE},
l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, fold, label, {c} AS v FROM folds" for c in SEL_FEATS)}),
k AS (SELECT * FROM range(0, 5) t(k)),
m AS (SELECT k.k AS fold, l.feature, avg(v) FILTER (WHERE label = 1) AS m1, avg(v) FILTER (WHERE label = 0) AS m0
      FROM l JOIN k ON l.fold <> k.k GROUP BY 1, 2),
sel AS (SELECT fold, feature FROM m WHERE m1 > m0),
fr AS (SELECT feature, count(DISTINCT fold) AS n_folds FROM sel GROUP BY 1),
g AS (SELECT *, CASE WHEN starts_with(feature, 'peso') THEN 'anthropometric' WHEN starts_with(feature, 'x') THEN 'economic'
      ELSE 'other' END AS "group" FROM fr),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY n_folds DESC, feature) AS INT) AS rank FROM g)
SELECT "group", feature, n_folds, rank, CAST(rank <= 3 AS INT) AS in_top FROM r""")
def q_selection_frequency(spark, sf):
    f = fx.folds(spark, sf)
    outer = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where(F.col("fold") != F.col("k"))
    long = unpivot(outer, SEL_FEATS, ["k", "label"], "double", "feature", "v")
    m = long.groupBy("k", "feature").agg(F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("m1"),
                                         F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("m0"))
    selected = m.where(F.col("m1") > F.col("m0")).select(F.col("k").alias("fold"), "feature")
    groups = select.feature_groups(selected.select("feature").distinct(), SEL_GROUP_RULES, "other")
    return profile.selection_frequency(selected, groups, 3)


@query("leaderboard", f"""
WITH {fx.LABELLED_CTE}, ll AS ({long_sql('lab', AUC_FEATS, ['label', 'segmento'])}), {auc_ctes('ll', ['segmento', 'feature'], 'lb')}
SELECT segmento AS model, feature AS algorithm, round(auc, 6) AS auc,
  CAST(row_number() OVER (PARTITION BY segmento ORDER BY auc DESC, feature) AS INT) AS rank_in_model,
  CAST(row_number() OVER (ORDER BY auc DESC, segmento, feature) AS INT) AS rank_overall,
  CAST(row_number() OVER (PARTITION BY segmento ORDER BY auc DESC, feature) = 1 AS INT) AS is_best FROM lb_auc""")
def q_leaderboard(spark, sf):
    lab = fx.labelled(spark, sf)
    long = unpivot(lab, AUC_FEATS, ["label", "segmento"], "double", "feature", "score")
    res = metrics.roc_auc(long, "score", "label", ["segmento", "feature"])
    res = res.select(F.col("segmento").alias("model"), F.col("feature").alias("algorithm"), "auc")
    return profile.leaderboard(res, "auc")


# ======================================================================== 2.6 splitting / resampling
@query("stratified_split", f"WITH {fx.SPLIT_CTE} SELECT id_anon, classe, split FROM splitted")
def q_stratified_split(spark, sf):
    return fx.split(spark, sf).select("id_anon", "classe", "split")


@query("stratified_kfold", f"WITH {fx.FOLDS_CTE} SELECT id_anon, label, fold FROM folds")
def q_stratified_kfold(spark, sf):
    return fx.folds(spark, sf).select("id_anon", "label", "fold")


@query("nested_folds", f"""
WITH {fx.FOLDS_CTE},
ex AS (SELECT CAST(o.k AS INT) AS outer_fold, f.id_anon, f.label, {portable_hash_sql(7, 'f.id_anon')} AS h
       FROM folds f JOIN range(0, 5) o(k) ON f.fold <> o.k)
SELECT outer_fold, id_anon, label, CAST((row_number() OVER (PARTITION BY outer_fold, label ORDER BY h, id_anon) - 1) % 5 AS INT) AS inner_fold
FROM ex""")
def q_nested_folds(spark, sf):
    return resample.nested_folds(fx.folds(spark, sf), "label", "id_anon", "fold", 5, 5, seed=7)


N_BOOT = 1000
BOOT_CTE = fx.LABELLED_CTE + f""", bl AS (SELECT id_anon, x1, label FROM lab),
{replicates.exact_draws_ctes('bl', 'id_anon', N_BOOT, 42, 'bs')},
brep AS (SELECT replicate, CAST(sum(w) AS BIGINT) AS n, sum(w * x1) / sum(w) FILTER (WHERE x1 IS NOT NULL) AS mean_x1,
  CAST(sum(w * label) AS BIGINT) AS n_pos FROM bs_draw GROUP BY replicate)"""


def boot_replicates(spark, sf):
    """Size, mean of x1 and positives of each exact resample of the labelled rows."""
    lab = fx.labelled(spark, sf).select("id_anon", "x1", "label")
    sums = replicates.replicate_sums(replicates.exact_draws(lab, "id_anon", N_BOOT, seed=42), {
        "n": F.lit(1), "x1": F.col("x1"), "known": F.col("x1").isNotNull(), "n_pos": F.col("label")})
    return sums.select("replicate", F.col("n").cast("long").alias("n"), F.try_divide("x1", "known").alias("mean_x1"),
                       F.col("n_pos").cast("long").alias("n_pos"))


@query("bootstrap_rows", f"""WITH {BOOT_CTE}
SELECT replicate, n, round(mean_x1, 6) AS mean_x1, n_pos FROM brep WHERE n_pos > 0 AND n_pos < n""")
def q_bootstrap_rows(spark, sf):
    r = boot_replicates(spark, sf)
    # replicates with one class only are skipped (degenerate for AUC-type statistics)
    return r.where((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))).select(
        "replicate", "n", F.round("mean_x1", 6).alias("mean_x1"), "n_pos")


N_BOOT_FOLD = 1000


@query("bootstrap_fold_mean", f"""
WITH {FOLD_AUC_CTE},
k AS (SELECT feature, count(*) AS k, avg(auc) AS mean FROM fa_auc WHERE feature IN ('x1', 'x2') GROUP BY 1),
ex AS (SELECT k.feature, k.mean, CAST(r.replicate AS INT) AS replicate, s.slot,
       CAST({portable_hash_sql(42, 'k.feature', 'r.replicate', 's.slot')} % k.k AS INT) AS draw
       FROM k, range(1, {N_BOOT_FOLD + 1}) r(replicate), range(0, 5) s(slot) WHERE s.slot < k.k),
rep AS (SELECT ex.feature, ex.mean, ex.replicate, avg(fa.auc) AS rm FROM ex JOIN fa_auc fa ON fa.feature = ex.feature AND fa.fold = ex.draw
        GROUP BY 1, 2, 3)
SELECT feature, round(mean, 6) AS mean, round(quantile_cont(rm, 0.025), 6) AS ci_lower, round(quantile_cont(rm, 0.975), 6) AS ci_upper
FROM rep GROUP BY feature, mean""")
def q_bootstrap_fold_mean(spark, sf):
    fa = fold_auc(spark, sf, ["x1", "x2"])
    return resample.bootstrap_fold_mean(fa, ["feature"], "auc", "fold", N_BOOT_FOLD, seed=42)


@query("balanced_weights", """
SELECT doc_id, toxic, round(CAST((SELECT count(*) FROM labels) AS DOUBLE) / (2 * count(*) OVER (PARTITION BY toxic)), 6) AS weight
FROM labels""", survey_cte=False)
def q_balanced_weights(spark, sf):
    w = resample.balanced_weights(load(spark, sf, "labels").select("doc_id", "toxic"), "toxic")
    return w.select("doc_id", "toxic", F.round("weight", 6).alias("weight"))


@query("pos_weight", f"WITH {fx.LABELLED_CTE} SELECT id_anon, label, CAST(CASE WHEN label = 1 THEN 33.0 ELSE 1.0 END AS DOUBLE) AS weight FROM lab")
def q_pos_weight(spark, sf):
    return resample.pos_weight(fx.labelled(spark, sf).select("id_anon", "label"), "label", 33.0)


@query("pos_weight_ratio", f"""WITH {fx.LABELLED_CTE}
SELECT id_anon, label, round(CASE WHEN label = 1 THEN (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE)
  / greatest(count(*) FILTER (WHERE label = 1), 1) FROM lab) ELSE 1.0 END, 6) AS weight FROM lab""")
def q_pos_weight_ratio(spark, sf):
    w = resample.pos_weight(fx.labelled(spark, sf).select("id_anon", "label"), "label", None)
    return w.select("id_anon", "label", F.round("weight", 6).alias("weight"))


# ======================================================================== 2.7 evaluation
@query("roc_auc", f"""WITH {fx.LABELLED_CTE}, rl AS (SELECT 'x1' AS feature, x1 AS score, label FROM lab), {auc_ctes('rl', ['feature'], 'ra')}
SELECT round(auc, 6) AS auc, n_pos, n_neg FROM ra_auc""")
def q_roc_auc(spark, sf):
    r = metrics.roc_auc(fx.labelled(spark, sf), "x1", "label")
    return r.select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@query("roc_auc_lineitem", f"""WITH rl AS (SELECT 1 AS g, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem),
{auc_ctes('rl', ['g'], 'ra')} SELECT round(auc, 6) AS auc, n_pos, n_neg FROM ra_auc""", survey_cte=False)
def q_roc_auc_lineitem(spark, sf):
    li = load(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("label"))
    r = metrics.roc_auc(li, "l_extendedprice", "label")
    return r.select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


_CONF_SQL = """CAST(count(*) FILTER (WHERE pred = 1 AND label = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE pred = 1 AND label = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE pred = 0 AND label = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE pred = 0 AND label = 0) AS BIGINT) AS tn"""


def _prf_sql():
    prec = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END"
    rec = "CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END"
    f1 = f"CASE WHEN ({prec}) + ({rec}) > 0 THEN 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0.0 END"
    return prec, rec, f1


@query("confusion_metrics", f"""WITH {fx.LABELLED_CTE}, c AS (SELECT {_CONF_SQL} FROM (SELECT CAST(x1 > 5000 AS INT) AS pred, label FROM lab))
SELECT tp, fp, fn, tn, round({_prf_sql()[0]}, 6) AS precision, round({_prf_sql()[1]}, 6) AS recall, round({_prf_sql()[2]}, 6) AS f1 FROM c""")
def q_confusion_metrics(spark, sf):
    lab = fx.labelled(spark, sf).withColumn("pred", (F.col("x1") > 5000).cast("int"))
    return metrics.confusion_metrics(lab, "pred", "label")


@query("holdout_metrics", f"""WITH {fx.SPLIT_CTE},
c AS (SELECT split, {_CONF_SQL} FROM (SELECT split, CAST(x1 > 5000 AS INT) AS pred, label FROM splitted) GROUP BY split)
SELECT split, tp, fp, fn, tn, round({_prf_sql()[0]}, 6) AS precision, round({_prf_sql()[1]}, 6) AS recall, round({_prf_sql()[2]}, 6) AS f1,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0.0 END, 6) AS accuracy,
  round(CASE WHEN tp + fn = 0 THEN 1.0 WHEN fp + tn = 0 THEN 0.0 WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0.0 END, 6) AS specificity,
  round(CASE WHEN tp + fn = 0 THEN 1.0 WHEN fp + tn = 0 THEN 0.0 WHEN tn + fn > 0 THEN tn / CAST(tn + fn AS DOUBLE) ELSE 0.0 END, 6) AS npv,
  round(CASE WHEN tp + fn = 0 THEN 0.0 WHEN fp + tn = 0 THEN 1.0 ELSE {_prf_sql()[0]} END, 6) AS ppv FROM c""")
def q_holdout_metrics(spark, sf):
    s = fx.split(spark, sf).withColumn("pred", (F.col("x1") > 5000).cast("int"))
    return metrics.holdout_metrics(s, "pred", "label", ["split"])


T_INTERVAL_SQL = f"""WITH {FOLD_AUC_CTE}, {t_values_sql()},
g AS (SELECT feature, count(auc) AS n, avg(auc) AS mean, stddev_samp(auc) AS sd FROM fa_auc GROUP BY 1),
ti AS (SELECT g.feature, g.n, g.mean, CASE WHEN g.n > 1 THEN g.mean - tv.t * g.sd / sqrt(g.n) ELSE g.mean END AS lo,
  CASE WHEN g.n > 1 THEN g.mean + tv.t * g.sd / sqrt(g.n) ELSE g.mean END AS hi FROM g LEFT JOIN tv ON tv.df = g.n - 1)"""


@query("t_interval", T_INTERVAL_SQL + " SELECT feature, n, round(mean, 6) AS mean, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper FROM ti")
def q_t_interval(spark, sf):
    return metrics.t_interval(fold_auc(spark, sf, AUC_FEATS), "auc", ["feature"])


@query("percentile_interval", f"""WITH {BOOT_CTE}
SELECT round(avg(mean_x1), 6) AS mean, round(quantile_cont(mean_x1, 0.025), 6) AS ci_lower, round(quantile_cont(mean_x1, 0.975), 6) AS ci_upper
FROM brep""")
def q_percentile_interval(spark, sf):
    return metrics.percentile_interval(boot_replicates(spark, sf), "mean_x1")


MW_FEATS = ["x1", "x2", "peso1"]


@query("mann_whitney", f"""WITH {fx.LABELLED_CTE}, ml AS ({long_sql('lab', MW_FEATS, ['label'])}), {auc_ctes('ml', ['feature'], 'mw')},
st AS (SELECT feature, u1, CAST(n_pos AS DOUBLE) AS n1, CAST(n_neg AS DOUBLE) AS n0, tie FROM mw_auc),
zz AS (SELECT *, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5)
   / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - tie / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM st)
SELECT feature, round(u1, 6) AS u, round(z, 6) AS z, round(least(1.0, 2.0 * (0.5 * {erfc_sql('z / sqrt(2.0)')})), 6) AS p_value,
  CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0 FROM zz""")
def q_mann_whitney(spark, sf):
    long = unpivot(fx.labelled(spark, sf), MW_FEATS, ["label"], "double", "feature", "v")
    return metrics.mann_whitney(long, "v", "label", ["feature"])


UNI_NUM = ["x1", "x2", "peso1", "peso2", "semanas", "tempo", "alto_missing"]
UNI_CAT = ["regiao", "segmento", "serie", "parto", "prenatal"]


def _uni_sql():
    num = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS score, label FROM lab WHERE {c} IS NOT NULL"
                             for c in UNI_NUM)
    cat = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST(label AS DOUBLE)) OVER (PARTITION BY {c}) AS score, label "
                             f"FROM lab WHERE {c} IS NOT NULL" for c in UNI_CAT)
    return f"""WITH {fx.LABELLED_CTE}, ul AS ({num} UNION ALL {cat}), {auc_ctes('ul', ['feature'], 'ua')}
SELECT feature, n_pos + n_neg AS n, n_pos, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_folded FROM ua_auc
WHERE n_pos + n_neg >= 50 AND n_pos >= 5 AND n_neg > 0"""


N_BOOT_UNI = 500


def _uni_ci_sql():
    h = f"({portable_hash_sql(42, 'id_anon')} % {replicates.PRIME})"
    num = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS score, label, id_anon FROM lab WHERE {c} IS NOT NULL"
                             for c in UNI_NUM)
    cat = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST(label AS DOUBLE)) OVER (PARTITION BY {c}) AS score, label, id_anon "
                             f"FROM lab WHERE {c} IS NOT NULL" for c in UNI_CAT)
    return f"""WITH {fx.LABELLED_CTE}, ul AS ({num} UNION ALL {cat}), {auc_ctes('ul', ['feature'], 'ua')},
bh AS (SELECT id_anon, {h} AS h FROM lab),
bw0 AS (SELECT id_anon, CAST(r.replicate AS INT) AS replicate, {replicates.weights_sql('h', 'r.replicate', '1.0', 42)} AS w
        FROM bh, range(1, {N_BOOT_UNI + 1}) r(replicate)),
bw AS (SELECT feature, score, label, replicate, w FROM ul JOIN bw0 USING (id_anon)),
bw2 AS (SELECT * FROM bw WHERE w > 0), {auc_ctes('bw2', ['feature', 'replicate'], 'ub', 'w')},
ci AS (SELECT feature, round(quantile_cont(auc, 0.025), 6) AS ci_lower, round(quantile_cont(auc, 0.975), 6) AS ci_upper
       FROM ub_auc WHERE auc IS NOT NULL GROUP BY feature)
SELECT a.feature, a.n_pos + a.n_neg AS n, a.n_pos, round(a.auc, 6) AS auc, round(greatest(a.auc, 1 - a.auc), 6) AS auc_folded,
  ci.ci_lower, ci.ci_upper FROM ua_auc a LEFT JOIN ci ON a.feature = ci.feature
WHERE a.n_pos + a.n_neg >= 50 AND a.n_pos >= 5 AND a.n_neg > 0"""


@query("univariate_auc_ci", _uni_ci_sql())
def q_univariate_auc_ci(spark, sf):
    return metrics.univariate_auc(fx.labelled(spark, sf), "label", UNI_NUM, UNI_CAT, n_boot=N_BOOT_UNI,
                                  id_col="id_anon", seed=42)


@query("univariate_auc", _uni_sql())
def q_univariate_auc(spark, sf):
    return metrics.univariate_auc(fx.labelled(spark, sf), "label", UNI_NUM, UNI_CAT)


@query("feature_status", f"""WITH b AS (SELECT {fx.survey_blank_select_sql()} FROM survey),
p AS ({_mp_sql('b', fx.SURVEY_COLS, fx.SURVEY_TYPES)})
SELECT feature, pct_missing, CASE WHEN feature NOT IN ('alto_missing', 'constante') THEN 'retained'
  WHEN pct_missing > 30 THEN 'removed_high_missing' ELSE 'removed_low_missing' END AS status FROM p""")
def q_feature_status(spark, sf):
    b = select.blank_to_null(survey(spark, sf))
    prof = profile.missing_profile(b).select("feature", "pct_missing")
    kept, _ = select.drop_high_missing(b, 0.30)
    kept, _ = select.drop_constant(kept)
    retained = spark.createDataFrame([(c,) for c in kept.columns], "feature string")
    return metrics.feature_status(prof, retained)


@query("ci_excludes", T_INTERVAL_SQL + """,
e AS (SELECT feature, round(round(mean, 6) - 0.5, 6) AS estimate, round(round(lo, 6) - 0.5, 6) AS ci_lower,
      round(round(hi, 6) - 0.5, 6) AS ci_upper FROM ti)
SELECT feature, estimate, ci_lower, ci_upper, CAST(ci_lower > 0 AS INT) AS above_chance,
  CAST(ci_lower > 0 OR ci_upper < 0 AS INT) AS significant, CASE WHEN estimate > 0 THEN 'Risk' ELSE 'Protective' END AS direction,
  CAST(row_number() OVER (ORDER BY abs(estimate) DESC, feature) AS INT) AS rank_abs FROM e""")
def q_ci_excludes(spark, sf):
    t = metrics.t_interval(fold_auc(spark, sf, AUC_FEATS), "auc", ["feature"])
    e = t.select("feature", *[F.round(F.col(c) - 0.5, 6).alias(n) for c, n in
                              (("mean", "estimate"), ("ci_lower", "ci_lower"), ("ci_upper", "ci_upper"))])
    return metrics.ci_excludes(e, chance=0.0)


def _above_mean(spark, sf, feats, keys):
    """Rows (keys, feature, label, pred): predicted 1 where the score is above its feature's mean in the table."""
    f = fx.folds(spark, sf)
    long = unpivot(f, feats, [*keys, "label"], "double", "feature", "score")
    cut = long.groupBy("feature").agg(F.avg("score").alias("_cut"))
    return long.join(F.broadcast(cut), "feature").where(F.col("score").isNotNull()).withColumn("pred", (F.col("score") > F.col("_cut")).cast("int"))


@query("auc_band", T_INTERVAL_SQL + f""",
am AS (SELECT feature, avg(score) AS cut FROM ({long_sql('folds', AUC_FEATS, ['label'])}) GROUP BY 1),
pc AS (SELECT s.feature, count(*) FILTER (WHERE score > cut AND label = 1) AS tp, count(*) FILTER (WHERE score > cut AND label = 0) AS fp
       FROM ({long_sql('folds', AUC_FEATS, ['label'])}) s JOIN am ON am.feature = s.feature GROUP BY 1)
SELECT ti.feature, n, round(mean, 6) AS auc, round(lo, 6) AS ci_lower, round(hi, 6) AS ci_upper,
  round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 6) AS precision,
  CASE WHEN round(lo, 6) <= 0.5 THEN 'includes_chance' WHEN round(hi, 6) < 0.7 THEN 'weak' ELSE 'moderate' END AS band,
  CAST(round(lo, 6) > 0.5 AS INT) AS exceeds_chance,
  CAST(round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END, 6) < 0.10 AS INT) AS low_precision
FROM ti JOIN pc ON pc.feature = ti.feature""")
def q_auc_band(spark, sf):
    t = metrics.t_interval(fold_auc(spark, sf, AUC_FEATS), "auc", ["feature"]).withColumnRenamed("mean", "auc")
    prec = metrics.confusion_metrics(_above_mean(spark, sf, AUC_FEATS, []), "pred", "label", ["feature"]).select("feature", "precision")
    return metrics.auc_band(t.join(prec, "feature"), "auc", "ci_lower", "ci_upper", precision="precision")


def _seg_auc(lab):
    long = unpivot(lab, ["x1", "x2"], ["label", "segmento"], "double", "feature", "score")
    r = metrics.roc_auc(long, "score", "label", ["segmento", "feature"])
    return r.select(F.col("segmento").alias("model"), F.col("feature").alias("algorithm"), "auc")


_DELTA_SQL = f"""WITH {fx.LABELLED_CTE},
o AS ({long_sql('lab', ['x1', 'x2'], ['label', 'segmento'])}),
nw AS ({long_sql('(SELECT * FROM lab WHERE prenatal IS NOT NULL)', ['x1', 'x2'], ['label', 'segmento'])}),
{auc_ctes('o', ['segmento', 'feature'], 'oa')}, {auc_ctes('nw', ['segmento', 'feature'], 'na')},
d AS (SELECT n.segmento AS model, n.feature AS algorithm, n.auc AS new, o.auc AS old, n.auc - o.auc AS delta
      FROM na_auc n JOIN oa_auc o ON n.segmento = o.segmento AND n.feature = o.feature),
v AS (SELECT model, algorithm, round(new, 6) AS new, round(old, 6) AS old, round(delta, 6) AS delta,
      CASE WHEN abs(delta) < 0.02 THEN 'No change' WHEN delta > 0 THEN 'Better' ELSE 'Worse' END AS verdict FROM d)"""


def _delta(spark, sf):
    lab = fx.labelled(spark, sf)
    return metrics.delta_verdict(_seg_auc(lab.where(F.col("prenatal").isNotNull())), _seg_auc(lab))


@query("delta_verdict", _DELTA_SQL + " SELECT * FROM v")
def q_delta_verdict(spark, sf):
    return _delta(spark, sf)


@query("delta_summary", _DELTA_SQL + " SELECT verdict, count(*) AS n, round(avg(delta), 6) AS mean_delta FROM v GROUP BY verdict")
def q_delta_summary(spark, sf):
    return metrics.delta_summary(_delta(spark, sf))


PERFORMANCE = ["auc", "precision", "recall", "f1", "specificity", "accuracy", "npv", "ppv"]
_PERF_RATES = {
    "precision": "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END",
    "f1": "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END",
    "specificity": "CASE WHEN tp + fn = 0 THEN 1.0 WHEN fp + tn = 0 THEN 0.0 ELSE tn / CAST(tn + fp AS DOUBLE) END",
    "accuracy": "(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)",
    "npv": "CASE WHEN tp + fn = 0 THEN 1.0 WHEN fp + tn = 0 OR tn + fn = 0 THEN 0.0 ELSE tn / CAST(tn + fn AS DOUBLE) END",
    "ppv": "CASE WHEN tp + fn = 0 THEN 0.0 WHEN fp + tn = 0 THEN 1.0 WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END",
}
_PERF_LONG = " UNION ALL ".join(f"SELECT segmento, feature, '{m}', round({e}, 6) FROM cc" for m, e in _PERF_RATES.items())
_PERF_PIVOT = ", ".join(f"max(printf('%.3f [%.3f-%.3f]', mean, lo, hi)) FILTER (WHERE metric = '{m}') AS {m}" for m in PERFORMANCE)


@query("performance_table", f"""WITH {SEG_FOLD_AUC_CTE}, {t_values_sql()},
am AS (SELECT feature, avg(score) AS cut FROM sfl GROUP BY 1),
cc AS (SELECT segmento, s.feature, fold, count(*) FILTER (WHERE score > cut AND label = 1) AS tp,
         count(*) FILTER (WHERE score > cut AND label = 0) AS fp, count(*) FILTER (WHERE score <= cut AND label = 1) AS fn,
         count(*) FILTER (WHERE score <= cut AND label = 0) AS tn FROM sfl s JOIN am ON am.feature = s.feature WHERE score IS NOT NULL GROUP BY 1, 2, 3),
lg(segmento, feature, metric, v) AS (SELECT segmento, feature, 'auc', auc FROM sfa_auc UNION ALL {_PERF_LONG}),
g AS (SELECT segmento, feature, metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM lg GROUP BY 1, 2, 3),
ti AS (SELECT g.*, CASE WHEN n > 1 THEN mean - tv.t * sd / sqrt(n) ELSE mean END AS lo,
  CASE WHEN n > 1 THEN mean + tv.t * sd / sqrt(n) ELSE mean END AS hi FROM g LEFT JOIN tv ON tv.df = g.n - 1)
SELECT segmento AS model, feature AS algorithm, {_PERF_PIVOT} FROM ti GROUP BY 1, 2""")
def q_performance_table(spark, sf):
    fa = fold_auc(spark, sf, ["x1", "x2"], extra_keys=["segmento"])
    conf = metrics.holdout_metrics(_above_mean(spark, sf, ["x1", "x2"], ["segmento", "fold"]), "pred", "label", ["segmento", "feature", "fold"])
    rates = unpivot(conf, PERFORMANCE[1:], ["segmento", "feature", "fold"], "double", "metric", "v")
    lg = fa.select("segmento", "feature", "fold", F.lit("auc").alias("metric"), F.col("auc").alias("v")).unionByName(rates)
    ti = metrics.t_interval(lg, "v", ["segmento", "feature", "metric"], digits=None)
    res = ti.select(F.col("segmento").alias("model"), F.col("feature").alias("algorithm"), "metric", "mean", "ci_lower", "ci_upper")
    return metrics.performance_table(res, PERFORMANCE, 3)
