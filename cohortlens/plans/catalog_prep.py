"""Registered queries for sources/sinks, selection and recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.expr import round_half_even
from cohortlens.operators import impute, recode, select
from cohortlens.operators.profile import class_distribution
from cohortlens.plans import fixtures as fx
from cohortlens.plans.registry import query
from cohortlens.session import fresh_path
from cohortlens.sources import io
from cohortlens.sources.tables import load, survey

CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _customer_csv(spark, sf):
    path = fresh_path(spark, "customer-csv")
    io.csv_sink(load(spark, sf, "customer"), path, fmt="csv")
    return path


# ======================================================================== 2.1
@query("csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", survey_cte=False)
def q_csv_scan(spark, sf):
    return io.csv_scan(spark, _customer_csv(spark, sf), CUSTOMER_SCHEMA)


@query("csv_scan_projected", "SELECT c_custkey, c_acctbal FROM customer", survey_cte=False)
def q_csv_scan_projected(spark, sf):
    return io.csv_scan_projected(spark, _customer_csv(spark, sf), CUSTOMER_SCHEMA, ["c_custkey", "c_acctbal"])


@query("dictionary_scan", fx.DICTIONARY_SQL, survey_cte=False)
def q_dictionary_scan(spark, sf):
    path = io.csv_sink(fx.dictionary(spark, sf), fresh_path(spark, "dictionary"), fmt="csv")
    return io.dictionary_scan(spark, path, fmt="csv")


@query("csv_sink", "SELECT * FROM survey")
def q_csv_sink(spark, sf):
    first = io.write_then_read(spark, survey(spark, sf), "survey")
    # a self-overwrite goes to a new path: read `first`, write the next version elsewhere
    return io.write_then_read(spark, first, "survey-v2")


def _results_run1(spark, sf):
    s = survey(spark, sf)
    return s.groupBy(F.col("segmento").alias("model"), F.col("serie").alias("algorithm")).agg(
        F.lit(1).alias("run"), F.round(F.avg("x2"), 6).alias("value"))


@query("result_upsert", """
SELECT segmento AS model, serie AS algorithm, 1 AS run, round(avg(x2), 6) AS value
FROM survey WHERE serie <> '1-URGENT' GROUP BY 1, 2
UNION ALL
SELECT segmento, serie, 2, round(max(x2), 6) FROM survey WHERE serie = '1-URGENT' GROUP BY 1, 2""")
def q_result_upsert(spark, sf):
    path = fresh_path(spark, "results")
    io.result_upsert(_results_run1(spark, sf), path)
    s = survey(spark, sf).where(F.col("serie") == "1-URGENT")
    run2 = s.groupBy(F.col("segmento").alias("model"), F.col("serie").alias("algorithm")).agg(
        F.lit(2).alias("run"), F.round(F.max("x2"), 6).alias("value"))
    io.result_upsert(run2, path)
    return io.read_results(spark, path).select("model", "algorithm", "run", "value")


@query("resume_skip_done", """
WITH jobs AS (SELECT DISTINCT regiao AS model, segmento AS algorithm FROM survey),
done AS (SELECT regiao AS model, segmento AS algorithm FROM survey GROUP BY 1, 2 HAVING avg(x1) > 4500)
SELECT * FROM jobs WHERE (model, algorithm) NOT IN (SELECT (model, algorithm) FROM done)""")
def q_resume_skip_done(spark, sf):
    s = survey(spark, sf)
    jobs = s.select(F.col("regiao").alias("model"), F.col("segmento").alias("algorithm")).distinct()
    done_rows = (s.groupBy(F.col("regiao").alias("model"), F.col("segmento").alias("algorithm"))
                 .agg(F.avg("x1").alias("v")).where("v > 4500").select("model", "algorithm", F.lit(1).alias("run")))
    path = fresh_path(spark, "done")
    io.result_upsert(done_rows, path)
    return io.resume_skip_done(jobs, io.read_results(spark, path))


_MISS_UNION = " UNION ALL ".join(
    f"SELECT '{c}' AS col, {i} AS ord, CAST(count(*) FILTER (WHERE "
    + (f"{c} IS NULL OR regexp_matches({c}, '^\\s*$')" if c in fx.SURVEY_STRING_COLS else f"{c} IS NULL")
    + f") AS DOUBLE) / count(*) AS share, count(*) FILTER (WHERE "
    + (f"{c} IS NULL OR regexp_matches({c}, '^\\s*$')" if c in fx.SURVEY_STRING_COLS else f"{c} IS NULL")
    + ") AS n_missing FROM survey"
    for i, c in enumerate(fx.SURVEY_COLS)
)


@query("step_report", f"""
WITH m AS ({_MISS_UNION})
SELECT 'clean' AS step, 'dropped' AS kind, CAST(row_number() OVER (ORDER BY ord) AS INT) AS ordinal, col AS column_name
FROM m WHERE share > 0.3
UNION ALL SELECT 'clean', 'kept', CAST(row_number() OVER (ORDER BY ord) AS INT), col FROM m WHERE share <= 0.3
UNION ALL SELECT 'clean', 'n_before', CAST((SELECT count(*) FROM m) AS INT), NULL
UNION ALL SELECT 'clean', 'n_after', CAST((SELECT count(*) FROM m WHERE share <= 0.3) AS INT), NULL""")
def q_step_report(spark, sf):
    before = select.blank_to_null(survey(spark, sf))
    after, _ = select.drop_high_missing(before, 0.30)
    return io.step_report(spark, "clean", before.columns, after.columns)


# ======================================================================== 2.2
@query("age_filter", "SELECT * FROM survey WHERE idade IN (2, 3)")
def q_age_filter(spark, sf):
    return select.age_filter(survey(spark, sf), "idade", [2, 3])


@query("retention_report", """
WITH per AS (SELECT idade AS value, count(*) AS n FROM survey GROUP BY 1),
t AS (SELECT sum(n) AS n_original, sum(n) FILTER (WHERE value IN (2, 3)) AS n_filtered FROM per)
SELECT value, n, round(n * 100.0 / n_filtered, 6) AS pct, CAST(n_original AS BIGINT) AS n_original,
  CAST(n_filtered AS BIGINT) AS n_filtered, CAST(n_original - n_filtered AS BIGINT) AS n_removed,
  round(n_filtered * 100.0 / n_original, 6) AS retention_pct
FROM per, t WHERE value IN (2, 3)""")
def q_retention_report(spark, sf):
    return select.retention_report(survey(spark, sf), "idade", [2, 3])


@query("blank_to_null", f"SELECT {fx.survey_blank_select_sql()} FROM survey")
def q_blank_to_null(spark, sf):
    return select.blank_to_null(survey(spark, sf))


@query("drop_high_missing", f"SELECT {fx.survey_blank_select_sql(exclude=('alto_missing',))} FROM survey")
def q_drop_high_missing(spark, sf):
    return select.drop_high_missing(select.blank_to_null(survey(spark, sf)), 0.30)[0]


@query("drop_constant", "SELECT * EXCLUDE (constante) FROM survey")
def q_drop_constant(spark, sf):
    return select.drop_constant(survey(spark, sf))[0]


@query("drop_high_cardinality", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part", survey_cte=False)
def q_drop_high_cardinality(spark, sf):
    return select.drop_high_cardinality(load(spark, sf, "part"), 20)[0]


@query("dedupe_columns", "SELECT id_anon, regiao, x1 FROM survey")
def q_dedupe_columns(spark, sf):
    s = survey(spark, sf)
    return select.dedupe_columns(s.select("id_anon", "regiao", "x1", F.col("regiao"), F.col("x1")))


@query("select_available", "SELECT id_anon, regiao, idade, peso1 FROM survey")
def q_select_available(spark, sf):
    return select.select_available(survey(spark, sf), ["id_anon", "regiao", "idade", "peso1", "not_in_table"])[0]


@query("select_available_status", """
SELECT * FROM (VALUES (1, 'id_anon', 'kept'), (2, 'regiao', 'kept'), (3, 'not_in_table', 'missing'), (4, 'segmento', 'excluded'),
  (5, 'serie', 'excluded'), (6, 'parto', 'excluded')) t(ordinal, column_name, status)""", survey_cte=False)
def q_select_available_status(spark, sf):
    s = survey(spark, sf).select("id_anon", "regiao", "segmento", "serie", "parto")
    return select.status_rows(s, select.select_available(s, ["id_anon", "not_in_table", "regiao"])[1])


@query("rename_columns", "SELECT * RENAME (x1 AS saldo, x2 AS preco) FROM survey")
def q_rename_columns(spark, sf):
    return select.rename_columns(survey(spark, sf), {"x1": "saldo", "x2": "preco"})


@query("drop_columns", "SELECT * EXCLUDE (alto_missing, constante) FROM survey")
def q_drop_columns(spark, sf):
    return select.drop_columns(survey(spark, sf), ["alto_missing", "constante", "not_in_table"])


_PESO_SQL = ("COALESCE((CASE WHEN peso1 <> 0 THEN peso1 END + CASE WHEN peso2 <> 0 THEN peso2 END) / 2, "
             "CASE WHEN peso1 <> 0 THEN peso1 END, CASE WHEN peso2 <> 0 THEN peso2 END)")


@query("replace_in_position", f"SELECT * EXCLUDE (peso1, peso2), {_PESO_SQL} AS peso FROM survey")
def q_replace_in_position(spark, sf):
    s = survey(spark, sf)
    x = F.when(F.col("peso1") != 0, F.col("peso1"))
    y = F.when(F.col("peso2") != 0, F.col("peso2"))
    return select.replace_in_position(s, "peso1", "peso", F.coalesce((x + y) / 2, x, y), drop_also=["peso2"])


NAME_RULES = {"exact": ["brand#1"], "prefix": ["brand#2"], "contains": ["#5"], "token": []}


@query("candidate_columns", f"""
SELECT * FROM ({fx.DICTIONARY_SQL}) d
WHERE NOT (lower(variavel) = 'brand#1' OR starts_with(lower(variavel), 'brand#2') OR contains(lower(variavel), '#5'))""",
       survey_cte=False)
def q_candidate_columns(spark, sf):
    return select.candidate_columns(fx.dictionary(spark, sf), NAME_RULES)


_ALLOWED_SQL = ", ".join(f"'{b}'" for b in fx.ALLOWED_BLOCKS)


@query("block_whitelist", f"""
WITH {fx.DICT_LAST_SQL}
SELECT u.variavel, d.bloco FROM ({fx.CASED_NAMES_SQL}) u JOIN dlast d ON u.variavel = d.variavel
WHERE d.bloco IN ({_ALLOWED_SQL}) AND {fx.WHITELIST_RULES_SQL}""", survey_cte=False)
def q_block_whitelist(spark, sf):
    return select.block_whitelist(fx.cased_names(spark, sf), fx.dictionary(spark, sf), fx.ALLOWED_BLOCKS,
                                  **fx.WHITELIST_RULES).select("variavel", "bloco")


@query("dictionary_match", f"""
WITH {fx.DICT_FIRST_SQL}
SELECT u.variavel, d.descricao, d.bloco FROM ({fx.USED_NAMES_SQL}) u LEFT JOIN dfirst d ON lower(u.variavel) = d.k""",
       survey_cte=False)
def q_dictionary_match(spark, sf):
    return select.dictionary_match(fx.used_names(spark, sf), fx.dictionary(spark, sf))


FEATURE_GROUP_RULES = [("contains", "ring", "jewelry"), ("prefix", "small", "size"),
                       ("contains", "bolt", "hardware"), ("contains", "gear", "hardware")]


@query("feature_groups", """
SELECT DISTINCT p_name AS feature, CASE WHEN contains(lower(p_name), 'ring') THEN 'jewelry'
  WHEN starts_with(lower(p_name), 'small') THEN 'size' WHEN contains(lower(p_name), 'bolt') THEN 'hardware'
  WHEN contains(lower(p_name), 'gear') THEN 'hardware' ELSE 'other' END AS "group" FROM part""", survey_cte=False)
def q_feature_groups(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_name").alias("feature")).distinct()
    return select.feature_groups(names, FEATURE_GROUP_RULES, "other")


@query("numeric_coerce", """
SELECT event_id, TRY_CAST(props AS DOUBLE) AS props, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_txt
FROM events""", survey_cte=False)
def q_numeric_coerce(spark, sf):
    e = load(spark, sf, "events").select("event_id", "props", F.col("value").cast("string").alias("value_txt"))
    return select.numeric_coerce(e, ["props", "value_txt"])


@query("binary_cast", "SELECT doc_id, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM labels",
       survey_cte=False)
def q_binary_cast(spark, sf):
    lab = load(spark, sf, "labels").select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return select.binary_cast(lab, ["quality", "toxic"])


@query("detect_binary", """
SELECT l.doc_id, CAST(l.quality AS INT) AS quality, CAST(l.toxic AS INT) AS toxic, CAST(d.n_chars AS DOUBLE) AS n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""", survey_cte=False)
def q_detect_binary(spark, sf):
    lab = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id").select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("quality", "toxic", "n_chars")])
    return select.detect_binary(j, ["quality", "toxic", "n_chars"])[0]


@query("dataset_shape", """
SELECT (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_cols, d.dtype, d.n_cols_dtype
FROM (VALUES ('bigint', 3), ('double', 4), ('int', 1), ('string', 2), ('timestamp_ntz', 1)) d(dtype, n_cols_dtype)""",
       survey_cte=False)
def q_dataset_shape(spark, sf):
    return select.dataset_shape(load(spark, sf, "lineitem"))


@query("complete_cases", "SELECT * FROM survey WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in fx.SURVEY_COLS))
def q_complete_cases(spark, sf):
    return select.complete_cases(survey(spark, sf))


def _mp(spark, sf, which):
    s = select.drop_high_missing(select.blank_to_null(survey(spark, sf)), 0.30)[0]
    s = recode.threshold_label(s, "zimc", 3.0, "label")
    return select.missingness_partition(s, "id_anon", ["label"])[which]


_MP_COMPLETE = ["regiao", "segmento", "serie", "parto", "idade", "x1", "x2", "zimc", "constante"]
_MP_INCOMPLETE = ["prenatal", "semanas", "tempo", "tempo_medida", "peso1", "peso2", "em_branco"]
_MP_BASE = f"base AS (SELECT {fx.survey_blank_select_sql(exclude=('alto_missing',))}, CAST({fx.LABEL_SQL} AS INT) AS label FROM survey)"


@query("missingness_partition", f"WITH {_MP_BASE} SELECT id_anon, {', '.join(_MP_COMPLETE)}, label FROM base")
def q_missingness_partition(spark, sf):
    return _mp(spark, sf, "complete")


@query("missingness_partition_incomplete", f"""WITH {_MP_BASE}
SELECT id_anon, {', '.join(_MP_INCOMPLETE)}, label FROM base WHERE {' AND '.join(c + ' IS NOT NULL' for c in _MP_INCOMPLETE)}""")
def q_missingness_partition_incomplete(spark, sf):
    return _mp(spark, sf, "incomplete")


@query("missingness_partition_all", f"""WITH {_MP_BASE}
SELECT * FROM base WHERE {' AND '.join(c + ' IS NOT NULL' for c in _MP_INCOMPLETE)}""")
def q_missingness_partition_all(spark, sf):
    return _mp(spark, sf, "all")


@query("sort_report", f"""
WITH m AS ({_MISS_UNION})
SELECT col AS feature, n_missing, CAST(row_number() OVER (ORDER BY n_missing DESC, col) AS INT) AS position FROM m""")
def q_sort_report(spark, sf):
    from cohortlens.operators.profile import missing_profile

    prof = missing_profile(select.blank_to_null(survey(spark, sf))).select("feature", "n_missing")
    return select.sort_report(prof, "n_missing", "feature").select("feature", "n_missing", F.col("position").cast("int"))


# ======================================================================== 2.3
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("one_hot_full", "SELECT id_anon, " + ", ".join(
    f"CAST(COALESCE(regiao = '{r}', false) AS INT) AS \"regiao_{r}\"" for r in _REGIONS) + " FROM survey")
def q_one_hot_full(spark, sf):
    return recode.one_hot_full(survey(spark, sf).select("id_anon", "regiao"), "regiao")


@query("one_hot_drop_first", "SELECT id_anon, " + ", ".join(
    f"CAST(COALESCE(segmento = '{r}', false) AS INT) AS \"segmento_{r}\"" for r in _SEGMENTS[1:]) + " FROM survey")
def q_one_hot_drop_first(spark, sf):
    return recode.one_hot_drop_first(survey(spark, sf).select("id_anon", "segmento"), "segmento")


@query("one_hot_sparse", """
WITH c AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS position FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL))
SELECT l_orderkey, l_linenumber, position FROM lineitem LEFT JOIN c USING (l_partkey)""", survey_cte=False)
def q_one_hot_sparse(spark, sf):
    """More categories than columns can hold: each row's place in the sparse vector."""
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return recode.one_hot_positions(rows, "l_partkey").select("l_orderkey", "l_linenumber", "position")


@query("one_hot_capped", """
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1),
nc AS (SELECT count(*) AS k FROM c),
kept AS (SELECT source FROM c WHERE (SELECT k FROM nc) <= 5
         UNION ALL SELECT source FROM (SELECT source FROM c ORDER BY n DESC, source DESC LIMIT 4) WHERE (SELECT k FROM nc) > 5),
cols AS (SELECT 'source_' || source AS onehot_column, source FROM kept
         UNION ALL SELECT 'source_infrequent', NULL WHERE (SELECT k FROM nc) > 5)
SELECT d.doc_id, cols.onehot_column,
  CAST(CASE WHEN cols.source IS NOT NULL THEN d.source = cols.source
            ELSE d.source IN (SELECT source FROM c) AND d.source NOT IN (SELECT source FROM kept) END AS INT) AS value
FROM documents d, cols""", survey_cte=False)
def q_one_hot_capped(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source")
    fitted = recode.fit_one_hot_capped(docs.where(F.col("lang") == "en"), "source", max_categories=5)
    wide = recode.apply_one_hot_capped(docs.drop("lang"), fitted)
    cols = [c for c in wide.columns if c != "doc_id"]
    return wide.unpivot(["doc_id"], cols, "onehot_column", "value")


@query("merge_categories", """
SELECT id_anon, CASE WHEN regiao IN ('MIDDLE EAST', 'AFRICA') THEN 'Outros' ELSE regiao END AS regiao FROM survey""")
def q_merge_categories(spark, sf):
    s = survey(spark, sf).select("id_anon", "regiao")
    return recode.merge_categories(s, "regiao", ["MIDDLE EAST", "AFRICA"], "Outros")


@query("rare_categories", """
SELECT prenatal AS category, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM survey) AS DOUBLE), 6) AS share
FROM survey WHERE prenatal IS NOT NULL GROUP BY 1
HAVING count(*) / CAST((SELECT count(*) FROM survey) AS DOUBLE) < 0.05""")
def q_rare_categories(spark, sf):
    return recode.rare_categories(survey(spark, sf), "prenatal", 0.05)


@query("equality_flag", "SELECT id_anon, CAST(COALESCE(parto = 'F', false) AS INT) AS parto_f FROM survey")
def q_equality_flag(spark, sf):
    return recode.equality_flag(survey(spark, sf).select("id_anon", "parto"), "parto", "F", "parto_f").drop("parto")


@query("membership_flag",
       "SELECT id_anon, CAST(COALESCE(serie IN ('1-URGENT', '2-HIGH'), false) AS INT) AS serie_alta FROM survey")
def q_membership_flag(spark, sf):
    s = survey(spark, sf).select("id_anon", "serie")
    return recode.membership_flag(s, "serie", ["1-URGENT", "2-HIGH"], "serie_alta").drop("serie")


@query("not_contains_flag",
       "SELECT id_anon, CASE WHEN prenatal IS NULL THEN 1 ELSE CAST(NOT contains(prenatal, 'Nao') AS INT) END AS sem_nao FROM survey")
def q_not_contains_flag(spark, sf):
    s = survey(spark, sf).select("id_anon", "prenatal")
    return recode.not_contains_flag(s, "prenatal", "Nao", "sem_nao").drop("prenatal")


@query("recode_map",
       "SELECT id_anon, CAST(CASE prenatal WHEN 'Sim' THEN 1 WHEN 'Nao' THEN 0 END AS INT) AS prenatal_bin FROM survey")
def q_recode_map(spark, sf):
    s = survey(spark, sf).select("id_anon", "prenatal")
    return recode.recode_map(s, "prenatal", {"Sim": 1, "Nao": 0}, "prenatal_bin").drop("prenatal")


ORDINAL_RULES = [("urgent", 3), ("high", 2), ("medium", 1), ("low", 0)]
_ORD_SQL = ("CASE WHEN contains(lower(trim(serie)), 'urgent') THEN 3 WHEN contains(lower(trim(serie)), 'high') THEN 2 "
            "WHEN contains(lower(trim(serie)), 'medium') THEN 1 WHEN contains(lower(trim(serie)), 'low') THEN 0 END")


@query("ordinal_rules", f"SELECT id_anon, serie, CAST({_ORD_SQL} AS INT) AS serie_ord FROM survey")
def q_ordinal_rules(spark, sf):
    return recode.ordinal_rules(survey(spark, sf).select("id_anon", "serie"), "serie", ORDINAL_RULES, "serie_ord")


@query("unmapped_report", f"SELECT serie AS value, count(*) AS n FROM survey WHERE ({_ORD_SQL}) IS NULL AND serie IS NOT NULL GROUP BY 1")
def q_unmapped_report(spark, sf):
    s = recode.ordinal_rules(survey(spark, sf).select("id_anon", "serie"), "serie", ORDINAL_RULES, "serie_ord")
    return recode.unmapped_report(s, "serie", "serie_ord")


@query("derived_difference",
       "SELECT id_anon, COALESCE(peso1, (SELECT quantile_cont(peso1, 0.5) FROM survey)) - peso2 AS diff FROM survey")
def q_derived_difference(spark, sf):
    s = survey(spark, sf).select("id_anon", "peso1", "peso2")
    return recode.derived_difference(s, "peso1", "peso2", "diff").select("id_anon", "diff")


@query("unit_convert",
       "SELECT id_anon, CASE WHEN tempo_medida = 'Dias' THEN tempo * CAST(24 AS DOUBLE) ELSE tempo END AS tempo_h FROM survey")
def q_unit_convert(spark, sf):
    s = survey(spark, sf).select("id_anon", "tempo", "tempo_medida")
    return recode.unit_convert(s, "tempo", "tempo_medida", {"Dias": 24}, out="tempo_h").select("id_anon", "tempo_h")


@query("sentinel_to_median", f"SELECT id_anon, CASE WHEN semanas = 99 THEN {fx.SEMANAS_MEDIAN_SQL} ELSE semanas END AS semanas FROM survey")
def q_sentinel_to_median(spark, sf):
    s = survey(spark, sf).select("id_anon", "prenatal", "semanas")
    valid = (F.col("prenatal") == "Sim") & (F.col("semanas") < 99)
    return recode.sentinel_to_median(s, "semanas", 99.0, valid).select("id_anon", "semanas")


@query("constant_impute", "SELECT id_anon, COALESCE(tempo, 0) AS tempo FROM survey")
def q_constant_impute(spark, sf):
    return impute.constant_impute(survey(spark, sf).select("id_anon", "tempo"), ["tempo"], 0.0)


_MED_COLS = ["peso1", "peso2", "semanas", "tempo", "alto_missing"]


@query("median_impute", "SELECT id_anon, " + ", ".join(
    f"COALESCE({c}, (SELECT quantile_cont({c}, 0.5) FROM survey)) AS {c}" for c in _MED_COLS) + " FROM survey")
def q_median_impute(spark, sf):
    return impute.median_impute(survey(spark, sf).select("id_anon", *_MED_COLS), _MED_COLS)


_MODE_COLS = ["prenatal", "tempo_medida", "em_branco"]


def _mode_sql(c, src="b", where=""):
    w = f"WHERE {c} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"(SELECT {c} FROM {src} {w} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("mode_impute", f"WITH b AS (SELECT id_anon, prenatal, tempo_medida, {fx.blank_sql('em_branco')} AS em_branco FROM survey) "
       "SELECT id_anon, " + ", ".join(f"COALESCE({c}, {_mode_sql(c)}) AS {c}" for c in _MODE_COLS) + " FROM b")
def q_mode_impute(spark, sf):
    s = select.blank_to_null(survey(spark, sf).select("id_anon", *_MODE_COLS))
    return impute.mode_impute(s, _MODE_COLS)


def _fold_impute_sql() -> str:
    """Each fold's rows with the fills of the other folds."""
    parts = " UNION ALL ".join(f"""SELECT id_anon,
  COALESCE(peso1, (SELECT quantile_cont(peso1, 0.5) FROM folds WHERE fold <> {k})) AS peso1,
  COALESCE(semanas, (SELECT quantile_cont(semanas, 0.5) FROM folds WHERE fold <> {k})) AS semanas,
  COALESCE(prenatal, {_mode_sql('prenatal', 'folds', f'fold <> {k}')}) AS prenatal
FROM folds WHERE fold = {k}""" for k in range(5))
    return f"WITH {fx.FOLDS_CTE} {parts}"


@query("fit_transform_impute", _fold_impute_sql())
def q_fit_transform_impute(spark, sf):
    """All folds: each one's rows are filled with what its training part (the other folds) gives."""
    f = fx.folds(spark, sf).select("id_anon", "fold", "peso1", "semanas", "prenatal")
    out = impute.cross_impute(f, "fold", range(5), ["peso1", "semanas"], ["prenatal"])
    return out.select("id_anon", "peso1", "semanas", "prenatal")


@query("range_to_null", "SELECT id_anon, CASE WHEN semanas BETWEEN 14 AND 60 THEN semanas END AS semanas FROM survey")
def q_range_to_null(spark, sf):
    return recode.range_to_null(survey(spark, sf).select("id_anon", "semanas"), "semanas", 14, 60)


@query("any_of_flags", """
SELECT id_anon, CASE WHEN COALESCE(prenatal, tempo_medida) IS NOT NULL THEN
  greatest(CAST(COALESCE(prenatal = 'Sim', false) AS INT), CAST(COALESCE(tempo_medida = 'Sim', false) AS INT)) END AS algum_sim
FROM survey""")
def q_any_of_flags(spark, sf):
    s = survey(spark, sf).select("id_anon", "prenatal", "tempo_medida")
    return recode.any_of_flags(s, ["prenatal", "tempo_medida"], "Sim", "algum_sim").select("id_anon", "algum_sim")


@query("consolidate_measures", f"SELECT id_anon, {_PESO_SQL} AS peso FROM survey")
def q_consolidate_measures(spark, sf):
    s = survey(spark, sf).select("id_anon", "peso1", "peso2")
    return recode.consolidate_measures(s, "peso1", "peso2", "peso").select("id_anon", "peso")


@query("consolidation_counts", """
SELECT count(*) FILTER (WHERE peso1 IS NOT NULL AND peso1 <> 0 AND peso2 IS NOT NULL AND peso2 <> 0) AS n_both,
  count(*) FILTER (WHERE (peso1 IS NOT NULL AND peso1 <> 0) AND NOT (peso2 IS NOT NULL AND peso2 <> 0)) AS n_only_first,
  count(*) FILTER (WHERE NOT (peso1 IS NOT NULL AND peso1 <> 0) AND (peso2 IS NOT NULL AND peso2 <> 0)) AS n_only_second,
  count(*) FILTER (WHERE COALESCE(peso1 = 0, false) OR COALESCE(peso2 = 0, false)) AS n_zero_removed,
  count(*) FILTER (WHERE NOT (peso1 IS NOT NULL AND peso1 <> 0) AND NOT (peso2 IS NOT NULL AND peso2 <> 0)) AS n_missing
FROM survey""")
def q_consolidation_counts(spark, sf):
    return recode.consolidation_counts(survey(spark, sf), "peso1", "peso2")


@query("round_half_even", "SELECT id_anon, round_even(x2 / 3 * 100, 0) / 100 AS x2_terco FROM survey")
def q_round_half_even(spark, sf):
    s = survey(spark, sf)
    return s.select("id_anon", round_half_even(F.col("x2") / 3, 2).alias("x2_terco"))


@query("ratio_feature", """
SELECT id_anon, CASE WHEN tempo * 4 / 100 <> 0 THEN peso1 / ((tempo * 4 / 100) * (tempo * 4 / 100)) END AS razao FROM survey""")
def q_ratio_feature(spark, sf):
    s = survey(spark, sf).select("id_anon", "peso1", (F.col("tempo") * 4).alias("altura"))
    return recode.ratio_feature(s, "peso1", "altura", "razao").select("id_anon", "razao")


_BINS_SQL = ("CAST(COALESCE(zimc <= -2, false) AS INT) AS desnutrido, "
             "CAST(COALESCE(zimc > -2 AND zimc <= 2, false) AS INT) AS eutrofico, "
             "CAST(COALESCE(zimc > 2 AND zimc <= 3, false) AS INT) AS sobrepeso, "
             "CAST(COALESCE(zimc > 3, false) AS INT) AS obeso")


@query("bin_indicators", f"SELECT id_anon, zimc, {_BINS_SQL} FROM survey")
def q_bin_indicators(spark, sf):
    return recode.bin_indicators(survey(spark, sf).select("id_anon", "zimc"), "zimc")


@query("threshold_label", f"SELECT id_anon, CAST({fx.LABEL_SQL} AS INT) AS label FROM survey")
def q_threshold_label(spark, sf):
    return recode.threshold_label(survey(spark, sf).select("id_anon", "zimc"), "zimc", 3.0, "label").drop("zimc")


@query("indicators_to_class", f"SELECT id_anon, {fx.CLASS_SQL} AS classe FROM survey")
def q_indicators_to_class(spark, sf):
    s = recode.bin_indicators(survey(spark, sf).select("id_anon", "zimc"), "zimc")
    return recode.indicators_to_class(s).select("id_anon", "classe")


@query("class_to_indicators", f"""
WITH c AS (SELECT id_anon, {fx.CLASS_SQL} AS classe FROM survey)
SELECT id_anon, classe, CAST(classe = 0 AS INT) AS desnutrido, CAST(classe = 1 AS INT) AS eutrofico,
  CAST(classe = 2 AS INT) AS sobrepeso, CAST(classe = 3 AS INT) AS obeso FROM c""")
def q_class_to_indicators(spark, sf):
    s = recode.indicators_to_class(recode.bin_indicators(survey(spark, sf).select("id_anon", "zimc"), "zimc"))
    return recode.class_to_indicators(s.select("id_anon", "classe"), "classe")


@query("group_aggregate_features", f"""
WITH b AS (SELECT id_anon, {_BINS_SQL} FROM survey)
SELECT id_anon, desnutrido, eutrofico, least(sobrepeso + obeso, 1) AS excesso, 1 - desnutrido AS nao_desnutrido FROM b""")
def q_group_aggregate_features(spark, sf):
    s = recode.bin_indicators(survey(spark, sf).select("id_anon", "zimc"), "zimc").drop("zimc")
    return recode.group_aggregate_features(s, {"excesso": ["sobrepeso", "obeso"]}, {"nao_desnutrido": "desnutrido"},
                                           drop=["sobrepeso", "obeso"])


_RS_COLS = ["x1", "x2", "peso1"]


def _rs_sql():
    parts = []
    for c in _RS_COLS:
        med = f"(SELECT quantile_cont({c}, 0.5) FROM folds WHERE fold <> 0)"
        iqr = (f"(SELECT CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1 "
               f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM folds WHERE fold <> 0)")
        parts.append(f"({c} - {med}) / {iqr} AS {c}")
    return ", ".join(parts)


@query("robust_scale", f"WITH {fx.FOLDS_CTE} SELECT id_anon, fold, {_rs_sql()} FROM folds")
def q_robust_scale(spark, sf):
    f = fx.folds(spark, sf).select("id_anon", "fold", *_RS_COLS)
    return impute.robust_scale(f.where("fold != 0"), f, _RS_COLS)


@query("ci_format", """
WITH g AS (SELECT segmento, CAST(count(*) AS DOUBLE) AS m, min(x1) AS lo, max(x1) AS hi FROM survey GROUP BY 1)
SELECT segmento, regexp_replace(regexp_replace('(' || printf('%.2f', lo) || '-' || printf('%.2f', hi) || ')', '\\(', '['), '\\)', ']') AS faixa,
  printf('%.2f [%.2f-%.2f]', m, lo, hi) AS resumo FROM g""")
def q_ci_format(spark, sf):
    g = survey(spark, sf).groupBy("segmento").agg(F.count(F.lit(1)).cast("double").alias("m"),
                                                   F.min("x1").alias("lo"), F.max("x1").alias("hi"))
    txt = F.concat(F.lit("("), F.format_string("%.2f", "lo"), F.lit("-"), F.format_string("%.2f", "hi"), F.lit(")"))
    return g.select("segmento", recode.ci_bracket(txt).alias("faixa"),
                    recode.ci_string(F.col("m"), F.col("lo"), F.col("hi"), 2).alias("resumo"))


# ======================================================================== flagship
@query("class_distribution", f"""
WITH {fx.PREPARED_CTE},
src AS (SELECT classe AS class, count(*) AS n_source FROM prep GROUP BY 1),
kept AS (SELECT classe AS class, count(*) AS n FROM prep WHERE prenatal_bin IS NOT NULL AND semanas IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(n) AS t FROM kept)
SELECT src.class, COALESCE(kept.n, 0) AS n, round(COALESCE(kept.n, 0) * 100.0 / tot.t, 6) AS pct, src.n_source,
  round(COALESCE(kept.n, 0) * 100.0 / src.n_source, 6) AS retention_pct
FROM src LEFT JOIN kept ON src.class = kept.class, tot""")
def q_class_distribution(spark, sf):
    p = fx.prepared(spark, sf)
    # model dataset = complete cases of the recoded columns; both counts in one grouped pass
    kept = F.col("prenatal_bin").isNotNull() & F.col("semanas").isNotNull()
    return class_distribution(p, "classe", kept=kept)
