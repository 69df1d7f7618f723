"""Derived tables shared by the registered queries, with their SQL twins.

Each Spark builder here reads the given tables (or data Spark derives from
them); the matching ``*_SQL`` text builds the same rows in DuckDB for the
oracle.  Keep both sides in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.hashing import portable_hash_sql
from cohortlens.operators import recode, resample, select
from cohortlens.sources.tables import load, survey

SURVEY_COLS = ["id_anon", "regiao", "segmento", "serie", "parto", "idade", "prenatal", "semanas", "tempo",
               "tempo_medida", "peso1", "peso2", "alto_missing", "em_branco", "x1", "x2", "zimc", "constante"]
SURVEY_STRING_COLS = ["regiao", "segmento", "serie", "parto", "prenatal", "tempo_medida", "em_branco", "constante"]
SURVEY_TYPES = {"id_anon": "bigint", "regiao": "string", "segmento": "string", "serie": "string", "parto": "string",
                "idade": "int", "prenatal": "string", "semanas": "double", "tempo": "double",
                "tempo_medida": "string", "peso1": "double", "peso2": "double", "alto_missing": "double",
                "em_branco": "string", "x1": "double", "x2": "double", "zimc": "double", "constante": "string"}
SEED = 42

# The allowed dictionary blocks of the reference's whitelist.
ALLOWED_BLOCKS = ["A", "B", "D", "H", "I", "J", "K", "Q", "R", "X"]


def blank_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN NULL ELSE {c} END"


def survey_blank_select_sql(exclude: tuple = ()) -> str:
    return ", ".join(
        (f"{blank_sql(c)} AS {c}" if c in SURVEY_STRING_COLS else c) for c in SURVEY_COLS if c not in exclude
    )


# ---------------------------------------------------------------- label / classes
def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """survey + label (zimc > 3) + four indicators + class code."""
    s = survey(spark, sf)
    s = recode.threshold_label(s, "zimc", 3.0, "label")
    s = recode.bin_indicators(s, "zimc")
    return recode.indicators_to_class(s)


LABEL_SQL = "CASE WHEN zimc > 3 THEN 1 ELSE 0 END"
CLASS_SQL = ("CAST(CASE WHEN zimc <= -2 THEN 0 WHEN zimc <= 2 THEN 1 WHEN zimc <= 3 THEN 2 "
             "WHEN zimc > 3 THEN 3 END AS INT)")
LABELLED_CTE = f"lab AS (SELECT *, CAST({LABEL_SQL} AS INT) AS label, {CLASS_SQL} AS classe FROM survey)"


def folds(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """labelled survey + ``fold`` (stratified by label, seeded hash order)."""
    return resample.stratified_kfold(labelled(spark, sf), "label", "id_anon", k=k, seed=SEED)


FOLDS_CTE = LABELLED_CTE + f""", fh AS (SELECT *, {portable_hash_sql(SEED, 'id_anon')} AS h FROM lab),
folds AS (SELECT * EXCLUDE (h), CAST((row_number() OVER (PARTITION BY label ORDER BY h, id_anon) - 1) % 5 AS INT) AS fold FROM fh)"""


def split(spark: SparkSession, sf: str) -> DataFrame:
    """labelled survey + ``split`` (80/20, exact per class)."""
    return resample.stratified_split(labelled(spark, sf), "classe", "id_anon", 0.2, seed=SEED)


SPLIT_CTE = LABELLED_CTE + f""", sh AS (SELECT *, {portable_hash_sql(SEED, 'id_anon')} AS h,
  row_number() OVER (PARTITION BY classe ORDER BY {portable_hash_sql(SEED, 'id_anon')}, id_anon) - 1 AS pos,
  count(*) OVER (PARTITION BY classe) AS n_class FROM lab),
splitted AS (SELECT * EXCLUDE (h, pos, n_class),
  CASE WHEN pos < floor(n_class * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM sh)"""


# ---------------------------------------------------------------- cleaned survey (minimum slice)
def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """survey -> blank_to_null -> drop_high_missing -> recode_map -> sentinel_to_median -> bins -> class."""
    s = select.blank_to_null(survey(spark, sf))
    s, _ = select.drop_high_missing(s, 0.30)
    s = recode.recode_map(s, "prenatal", {"Sim": 1, "Nao": 0}, out="prenatal_bin")
    valid = (F.col("prenatal") == "Sim") & (F.col("semanas") < 99)
    s = recode.sentinel_to_median(s, "semanas", 99.0, valid)
    s = recode.bin_indicators(s, "zimc")
    return recode.indicators_to_class(s)


SEMANAS_MEDIAN_SQL = ("(SELECT quantile_cont(semanas, 0.5) FROM survey "
                      "WHERE semanas <> 99 AND prenatal = 'Sim' AND semanas < 99)")
PREPARED_CTE = f"""prep AS (SELECT id_anon, regiao, segmento, serie, parto, idade, prenatal,
  CAST(CASE prenatal WHEN 'Sim' THEN 1 WHEN 'Nao' THEN 0 END AS INT) AS prenatal_bin,
  CASE WHEN semanas = 99 THEN {SEMANAS_MEDIAN_SQL} ELSE semanas END AS semanas,
  tempo, tempo_medida, peso1, peso2, {blank_sql('em_branco')} AS em_branco, x1, x2, zimc, constante,
  {CLASS_SQL} AS classe FROM survey)"""


# ---------------------------------------------------------------- variable dictionary from part
def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """(variavel, descricao, bloco, ordem): one entry per part; names repeat with mixed case."""
    p = load(spark, sf, "part")
    return p.select(
        F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("variavel"),
        F.col("p_name").alias("descricao"),
        F.expr("char(65 + p_size % 26)").alias("bloco"),
        F.col("p_partkey").alias("ordem"),
    )


DICTIONARY_SQL = """SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS variavel,
  p_name AS descricao, chr(CAST(65 + p_size % 26 AS INT)) AS bloco, p_partkey AS ordem FROM part"""


def used_names(spark: SparkSession, sf: str) -> DataFrame:
    """Column names of a wide brand table: brands that occur in lineitem (as written in part)."""
    li = load(spark, sf, "lineitem").select("l_partkey").distinct()
    p = load(spark, sf, "part").select("p_partkey", "p_brand")
    return p.join(li, p.p_partkey == li.l_partkey, "left_semi").select(F.col("p_brand").alias("variavel")).distinct()


USED_NAMES_SQL = """SELECT DISTINCT p_brand AS variavel FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)"""

DICT_FIRST_SQL = f"""dfirst AS (SELECT lower(variavel) AS k, descricao, bloco FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(variavel) ORDER BY ordem) AS r FROM ({DICTIONARY_SQL})) WHERE r = 1)"""


#: Rules of the whitelist query: substrings out of the window, exact names, prefixes.
WHITELIST_RULES = {"out_of_window": ["#3"], "exclude_exact": ["brand#11", "Brand#12"], "exclude_prefix": ["brand#2"]}
WHITELIST_RULES_SQL = ("NOT contains(lower(u.variavel), '#3') AND u.variavel NOT IN ('brand#11', 'Brand#12') "
                       "AND NOT starts_with(lower(u.variavel), 'brand#2')")


def cased_names(spark: SparkSession, sf: str) -> DataFrame:
    """Column names as the dictionary spells them, for parts that occur in lineitem, and one that it hasn't."""
    li = load(spark, sf, "lineitem").select("l_partkey").distinct()
    d = dictionary(spark, sf)
    return (d.join(li, d.ordem == li.l_partkey, "left_semi").select("variavel")
            .union(used_names(spark, sf)).distinct())


CASED_NAMES_SQL = f"""SELECT variavel FROM ({DICTIONARY_SQL}) WHERE ordem IN (SELECT l_partkey FROM lineitem)
UNION ({USED_NAMES_SQL})"""

DICT_LAST_SQL = f"""dlast AS (SELECT variavel, bloco FROM (
  SELECT *, row_number() OVER (PARTITION BY variavel ORDER BY ordem DESC) AS r FROM ({DICTIONARY_SQL})) WHERE r = 1)"""
