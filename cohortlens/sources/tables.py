"""Table loading and the derived ``survey`` table used as the survey stand-in.

The survey view follows the portable definition in FIXTURES.md: one row per
order, ids unique, a block of conditional missing values, a sentinel code,
mixed units, an invalid-zero measurement pair, a blank string column, a
constant column and a z-score target.  The SQL text (``SURVEY_SQL``) is the
oracle's copy of the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``survey`` table derived from orders, customer, nation and region."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    k = F.col("o_orderkey")
    block = (k % 10) < 7
    dbl = lambda v: F.lit(v).cast("double")
    return j.select(
        k.alias("id_anon"),
        F.col("r_name").alias("regiao"),
        F.col("c_mktsegment").alias("segmento"),
        F.col("o_orderpriority").alias("serie"),
        F.col("o_orderstatus").alias("parto"),
        (F.lit(2) + k % 3).cast("int").alias("idade"),
        F.when(block, F.when(k % 7 == 0, "Nao").when(k % 41 == 0, "Nao sabe").otherwise("Sim")).alias("prenatal"),
        F.when(block, F.when(k % 23 == 0, dbl(99)).otherwise((F.col("o_custkey") % 40).cast("double"))).alias("semanas"),
        F.when(block, (F.col("o_custkey") % 30).cast("double")).alias("tempo"),
        F.when(block, F.when(k % 4 == 0, "Dias").otherwise("Horas")).alias("tempo_medida"),
        F.when(k % 17 == 0, dbl(0)).when(k % 19 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(40) + F.col("c_acctbal") / 100).alias("peso1"),
        F.when(k % 29 == 0, dbl(0)).when(k % 19 == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(41) + F.col("c_acctbal") / 100).alias("peso2"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("alto_missing"),
        F.when(k % 13 == 0, F.lit("   ")).otherwise(F.col("o_orderstatus")).alias("em_branco"),
        F.col("c_acctbal").alias("x1"),
        F.col("o_totalprice").alias("x2"),
        (((k * 7919) % 1000).cast("double") / 100 - 5
         + F.when(F.col("c_acctbal") > 5000, dbl(0.5)).otherwise(dbl(0))).alias("zimc"),
        F.lit("Nao").alias("constante"),
    )


# Oracle copy of the survey definition (DuckDB dialect), used as a CTE.
SURVEY_SQL = """
SELECT o.o_orderkey AS id_anon, r.r_name AS regiao, c.c_mktsegment AS segmento,
 o.o_orderpriority AS serie, o.o_orderstatus AS parto,
 CAST(2 + o.o_orderkey % 3 AS INT) AS idade,
 CASE WHEN o.o_orderkey % 10 < 7 THEN CASE WHEN o.o_orderkey % 7 = 0 THEN 'Nao'
      WHEN o.o_orderkey % 41 = 0 THEN 'Nao sabe' ELSE 'Sim' END END AS prenatal,
 CASE WHEN o.o_orderkey % 10 < 7 THEN CASE WHEN o.o_orderkey % 23 = 0 THEN CAST(99 AS DOUBLE)
      ELSE CAST(o.o_custkey % 40 AS DOUBLE) END END AS semanas,
 CASE WHEN o.o_orderkey % 10 < 7 THEN CAST(o.o_custkey % 30 AS DOUBLE) END AS tempo,
 CASE WHEN o.o_orderkey % 10 < 7 THEN CASE WHEN o.o_orderkey % 4 = 0 THEN 'Dias' ELSE 'Horas' END END AS tempo_medida,
 CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE) WHEN o.o_orderkey % 19 = 0 THEN NULL
      ELSE 40 + c.c_acctbal / 100 END AS peso1,
 CASE WHEN o.o_orderkey % 29 = 0 THEN CAST(0 AS DOUBLE) WHEN o.o_orderkey % 19 = 0 THEN NULL
      ELSE 41 + c.c_acctbal / 100 END AS peso2,
 CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_totalprice END AS alto_missing,
 CASE WHEN o.o_orderkey % 13 = 0 THEN '   ' ELSE o.o_orderstatus END AS em_branco,
 c.c_acctbal AS x1, o.o_totalprice AS x2,
 CAST((o.o_orderkey * 7919) % 1000 AS DOUBLE) / 100 - 5
   + CASE WHEN c.c_acctbal > 5000 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS zimc,
 'Nao' AS constante
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def with_survey(sql: str) -> str:
    """Prefix an oracle query with the survey CTE."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH survey AS ({SURVEY_SQL}), {body[5:]}"
    return f"WITH survey AS ({SURVEY_SQL}) {body}"
