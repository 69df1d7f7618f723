"""Results arriving as a stream are upserted per (model, algorithm)."""

from pyspark.sql import functions as F

from cohortlens.session import fresh_path
from cohortlens.sources.io import read_results
from cohortlens.streaming import start_results_upsert
from tests.conftest import SF0001


def test_stream_upsert(spark):
    from cohortlens.sources.tables import survey

    src = fresh_path(spark, "incoming")
    s = survey(spark, SF0001)
    first = s.groupBy(F.col("segmento").alias("model"), F.col("serie").alias("algorithm")).agg(
        F.lit(1).alias("run"), F.avg("x2").alias("value"))
    first.coalesce(1).write.parquet(src + "/b1")
    second = first.where(F.col("algorithm") == "1-URGENT").withColumn("run", F.lit(2))
    second.coalesce(1).write.parquet(src + "/b2")
    out, ckpt = fresh_path(spark, "results"), fresh_path(spark, "ckpt")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = start_results_upsert(stream, out, ckpt)
    q.awaitTermination(120)
    res = read_results(spark, out)
    assert res.count() == first.count()
    # one file per micro-batch, in arrival order: the second batch replaced the URGENT partitions
    runs = {(r.algorithm, r.run) for r in res.select("algorithm", "run").distinct().collect()}
    assert ("1-URGENT", 2) in runs and ("1-URGENT", 1) not in runs and ("2-HIGH", 1) in runs
