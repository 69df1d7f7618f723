"""Mixing sources to target weights by systematic sampling.

1. Each document's size is its number of words; each source's size is the sum.
2. Sources, ordered by code point with null last, get ``weights`` in turn and
   share ``budget`` times all words; a source stops at ``cap`` times its size
   and what is over goes to the others by weight (a water level).
3. A document of a source is expected ``target / source size`` times. The
   running sum of expected copies within the source, plus one random offset,
   crosses some integers at each document: it is taken once for each. Documents
   are walked in order of size, so the words taken follow the target closely.

Nulls: a null text has size 0; null sources form one source, the last. A source
without words has target 0 and none of its documents are taken. Repeated rows
are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, own_names, positions, written

#: The offset of a source has so many random bits, so that position x rate + offset stays exact.
OFFSET_BITS = 20


def source_key(source: str):
    """Orders sources by code point, null last, and is never null."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def water_level(sources: DataFrame, share: float) -> float:
    """The level L at which sum(min(most, L * weight)) reaches ``share``: one aggregate for each round.

    Each round caps the sources that the last level fills; the level only rises,
    and it stands when no more sources are filled.
    """
    level = -1.0
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        spent, left = sources.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            return max(level, 0.0)
        rise = (share - (spent or 0.0)) / left
        if rise <= level:
            return level
        level = rise


def source_targets(sized: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """One row for each source key: source_size, target (both in words)."""
    totals = written(sized.groupBy("_key").agg(F.sum("_size").alias("source_size")), "mix-sources")
    n = len(weights)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % n + 1).cast("int"))
    sources = written(positions(totals, ["_key"], out="_rank").withColumn("weight", choice)
                      .withColumn("most", F.col("source_size") * F.lit(float(cap))), "mix-weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * budget)
    return sources.select("_key", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, rate, copies, taken.

    ``copies`` is how often the mix takes the document and ``taken`` is copies x size.
    """
    sized = written(docs.select(F.col(id_col).alias("_id"), source_key(source_col).alias("_key"),
                                F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size")),
                    "mix-sizes")
    targets = source_targets(sized, weights, budget, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = OFFSET_BITS // 4
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_key"))), 1, digits), 16, 10).cast("double") / F.lit(float(1 << OFFSET_BITS))
    walked = positions(sized, ["_size", "_id"], by=["_key"], out="_at").join(
        targets.withColumn("rate", rate).withColumn("_offset", offset), "_key")
    crossed = lambda at: F.floor(at * F.col("rate") + F.col("_offset"))
    copies = F.least(crossed(F.col("_at")) - crossed(F.col("_at") - 1), F.ceil(F.col("rate")))
    return (walked.withColumn("copies", copies.cast("long"))
            .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("_size")).alias("taken")))


@own_names
def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as often as it is taken.

    Rows that share an id are told apart by their order of size within the id.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).select(
        F.col(id_col).alias("_id"), F.col("size").alias("_planned"), F.col("copies").alias("_copies"))
    plan = plan.withColumn("_nth", F.row_number().over(Window.partitionBy("_id").orderBy("_planned", "_copies"))).where("_copies > 0")
    rows = docs.withColumn("_size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(id_col).orderBy("_size", F.xxhash64(text_col))))
    taken = rows.join(plan, rows[id_col].eqNullSafe(plan["_id"]) & (F.col("_at") == F.col("_nth")))
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return taken.select(*[rows[c] for c in docs.columns], repeats.alias("_copy")).drop("_copy")
