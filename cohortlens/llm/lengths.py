"""Token counts: an exact histogram of encoded lengths, and sums over it for every context limit.

Each task counts the lengths of its own documents, so what is shuffled is one
row for each task and length. All questions are then answered by the
histogram: totals, quantiles, and how many tokens are left when documents are
cut at a limit. The running sums go over blocks of lengths, so no task sorts
more than ``BLOCK`` of them.

A null text counts as empty (length 0); repeated rows count each; an empty
table has an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import written
from cohortlens.llm.encode import Encoder, batches_of

BLOCK = 4096


def histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs): how many documents encode to each number of tokens."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, counts = Encoder.shared(vocabulary), {}
        for b in batches:
            for some in batches_of(b["_text"].fillna("").tolist()):
                for ids in encoder.ids(some):
                    counts[len(ids)] = counts.get(len(ids), 0) + 1
        yield pd.DataFrame({"length": np.array(list(counts), dtype=np.int64), "n": np.array(list(counts.values()), dtype=np.int64)})

    local = docs.select(F.col(text_col).cast("string").alias("_text")).mapInPandas(run, "length long, n long")
    return local.groupBy("length").agg(F.sum("n").alias("n_docs"))


def sums(hist: DataFrame) -> DataFrame:
    """The histogram (a written table) with, for each length taken as a context limit:

    docs_over and tokens_over (of longer documents), docs_up_to, tokens_up_to,
    truncated_total (tokens left when every document is cut at the limit) and
    share_up_to (of documents).
    """
    parts = hist.withColumn("_block", F.floor(F.col("length") / BLOCK)).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (parts.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
              .select("_block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")]))
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    total = parts.agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("_all"))
    over = (parts.join(blocks, "_block")
            .withColumn("docs_over", F.col("_d_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
            .withColumn("tokens_over", F.col("_t_later") + F.coalesce(F.sum("_tokens").over(inside), F.lit(0))))
    docs, tokens = total.first()
    up_to = F.lit(docs).cast("long") - F.col("docs_over")
    return over.select(
        "length", "n_docs", "docs_over", "tokens_over", up_to.alias("docs_up_to"),
        (F.lit(tokens).cast("long") - F.col("tokens_over")).alias("tokens_up_to"),
        (F.lit(tokens).cast("long") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
        (up_to / F.lit(docs)).alias("share_up_to"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of documents don't exceed, from sums()."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    return (table.select("length", "share_up_to", wanted.alias("share")).where("share_up_to >= share")
            .groupBy("share").agg(F.min("length").alias("length")))


def truncated(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): tokens left when every document is cut at each limit, from sums()."""
    each = table.select("length", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    return each.groupBy("limit").agg(F.sum(F.least("length", "limit") * F.col("n_docs")).alias("tokens"))


def length_sums(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    return sums(written(histogram(docs, vocabulary, text_col), "lengths"))
