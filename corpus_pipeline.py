"""A corpus pipeline: toxicity filter, SimHash near-dedup, secret redaction, source mixing, packing.

``run`` applies the stages to ``documents`` one after the other; each stage's
rows are written to the shared folder and read again as the next one's input.
All stages but the last return the columns of documents; further columns of any
name come along unchanged. Null ids, texts, languages and sources, empty texts
and repeated rows go through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import mixing, packing, secrets, simhash, toxicity
from cohortlens.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier scores below its language's threshold.

    A null or empty text is scored like any other; repeated rows go or stay together; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), "text", "lang"), model)
    return scored.where(F.col("score") < toxicity.language_threshold(model)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 2 or fewer differing bits: the one with the smallest id."""
    return simhash.keep_one(docs, threshold=2, shingle=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text; n_chars changes as the text's length does (a null n_chars stays null)."""
    masked = secrets.redact(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    grown = F.coalesce(F.length("text") - F.length("row.text"), F.lit(0))
    n_chars = (F.col("row.n_chars") + grown).cast(docs.schema["n_chars"].dataType)
    return masked.select(F.col("row").withField("text", F.col("text")).withField("n_chars", n_chars).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 by source, 150 % of all words, at most twice a source."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and hashes decide what stays, so SQL can't give run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages leave."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
