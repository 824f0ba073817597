"""A corpus made ready for training, in stages that each call one operator of quire.llm.

Stages take documents with any further columns and all but the last, whose rows
are pieces, keep them, whatever their names; nulls, empty texts, repeated rows and empty tables as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, langid, packing, secrets
from quire.llm.common import bound_batches, materialize, remove_tables, table, tables_written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language with a probability of a half, go."""
    bound_batches(spark)
    return langid.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    bound_batches(spark)
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bound_batches(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark, and n_chars, which the table must have, the length of what is left."""
    bound_batches(spark)
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: a row for each piece."""
    bound_batches(spark)
    return packing.pack_exact_complement(docs)


STAGES = [("language_id", identified), ("jaccard_join", deduplicated), ("decontamination", decontaminated), ("secret_scan", redacted), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written, and what was needed for it then removed."""
    docs, first = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        remove_tables(spark, first, keep=1)
    return docs


#: Tokens, and what a model learns, are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
