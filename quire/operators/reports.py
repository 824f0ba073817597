"""Roll-ups over books, usage logs and trials of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_WORDS = 250


def status(chunks: DataFrame) -> DataFrame:
    """(book_id, done, total, missing, first_missing) of chunks with book_id, chunk, translation."""
    gap = F.col("translation").isNull()
    return chunks.groupBy("book_id").agg(F.count("translation").alias("done"), F.count("*").alias("total"), F.count_if(gap).alias("missing"), F.min(F.when(gap, F.col("chunk"))).alias("first_missing"))


def judged(scores: DataFrame, keys: list[str], criteria: list[str]) -> DataFrame:
    """(keys, judges, score): the mean over judges of the mean over criteria, an absent one counting 0; 0 without judges.

    scores has a row for each run and judge; a judge without any criterion doesn't count.
    """
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in criteria), start=F.lit(0)) / len(criteria)
    counts = F.coalesce(*[F.col(c) for c in criteria]).isNotNull()
    return scores.groupBy(*keys).agg(F.count_if(counts).alias("judges"), F.coalesce(F.avg(F.when(counts, total)), F.lit(0.0)).alias("score"))


def prices(cost: Column, words: Column) -> tuple[Column, Column]:
    """What 10 and 300 pages cost at this cost for so many words; no cost is 0."""
    page = F.coalesce(cost, F.lit(0.0)) / (words / PAGE_WORDS)
    return page * 10, page * 300


def run_ok(exit_code: Column, translations: Column) -> Column:
    """An aggregate: the run ended well and every chunk has a translation that isn't empty."""
    return F.every(F.coalesce((exit_code == 0) & (F.size(translations) > 0), F.lit(False)))
