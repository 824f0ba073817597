"""Ranks, running sums and preceding rows in the order of a book, however long the book is.

A window over a book would gather it in one task. Here rows are dealt by ranges
of the order, so a long book spreads over tasks; windows run within a task's
range, and what the ranges before it hold of the same book is carried over: a
row for each range and book. Where every group is known to fit in a task, a plain
Window is the better plan: it needs one shuffle and no written table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.common import written

PART = "_part"


def spread(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges of group and order, each row with its range. Written, as ranges hold within one run."""
    return written(df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()), "spread")


def _carried(df: DataFrame, totals: DataFrame, group: list[str], added: list[str]) -> DataFrame:
    other = totals.select(F.col(PART).alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *added)
    same = F.col(PART) == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return df.join(other, same, "left").drop("_p", *[f"_g{i}" for i in range(len(group))])


def running(df: DataFrame, group: list[str], order: list[str], sums: Mapping[str, Column | str], before: bool = False) -> DataFrame:
    """Adds running sums of non-negative values over a spread table, up to each row, or with ``before`` up to the one before it."""
    own = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    valued = df.withColumns({f"_v_{k}": F.expr(v) if isinstance(v, str) else v for k, v in sums.items()})
    totals = valued.groupBy(PART, *group).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_c_{k}": F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)) for k in sums})
    local = valued.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0)) for k in sums})
    out = _carried(local, totals, group, [f"_c_{k}" for k in sums])
    return out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_c_{k}") for k in sums}).drop(*[f"_{x}_{k}" for x in "vlc" for k in sums])


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place in its group, from 1, to a spread table."""
    return running(df, group, order, {name: F.lit(1)})


def previous(df: DataFrame, group: list[str], order: list[str], columns: Mapping[str, str]) -> DataFrame:
    """Adds columns of the row before (null on the first) to a spread table; columns: new name -> column."""
    row = F.struct(*[F.col(c).alias(k) for k, c in columns.items()])
    own = Window.partitionBy(PART, *group).orderBy(*order)
    local = df.withColumn("_prev", F.lag(row).over(own))
    ends = df.groupBy(PART, *group).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*group).orderBy(PART)))
    out = _carried(local, ends, group, ["_before"])
    found = F.coalesce(F.col("_prev"), F.col("_before"))
    return out.withColumns({k: found[k] for k in columns}).drop("_prev", "_before")
