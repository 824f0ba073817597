"""Checking answers against their sources, by joins on segment ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_problems(source: DataFrame, answer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missing, extra, repeated): ids asked for but not answered, answered but not asked for, and answered more than once.

    source and answer have keys and id; a row for each task with a problem, ids sorted.
    """
    counted = answer.groupBy(*keys, "id").agg(F.count("*").alias("answers"))
    asked = source.select(*keys, "id").distinct().withColumn("asked", F.lit(True))
    both = asked.join(counted, [*keys, "id"], "full")
    listed = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("id"))))
    found = both.groupBy(*keys).agg(listed(F.col("answers").isNull()).alias("missing"), listed(F.col("asked").isNull()).alias("extra"), listed(F.col("answers") > 1).alias("repeated"))
    return found.where("size(missing) + size(extra) + size(repeated) > 0")


def signature_problems(source: DataFrame, answer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, expected, got) of answered segments whose tags differ; both tables have keys, id and signature."""
    both = source.select(*keys, "id", F.col("signature").alias("expected")).join(answer.select(*keys, "id", F.col("signature").alias("got")), [*keys, "id"])
    return both.where(~F.col("expected").eqNullSafe(F.col("got")))


def problems(source: DataFrame, answer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): all that is wrong with each answer, in one text."""
    ids = id_problems(source, answer, keys)
    told = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: "), F.array_join(name, ", ")))
    first = ids.select(*keys, F.lit("").alias("id"), F.concat_ws("; ", told("missing"), told("extra"), told("repeated")).alias("problem"))
    tags = signature_problems(source, answer, keys)
    second = tags.select(*keys, "id", F.concat(F.lit("tags of "), F.col("id"), F.lit(" differ: expected "), F.array_join("expected", ", "), F.lit("; got "), F.array_join("got", ", ")).alias("problem"))
    rows = first.unionByName(second).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "problem"))).alias("p"))
    return rows.select(*keys, F.array_join(F.transform("p", lambda x: x["problem"]), "\n").alias("problem"))
