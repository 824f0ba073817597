"""Exact top-k search by inner product: columnar branch and bound.

Candidates are dealt into shards, queries into blocks, and every shard meets
every block once. There, vectors lie dimension by dimension; products are added
up one block of dimensions after another, and after each block only candidates
are kept whose sum so far, plus the most that the remaining mass of both
vectors allows (Cauchy-Schwarz), reaches the k-th best guaranteed sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import shuffle_partitions

#: Candidates of a shard and queries of a block, at most; shards are smaller, down to LEAST_ROWS, where there would be fewer of them than partitions.
SHARD_ROWS, LEAST_ROWS, BLOCK_ROWS, DIMENSIONS = 1 << 16, 4096, 1 << 14, 8


def finite(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    inf = F.lit(float("inf"))
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def quantized(vector: str, scale: int = 1024) -> Column:
    """Components rounded down to 1/scale, as whole numbers; one beyond 64 bits ends the job."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        beyond = (y < F.lit(-(2.0**63))) | (y >= F.lit(2.0**63))
        return F.when(beyond, F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")).otherwise(F.floor(y).cast("long"))

    return F.transform(F.col(vector), whole)


class OwnRows:
    """For each query, which candidates have its key."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray):
        self.queries, self.candidates = queries, candidates

    def __getitem__(self, i: int) -> np.ndarray:
        return self.candidates == self.queries[i]


def branch_and_bound(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray | OwnRows, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (row of integers) the candidate rows that can be among its k best, and their scores.

    own: for each query the candidate rows that are not to be found by it, as a
    mask. Sums are doubles and bounds allow for their rounding; where sums
    can be inexact, the scores of what is left are computed again in integers.
    Fails if one of them doesn't fit into 64 bits.
    """
    dims = queries.shape[1]
    c, q = candidates.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(-np.square(c).sum(0), kind="stable")  # heavy dimensions first
    vertical, q = np.ascontiguousarray(c[:, order].T), q[:, order]
    edges = [*range(0, dims, DIMENSIONS), dims]
    rest_c = [np.sqrt(np.square(vertical[e:]).sum(0)) for e in edges]
    rest_q = [np.sqrt(np.square(q[:, e:]).sum(1)) for e in edges]
    exact = np.abs(q).max(initial=0) * np.abs(vertical).max(initial=0) * max(dims, 1) < 2**53
    for i in range(len(q)):
        alive = np.flatnonzero(~own[i])
        total = np.zeros(len(alive))
        for b, (a, e) in enumerate(zip(edges, edges[1:], strict=False)):
            total += q[i, a:e] @ (vertical[a:e] if len(alive) == vertical.shape[1] else vertical[a:e, alive])
            if len(alive) > k and (e < dims or not exact):
                slack = rest_c[b + 1][alive] * (rest_q[b + 1][i] * (1 + 1e-9)) + 1
                if not exact:
                    slack += rest_c[0][alive] * (rest_q[0][i] * (dims + 4) * 2.0**-50)
                sure = np.partition(total - slack, len(alive) - k)[len(alive) - k]
                keep = total + slack >= sure
                alive, total = alive[keep], total[keep]
        if exact:
            yield alive, total.astype(np.int64)
            continue
        whole = candidates[alive].astype(object) @ queries[i].astype(object) if dims else [0] * len(alive)
        yield alive, np.array([int(x) for x in whole], np.int64)  # OverflowError beyond 64 bits


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """The k candidates of highest inner product for each query, ties to the smaller key.

    Both tables have an integer key and an array<long> vector without null
    components. Returns query_id, rank (from 1), key, score. A candidate with a
    query's key is its own and not found by it; vectors of another length don't
    meet; rows repeated in key and vector count once; rows with a null key or
    vector take no part; a query without candidates gives no row. A score beyond
    64 bits ends the job.
    """
    kind = candidates.schema[key].dataType.simpleString()
    whole = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"), F.size(vector).alias("_d")).dropDuplicates([key, "_v"])
    queries, candidates = whole(queries), whole(candidates)
    blocks = max(1, math.ceil(queries.count() / BLOCK_ROWS))
    rows = candidates.count()
    shards = max(1, math.ceil(rows / SHARD_ROWS), min(math.ceil(rows / LEAST_ROWS), shuffle_partitions(candidates.sparkSession)))
    deal = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_b", deal(blocks)).withColumn("_s", spread(shards))
    right = candidates.withColumn("_s", deal(shards)).withColumn("_b", spread(blocks))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[], [], []]
        if q.num_rows and c.num_rows:
            own_q, own_c = (t.column(key).to_numpy() for t in (q, c))
            mq, mc = (t.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (q, c))
            for name, (at, score) in zip(own_q, branch_and_bound(mq, mc, OwnRows(own_q, own_c), k), strict=True):
                best = np.lexsort((own_c[at], -score))[:k]
                for column, values in zip(rows, (np.full(len(best), name), own_c[at][best], score[best]), strict=True):
                    column.append(values)
        merged = [np.concatenate(r) if r else np.empty(0, np.int64) for r in rows]
        id_type = c.schema.field(key).type
        return pa.table([pa.array(merged[0]).cast(id_type), pa.array(merged[1]).cast(id_type), pa.array(merged[2], pa.int64())], ["query_id", key, "score"])

    by = ["_s", "_b", "_d"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"query_id {kind}, `{key}` {kind}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def embedding_top_k(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """exact_top_k of the rows whose vec_id is divisible by ``every`` against all rows, vectors rounded down to 1/scale; a component beyond 64 bits ends the job as such a score does."""
    rows = embeddings.where(finite("embedding")).select("vec_id", quantized("embedding", scale).alias("vector"))
    return exact_top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


EMBEDDING_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
