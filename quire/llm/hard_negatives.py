"""Mining hard negatives: bit-sliced integer products.

Components are cut into bits, and a bit of all components of a vector is a
plane. An anchor's product with the planes, most significant first, leaves a
candidate's score in an interval that each plane halves: what the lower bits can
still add lies between the sums of the anchor's negative and of its positive
components, times the value of those bits. A candidate goes as soon as its
interval misses every range of scores asked for, or as enough others are sure to
beat it there. After the last plane scores are exact.

Candidates are dealt into shards and anchors into blocks; every shard meets
every block twice, for positives and then, with their scores known, for
negatives.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions
from quire.llm.topk import finite, quantized

#: Components of a shard's candidates and of a block's anchors, at most, unless a single row has more; shards are smaller, down to LEAST_ROWS, where there would be fewer of them than partitions.
SHARD_VALUES, BLOCK_VALUES, LEAST_ROWS = 1 << 22, 1 << 20, 2048
#: Share of a positive's score, in percent, from which and up to which a negative counts as hard.
LOW, HIGH = 50, 95
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


class Planes:
    """Integer vectors as bit planes over their least component, most significant first; a plane has a row for every eight components."""

    def __init__(self, vectors: np.ndarray):
        self.dims = vectors.shape[1]
        self.base = int(vectors.min(initial=0))
        above = vectors.astype(np.uint64) - np.uint64(self.base % 2**64)
        self.bits = int(above.max(initial=0)).bit_length()
        shifts = [np.uint64(b) for b in reversed(range(self.bits))]
        self.planes = [np.ascontiguousarray(np.packbits(((above >> b) & np.uint64(1)).astype(np.uint8), axis=1).T) for b in shifts]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For every eight components of a query its product with each of the 256 patterns of bits."""
        padded = np.zeros(-(-self.dims // 8) * 8, np.int64)
        padded[: self.dims] = query
        return padded.reshape(-1, 8) @ _BITS.T

    def fits(self, queries: np.ndarray) -> bool:
        """Whether no sum of products with these queries leaves 62 bits."""
        most = max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0))))
        return most * max(self.dims, 1) * (2**self.bits + abs(self.base)) < 2**62


def best_within(query: np.ndarray, planes: Planes, alive: np.ndarray, ranges: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidates ``alive``, those that can be among the k best scores of any of the ranges (both ends included), and their scores."""
    tables = planes.tables(query)
    down, up = int(np.minimum(query, 0).sum()), int(np.maximum(query, 0).sum())
    total = np.full(len(alive), planes.base * int(query.sum()), np.int64)
    for bit, plane in zip(reversed(range(planes.bits)), planes.planes, strict=True):
        if not len(alive):
            break
        part = np.zeros(len(alive), np.int64)
        for table, own in zip(tables, plane, strict=True):
            part += table[own if len(alive) == len(own) else own[alive]]
        total += part << bit
        room = (1 << bit) - 1
        low, high = total + room * down, total + room * up
        # with intervals wider than all sums lie apart, none is beaten for sure
        apart = int(total.max()) - int(total.min()) > room * (up - down)
        keep = np.zeros(len(alive), bool)
        for a, b in ranges:
            here = (high >= a) & (low <= b)
            if apart and len(sure := low[(low >= a) & (high <= b)]) >= k:
                here &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= here
        if not keep.all():
            alive, total = alive[keep], total[keep]
    return alive, total


def _exactly(query: np.ndarray, vectors: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all candidates in whole numbers of any size, where planes' sums could leave 64 bits; fails if a score does."""
    found = vectors[alive].astype(object) @ query.astype(object) if vectors.shape[1] else [0] * len(alive)
    return alive, np.array([int(x) for x in found], np.int64)


def _whole(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    return known.select(F.col(key).alias("_k"), F.col(label).alias("_l"), F.col(vector).alias("_v"), F.size(vector).alias("_d")).dropDuplicates(["_k", "_l", "_v"])


def _dealt(n: int) -> Column:
    return F.pmod(F.xxhash64("_k"), F.lit(n)).cast("int")


def _spread(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def mine_hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, key: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """For each anchor's best positives the best negatives whose score lies within ``low`` to ``high`` percent of theirs.

    Both tables have an integer key, a label and an array<long> vector. A
    positive is one of an anchor's ``positives`` rows of highest inner product
    with its label, ties to the smaller key; its negatives are the first
    ``negatives`` rows of other labels in the same order with low * positive <=
    100 * score <= high * positive. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score; a positive without such a row
    gives none, so one with a score below 0 never does.

    A row with an anchor's key is its own and not found by it; vectors of another
    length don't meet; rows repeated in key, label and vector count once; rows
    with a null key, label or vector take no part; an empty table gives no rows;
    other columns are not read. A score beyond 64 bits ends the job.
    """
    kind, label_kind = rows.schema[key].dataType.simpleString(), rows.schema[label].dataType.simpleString()
    candidates = materialize(_whole(rows, key, label, vector), "candidates")
    asked = materialize(_whole(anchors, key, label, vector), "anchors")
    found = candidates.agg(F.count("*"), F.max("_d")).first()
    dims = max(1, found[1] or 1)
    shards = max(1, math.ceil(found[0] * dims / SHARD_VALUES), min(math.ceil(found[0] / LEAST_ROWS), shuffle_partitions(rows.sparkSession)))
    blocks = max(1, math.ceil(asked.count() * dims / BLOCK_VALUES))
    right = candidates.withColumn("_s", _dealt(shards)).withColumn("_b", _spread(blocks))
    by = ["_s", "_b", "_d"]

    def search(q: pa.Table, c: pa.Table, of_label: bool, k: int):
        """(anchor's place, its ranges, candidates' places, scores) for each anchor of a block; the anchor's own label, or all others."""
        vectors, queries = _matrix(c), _matrix(q)
        planes = Planes(vectors)
        exact = planes.fits(queries)
        keys, labels = (c.column(n).to_numpy() for n in ("_k", "_l"))
        everything = [[(-(2**63), 2**63 - 1)]] * q.num_rows
        wanted = everything if of_label else [[(-((-low * s) // 100), high * s // 100) for s in scores] for scores in q.column("_scores").to_pylist()]
        for i, (own, name) in enumerate(zip(q.column("_k").to_pylist(), q.column("_l").to_pylist(), strict=True)):
            ranges = [r for r in dict.fromkeys(wanted[i]) if r[0] <= r[1]]
            alive = np.flatnonzero(((labels == name) == of_label) & (keys != own)) if ranges else np.empty(0, np.int64)
            yield (i, wanted[i], *(best_within(queries[i], planes, alive, ranges, k) if exact else _exactly(queries[i], vectors, alive)))

    def best_positives(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            keys, names = c.column("_k").to_numpy(), q.column("_k").to_numpy()
            for i, _, at, score in search(q, c, True, positives):
                best = np.lexsort((keys[at], -score))[:positives]
                out.append((np.full(len(best), names[i]), keys[at][best], score[best]))
        return _table(out, [c.schema.field("_k").type] * 2 + [pa.int64()], ["_k", "_positive", "_score"])

    def best_negatives(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if q.num_rows and c.num_rows:
            keys, names, wanted = c.column("_k").to_numpy(), q.column("_k").to_numpy(), zip(q.column("_positives").to_pylist(), q.column("_scores").to_pylist(), strict=True)
            for (i, ranges, at, score), own in zip(search(q, c, False, negatives), wanted, strict=True):
                order = np.lexsort((keys[at], -score))
                at, score = at[order], score[order]
                for (a, b), positive, reached in zip(ranges, *own, strict=True):
                    best = np.flatnonzero((score >= a) & (score <= b))[:negatives]
                    n = len(best)
                    out.append((np.full(n, names[i]), np.full(n, positive), keys[at[best]], np.full(n, reached), score[best]))
        return _table(out, [c.schema.field("_k").type] * 3 + [pa.int64()] * 2, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    left = asked.withColumn("_b", _dealt(blocks)).withColumn("_s", _spread(shards))
    top = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best_positives, f"_k {kind}, _positive {kind}, _score long")
    order = Window.partitionBy("_k").orderBy(F.desc("_score"), "_positive")
    top = top.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= positives)
    listed = top.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_rank", "_positive", "_score"))).alias("p"))
    known = materialize(asked.join(listed, "_k").select("_k", "_l", "_v", "_d", F.transform("p", lambda x: x["_positive"]).alias("_positives"), F.transform("p", lambda x: x["_score"]).alias("_scores")), "positives")
    left = known.withColumn("_b", _dealt(blocks)).withColumn("_s", _spread(shards))
    hard = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best_negatives, f"anchor_id {kind}, positive_id {kind}, negative_id {kind}, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple[np.ndarray, ...]], types: list[pa.DataType], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*rows, strict=True)] or [np.empty(0, np.int64)] * len(names)
    return pa.table([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)


def embedding_hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256) -> DataFrame:
    """mine_hard_negatives of the rows whose vec_id is divisible by ``every`` against all rows, vectors rounded down to 1/scale; where vec_id is divisible by 7 the label first becomes (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(finite("embedding")).select("vec_id", moved.alias("label"), quantized("embedding", scale).alias("vector"))
    return mine_hard_negatives(rows.where(F.col("vec_id") % every == 0), rows, positives, negatives)


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
