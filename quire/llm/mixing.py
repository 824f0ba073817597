"""Mixing sources to target weights along a time-varying curriculum.

Sources share the words of all documents by weight; none gives more than
``most`` times what it has. Each source has a schedule, its weight over the
training's time from 0 to 1. A schedule is integrated to a source's cumulative
demand of words; a document stands where its source's words, in a random but
fixed order, have been demanded so far, and the inverse of the demand says when
that is: its position. Sources that give less than they have end before their
last document, those that give more go round again.

DataFrame functions only. What comes before a document in its source is summed
within ranges of (source, order) and carried from range to range, so a source
that holds most of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; and of whole sources the most that is taken.
WEIGHTS, MOST = (1, 2, 3), 3
Schedule = Sequence[tuple[float, float]]
#: (time, weight) with straight lines between, repeating as the weights do: light sources fade, heavy ones grow.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.75), (0.5, 1.25), (1.0, 0.75)), ((0.0, 0.5), (1.0, 1.5)))
#: Small tables are broadcast up to so many rows (about 150 bytes each as Spark holds them), joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
_RANGE = "_range"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def pieces_of(schedule: Schedule) -> list[tuple[float, float, float, float]]:
    """(time, demand before it, weight, change of weight in a unit of time) of each straight piece of a schedule, scaled to a demand of 1 in all."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(schedule, schedule[1:], strict=False)) or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule has weights of 0 or more at rising times from 0 to 1")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, []
    if whole <= 0:
        raise ValueError("a schedule has a weight above 0 somewhere")
    for (t, w), (u, v), area in zip(schedule, schedule[1:], areas, strict=False):
        if area > 0:
            out.append((t, before, w / whole, (v - w) / (u - t) / whole))
            before += area / whole
    return out


def time_of(demand: Column, schedule: Schedule) -> Column:
    """When the demand of a schedule has come to a share of its whole: the integral's inverse."""
    out = None
    for t, before, weight, change in pieces_of(schedule):
        x = demand - F.lit(before)
        here = F.when(x > 0, F.lit(t) + F.lit(2.0) * x / (F.lit(weight) + F.sqrt(F.greatest(F.lit(0.0), F.lit(weight * weight) + F.lit(2.0 * change) * x)))).otherwise(F.lit(t))
        out = here if out is None else F.when(x >= 0, here).otherwise(out)
    return F.least(out, F.lit(1.0))


def _ranges(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df dealt by ranges of an order, each row with its range. Written, as ranges hold within one run."""
    return materialize(df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), tag)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sums_before(df: DataFrame, order: list[Column], sums: Mapping[str, str], tag: str) -> DataFrame:
    """Adds, for each row of a table in an order, the sums of columns over all rows before it; sums: new name -> column."""
    dealt = _ranges(df, order, tag)
    within = Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range: as many as there are partitions
    totals = dealt.groupBy(_RANGE).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(_RANGE, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums])
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    return own.join(totals, _RANGE).withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop(_RANGE, *[f"_t_{n}" for n in sums])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, turn, target) of a table (source, size) with a row for each source.

    turn: the place of the source's weight and schedule. The target is the share
    by weight of all sizes, at most ``most`` times the source's own; the excess
    goes to the others by weight until none is above. Each set of sources that
    stop there leaves the others (words left) / (weights left) a unit of weight;
    the right set leaves the most of all, and it holds the sources with the least
    room for their weight, so running sums in that order have it among them.
    """
    turn = F.pmod(F.col("_rank"), F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.col("turn") + 1)
    ranked = _sums_before(sizes.withColumn("_one", F.lit(1).cast("long")), [F.asc_nulls_last("source")], {"_rank": "_one"}, "sources")
    own = ranked.select("source", F.col("size").alias("source_size"), turn.alias("turn")).withColumn("_weight", weight).withColumn("_most", F.col("source_size") * most)
    room = F.col("_most").cast("double") / F.col("_weight")
    filled = _sums_before(own.withColumn("_room", room), [F.asc("_room"), F.asc_nulls_last("source")], {"_m": "_most", "_w": "_weight"}, "targets")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weights")).first()
    left = (F.lit(whole.words) - F.col("_m")).cast("double") / (F.lit(whole.weights) - F.col("_w"))
    unit = filled.agg(F.max(left)).first()[0]
    target = F.least(F.col("_most").cast("double"), F.lit(unit).cast("double") * F.col("_weight"))
    return filled.select("source", "source_size", "turn", target.alias("target"))


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """Every document with what a mix takes of it and when, sorted by position over ranges.

    Returns key, source, size (words), source_size, target (words the mix wants
    of the source), taken (words it takes of the document, repeats counted),
    position (of the first visit, 0 to 1, null where it has none) and visits
    (array of position, epoch, words: the document's first ``words`` words). A
    source's taken words are its target rounded; its last document may be cut.
    The order within a source is by the MD5 of the key, then key and size, so
    reruns agree; rows alike in all three may stand for each other.

    A null text has no words; a document without words is never visited; a null
    source is a source, the last; a null key is one more key; repeated rows are
    documents each; an empty table gives no rows; other columns are not read.
    """
    if len(schedules) != len(weights) or min(weights) < 1:
        raise ValueError("as many schedules as weights, and weights of 1 or more")
    read = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), words(text).alias("size"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_order"))
    order = [F.asc("_order"), F.asc_nulls_last("_key"), F.asc("size")]
    dealt = _ranges(read, [F.asc_nulls_last("source"), *order], "mixing")
    parts = materialize(dealt.groupBy(_RANGE, "source").agg(F.sum("size").alias("size")), "mixing-parts")
    wanted = materialize(targets(parts.groupBy("source").agg(F.sum("size").alias("size")), weights, most), "mixing-targets")
    earlier = Window.partitionBy("source").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("_base", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    named = wanted.withColumnRenamed("source", "_s")
    based = based.join(_small(named), F.col("source").eqNullSafe(F.col("_s"))).select(F.col(_RANGE).alias("_r"), F.col("source").alias("_s"), "_base", "source_size", "turn", "target")
    within = Window.partitionBy(_RANGE, "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_sum", F.coalesce(F.sum("size").over(within), F.lit(0)))
    own = own.join(_small(based), (F.col(_RANGE) == F.col("_r")) & F.col("source").eqNullSafe(F.col("_s"))).withColumn("_before", F.col("_base") + F.col("_sum"))
    goal = F.round("target").cast("long")

    def visit(epoch: Column) -> Column:
        start = epoch.cast("long") * F.col("source_size") + F.col("_before")
        demand = start.cast("double") / F.greatest(goal, F.lit(1)).cast("double")
        at = F.coalesce(*[F.when(F.col("turn") == i, time_of(demand, s)) for i, s in enumerate(schedules)])
        return F.struct(at.alias("position"), epoch.alias("epoch"), F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start)).alias("words"))

    visits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), visit), lambda v: v["words"] > 0)
    found = own.withColumn("visits", visits)
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda n, v: n + v["words"])
    out = found.withColumn("taken", taken).withColumn("position", F.when(F.size("visits") > 0, F.col("visits")[0]["position"]))
    sorted_ = out.orderBy(F.asc_nulls_last("position"), "_order", F.asc_nulls_last("_key"))
    return sorted_.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "taken", "position", "visits")


def training_order(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """(position, key, source, epoch, words): a row for each visit, sorted by position over ranges."""
    rows = mix.select(key, "source", F.explode("visits").alias("v")).select("v.position", key, "source", "v.epoch", "v.words")
    return rows.orderBy("position", F.asc_nulls_last("source"), F.asc_nulls_last(key), "epoch")


def mix_digest(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    return mix.select(key, "size", "source_size", "target", "taken", "position", F.size("visits").alias("n_visits"))


def _time_sql(u: str, schedule: Schedule) -> str:
    out = ""
    for t, before, weight, change in pieces_of(schedule):
        x = f"({u} - {before!r}::DOUBLE)"
        here = f"CASE WHEN {x} > 0 THEN {t!r}::DOUBLE + 2.0::DOUBLE * {x} / ({weight!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {weight * weight!r}::DOUBLE + {2.0 * change!r}::DOUBLE * {x}))) ELSE {t!r}::DOUBLE END"
        out = f"CASE WHEN {x} >= 0 THEN {here} ELSE {out} END" if out else here
    return f"least({out}, 1.0::DOUBLE)"


#: Shares the excess round by round, as the contract says it.
MIXING_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS turn FROM s
), fill AS (
  SELECT 0 AS step, source, source_size, turn, FALSE AS stopped, CAST(0 AS DOUBLE) AS unit FROM w
  UNION ALL
  SELECT step + 1, source, source_size, turn, CAST(source_size * 3 AS DOUBLE) < u * (turn + 1), u
  FROM (
    SELECT *, CAST(sum(source_size) OVER () - sum(CASE WHEN stopped THEN source_size * 3 ELSE 0 END) OVER () AS DOUBLE) / sum(CASE WHEN stopped THEN 0 ELSE turn + 1 END) OVER () AS u
    FROM fill
  )
  WHERE step < (SELECT count(*) FROM w)
), t AS (
  SELECT source, source_size, turn, least(CAST(source_size * 3 AS DOUBLE), unit * (turn + 1)) AS target FROM fill WHERE step = (SELECT count(*) FROM w)
), b AS (
  SELECT d.*, t.source_size, t.turn, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), v AS (
  SELECT *, greatest(0, least(size, goal - before)) AS a, greatest(0, least(size, goal - before - source_size)) AS b, greatest(0, least(size, goal - before - 2 * source_size)) AS c,
    CAST(before AS DOUBLE) / CAST(greatest(goal, 1) AS DOUBLE) AS u
  FROM b
)
SELECT doc_id, size, source_size, target, CAST(a + b + c AS BIGINT) AS taken,
  CASE WHEN a = 0 THEN NULL WHEN turn = 0 THEN {_time_sql("u", SCHEDULES[0])} WHEN turn = 1 THEN {_time_sql("u", SCHEDULES[1])} ELSE {_time_sql("u", SCHEDULES[2])} END AS position,
  CAST((a > 0)::INTEGER + (b > 0)::INTEGER + (c > 0)::INTEGER AS INTEGER) AS n_visits
FROM v
"""
