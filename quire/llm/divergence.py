"""How far the sources of a language differ in the terms they use: shards aggregated by DuckDB, merged by Spark.

Each task counts the terms of its documents in DuckDB and sends a row for each
term of a (lang, source) group; so a term that all documents have is as many
rows as there are tasks and groups. Rows are dealt into shards by a hash of lang
and term; a shard's counts are added up by DuckDB, which also keeps the terms of
enough documents. Spark sums the groups' totals, DuckDB forms each shard's part
of the pair sums and its best terms, and Spark adds and ranks these.

A pair's sum runs over all kept terms, also those that neither source has. With
f(p, q) for a term, and a', b' for what a source gives a term that it doesn't
have, it is: the terms of a as if b had none of them, those of b as if a had
none, the rest as if neither, and for terms of both what this got wrong:
f(a, b) - f(a, b') - f(a', b) + f(a', b'). Only the last needs terms side by
side, and shards sum it; the others need how many terms a source has of each
count.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, BEST_TERMS, UNIT = 3, 200, 1_000_000_000
#: Rows that a task holds before it adds them up or sends them on, and rows of a shard; shards are smaller, down to LEAST_ROWS, where there would be fewer of them than partitions.
HELD_ROWS, SHARD_ROWS, LEAST_ROWS = 1 << 19, 1 << 18, 1 << 13
#: Groups' totals are broadcast up to so many rows (about 200 bytes each as Spark holds them), joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Memory of a DuckDB connection in a task; beyond it goes to files in the task's temporary folder while it runs.
MEMORY = "256MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNTED = "lang string, source string, term string, n long, docs long"
#: A group's terms, with what its language has of each; first marks one row of each term of a language.
KEPT = "lang string, source string, term string, n long, total long, first long"
SCORED = "part string, lang string, source string, item string, n long, value decimal(38,0)"

_TERMS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term
  FROM batch
), t AS (
  SELECT doc, lang, source, term, count(*) AS n FROM d GROUP BY ALL
)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM t GROUP BY ALL
UNION ALL
SELECT DISTINCT coalesce(lang, ''), coalesce(source, ''), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM batch
"""
_SUM_SQL = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM {} GROUP BY ALL"
_KEPT_SQL = f"""
WITH g AS ({_SUM_SQL.format("counted")}), k AS (
  SELECT lang, source, term, n, CAST(sum(n) OVER w AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS BIGINT) AS first
  FROM g WHERE term IS NOT NULL
  WINDOW w AS (PARTITION BY lang, term)
  QUALIFY sum(docs) OVER w >= {{least}}
)
SELECT * FROM k
UNION ALL
SELECT lang, source, NULL, 0, 0, 0 FROM g WHERE term IS NULL
"""


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


_SCORED_SQL = f"""
WITH r AS (
  SELECT lang, source, term, n, CAST(1 + {UNIT} * (CAST(n AS HUGEINT) + 1) // (words + terms) AS BIGINT) AS p, CAST(1 + {UNIT} // (words + terms) AS BIGINT) AS p0,
    CAST(1 + {UNIT} * (CAST(total AS HUGEINT) + 1) // (lang_words + terms) AS BIGINT) AS q
  FROM counted
), t AS (
  SELECT lang, source, term, {_f("p", "q")} AS value FROM r WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{best}}
)
SELECT 'term' AS part, lang, source, term AS item, CAST(0 AS BIGINT) AS n, CAST(value AS DECIMAL(38,0)) AS value FROM t
UNION ALL
SELECT 'both', a.lang, a.source, b.source, 0, CAST(sum({_f("a.p", "b.p")} - {_f("a.p", "b.p0")} - {_f("a.p0", "b.p")} + {_f("a.p0", "b.p0")}) AS DECIMAL(38,0))
FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT 'count', lang, source, NULL, n, CAST(count(*) AS DECIMAL(38,0)) FROM r GROUP BY lang, source, n
"""


class _Duck:
    """A connection of one thread and bounded memory, gone with its files when left."""

    def __enter__(self):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(tempfile.gettempdir(), f"duckdb-{uuid.uuid4().hex}")})
        return self.con

    def __exit__(self, *_):
        self.con.close()


def _arrow(con, sql: str, schema: pa.Schema) -> pa.Table:
    return con.sql(sql).to_arrow_table().cast(schema)


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "decimal(38,0)": pa.decimal128(38, 0)}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in fields.split(", "))])


def _in_shards(rows: DataFrame, shards: int, sql: str, out: str) -> DataFrame:
    """A statement over ``counted``, the rows of a shard by lang and term."""
    schema = _schema(out)

    def run(own: pa.Table) -> pa.Table:
        with _Duck() as con:
            con.register("counted", own)
            return _arrow(con, sql, schema)

    return rows.withColumn("_s", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")).groupBy("_s").applyInArrow(run, out)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """COUNTED: occurrences and documents of the terms of each (lang, source), added up within tasks; a row without term for each group."""
    schema, most = _schema(COUNTED), HELD_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Duck() as con:
            held = 0
            con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                held += con.execute(f"INSERT INTO held {_TERMS_SQL}").fetchall()[0][0]
                con.unregister("batch")
                if held > most:
                    con.execute(f"CREATE TABLE less AS {_SUM_SQL.format('held')}")
                    con.execute("DROP TABLE held")
                    con.execute("ALTER TABLE less RENAME TO held")
                    held = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
                    if held > most // 2:
                        yield from _arrow(con, "SELECT * FROM held", schema).to_batches(1 << 16)
                        con.execute("DELETE FROM held")
                        held = 0
            yield from _arrow(con, _SUM_SQL.format("held"), schema).to_batches(1 << 16)

    return docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")).mapInArrow(count, COUNTED)


def _probability(count: str, words: str, terms: str) -> str:
    """1 + floor(UNIT * (count + 1) / (words + terms)), in whole numbers of any size that counts can have."""
    return f"(1 + ({UNIT}BD * (cast({count} AS decimal(24,0)) + 1)) div cast({words} + {terms} AS decimal(38,0)))"


def _spark_f(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, best: int = BEST_TERMS) -> DataFrame:
    """How each source of a language differs from each other one, and by which terms from the language.

    A language keeps its terms in at least ``least`` of its rows. A group of
    (lang, source), and a language, gives each kept term p = 1 + floor(10**9 *
    (count + 1) / (N + V)), V kept terms, N their occurrences there, and f =
    floor((p - q)**2 / q) with the group's p. Returns lang, source, part, item,
    value, rank: part ``pair``, each other source of the language with f summed
    over all kept terms (0 without any), and part ``term``, the ``best`` terms
    that the group has and gives more than the language does, with f. Ranks go
    from 1 by value down, then by the item's bytes.

    A null text, lang or source counts as ''; every group that occurs is there,
    also without terms; a single source has no pairs; repeated rows count each;
    an empty table gives no rows; other columns are not read. A sum beyond 64
    bits ends the job.
    """
    spark = docs.sparkSession
    counted = materialize(term_counts(docs, text, lang, source), "term-counts")
    rows = counted.count()
    shards = max(1, math.ceil(rows / SHARD_ROWS), min(math.ceil(rows / LEAST_ROWS), shuffle_partitions(spark)))
    kept = materialize(_in_shards(counted, shards, _KEPT_SQL.format(least=least), KEPT), "terms")

    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("term").alias("own_terms"), F.sum("first").alias("_first"))
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("_first").alias("terms"), F.sum("words").alias("lang_words"))
    groups = materialize(groups.drop("_first").join(langs, "lang"), "totals")
    few = groups.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df

    totals = small(groups.select("lang", "source", "words", "terms", "lang_words"))
    scored = materialize(_in_shards(kept.where("term IS NOT NULL").join(totals, ["lang", "source"]), shards, _SCORED_SQL.format(best=best), SCORED), "scores")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first))
    terms = ranked(scored.where("part = 'term'").select("lang", "source", "item", "value")).where(F.col("rank") <= best)

    absent = _probability("0", "words", "terms")
    has_terms = groups.where("terms > 0").withColumn("p0", F.expr(absent))
    other = small(has_terms.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own_terms").alias("other_terms")))
    differ = F.col("source") != F.col("item")
    # terms of one source as if the other had none of them, both ways round
    counts = scored.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("how_many"))
    counts = counts.join(totals, ["lang", "source"]).withColumn("p", F.expr(_probability("n", "words", "terms"))).select("lang", "source", "how_many", "p")
    one_sided = counts.join(other, "lang").where(differ)
    product = lambda p, q, n="how_many": F.expr(f"cast(cast({n} AS decimal(18,0)) * {_spark_f(p, q)} AS decimal(38,0))")
    summed = one_sided.groupBy("lang", "source", "item").agg(F.sum(product("p", "q0")).alias("there"), F.sum(product("q0", "p")).alias("back"))
    there = summed.select("lang", "source", "item", F.col("there").alias("value"))
    back = summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))
    rest = has_terms.select("lang", "source", "p0", "terms", "own_terms").join(other, "lang").where(differ)
    neither = rest.select("lang", "source", "item", product("p0", "q0", "terms - own_terms - other_terms").alias("value"))
    both = scored.where("part = 'both'").select("lang", "source", "item", "value")
    every = groups.select("lang", "source").join(small(groups.select("lang", F.col("source").alias("item"))), "lang").where(differ)
    without = every.join(small(langs.where("terms = 0").select("lang")), "lang", "left_semi").withColumn("value", F.lit(0).cast("decimal(38,0)"))
    pairs = there.unionByName(back).unionByName(neither).unionByName(both).unionByName(without).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    out = ranked(pairs).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text
  FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d
), k AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (
  SELECT lang, source, term, d.n, CAST(1 + {UNIT} * (d.n + 1) // (sum(d.n) OVER (PARTITION BY lang, source) + l.v) AS HUGEINT) AS p, CAST(1 + {UNIT} * (d.total + 1) // (l.n + l.v) AS HUGEINT) AS q
  FROM dense d JOIN l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {BEST_TERMS}
"""
