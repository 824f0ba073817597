"""Benchmark decontamination by winnowing. DataFrame functions only.

Of the hashes of every GUARANTEE - GRAM + 1 consecutive GRAM-word runs the least
is kept as a fingerprint, so a text and an item that share GUARANTEE words share
a fingerprint. Documents whose fingerprints occur among the items' are read
again: around each such run, every window of GUARANTEE words is compared with
the items' windows, word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, unused

GUARANTEE, GRAM = 10, 5
#: ASCII letters and digits and all that is not ASCII; in lower case, the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_WORD = r"[\\p{Alnum}\\P{ASCII}]+"
#: Rows (hits) or windows of items that are broadcast; joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Characters of windows and their items' names that are broadcast, at most.
BROADCAST_BYTES = 64 << 20


def _words(text: str) -> str:
    """Words of a text with A-Z in lower case."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}', 0)"


def _hashes(words: str, gram: int) -> str:
    run = ", ".join(f"{words}[i + {o}]" for o in range(gram))
    return f"IF(size({words}) < {gram}, cast(array() AS array<bigint>), transform(sequence(0, size({words}) - {gram}), i -> xxhash64({run}, {gram})))"


def _least(hashes: str, span: int) -> str:
    """Winnowing: the least hash of each ``span`` consecutive ones."""
    if span == 1:
        return f"array_distinct({hashes})"
    return f"IF(size({hashes}) < {span}, cast(array() AS array<bigint>), array_distinct(transform(sequence(0, size({hashes}) - {span}), i -> array_min(slice({hashes}, i + 1, {span})))))"


class _Kind:
    """Windows of one length: fingerprints of ``gram`` words, the least of ``span``."""

    def __init__(self, window: int):
        self.window = window
        self.gram = GRAM if window == GUARANTEE else window
        self.span = window - self.gram + 1


def _fingerprints(rows: DataFrame, keys: list[str], kinds: list[_Kind]) -> DataFrame:
    """keys and fp, from the column w."""
    listed = rows
    for k in kinds:
        listed = listed.withColumn(f"h{k.window}", F.expr(_hashes("w", k.gram)))
    arrays = ", ".join(_least(f"h{k.window}", k.span) for k in kinds)
    return listed.select(*keys, F.explode(F.expr(f"concat({arrays})")).alias("fp"))


def _near(k: _Kind) -> str:
    """Windows of this kind around the positions of hit fingerprints: array of (at, n, window)."""
    where = f"filter(sequence(0, size(h{k.window}) - 1), i -> array_contains(hits, h{k.window}[i]))"
    last = f"size(w) - {k.window}"
    starts = f"array_distinct(flatten(transform({where}, p -> sequence(greatest(0, p - {k.span - 1}), least(p, {last})))))"
    windows = f"transform({starts}, s -> struct(s AS at, {k.window} AS n, array_join(slice(w, s + 1, {k.window}), ' ') AS window))"
    # a text of fewer words can hold hit fingerprints all the same, as its 5-word runs are those of items of 5 words
    return f"IF(hits IS NULL OR size(w) < {k.window}, cast(array() AS array<struct<at: int, n: int, window: string>>), {windows})"


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Where documents hold windows of benchmark items.

    Returns key, n_words and hits: array of (start, end, items) in words, one
    for each place where a window of 10 consecutive item words occurs (of all
    words, for items of fewer). One row for each key and text: rows repeated in
    both count once, a null key is kept as a document of its own, and a null or
    empty text has no words. Items without words or key are left out; an empty
    table of items leaves every document without hits. Other columns are not
    read.
    """
    doc = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    item = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).selectExpr(f"`{item_key}` AS item", f"{_words(f'`{item_text}`')} AS w").where("size(w) > 0")
    short = sorted(r[0] for r in item.where(f"size(w) < {GUARANTEE}").selectExpr("size(w)").distinct().collect())  # 9 values at most
    kinds = [_Kind(n) for n in (*short, GUARANTEE)]

    lengths = ", ".join(map(str, short)) or "0"
    windows = item.selectExpr(
        "item", f"CASE WHEN size(w) >= {GUARANTEE} THEN transform(sequence(0, size(w) - {GUARANTEE}), i -> array_join(slice(w, i + 1, {GUARANTEE}), ' ')) WHEN size(w) IN ({lengths}) THEN array(array_join(w, ' ')) ELSE array() END AS windows"
    ).select("item", F.explode("windows").alias("window"))
    windows = materialize(windows.groupBy("window").agg(F.collect_set("item").alias("items")), "item-windows")
    kept = materialize(_fingerprints(item, [], kinds).distinct(), "item-fingerprints")
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("window") + 24 * F.size("items")), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES:  # an item has no more fingerprints than windows
        windows, kept = F.broadcast(windows), F.broadcast(kept)

    split = doc.where("_t IS NOT NULL").selectExpr("_k", "xxhash64(_t) AS _h", f"{_words('_t')} AS w")
    found = _fingerprints(split, ["_k", "_h"], kinds).join(kept, "fp")
    hits = materialize(found.groupBy("_k", "_h").agg(F.collect_set("fp").alias("hits")), "hits")
    size = hits.agg(F.coalesce(F.sum(F.size("hits") + 1), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        hits = F.broadcast(hits)

    keyed = doc.withColumn("_h", F.xxhash64("_t"))
    both = keyed.join(hits.withColumnRenamed("_k", "_k2").withColumnRenamed("_h", "_h2"), F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_h") == F.col("_h2")), "left")
    read = both.selectExpr("_k", "_h", "hits", f"cast(coalesce(regexp_count(_t, '{_WORD}'), 0) AS long) AS n_words", f"IF(hits IS NULL, cast(array() AS array<string>), {_words('_t')}) AS w")
    for k in kinds:
        read = read.withColumn(f"h{k.window}", F.expr(_hashes("w", k.gram)))
    near = read.selectExpr("_k", "_h", "n_words", f"inline_outer(concat({', '.join(map(_near, kinds))}))")
    # documents without hits go each its own way, not together as one null
    near = near.withColumn("window", F.coalesce("window", F.concat(F.lit("\0"), F.xxhash64("_k", "_h").cast("string"))))
    matched = near.join(windows, "window", "left")
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.col("n")).cast("long").alias("end"), "items"))
    return matched.groupBy("_k", "_h", "n_words").agg(F.array_sort(F.collect_set(hit)).alias("hits")).select(F.col("_k").alias(key), "n_words", "hits")


def contamination_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of hit words and items, and a digest of the items."""
    step = "struct(greatest(a.upto, x.end) AS upto, a.n + greatest(0L, x.end - greatest(a.upto, x.start)) AS n)"
    covered = f"aggregate(hits, struct(0L AS upto, 0L AS n), (a, x) -> {step}, a -> a.n)"
    ids = "array_sort(transform(array_distinct(flatten(transform(hits, x -> x.items))), x -> cast(x AS string)))"
    counted = found.selectExpr(f"`{key}`", "n_words", f"{covered} AS n_hit", f"{ids} AS ids")
    return counted.selectExpr(f"`{key}`", "n_words", "n_hit", "cast(size(ids) AS long) AS n_items", "sha2(array_join(ids, ','), 256) AS items_sha256", "n_hit > 0 AS contaminated")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without those whose text holds a window of an item; a null text holds none. All columns, whatever their names, and repeated rows stay."""
    name = unused(docs, "_key")
    digest = F.sha2(F.col(text), 256)
    texts = docs.select(digest.alias("_key"), F.col(text).alias("_text"))
    hit = find_contamination(texts, items, "_text", "_key").where("size(hits) > 0").select(F.col("_key").alias(name)).distinct()
    hit = materialize(hit, "contaminated")
    gone = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.join(gone, digest == F.col(name), "left_anti")


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), p AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
