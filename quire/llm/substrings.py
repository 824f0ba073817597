"""Substring deduplication by level-wise doubling.

Windows of words that repeat at one length are extended to twice that length;
others can't be part of anything longer that repeats. The lengths are half of
the least length asked for, that length, twice it, four times, ... until no
window repeats. At the first length only the least hash of each run of windows
counts: two equal windows of the full length hold the same one.

Texts are written once, in buckets of their documents; each level brings the
repeated hashes to the buckets, so texts are shuffled once for all levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import meeting
from quire.llm.common import bucketed, materialize
from quire.llm.wordhash import Words, last_starts, runs, texts_of

WINDOW = 13


def _least(words: Words, base: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of base-word runs; the least of them in each window from each word on; which windows lie in one text."""
    h = words.windows(base)
    span = window - base + 1
    n = len(h) - span + 1
    if n <= 0:
        return h, np.empty(0, np.uint64), np.empty(0, bool)
    least = h[:n].copy()
    for o in range(1, span):
        np.minimum(least, h[o : o + n], out=least)
    return h, least, last_starts(words, window)[:n]


def _rows(words: Words, keys: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(keys[words.row : words.row + words.count], np.diff(words.first))


def _anchors(base: int, window: int):
    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = batch.column(0).to_numpy()
        for words in runs(batch.column(1)):
            h, least, whole = _least(words, base, window)
            chosen = np.zeros(len(h), bool)
            n = len(least)
            for o in range(window - base + 1):
                chosen[o : o + n] |= (h[o : o + n] == least) & whole
            at = np.flatnonzero(chosen)
            yield h[at], _rows(words, keys)[at]

    return of


def _among_hits(words: Words, hashes: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether the hash at each word is among the hits of its text."""
    own = column.slice(words.row, words.count)
    hits = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros(len(hashes), bool)
    if not len(hits):
        return out
    known, place = np.unique(hits, return_inverse=True)
    sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    pairs = np.sort(np.repeat(np.arange(words.count), sizes) * len(known) + place)
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    at = np.flatnonzero(known[place] == hashes)
    text = np.repeat(np.arange(words.count), np.diff(words.first))[at]
    asked = text * len(known) + place[at]
    out[at] = pairs[np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)] == asked
    return out


def _extended(length: int, before: int, sampled: bool):
    """Windows of ``length`` words whose parts repeat at the level ``before``: by their least hash where that was sampled, and then with second hashes, else by both halves."""

    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        keys = batch.column(0).to_numpy()
        for words in runs(batch.column(1)):
            n = len(words.hash) - length + 1
            if n <= 0:
                continue
            whole = last_starts(words, length)[:n]
            if sampled:
                ok = whole & _among_hits(words, _least(words, before, length)[1], batch.column(2))
            else:
                part = _among_hits(words, words.windows(before), batch.column(2))
                ok = whole & part[:n] & part[length - before : length - before + n]
            at = np.flatnonzero(ok)
            if len(at):
                found = words.windows(length)[at], _rows(words, keys)[at]
                yield (*found, words.windows(length, 1)[at]) if sampled else found

    return of


def levels(docs: DataFrame, window: int = WINDOW) -> Iterator[tuple[int, DataFrame]]:
    """(length, table of doc, hits and, at the first length, later_hits) from ``window`` on, doubling until nothing repeats.

    docs: columns doc and text, best bucketed by doc. hits: hashes of the
    document's windows of this length that another document has too;
    later_hits: those that a smaller one has. Windows of the first length are
    equal if two independent 64-bit hashes are, longer ones if one is. Each level is computed when it is asked for.
    """
    base = (window + 1) // 2
    anchors = meeting.repeated(meeting.emit(docs, _anchors(base, window)))
    hits = anchors.groupBy("doc").agg(F.collect_list("h").alias("hits"))
    length, before, sampled = window, base, True
    while True:
        source = docs.join(hits, "doc").select("doc", "text", "hits")
        found = meeting.repeated(meeting.emit(source, _extended(length, before, sampled), twice=sampled))
        later = [F.collect_list(F.when(F.col("later"), F.col("h"))).alias("later_hits")] * sampled
        level = materialize(found.groupBy("doc").agg(F.collect_list("h").alias("hits"), *later), f"repeats-{length}")
        if level.isEmpty():
            return
        yield length, level
        hits = level.select("doc", "hits")
        length, before, sampled = 2 * length, length, False


def _digest(value: bytes) -> bytes:
    return hashlib.blake2b(value, digest_size=16).digest()


def _with_digest(window: int):
    """(doc, text, n, a, b): each text with its words and a digest of them, if it has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            data, offsets = texts_of(batch.column(1))
            raw = data.tobytes()
            for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
                words = raw[a:b].split()
                digest = np.frombuffer(_digest(b" ".join(words)), "<i8").tolist() if len(words) >= window else (None, None)
                found.append((len(words), *digest))
            added = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], ["doc", "text", "n", "a", "b"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Removes words covered by windows that also start in a document with a smaller key.

    Returns key, n_words, removed: array of (start, end) in words, kept: the
    other words joined by one space, and longest_repeat: the longest of window,
    2 * window, 4 * window, ... words that another document has too (0: none).
    Windows are judged on the input. A row that copies a smaller document whole
    loses all its words (if it has a window), without a search; what it shares is
    known from the smallest one. A null or empty text has no words; rows without
    a key are left out; rows that repeat a key are each judged against the
    smaller keys, and longest_repeat is that of the key; an empty table gives
    none; other columns are not read. Keys are integers.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    texts = bucketed(rows.mapInArrow(_with_digest(window), "doc long, text string, n long, a long, b long"), "doc")
    same = texts.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("a", "b", "first")
    same = materialize(same, "first-copies")
    whole = f"{window}L << length(bin(max(n) div {window})) - 1"
    copies = texts.select("doc", "n", "a", "b").join(same, ["a", "b"]).groupBy("doc").agg(F.collect_set(F.expr("IF(doc > first, struct(a, b), NULL)")).alias("copied"), F.expr(f"cast({whole} AS int)").alias("shared"))
    copies = materialize(copies, "copies")
    listed = texts.join(copies, "doc", "left")
    searched = listed.where("copied IS NULL OR NOT coalesce(exists(copied, x -> x.a = a AND x.b = b), false)").select("doc", "text")

    marks, longest = copies.select("doc", "copied"), copies.select("doc", F.col("shared").alias("longest"))
    for length, level in levels(searched, window):
        if length == window:
            marks = marks.join(level.where(F.size("later_hits") > 0).select("doc", "later_hits"), "doc", "full")
        longest = longest.unionByName(level.select("doc", F.lit(length).alias("longest")))
    if "later_hits" not in marks.columns:
        marks = marks.withColumn("later_hits", F.lit(None).cast("array<long>"))
    marks = marks.join(longest.groupBy("doc").agg(F.max("longest").alias("longest")), "doc", "full")
    copy = F.coalesce(F.expr("exists(copied, x -> x.a = a AND x.b = b)"), F.lit(False))
    marked = texts.join(marks, "doc", "left").select("doc", "text", copy.alias("copy"), "later_hits", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            copies = batch.column(2).to_numpy(zero_copy_only=False)
            for words in runs(batch.column(1)):
                n = len(words.hash)
                gone = np.zeros(n + 1, np.int64)
                at = np.flatnonzero(_among_hits(words, words.windows(window), batch.column(3)) & last_starts(words, window)[: max(0, n - window + 1)])
                np.add.at(gone, at, 1)
                np.subtract.at(gone, at + window, 1)
                out = (np.cumsum(gone[:n]) > 0) | np.repeat(copies[words.row : words.row + words.count], np.diff(words.first))
                for i in range(words.count):
                    own = out[words.first[i] : words.first[i + 1]]
                    value = batch.column(1)[words.row + i].as_buffer()
                    parts = value.to_pybytes().split() if value is not None else []
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if own.any() else own[:0]
                    counts.append(len(own))
                    removed.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                    if len(edges):
                        parts = [p for p, x in zip(parts, own.tolist(), strict=True) if not x]
                    kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.string()), batch.column(4)], ["k", "n_words", "removed", "kept", "l"])

    return marked.mapInArrow(cut, f"`{key}` long, n_words long, removed array<struct<start: int, end: int>>, kept string, longest_repeat long")


def repeats_digest(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    n = "aggregate(removed, 0L, (n, x) -> n + x.end - x.start)"
    return cut.selectExpr(f"`{key}`", "n_words", f"{n} AS n_removed", "sha2(kept, 256) AS kept_sha256", "longest_repeat")


REPEATS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), x AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f ON g.g = f.g AND f.first < g.doc_id) GROUP BY doc_id
), k AS (
  SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, string_agg(w[p], ' ' ORDER BY p) AS kept
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d) AS q ON q.doc_id = d.doc_id AND NOT coalesce(list_contains(gone, p), false)
  GROUP BY d.doc_id, len(w), len(gone)
), v AS (
  SELECT 13 AS n, doc_id, i, md5(g) AS h FROM g
  UNION ALL
  SELECT 2 * a.n, a.doc_id, a.i, md5(a.h || b.h)
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) <> max(doc_id) OVER (PARTITION BY h) AS s FROM v) AS a
  JOIN (SELECT *, min(doc_id) OVER (PARTITION BY h) <> max(doc_id) OVER (PARTITION BY h) AS s FROM v) AS b ON a.doc_id = b.doc_id AND b.i = a.i + a.n AND a.s AND b.s
), longest AS (
  SELECT doc_id, max(n) AS l FROM v WHERE (n, h) IN (SELECT (n, h) FROM v GROUP BY n, h HAVING min(doc_id) < max(doc_id)) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(l, 0) AS BIGINT) AS longest_repeat
FROM k LEFT JOIN longest USING (doc_id)
"""
