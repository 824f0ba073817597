"""Translating books chunk by chunk with a model, resumably.

A chunk needs the end of the one before it, so within a book chunks follow one
another; books run side by side. Each round takes the next chunks of every book,
as many as the time of the rounds before allows, calls the model in tasks that
read a book's chunks in order, and appends what came to the stored tables. A later
run goes on from there. A model stage is written before anything reads it, so
no call is made twice for one result. Each call's usage is stored with its
result, also where the answer was of no use.
"""

from __future__ import annotations

import html
import json
import re
import time
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quire.functions import text as T
from quire.functions.answers import first_json, read_segments, string_list
from quire.functions.markup import MarkupError, signature
from quire.operators.common import written
from quire.operators.packing import slice_texts
from quire.operators.providers import ModelError, Provider, QuotaError
from quire.operators.store import Store

CONTEXT_SEGMENTS, ATTEMPTS, SPEECH_BATCH = 10, 2, 60
TRANSLATIONS = "book_id string, chunk int, translation array<string>, usage map<string,double>, error string, error_kind string"
ROUND = TRANSLATIONS + ", provider string, seconds double"
_ROUND = pa.schema([
    ("book_id", pa.string()), ("chunk", pa.int32()), ("translation", pa.list_(pa.string())), ("usage", pa.map_(pa.string(), pa.float64())),
    ("error", pa.string()), ("error_kind", pa.string()), ("provider", pa.string()), ("seconds", pa.float64()),
])
#: A round in which no book was worked on for so many seconds is followed by one of so many times the chunks a book; one that took as many times longer, by one of fewer.
ROUND_SECONDS, GROWTH = 30, 8
#: The books' places, each with the end of a chunk, are broadcast up to so many books.
BROADCAST_BOOKS = 10_000
#: Which chunks the store has, for streams; an edition is a book as it was prepared once.
ARRIVALS = "book_id string, edition string, chunk int"
USAGE = "usage map<string,double>"
PARTS, LABELS = f"book_id string, slice int, part string, {USAGE}", f"book_id string, label string, translation string, {USAGE}"
SPOKEN = f"text string, spoken string, book_id string, {USAGE}"
SYSTEM = "Translate every segment into Hungarian. Keep each segment's id and all its numbered tags, in whatever order the sentence needs. Answer with the segments alone."
SYSTEMS = {
    "fiction": SYSTEM + " This is a novel or a story: keep the narrator's voice and each speaker's manner, and how characters address each other, as the terms say.",
    "nonfiction": SYSTEM + " This is a factual text: be exact, use the field's established terms as listed, and leave names, titles, numbers and units as they are.",
}
#: Where the segments of a prompt begin.
ASKED = "Segments to translate:"
LISTED = "Labels:"


def prompt_of(glossary: str, context: list[str], sources: list[str], error: str | None = None) -> str:
    """What a model is asked: terms, what was translated before, what was wrong with its last answer, and the segments, numbered from 1."""
    parts = [("Terms:", glossary), ("Translated before, for the context alone:", "\n".join(context)), ("The last answer couldn't be used:", error)]
    named = [f"{title}\n{text}\n" for title, text in parts if text]
    return "\n".join([*named, ASKED, *(f'<seg id="{i}">{own}</seg>' for i, own in enumerate(sources, 1))])


def checked(answer: str, sources: list[str]) -> list[str]:
    """The content of each segment of an answer, in order; fails with all that is wrong with it."""
    found = {name: (markup, own) for name, markup, own in read_segments(answer)}
    asked = [str(i) for i in range(1, len(sources) + 1)]
    named = set(asked)
    wrong = [f"missing: {', '.join(x)}" for x in [[i for i in asked if i not in found]] if x]
    wrong += [f"extra: {', '.join(x)}" for x in [[i for i in found if i not in named]] if x]
    wrong += [f"tags of {i} differ: expected {signature(s)}; got {found[i][1]}" for i, s in zip(asked, sources, strict=True) if i in found and found[i][1] != signature(s)]
    if wrong:
        raise MarkupError("\n".join(wrong))
    return [found[i][0] for i in asked]


def _plain(markup: str) -> str:
    return html.unescape(" ".join(re.sub(r"<[^>]+>", "", markup).split()))


def translate_chunk(call: Provider, sources: list[str], context: list[str], glossary: str, system: str, model: str | None) -> tuple[list[str] | None, dict[str, float], str | None, str]:
    """(translation, usage, error, kind: ok, invalid, error or quota) of one chunk.

    An invalid answer is asked for again with what was wrong; after that the
    segments are halved, and the second half sees the end of the first.
    """
    usage: dict[str, float] = {"calls": 0.0}
    done: list[str] = []
    todo = [sources]
    while todo:
        own = todo.pop()
        before = [_plain(m) for m in done[-CONTEXT_SEGMENTS:]] if done else context
        error, kind = None, "ok"
        for _ in range(ATTEMPTS):
            try:
                result = call(prompt_of(glossary, before, own, error), system, model)
                usage["calls"] += 1
                for k, v in result.usage.items():
                    usage[k] = usage.get(k, 0.0) + v
                done += checked(result.text, own)
                error = None
                break
            except QuotaError as e:
                return None, usage, str(e), "quota"
            except ModelError as e:
                error, kind = str(e), "error"
            except MarkupError as e:
                error, kind = str(e), "invalid"
        if error is not None:
            if len(own) == 1:
                return None, usage, error, kind
            todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return done, usage, None, "ok"


def chunk_rows(segments: DataFrame, numbers: DataFrame) -> DataFrame:
    """(book_id, chunk, sources): the markup of each chunk's segments in order. A chunk is bounded by its words."""
    row = F.struct("file_pos", "idx", "src")
    joined = segments.join(numbers, ["book_id", "file_pos", "idx"])
    return joined.groupBy("book_id", "chunk").agg(F.array_sort(F.collect_list(row)).alias("s")).select("book_id", "chunk", F.transform("s", lambda x: x["src"]).alias("sources"))


def translated(store: Store) -> DataFrame:
    """The chunks that are translated, each once. Texts are only shuffled for that where a chunk was stored more than once."""
    rows, keys = store.read("translations", TRANSLATIONS), ["book_id", "chunk"]
    good = rows.where("translation IS NOT NULL")
    return good if rows.groupBy(*keys).count().where("count > 1").isEmpty() else good.dropDuplicates(keys)


def arrivals(store: Store) -> DataFrame:
    """What was announced to streams; a chunk may be there more than once."""
    try:
        return store.spark.read.schema(ARRIVALS).parquet(f"{store.path}/arrivals")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return store.spark.createDataFrame([], ARRIVALS)


def announce(store: Store, chunks: DataFrame) -> None:
    """Tells streams of chunks (ARRIVALS) that the store has."""
    chunks.select("book_id", "edition", "chunk").write.mode("append").parquet(f"{store.path}/arrivals")


def _tails(done: DataFrame) -> DataFrame:
    """(book_id, chunk, context): the end of each translated chunk, for the chunk after it."""
    tail = F.slice("translation", F.greatest(F.size("translation") - (CONTEXT_SEGMENTS - 1), F.lit(1)), CONTEXT_SEGMENTS)
    return done.select("book_id", (F.col("chunk") + 1).alias("chunk"), tail.alias("context"))


def next_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The first untranslated chunk of each book, with the end of the chunk before it as context."""
    todo = chunks.join(done.select("book_id", "chunk"), ["book_id", "chunk"], "left_anti")
    first = todo.groupBy("book_id").agg(F.min("chunk").alias("chunk"))
    return chunks.join(first, ["book_id", "chunk"]).join(_tails(done), ["book_id", "chunk"], "left")


def _answered(rows: DataFrame, call: Provider | Mapping[str, Provider]) -> DataFrame:
    """ROUND for chunks (book_id, chunk, sources, context, glossary, provider, model, system), each book's in order and up to one that fails.

    A chunk sees the end of the one before it, where that was translated here, or else its context.
    A task holds one chunk and a batch of segments.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        last, tail, good = None, [], True
        for (book, chunk), own in groupby(segments, key=lambda r: r[:2]):
            _, _, source, context, glossary, name, model, system = next(own)
            if last is not None and last[0] == book and not good:
                continue
            if last != (book, chunk - 1):
                tail = context or []
            sources, began = [source, *(r[2] for r in own)], time.monotonic()
            found = translate_chunk(call if callable(call) else call[name], sources, [_plain(m) for m in tail], glossary or "", system, model)
            last, tail, good = (book, chunk), (found[0] or [])[-CONTEXT_SEGMENTS:], found[0] is not None
            row = (book, chunk, found[0], list(found[1].items()), *found[2:], name, time.monotonic() - began)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ROUND, strict=True)], schema=_ROUND)

    once = ("context", "glossary", "provider", "model", "system")  # with a chunk's first segment
    split = F.transform("sources", lambda x, i: F.struct(x.alias("src"), *[F.when(i == 0, F.col(c)).alias(c) for c in once]))
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: books stay side by side, however small they are
    dealt = rows.repartition(many, "book_id").sortWithinPartitions("book_id", "chunk")
    return dealt.select("book_id", F.col("chunk").cast("int").alias("chunk"), F.inline(split)).mapInArrow(answer, ROUND)


def translate(chunks: DataFrame, store: Store, call: Provider | Mapping[str, Provider], model: str | None = None, glossary: DataFrame | None = None, system: str = SYSTEM, max_chunks: int | None = None) -> bool:
    """Translates what the store lacks, at most ``max_chunks`` new ones a book; True when all chunks are done.

    chunks: book_id, chunk (from 1), sources, and, where books differ in them,
    provider, model, system and edition; call is then a map from providers. They
    are read in each round, so they should be written. A book whose
    chunk fails stops for this run and keeps what it has; its errors are in the
    store. A provider whose quota is used up is asked no more after that round.
    glossary: book_id, glossary. The first round takes one chunk of each book;
    how many the next one takes follows from the seconds that the calls for a book
    took, so a run that breaks off loses some minutes' work on a book at most, or one
    chunk. A round reads what the round before it wrote, not the whole store. What a
    round stored is then announced to streams; what a run that broke off had stored
    and not announced is at the next one's start.
    """
    for name, value in (("provider", None), ("model", model), ("system", system), ("edition", "")):
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, F.lit(value).cast("string"))
    known = translated(store)
    editions = written(chunks.select("book_id", "edition").distinct(), "editions")
    untold = known.select("book_id", "chunk").join(editions, "book_id").join(arrivals(store), ["book_id", "edition", "chunk"], "left_anti")
    untold = written(untold.select("book_id", "edition", "chunk"), "untold")
    if not untold.isEmpty():
        announce(store, untold)
    fresh = known.isEmpty()
    pending = chunks if fresh else written(chunks.join(known.select("book_id", "chunk"), ["book_id", "chunk"], "left_anti"), "pending")
    numbered = pending.select("book_id", "chunk", F.row_number().over(Window.partitionBy("book_id").orderBy("chunk")).alias("_place"))
    if max_chunks is not None:
        numbered = numbered.where(F.col("_place") <= max_chunks)
    # what is missing, as stretches of chunks that follow one another
    stretches = written(numbered.groupBy("book_id", (F.col("chunk") - F.col("_place")).alias("_by")).agg(F.min("chunk").alias("_first"), F.max("chunk").alias("_end")).drop("_by"), "stretches")
    before = written(_tails(known), "context")

    def next_of(left: DataFrame, context: DataFrame) -> DataFrame:
        """(book_id, _first, _end, context): the first stretch of each book and the end of the chunk before it."""
        first = left.groupBy("book_id").agg(F.min("_first").alias("_first"), F.min("_end").alias("_end"))
        return written(first.join(context.withColumnRenamed("chunk", "_first"), ["book_id", "_first"], "left"), "following")

    following = next_of(stretches, before)
    stopped: set[str | None] = set()
    size = 1
    while books := following.count():
        own = pending.join(F.broadcast(following) if books <= BROADCAST_BOOKS else following, "book_id")
        rows = own.where(F.col("chunk").between(F.col("_first"), F.col("_end")) & (F.col("chunk") < F.col("_first") + F.lit(size)))
        rows = rows.withColumn("context", F.when(F.col("chunk") == F.col("_first"), F.col("context")))
        rows = rows.join(glossary.select("book_id", "glossary"), "book_id", "left") if glossary is not None else rows.withColumn("glossary", F.lit(""))
        folder = store.stage("translations", _answered(rows.select("book_id", "chunk", "sources", "context", "glossary", "provider", "model", "system"), call))
        now = store.staged("translations", folder, ROUND)
        store.commit("translations", folder)
        announce(store, now.where("translation IS NOT NULL").select("book_id", "chunk").join(editions, "book_id"))
        of_books = now.groupBy("provider", "book_id").agg(F.sum("seconds").alias("seconds"), F.bool_or(F.col("error_kind") == "quota").alias("quota"))
        ended = of_books.groupBy("provider").agg(F.max("seconds").alias("seconds"), F.bool_or("quota").alias("quota")).collect()
        stopped |= {r.provider for r in ended if r.quota}
        good = F.col("translation").isNotNull()
        if stopped:
            good &= ~F.coalesce("provider", F.lit("")).isin([x or "" for x in stopped])
        ends = now.groupBy("book_id").agg(F.max("chunk").alias("chunk"), F.bool_and(good).alias("_good")).where("_good").select("book_id", "chunk")
        left = stretches.join(ends.withColumnRenamed("chunk", "_last"), "book_id").where("_end > _last").withColumn("_first", F.greatest("_first", F.col("_last") + 1))
        following = next_of(left, before.unionByName(_tails(now.join(ends, ["book_id", "chunk"]))))
        took = max((r.seconds for r in ended), default=0.0)
        size = size * GROWTH if took < ROUND_SECONDS else max(1, size // GROWTH) if took > GROWTH * ROUND_SECONDS else size
    return chunks.join(translated(store).select("book_id", "chunk"), ["book_id", "chunk"], "left_anti").isEmpty()


def compact(store: Store) -> None:
    """Puts the many small files of translations together, and deletes what no readable version needs."""
    store.compact("translations", TRANSLATIONS, "book_id")
    store.clean("translations")


def usage_totals(usage: DataFrame) -> DataFrame:
    """(book_id, name, total): the sums of each counter over a table with book_id and usage."""
    return usage.select("book_id", F.explode("usage").alias("name", "value")).groupBy("book_id", "name").agg(F.sum("value").alias("total"))


def _counted(call: Provider, prompt: str, system: str, model: str | None, read: Callable[[str], object], tries: int = 1) -> tuple[object, dict[str, float], Exception | None]:
    """(what ``read`` made of the answer, usage of all calls, the error of the last one)."""
    usage: dict[str, float] = {"calls": 0.0}
    error: Exception | None = None
    for _ in range(tries):
        try:
            result = call(prompt, system, model)
            usage["calls"] += 1
            for k, v in result.usage.items():
                usage[k] = usage.get(k, 0.0) + v
            return read(result.text), usage, None
        except (ValueError, ModelError) as e:
            error = e
            if isinstance(e, QuotaError):
                break
    return None, usage, error


def _object(call: Provider, prompt: str, system: str, model: str | None) -> tuple[str, dict[str, float]]:
    """A JSON object as text, and usage; an answer that can't be read is asked for once more."""
    found, usage, error = _counted(call, prompt, system, model, lambda text: json.dumps(first_json(text, "{"), ensure_ascii=False), tries=2)
    if error is not None:
        raise error
    return found, usage


def glossary_parts(segments: DataFrame, store: Store, call: Provider, model: str | None = None, limit: int = 40000) -> None:
    """Asks for the terms of each slice of a book that the store has none for."""
    have = store.read("glossary_parts", PARTS).select("book_id", "slice")
    todo = slice_texts(segments, limit).join(have, ["book_id", "slice"], "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, s, *_object(call, f"Part {s} of a book:\n{t}", "List the characters, places, terms and relationships as one JSON object.", model)) for b, s, t in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["book_id", "slice", "part", "usage"])

    store.append("glossary_parts", todo.select("book_id", "slice", "text").mapInPandas(ask, PARTS))


def merged_glossary(store: Store, call: Provider, model: str | None = None, books: DataFrame | None = None) -> DataFrame:
    """(book_id, glossary, usage): one call for each book, of those given, over all its parts in order. To be written before use."""
    parts = store.read("glossary_parts", PARTS).dropDuplicates(["book_id", "slice"])
    if books is not None:
        parts = parts.join(books.select("book_id").distinct(), "book_id", "left_semi")
    listed = parts.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("slice", "part"))).alias("p")).select("book_id", F.concat(F.lit("[\n"), F.array_join(F.transform("p", lambda x: x["part"]), ",\n"), F.lit("\n]")).alias("parts"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(b, *_object(call, f"What was found in the parts of a book:\n{p}", "Merge this into one glossary, as one JSON object.", model)) for b, p in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["book_id", "glossary", "usage"])

    return listed.mapInPandas(ask, f"book_id string, glossary string, {USAGE}")


def translated_labels(labels: DataFrame, call: Provider, model: str | None = None) -> DataFrame:
    """LABELS of the distinct labels of each book, one call a book; after a wrong answer a book has a row without label alone, with the usage. To be written before use."""
    first = labels.where("label <> ''").groupBy("book_id", "label").agg(F.min(F.struct("source", "pos")).alias("at"))
    listed = first.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("l")).select("book_id", F.transform("l", lambda x: x["label"]).alias("labels"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for book, own in batch.itertuples(index=False):
                own = list(own)
                answer, usage, _ = _counted(call, f"{LISTED}\n{json.dumps(own, ensure_ascii=False)}", "Translate the labels into Hungarian, as one JSON list of as many.", model, lambda text, n=len(own): string_list(text, n))
                rows += [(book, a, b, None if i else usage) for i, (a, b) in enumerate(zip(own, answer, strict=True))] if answer is not None else [(book, None, None, usage)]
            yield pd.DataFrame(rows, columns=["book_id", "label", "translation", "usage"])

    return listed.mapInPandas(ask, LABELS)


def spelled(texts: DataFrame, known: DataFrame, call: Provider, model: str | None = None, size: int = SPEECH_BATCH) -> DataFrame:
    """SPOKEN for the distinct texts with numbers that ``known`` (text) lacks, in batches; after a wrong answer a batch is a row without text, with the usage.

    texts: columns text and seq, its place, and perhaps book_id, which usage is
    booked on. Batches are cut within tasks, so their number, not their content,
    follows the data. To be written before use.
    """
    book = F.col("book_id") if "book_id" in texts.columns else F.lit(None).cast("string")
    todo = texts.where(T.needs_spelling("text")).groupBy("text").agg(F.min(F.struct("seq", book.alias("book_id"))).alias("at")).select("text", "at.*").join(known.select("text"), "text", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), size):
                own, books = batch["text"].iloc[a : a + size].tolist(), batch["book_id"].iloc[a : a + size].tolist()
                answer, usage, _ = _counted(call, json.dumps(own, ensure_ascii=False), "speech", model, lambda text, n=len(own): string_list(text, n))
                rows = [(t, x, b, None if i else usage) for i, (t, x, b) in enumerate(zip(own, answer, books, strict=True))] if answer is not None else [(None, None, books[0], usage)]
                yield pd.DataFrame(rows, columns=["text", "spoken", "book_id", "usage"])

    return todo.repartitionByRange("seq").sortWithinPartitions("seq").select("text", "book_id").mapInPandas(ask, SPOKEN)
