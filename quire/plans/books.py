"""The steps of a book's work over one store: prepare, glossary, translate, build, narrate, status.

A store is a folder that all executors share. It holds any number of books; each
step takes all of them, or those named, and goes on from what is there. Each
book's own provider, model and profile, as prepare stored them, rule every step.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import glossaries, narration, packing, reports, segments
from quire.operators import translation as tr
from quire.operators.common import mounted, put, written
from quire.operators.providers import Provider, check_ready, chosen_model, provider
from quire.operators.store import Store, columns
from quire.operators.translation import LABELS, SPOKEN, SYSTEMS
from quire.sources import epub
from quire.streaming.follow import follow, released

STATE = "book_id string, profile string, provider string, model string, source string, archive string, edition string"
SEGMENTS = segments.SEGMENTS + ", words int, chunk int"
PIECES = "piece_key string, text string, heard string, score double, data binary"
GLOSSARY = f"book_id string, glossary string, {tr.USAGE}"
CHAPTERS = "book_id string, chapter long, keys array<string>, ms long, data binary"
PROFILES = tuple(SYSTEMS)
Books = list[str] | DataFrame | None


class BookError(Exception):
    """A step that can't be done as things are."""


def state(store: Store) -> DataFrame:
    return store.read("state", STATE)


def _of(df: DataFrame, books: Books) -> DataFrame:
    """The rows of these books; of all if None."""
    if books is None:
        return df
    return df.where(F.col("book_id").isin(books)) if isinstance(books, list) else df.join(books.select("book_id").distinct(), "book_id", "left_semi")


@dataclass(frozen=True)
class Setting:
    """Books that share a provider, a model and a profile."""

    provider: str
    model: str | None
    call: Provider
    light_model: str | None
    books: DataFrame


def _settings(store: Store, books: Books, provider_name: str | None = None, model: str | None = None, call: Provider | None = None) -> list[Setting]:
    """The books by what they are worked on with: what is stored with them, or what is named here; ``call`` stands for any provider."""
    own = _of(state(store), books)
    out = []
    for r in own.select("provider", "model").distinct().collect():  # as many as there are providers and models
        name = provider_name or r.provider
        chosen = model or (r.model if name == r.provider else None)
        if call is None:
            check_ready(name)
            chosen = chosen_model(name, chosen)
        light = None if call is not None else provider(name).light_model
        out.append(Setting(name, chosen, call or provider(name).call, light, own.where(F.col("provider").eqNullSafe(r.provider) & F.col("model").eqNullSafe(r.model)).select("book_id")))
    return out


def prepare(spark: SparkSession, path: str, store: Store, profile: str, provider_name: str, model: str | None = None, references: bool = False, known: str = "refuse", book_id: str | None = None) -> DataFrame:
    """Reads the archives below a path, cuts them into chunks and registers them; the state is written last, so a broken run leaves no book.

    known: what is done with books that the store has: ``refuse`` (an error),
    ``keep`` (only others are prepared) or ``replace`` (all that is stored of
    them goes). book_id: the name of the one book there. Returns the state rows
    of what was prepared.
    """
    if profile not in PROFILES:
        raise BookError(f"no profile {profile}; there are: {', '.join(PROFILES)}")
    check_ready(provider_name)
    model = chosen_model(provider_name, model)
    index = epub.read_index(spark, path).withColumn("archive", F.col("book_id"))
    if book_id is not None:
        if index.select("archive").distinct().count() != 1:
            raise BookError("a name can be given to one book alone")
        index = index.withColumn("book_id", F.lit(book_id))
    index = written(index.select(F.lit(path).alias("source"), "book_id", "archive", "path", "ord", "entry"), "index")
    names = index.select("book_id", "archive").distinct()
    there = names.join(state(store), "book_id", "left_semi")
    first = there.select("book_id").take(5)
    if first and known == "refuse":
        raise BookError(f"already prepared: {', '.join(r[0] for r in first)}")
    if first and known == "replace":
        gone = written(there.select("book_id"), "replaced")
        for name, schema in (("state", STATE), ("segments", SEGMENTS), ("translations", tr.TRANSLATIONS), ("glossary_parts", tr.PARTS), ("glossary", GLOSSARY), ("labels", LABELS), ("chapters", CHAPTERS)):
            store.without(name, schema, gone)
    if first and known == "keep":
        names = written(names.join(state(store), "book_id", "left_anti"), "new-books")
        index = index.join(names.select("book_id"), "book_id", "left_semi")
    archives = Archives(spark, index, (path,))
    spine = epub.spine(archives.package())
    pages = segments.book_pages(archives.entries(spine.select("book_id", F.col("file").alias("entry"))), spine)
    found = written(segments.page_segments(pages, references), "segments")
    store.append("segments", found.join(packing.chunks(found), ["book_id", "file_pos", "idx"]).select(*columns(SEGMENTS)))
    fresh = names.select("book_id", F.lit(profile).alias("profile"), F.lit(provider_name).alias("provider"), F.lit(model).cast("string").alias("model"), F.lit(path).alias("source"), "archive", F.lit(uuid.uuid4().hex).alias("edition"))
    fresh = written(fresh, "state")
    store.append("state", fresh)
    return fresh


def _segments(store: Store, books: Books) -> DataFrame:
    return _of(store.read("segments", SEGMENTS), books)


def _chunks(store: Store, books: Books) -> DataFrame:
    own = _segments(store, books)
    return written(tr.chunk_rows(own.drop("chunk"), own.select("book_id", "file_pos", "idx", "chunk")), "chunks")


def glossary(store: Store, provider_name: str | None = None, model: str | None = None, books: Books = None, call: Provider | None = None) -> None:
    """Terms of each slice that has none yet, merged anew for each of these books; other books keep theirs."""
    for own in _settings(store, books, provider_name, model, call):
        texts = _segments(store, own.books).withColumn("text", T.plain_text("src"))
        tr.glossary_parts(texts, store, own.call, own.model)
        merged = written(tr.merged_glossary(store, own.call, own.model, own.books), "glossary")
        store.replace_rows("glossary", GLOSSARY, merged, merged.select("book_id"))


def write_glossaries(store: Store, folder: str, books: Books = None) -> None:
    """A YAML file for each book that has a glossary, to be read and edited, in a folder that all executors mount."""
    glossaries.write_files(_of(store.read("glossary", GLOSSARY), books), folder)


def read_glossaries(store: Store, folder: str, books: Books = None) -> None:
    """Takes over what the files in a folder say now: a book whose file says something new, or that had no glossary, has its row replaced.

    Books without a file keep what they have. A file that isn't a mapping ends
    the step before anything is changed.
    """
    found = written(glossaries.read_files(_of(state(store), books), folder), "edited")
    wrong = found.where("error IS NOT NULL").orderBy("book_id").take(5)
    if wrong:
        raise BookError("\n".join(f"{folder}/{r.book_id}.yaml: {r.error}" for r in wrong))
    had = store.read("glossary", GLOSSARY).select("book_id", F.col("glossary").alias("before"), "usage")
    changed = written(found.join(had, "book_id", "left").where("NOT glossary <=> before").select("book_id", "glossary", "usage"), "changed")
    if not changed.isEmpty():
        store.replace_rows("glossary", GLOSSARY, changed, changed.select("book_id"))


def glossary_terms(store: Store, books: Books = None) -> DataFrame:
    """The names and terms of the books' glossaries, a row each."""
    return glossaries.terms(_of(store.read("glossary", GLOSSARY), books).select("book_id", "glossary"))


def translate(store: Store, provider_name: str | None = None, model: str | None = None, books: Books = None, max_chunks: int | None = None, call: Provider | None = None) -> bool:
    """Translates what isn't yet, then the labels of books without any. True when all chunks are done.

    A provider whose quota is used up is asked no more in this run.
    """
    settings = _settings(store, books, provider_name, model, call)
    chunks, rows = _chunks(store, books), None
    system = F.create_map(*[F.lit(x) for pair in SYSTEMS.items() for x in pair])[F.col("profile")]
    for i, own in enumerate(settings):
        named = own.books.join(state(store).select("book_id", "profile", "edition"), "book_id").select("book_id", "edition", F.lit(str(i)).alias("provider"), F.lit(own.model).cast("string").alias("model"), system.alias("system"))
        rows = named if rows is None else rows.unionByName(named)
    if rows is None:
        raise BookError("the store has none of these books")
    calls = {str(i): own.call for i, own in enumerate(settings)}
    done = tr.translate(chunks.join(rows, "book_id"), store, calls, glossary=store.read("glossary", GLOSSARY), max_chunks=max_chunks)
    if done:
        have = store.read("labels", LABELS).where("label IS NOT NULL").select("book_id").distinct()
        new = written(labels(store.spark, store, books).join(have, "book_id", "left_anti"), "labels")
        for own in settings:
            store.append("labels", tr.translated_labels(_of(new, own.books), own.call, own.model))
    return done


@dataclass(frozen=True)
class Archives:
    """The archives of some books, under the names that they have in the store: an index, and what it is asked for."""

    spark: SparkSession
    index: DataFrame  # source, book_id, archive, path, ord, entry
    sources: tuple[str, ...]

    def entries(self, wanted: DataFrame | None = None) -> DataFrame:
        """All entries, or those that ``wanted`` (book_id, entry) names. To be written where it is used more than once."""
        listed = self.index if wanted is None else self.index.join(wanted.select("book_id", "entry").distinct(), ["book_id", "entry"], "left_semi")
        names = self.index.select("source", "archive", "book_id").distinct()
        out = None
        for source in self.sources:
            own = epub.read_entries(self.spark, source, listed.where(F.col("source") == source).select("path", "ord"))
            own = own.withColumnRenamed("book_id", "archive").join(names.where(F.col("source") == source).select("archive", "book_id"), "archive").drop("archive")
            out = own if out is None else out.unionByName(own)
        return out

    def package(self) -> DataFrame:
        """The books' package files as rows; the container and the package are all that is read."""
        container = self.entries(self.index.where(F.col("entry") == epub.CONTAINER))
        opf = written(epub.roots(container), "roots")
        return written(epub.package_rows(self.entries(opf.select("book_id", F.col("opf").alias("entry"))), opf), "package")

    def label_files(self, package: DataFrame) -> DataFrame:
        navigation = epub.navigation(package)
        named = navigation.select("book_id", F.explode(F.array("opf", "nav", "ncx")).alias("entry"))
        return segments.label_files(self.entries(named), navigation)


def _archives(spark: SparkSession, store: Store, books: Books) -> Archives:
    named = _of(state(store), books).select("book_id", "source", F.coalesce("archive", "book_id").alias("archive"))
    sources = tuple(r[0] for r in named.select("source").distinct().collect())  # the folders that prepare was called with
    out = None
    for path in sources:
        own = epub.read_index(spark, path).withColumnRenamed("book_id", "archive").join(named.where(F.col("source") == path), "archive").select("source", "book_id", "archive", "path", "ord", "entry")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise BookError("the store has no books")
    return Archives(spark, written(out, "archives"), sources)


def labels(spark: SparkSession, store: Store, books: Books = None) -> DataFrame:
    archives = _archives(spark, store, books)
    return segments.labels(archives.label_files(archives.package()))


def _markup(store: Store, books: Books, done: DataFrame) -> DataFrame:
    """(book_id, file, file_pos, idx, markup): translations by their place; a chunk whose translation has another length fails."""
    order = F.array_sort(F.collect_list(F.struct("file_pos", "idx", "file")))
    own = _segments(store, books).groupBy("book_id", "chunk").agg(order.alias("s"))
    both = own.join(done.select("book_id", "chunk", "translation"), ["book_id", "chunk"])
    told = F.when(F.size("s") != F.size("translation"), F.raise_error(F.lit("a translation has another number of segments than its chunk"))).otherwise(F.arrays_zip("s", "translation"))
    return both.select("book_id", F.explode(told).alias("z")).select("book_id", "z.s.file", "z.s.file_pos", "z.s.idx", F.col("z.translation").alias("markup"))


def build(store: Store, target: str, books: Books = None, partial: bool = False, language: str = "hu") -> None:
    """Writes the translated archives into a folder that all executors mount. Missing chunks are refused, or with ``partial`` left as they were."""
    spark = store.spark
    done = tr.translated(store)
    left = _chunks(store, books).join(done.select("book_id", "chunk"), ["book_id", "chunk"], "left_anti")
    gaps = left.groupBy("book_id").agg(F.count("*").alias("n"), F.min("chunk").alias("first")).take(5)
    if gaps and not partial:
        raise BookError("; ".join(f"{r.book_id}: {r.n} chunks aren't translated, the first is {r['first']}" for r in gaps))
    archives = _archives(spark, store, books)
    package = archives.package()
    spine = epub.spine(package)
    pages = segments.book_pages(archives.entries(spine.select("book_id", F.col("file").alias("entry"))), spine)
    new = segments.written_back(pages, _markup(store, books, done), language)
    named = segments.relabelled(archives.label_files(package), store.read("labels", LABELS), language)
    epub.write_books(epub.overlaid(archives.entries(), new.unionByName(named)), target)


def _read_aloud(store: Store, books: Books, done: DataFrame, skip: list[str]) -> DataFrame:
    own = _segments(store, books)
    texts = own.join(_markup(store, books, done).select("book_id", "file", "idx", "markup"), ["book_id", "file", "idx"]).withColumn("text", T.speech_text("markup"))
    skipped = narration.skipped_files(own.select("book_id", "file", "skip"), labels(store.spark, store, books))
    return narration.chapters(narration.flow(texts, skipped, skip))


def _spoken(store: Store) -> DataFrame:
    return store.read("spoken", SPOKEN).where("text IS NOT NULL").select("text", "spoken").dropDuplicates(["text"])


def narrate(store: Store, speak: Callable[[DataFrame], DataFrame], provider_name: str | None = None, model: str | None = None, books: Books = None, skip: list[str] | None = None, call: Provider | None = None) -> DataFrame:
    """Makes the pieces that are missing for what is translated without a gap, and returns (book_id, chapter, complete, title).

    speak: takes (piece_key, text, window, batch, place, seed), the missing
    pieces in batches of similar length, and returns PIECES: the best take of
    each with what was heard and how alike it is.
    """
    chunks = _chunks(store, books).select("book_id", "chunk")
    read = written(_read_aloud(store, books, released(chunks, tr.translated(store)), skip or []), "read")
    prepared = read.withColumn("text", T.prepare("text", "heading")).withColumn("seq", F.struct("book_id", "file_pos", "idx", "sub"))
    for own in _settings(store, books, provider_name, model, call):
        store.append("spoken", tr.spelled(_of(prepared, own.books), _spoken(store), own.call, own.light_model or own.model))
    stored = store.read("pieces", PIECES)
    made = written(narration.narration(read, _spoken(store), stored), "pieces")
    order = ["book_id", "chapter", "run", "sub_order", "part"]
    missing = narration.missing(made, stored, order).withColumn("seed", T.piece_seed("text"))
    store.append("pieces", speak(narration.length_batches(missing, ["first", "piece_key"]).drop("first", "seq")))
    titles = narration.chapter_titles(read)
    return narration.complete_chapters(titles, made, store.read("pieces", PIECES)).join(titles, ["book_id", "chapter"])


def report(store: Store) -> DataFrame:
    """The stored pieces whose best take isn't good enough."""
    return narration.suspects(store.read("pieces", PIECES).drop("data"))


def narrate_stream(store: Store, speak: Callable[[DataFrame], DataFrame], checkpoint: str, seconds: int = 60, once: bool = False, target: str | None = None, **settings):
    """narrate and refresh_chapters for the books of which chunks were released, each time some are; with a target the chapters that changed are written there."""

    def came(new: DataFrame) -> None:
        books = written(_of(new.select("book_id").distinct(), settings.get("books")), "released-books")
        if books.isEmpty():
            return
        narrate(store, speak, **settings | {"books": books}).write.format("noop").mode("overwrite").save()
        if target is None:
            refresh_chapters(store, _narrated(store, books, settings.get("skip")))
        else:
            write_audio(*audiobook(store, books, settings.get("skip"), only_changed=True), target)

    return follow(store.spark, store, came, checkpoint, seconds, once)


def usage_log(store: Store) -> DataFrame:
    """(book_id, step, name, total): what each step's calls took for each book."""
    steps = {"translate": ("translations", tr.TRANSLATIONS), "glossary": ("glossary_parts", tr.PARTS), "merge": ("glossary", GLOSSARY), "labels": ("labels", LABELS), "speech": ("spoken", SPOKEN)}
    out = None
    for step, (name, schema) in steps.items():
        own = tr.usage_totals(store.read(name, schema).select("book_id", "usage")).withColumn("step", F.lit(step))
        out = own if out is None else out.unionByName(own)
    return out.select("book_id", "step", "name", "total")


def status(store: Store, books: Books = None) -> DataFrame:
    """(book_id, done, total, missing, first_missing, glossary, usage): how far each book is."""
    chunks = _segments(store, books).select("book_id", "chunk").distinct().join(tr.translated(store).select("book_id", "chunk", "translation"), ["book_id", "chunk"], "left")
    usage = usage_log(store).groupBy("book_id", "name").agg(F.sum("total").alias("total")).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "total")))).alias("usage"))
    terms = store.read("glossary", GLOSSARY).select("book_id", F.lit(True).alias("glossary"))
    return reports.status(chunks).join(terms, "book_id", "left").join(usage, "book_id", "left").fillna({"glossary": False})


def metadata(store: Store, books: Books = None) -> DataFrame:
    """(book_id, title, artists, cover, image, toc): translated titles, authors, the cover's file and data, and a map from files to their translated labels."""
    archives = _archives(store.spark, store, books)
    package = archives.package()
    named = store.read("labels", LABELS).where("label IS NOT NULL").select("book_id", F.col("label").alias("text"), "translation").dropDuplicates(["book_id", "text"])
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "own")))), lambda x: x["own"])
    about = package.where("kind IN ('title', 'creator')").join(named, ["book_id", "text"], "left").withColumn("own", F.when(F.col("kind") == "title", F.coalesce("translation", "text")).otherwise(F.col("text")))
    texts = about.groupBy("book_id").agg(F.array_join(listed("title"), ": ").alias("title"), F.array_join(listed("creator"), ", ").alias("artists"))
    contents = segments.labels(archives.label_files(package)).where("toc AND href IS NOT NULL").withColumnRenamed("label", "text").join(named, ["book_id", "text"], "left")
    first = contents.groupBy("book_id", "href").agg(F.min_by(F.coalesce("translation", "text"), "pos").alias("label"))
    toc = first.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("href", "label")))).alias("toc"))
    covers = epub.covers(package).select("book_id", F.col("file").alias("cover"))
    images = archives.entries(covers.select("book_id", F.col("cover").alias("entry"))).select("book_id", F.col("entry").alias("cover"), F.col("data").alias("image"))
    images = covers.join(images, ["book_id", "cover"])
    return epub.navigation(package).select("book_id").join(texts, "book_id", "left").join(images, "book_id", "left").join(toc, "book_id", "left").select("book_id", F.coalesce(F.expr("nullif(title, '')"), "book_id").alias("title"), "artists", "cover", "image", "toc")


@dataclass(frozen=True)
class Narrated:
    """What is read aloud of some books: the pieces' table, the pieces of each chapter, titles, and the keys of each chapter that is complete."""

    stored: DataFrame
    pieces: DataFrame
    titles: DataFrame
    wanted: DataFrame


def _narrated(store: Store, books: Books, skip: list[str] | None) -> Narrated:
    chunks = _chunks(store, books).select("book_id", "chunk")
    read = written(_read_aloud(store, books, released(chunks, tr.translated(store)), skip or []), "read")
    stored = store.read("pieces", PIECES).dropDuplicates(["piece_key"])
    pieces = written(narration.narration(read, _spoken(store), stored), "pieces")
    titles = narration.chapter_titles(read)
    whole = narration.complete_chapters(titles, pieces, stored).where("complete").select("book_id", "chapter")
    return Narrated(stored, pieces, titles, written(narration.manifests(pieces.join(whole, ["book_id", "chapter"])), "manifests"))


def refresh_chapters(store: Store, own: Narrated) -> DataFrame:
    """Makes the complete chapters that the store lacks or whose pieces changed, in one version of the table; others stay in their files. Returns (book_id, chapter) of those made."""
    have = store.read("chapters", CHAPTERS)
    same = F.col("keys") == F.col("_keys")
    changed = own.wanted.join(have.select("book_id", "chapter", F.col("keys").alias("_keys")), ["book_id", "chapter"], "left").where(~F.coalesce(same, F.lit(False))).select("book_id", "chapter", "keys")
    changed = written(changed, "changed-chapters")
    if not changed.isEmpty():
        made = narration.chapter_audio(own.pieces.join(changed.select("book_id", "chapter"), ["book_id", "chapter"]), own.stored.select("piece_key", "data")).join(changed, ["book_id", "chapter"])
        store.replace_rows("chapters", CHAPTERS, made.select(*columns(CHAPTERS)), changed.select("book_id", "chapter"))
    return changed.select("book_id", "chapter")


def audiobook(store: Store, books: Books = None, skip: list[str] | None = None, only_changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """((book_id, chapter, title, start_ms, end_ms, data), (book_id, metadata)): the complete chapters as WAV files, and the chapter marks as text.

    A chapter's title is its label in the table of contents, else its beginning.
    Chapters are kept in the store, and made anew only where their pieces
    changed; with ``only_changed`` only those are returned, with all marks.
    """
    own = _narrated(store, books, skip)
    made = refresh_chapters(store, own)
    sound = store.read("chapters", CHAPTERS).join(own.wanted.select("book_id", "chapter"), ["book_id", "chapter"], "left_semi")
    about = metadata(store, books).select("book_id", F.col("title").alias("book_title"), "artists", "toc")
    marks = narration.offsets(sound.select("book_id", "chapter", "ms"), ["book_id"], ["chapter"]).join(own.titles, ["book_id", "chapter"]).join(about, "book_id")
    marks = written(marks.withColumn("title", F.coalesce(F.expr("nullif(toc[file], '')"), "title")), "marks")
    if only_changed:
        sound = sound.join(made, ["book_id", "chapter"], "left_semi")
    return marks.select("book_id", "chapter", "title", "start_ms", "end_ms").join(sound.select("book_id", "chapter", "data"), ["book_id", "chapter"]), narration.chapter_metadata(marks)


def write_audio(sound: DataFrame, marks: DataFrame, target: str) -> None:
    """Writes a folder for each book into one that all executors mount: chapters as WAV files, and the chapter marks as metadata.txt. Fails where an executor doesn't see what the driver put there."""
    name = F.substring(T.output_name("title"), 1, 60)
    with mounted(target) as place:

        def chapters(rows: Iterator[Row]) -> None:
            for r in rows:
                put(place(f"{r.book_id}/{r.chapter:04d}-{r.name}.wav"), bytes(r.data))

        def texts(rows: Iterator[Row]) -> None:
            for r in rows:
                put(place(f"{r.book_id}/metadata.txt"), r.metadata.encode())

        sound.select("book_id", "chapter", name.alias("name"), "data").foreachPartition(chapters)
        marks.foreachPartition(texts)
