"""The queries of the library's own operators over the driver's tables, and their SQL.

``documents`` plays the books: a source is a book, a document a file of it, a
line a segment. Limits are smaller than a book's, so that chunks and slices come
to several.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import answers, speech
from quire.functions import text as T
from quire.operators import glossaries, narration, packing, reports, segments, translation, validation
from quire.operators.common import shared_dir, table, written
from quire.operators.ordered import previous, running, spread
from quire.operators.providers import provider
from quire.operators.store import Store
from quire.streaming.follow import RELEASED, follow

CHUNK, PART, SLICE = 2000, 500, 3000
BOOK, ORDER = ["book_id"], ["file_pos", "idx"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.lines(_documents(spark, sf_dir))


def _chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk of its source, translated where it has a label."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    joined = _documents(spark, sf_dir).select("doc_id", "source").join(known, "doc_id", "left")
    return joined.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chunk"), F.when(F.col("known"), F.array(F.lit("done"))).alias("translation"))


def segments_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("book_id", *ORDER, "text")


def plain_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", T.plain_text("html", html5=False).alias("text"))
    return out.withColumn("words", T.word_count("text"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    files = lines.groupBy("book_id", "file_pos").agg(F.count("*").alias("segments"), F.sum("words").alias("words"))
    return files.groupBy("book_id").agg(F.count("*").alias("files"), F.sum("segments").alias("segments"), F.sum("words").alias("words"))


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.chunks(_lines(spark, sf_dir), CHUNK)


def split_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.parts(_lines(spark, sf_dir), PART)


def glossary_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.slices(_lines(spark, sf_dir), SLICE)


def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(T.LETTER))
    docs = _documents(spark, sf_dir).where("text IS NOT NULL").select(F.col("source").alias("book_id"), F.col("doc_id").alias("file_pos"), kept.alias("l"))
    tail = docs.withColumn("tail", F.array_join(F.expr("slice(l, greatest(size(l) - 9, 1), 10)"), "\n")).drop("l")
    return previous(spread(tail, BOOK, ["file_pos"]), BOOK, ["file_pos"], {"context": "tail"}).select("book_id", "file_pos", "context")


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.first_places(_lines(spark, sf_dir), "text", ORDER).select("text", "first.file_pos", "first.idx", "copies")


def _page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_sort(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", tags.alias("signature"))


def tag_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_tags(spark, sf_dir).select("page_id", F.size("signature").alias("tags"), F.array_join("signature", ",").alias("signature"))


def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.expr("turn div 2").alias("id"))
    found = validation.id_problems(turns.where("role = 'user'"), turns.where("role = 'assistant'"), ["conv_id"])
    return found.select("conv_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("missing", "extra", "repeated")])


def signature_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _page_tags(spark, sf_dir).withColumn("id", F.lit("1"))
    other = tags.select(F.expr("page_id ^ 1L AS page_id"), "id", "signature")
    found = validation.signature_problems(tags, other, ["page_id"])
    return found.select("page_id", F.array_join("expected", ",").alias("expected"), F.array_join("got", ",").alias("got"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.create_map("event_type", "value", F.lit("calls"), F.lit(1.0)).alias("usage"))
    return translation.usage_totals(usage).withColumn("total", F.round("total", 4))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status(_chunk_table(spark, sf_dir))


def first_gap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.first_gap(_chunk_table(spark, sf_dir)).select("book_id", "chunk")


def chapter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("file_pos"), F.lit(0).alias("idx"), F.lit(0).alias("sub"), F.col("lang").alias("file"))
    return narration.chapters(rows).select("book_id", "file_pos", "file", "chapter")


def skip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a licence is marked in itself, one with reserved rights by a link to it."""
    holds = lambda pattern: F.bool_or(F.col("text").rlike(pattern))
    pages = _lines(spark, sf_dir).groupBy("book_id", "file_pos").agg(holds("(?i)licen[cs]e").alias("skip"), holds("(?i)rights reserved").alias("linked"))
    named = pages.withColumn("file", F.concat_ws("/", "book_id", F.col("file_pos").cast("string")))
    labels = named.select("book_id", F.col("linked").alias("skip"), F.col("file").alias("href"), F.lit(1).alias("source"))
    gone = narration.skipped_files(named, labels)
    return named.where(~narration.matches_any("file", ["/13"])).join(gone, ["book_id", "file"], "left_anti").select("book_id", "file_pos")


def short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "pages").select(F.col("page_id"), F.posexplode(F.regexp_extract_all("html", F.lit("<li><a[^>]*>([^<]*)"), F.lit(1))).alias("idx", "text"))
    runs = narration.short_runs(cells.withColumn("text", T.collapse("text")).withColumn("heading", F.lit(False)), ["page_id"], ["idx"])
    return narration.joined_runs(runs, ["page_id"], ["idx"]).select("page_id", "run", "text")


def note_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each citing a benchmark item as a note, or one that isn't there: then the first of its file. Sources whose name ends in 1 are skipped."""
    none = F.lit(None).cast("struct<file: string, id: string>")
    ref = F.struct(F.concat(F.lit("notes"), (F.col("n_chars") % 7).cast("string")).alias("file"), (F.col("n_chars") % 60).cast("string").alias("id"))
    docs = _documents(spark, sf_dir).select(F.lit("b").alias("book_id"), F.col("source").alias("file"), F.col("doc_id").alias("file_pos"), F.lit(0).alias("idx"), "text", F.lit(False).alias("heading"), none.alias("note"), F.array(ref).alias("refs"))
    where = F.concat(F.lit("notes"), (F.col("item_id") % 7).cast("string"))
    notes = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("book_id"), where.alias("file"), (F.col("item_id") + 10**12).alias("file_pos"), F.lit(0).alias("idx"), "text", F.lit(False).alias("heading"), F.struct(where.alias("file"), F.col("item_id").cast("string").alias("id")).alias("note"), F.array().cast(docs.schema["refs"].dataType).alias("refs"))
    skipped = docs.where(F.col("file").endswith("1")).select("book_id", "file").distinct()
    return narration.flow(docs.unionByName(notes), skipped, note_label="Note: ").select("file_pos", "sub", "text")


def speech_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.speech_text(F.concat_ws(" ", "url", "html"), html5=False).alias("text"))


def prepare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    heading = F.col("idx") == 0
    own = F.concat(F.when(F.col("words") > 8, F.concat((F.col("words") % 10).cast("string"), F.lit(". "))).otherwise("2.3. "), "text", F.lit(" (pp. 7–9) __"))
    return lines.select("book_id", *ORDER, T.prepare(own, heading).alias("text"))


def spell_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(T.needs_spelling("text")).select("book_id", *ORDER, "text")


def split_long_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.pieces(_lines(spark, sf_dir).withColumn("heading", F.col("idx") == 0), ["book_id", *ORDER])


def piece_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _lines(spark, sf_dir).select("text").distinct()
    return texts.select("text", T.piece_key("text").alias("piece_key"), T.piece_seed("text", 2).alias("seed"), T.frame_cap(F.length("text")).alias("frames"))


def missing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("piece_key", T.piece_key("text"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("file_pos"))
    found = narration.missing(lines, lines.join(good, "file_pos", "left_semi"), ORDER)
    return found.select("piece_key", "text", "first.file_pos", "first.idx")


def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.length_batches(_documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text"), ["doc_id"]).select("doc_id", "window", "batch", "place")


def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.fixed_batches(_lines(spark, sf_dir).where(T.needs_spelling("text")).select("book_id", *ORDER), ["book_id", *ORDER], translation.SPEECH_BATCH).select("book_id", *ORDER, "batch")


def best_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narration.best_takes(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


def chapter_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter"), F.col("n_chars").alias("ms"))
    return narration.offsets(rows, BOOK, ["chapter"])


def judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _documents(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.judged(scores, ["source"], ["quality", "toxic"])


def price_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("cost"), F.count("*").alias("words"))
    ten, book = reports.prices(F.col("cost"), F.col("words"))
    return sums.select("event_type", F.round(ten, 4).alias("ten_pages"), F.round(book, 4).alias("book"))


def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "conversations").select("conv_id", T.occurrences("text", "th").alias("a"), T.occurrences("text", "an").alias("b"))
    return counted.groupBy("conv_id").agg(F.sum("a").alias("retries"), F.sum("b").alias("splits"))


def spoken_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("book_id", *ORDER, "text")
    known = lines.where(T.needs_spelling("text")).select("text").distinct().withColumn("spoken", F.regexp_replace("text", "[0-9]", "#"))
    return narration.spoken(lines, known)


def label_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in old tables of contents; those of several pages are translated, every third to nothing, which leaves it as it was."""
    title = T.collapse(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), "[&;]", ""))
    own = table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("book_id"), title.alias("label"))
    known = own.withColumn("n", F.count("*").over(Window.partitionBy("label"))).where("n > 1")
    translated = known.select("book_id", "label", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("[A & "), "label", F.lit("]"))).alias("translation"))
    data = F.concat(F.lit("<ncx><docTitle><text> "), "label", F.lit("</text></docTitle></ncx>"))
    files = own.select("book_id", F.lit(2).alias("source"), F.lit("ncx").alias("kind"), F.lit("toc.ncx").alias("file"), F.encode(data, "UTF-8").alias("data"))
    return segments.relabelled(files, translated).select(F.col("book_id").cast("long").alias("page_id"), F.decode("data", "UTF-8").alias("data"))


def slug_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.slug("url", "book").alias("slug"), T.output_name("url").alias("output_name"), T.metadata_escape("url").alias("escaped"), T.quote_path("url").alias("quoted"), T.domain_only("url").alias("domain"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON value in a text that has more around it."""
    rows = table(spark, sf_dir, "events").where(F.col("props").startswith("{"))
    found = answers.json_value(F.concat(F.lit("log "), "props", F.lit(" {more")), F.lit("{"))
    return rows.select("event_id", F.from_json(found, "k long")["k"].alias("k"))


def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's distinct words as the glossary that a model answers, with talk around it: capitalised ones are characters, the others terms."""
    words = F.array_distinct(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = _documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", words.alias("w"))
    people = F.transform(F.filter("w", lambda w: w.rlike("^[A-Z]")), lambda w: F.struct(w.alias("name"), F.concat(F.lit("HU "), w).alias("hu")))
    others = F.transform(F.filter("w", lambda w: ~w.rlike("^[A-Z]")), lambda w: F.struct(w.alias("source"), F.concat(F.lit("HU "), w).alias("hu"), (F.length(w) > 8).alias("keep_original")))
    answer = F.concat(F.lit("Here: "), F.to_json(F.struct(people.alias("characters"), others.alias("terms"))), F.lit("} done"))
    found = docs.select("doc_id", answers.json_value(answer, F.lit("{")).alias("glossary"))
    return glossaries.terms(found).select("doc_id", "kind", "place", "source", "hu", "keep_original")


def similarity_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each benchmark item is to the one whose id differs in the lowest bit."""
    items = table(spark, sf_dir, "benchmark")
    other = items.select(F.expr("item_id ^ 1L AS item_id"), F.col("text").alias("heard"))
    return items.join(other, "item_id").select("item_id", F.round(speech.similarity("text", "heard"), 6).alias("score"))


def xhtml_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a paragraph for each line, and the segments of these."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit("<html><body><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></body></html>"))
    docs = _documents(spark, sf_dir).where("text IS NOT NULL")
    pages = docs.select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("file_pos"), F.encode(body, "UTF-8").alias("data"))
    return segments.page_segments(pages).select("book_id", *ORDER, "tag", "src", "words")


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose lines are paragraphs with elements inside: nested, empty, opaque, and a comment."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def paragraph(line: Column) -> Column:
        first = F.regexp_extract(line, "^[^ ]*", 0)
        return F.concat(F.lit("<p>"), first, F.lit(' <em class="k"><b>'), F.substr(line, F.length(first) + 2), F.lit("</b></em><!-- c --><br/>!<svg><text>no</text></svg></p>"))

    body = F.array_join(F.transform(F.split(safe, "\n"), paragraph), "")
    docs = _documents(spark, sf_dir).where("text IS NOT NULL")
    page = F.concat(F.lit('<html lang="en"><body>'), body, F.lit("</body></html>"))
    return docs.select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("file_pos"), F.encode(page, "UTF-8").alias("data"))


def inline_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with numbered elements inside, and their signatures."""
    found = segments.page_segments(_marked_up(spark, sf_dir))
    return found.select("book_id", *ORDER, "src", "words", F.array_join(answers.tag_signature("src"), ",").alias("signature"))


def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations that leave elements out and bring others in another order, put back into their pages."""
    pages = _marked_up(spark, sf_dir)
    first = F.regexp_extract("src", "^[^ ]*", 0)
    found = segments.page_segments(pages).select("book_id", "file", "idx", F.concat(F.lit('<br n="3"/><svg n="4"/><em n="1">'), first, F.lit("</em>")).alias("markup"))
    out = segments.written_back(pages, found)
    return out.select("book_id", F.col("entry").cast("long").alias("file_pos"), F.sha1("data").alias("digest"))


def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a book from its package, its table of contents and its old one."""
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    texts = {
        "opf": ('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>', "</dc:title></metadata></package>"),
        "nav": ('<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><a href="x.xhtml#a">Part <i> of </i> ', '</a><a href="y"> </a></nav><nav><a epub:type="cover" href="z">Cover</a></nav></body></html>'),
        "ncx": ("<ncx><navMap><navPoint><navLabel><text>", "</text></navLabel></navPoint></navMap><docTitle><text>All</text></docTitle></ncx>"),
    }
    kinds = F.array(*[F.struct(F.lit(i).alias("source"), F.lit(k).alias("kind"), F.lit(f"d/{k}").alias("file"), F.encode(F.concat(F.lit(a), url, F.lit(b)), "UTF-8").alias("data")) for i, (k, (a, b)) in enumerate(texts.items())])
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("book_id"), F.inline(kinds))
    return segments.labels(files).select(F.col("book_id").cast("long").alias("page_id"), "source", "pos", "label", "href", "toc", "skip")


def translate_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole books through the translation loop with the provider that needs no model."""
    lines = _lines(spark, sf_dir).withColumn("src", F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    chunks = written(translation.chunk_rows(lines, packing.chunks(lines)), "chunks")
    store = Store(spark, f"{shared_dir(spark)}/books-{uuid.uuid4().hex}")
    translation.translate(chunks, store, provider("echo").call)
    return translation.translated(store).select("book_id", "chunk", F.size("translation").alias("segments"), F.sha1(F.array_join("translation", "\n")).alias("digest"))


def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is appended to, replaced in part, compacted and appended to again, read at a version before and at the last."""
    store = Store(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    schema = "book_id string, chunk long, size long, step string"
    rows = _documents(spark, sf_dir).select(F.col("source").alias("book_id"), F.col("doc_id").alias("chunk"), F.col("n_chars").cast("long").alias("size"))
    step = lambda df, name: df.withColumn("step", F.lit(name))
    store.append("rows", step(rows.where("chunk % 3 = 0"), "first"))
    before = store.append("rows", step(rows.where("chunk % 3 = 1"), "second"))
    german = _documents(spark, sf_dir).where("lang = 'de'").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chunk"))
    again = rows.join(german, ["book_id", "chunk"], "left_semi").where("chunk % 3 < 2").withColumn("size", F.col("size") * 2)
    store.replace_rows("rows", schema, step(again, "again"), german)
    store.without("rows", schema, rows.where("book_id LIKE '%1'"))
    store.compact("rows", schema, "book_id")
    store.append("rows", step(rows.where("chunk % 3 = 2"), "last"))
    return store.read("rows", schema, before).withColumn("at", F.lit("before")).unionByName(store.read("rows", schema).withColumn("at", F.lit("now")))


def stream_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come in any order, some never, released in order by a stream's state."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    docs = _documents(spark, sf_dir).select("source", "doc_id")
    numbered = running(spread(docs, ["source"], ["doc_id"]), ["source"], ["doc_id"], {"chunk": F.lit(1)})
    early = numbered.where("chunk <= 7").join(known, "doc_id", "left_anti")
    arrived = numbered.join(known, "doc_id", "left_semi").unionByName(early, allowMissingColumns=True)
    store = Store(spark, f"{shared_dir(spark)}/release-{uuid.uuid4().hex}")
    rows = arrived.select(F.coalesce("source", F.lit("")).alias("book_id"), F.lit("").alias("edition"), F.col("chunk").cast("int").alias("chunk"))
    translation.announce(store, rows.repartition(3, F.xxhash64("book_id", "chunk")))  # several files, in no order
    out = f"{store.path}/released"
    store.append("released", spark.createDataFrame([], RELEASED))
    follow(spark, store, lambda new: store.append("released", new) and None, f"{out}-checkpoint", once=True).awaitTermination()
    return store.read("released", RELEASED).select("book_id", "chunk")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals and preceding events of each user, in order of time."""
    rows = spread(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    rows = previous(rows, ["user_id"], ["ts", "event_id"], {"before": "event_type"})
    return running(rows, ["user_id"], ["ts", "event_id"], {"errors": F.when(F.col("event_type") == "error", 1).otherwise(0)}).select("event_id", "before", "errors")


QUERIES = {
    f.__name__: f
    for f in (
        segments_explode, plain_text_pages, word_counts, chunk_packing, split_by_words, glossary_slices, rolling_context, ordered_distinct, tag_signature, validate_ids,
        signature_mismatch, usage_rollup, status_rollup, first_gap_prefix, chapter_runs, skip_files, short_runs, note_join, speech_text, prepare_text, spell_detect,
        split_long_pieces, piece_keys, missing_pieces, length_batches, fixed_batches, best_take, chapter_offsets, judge_report, price_report, log_counters, spoken_lookup,
        label_translate, slug_urls, json_props, glossary_terms, similarity_best, xhtml_segments, inline_markup, write_back, label_union, translate_echo, store_snapshots, stream_release, event_sequences,
    )
}

_WS, _NS, _L = r"[\s\x0b\x1c-\x1f\x85\p{Z}]", r"[^\s\x0b\x1c-\x1f\x85\p{Z}]", r"[\p{L}\p{Nl}\p{No}]"


def _collapsed(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{_NS}+')) AS INTEGER)"


def _bare(x: str) -> str:
    out = _collapsed(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "''''"), ("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
        out = f"replace({out}, '{a}', {b})"
    return out


def _domain(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)(?:https?://)?(?:www\.)?((?:[\p{{L}}\p{{N}}\p{{M}}_-]+\.)+(?:com|org|net|edu|gov|io|hu|uk))(?:/{_NS}*)?', '\1', 'g')"


_SPELL = r"\p{Nd}|(?:^|[^\p{L}\p{N}\p{M}_])(?:[IVXLCDM]{2,}|[IVX])\."
_LINES = f"""lines AS (
  SELECT book_id, file_pos, CAST(i - 1 AS INTEGER) AS idx, l[i] AS text, {_words('l[i]')} AS words
  FROM (SELECT source AS book_id, doc_id AS file_pos, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(l[i], '{_L}')
)"""
_CHUNKS = "chunk_table AS (SELECT d.source AS book_id, d.doc_id AS chunk, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)"
_TAGS = "tags AS (SELECT page_id, list_sort(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS s FROM pages)"


def _parts(limit: int, files: str) -> str:
    """CTEs that number the parts of each file (of the table ``files``: book_id, file_pos) from 0, in part_of."""
    return f"""
sized AS (
  SELECT l.*, row_number() OVER w AS rn, sum(words) OVER (PARTITION BY l.book_id, l.file_pos) AS total FROM lines l JOIN {files} f ON f.book_id = l.book_id AND f.file_pos = l.file_pos
  WINDOW w AS (PARTITION BY l.book_id, l.file_pos ORDER BY idx)
), part_of AS (
  SELECT book_id, file_pos, idx, rn, total, 0 AS part, words AS n FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.book_id, s.file_pos, s.idx, s.rn, s.total,
         CASE WHEN p.n >= p.total / ceil(p.total / {limit}.0) AND p.part < ceil(p.total / {limit}.0) - 1 THEN p.part + 1 ELSE p.part END,
         CASE WHEN p.n >= p.total / ceil(p.total / {limit}.0) AND p.part < ceil(p.total / {limit}.0) - 1 THEN s.words ELSE p.n + s.words END
  FROM part_of p JOIN sized s ON s.book_id = p.book_id AND s.file_pos = p.file_pos AND s.rn = p.rn + 1
)"""


#: A closing angle bracket as a page's text is written anew.
_SHOWN = "replace({}, '>', '&gt;')"
_HEADING = r"CASE WHEN idx = 0 THEN regexp_replace(t, '^\p{Nd}+(?:\.\p{Nd}+)*\.?" + _WS + r"+([A-ZÁÉÍÓÖŐÚÜŰ])', '\1') ELSE regexp_replace(t, '^\p{Nd}+(?:\.\p{Nd}+)+\.?" + _WS + r"+([A-ZÁÉÍÓÖŐÚÜŰ])', '\1') END"
_PAGES = r"\p{Nd}+(?:" + _WS + "*[–-]" + _WS + r"*\p{Nd}+)?"

ORACLE_SQL: dict[str, str] = {
    "segments_explode": f"WITH {_LINES} SELECT book_id, file_pos, idx, text FROM lines",
    "plain_text_pages": f"SELECT page_id, text, {_words('text')} AS words FROM (SELECT page_id, {_bare('html')} AS text FROM pages)",
    "word_counts": f"WITH {_LINES} SELECT book_id, count(DISTINCT file_pos) AS files, count(*) AS segments, CAST(sum(words) AS BIGINT) AS words FROM lines GROUP BY book_id",
    "chunk_packing": f"""WITH RECURSIVE {_LINES}, files AS (
  SELECT book_id, file_pos, sum(words) AS w, row_number() OVER (PARTITION BY book_id ORDER BY file_pos) AS rn FROM lines GROUP BY book_id, file_pos
), groups AS (
  SELECT book_id, file_pos, rn, 0 AS g, w AS n FROM files WHERE rn = 1
  UNION ALL
  SELECT f.book_id, f.file_pos, f.rn, CASE WHEN g.n + f.w > {CHUNK} THEN g.g + 1 ELSE g.g END, CASE WHEN g.n + f.w > {CHUNK} THEN f.w ELSE g.n + f.w END
  FROM groups g JOIN files f ON f.book_id = g.book_id AND f.rn = g.rn + 1
), long AS (SELECT book_id, file_pos FROM files WHERE w > {CHUNK}), {_parts(CHUNK, 'long')}
SELECT l.book_id, l.file_pos, l.idx, CAST(dense_rank() OVER (PARTITION BY l.book_id ORDER BY g.g, coalesce(p.part, 0)) AS INTEGER) AS chunk
FROM lines l JOIN groups g ON g.book_id = l.book_id AND g.file_pos = l.file_pos LEFT JOIN part_of p ON p.book_id = l.book_id AND p.file_pos = l.file_pos AND p.idx = l.idx""",
    "split_by_words": f"WITH RECURSIVE {_LINES}, every_file AS (SELECT DISTINCT book_id, file_pos FROM lines), {_parts(PART, 'every_file')} SELECT book_id, file_pos, idx, CAST(part + 1 AS INTEGER) AS part FROM part_of",
    "glossary_slices": f"""WITH RECURSIVE {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY file_pos, idx) AS rn FROM lines), s AS (
  SELECT book_id, file_pos, idx, rn, 1 AS slice, words AS n FROM r WHERE rn = 1
  UNION ALL
  SELECT r.book_id, r.file_pos, r.idx, r.rn, CASE WHEN s.n >= {SLICE} THEN s.slice + 1 ELSE s.slice END, CASE WHEN s.n >= {SLICE} THEN r.words ELSE s.n + r.words END
  FROM s JOIN r ON r.book_id = s.book_id AND r.rn = s.rn + 1
) SELECT book_id, file_pos, idx, CAST(slice AS INTEGER) AS slice FROM s""",
    "rolling_context": f"""WITH d AS (SELECT source AS book_id, doc_id AS file_pos, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_L}')) AS l FROM documents WHERE text IS NOT NULL)
SELECT book_id, file_pos, lag(coalesce(array_to_string(l[-10:], chr(10)), '')) OVER (PARTITION BY book_id ORDER BY file_pos) AS context FROM d""",
    "ordered_distinct": f"WITH {_LINES} SELECT text, file_pos, idx, copies FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY file_pos, idx) AS rn, count(*) OVER (PARTITION BY text) AS copies FROM lines) WHERE rn = 1",
    "tag_signature": f"WITH {_TAGS} SELECT page_id, CAST(len(s) AS INTEGER) AS tags, array_to_string(s, ',') AS signature FROM tags",
    "validate_ids": """WITH t AS (SELECT conv_id, role, turn // 2 AS id FROM conversations), q AS (SELECT DISTINCT conv_id, id FROM t WHERE role = 'user'),
a AS (SELECT conv_id, id, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id, id),
j AS (SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, coalesce(q.id, a.id) AS id, q.id IS NULL AS extra, a.n FROM q FULL JOIN a ON a.conv_id = q.conv_id AND a.id = q.id)
SELECT conv_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE n IS NULL), '') AS missing, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE extra), '') AS extra,
       coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE n > 1), '') AS repeated
FROM j GROUP BY conv_id HAVING count(*) FILTER (WHERE n IS NULL OR extra OR n > 1) > 0""",
    "signature_mismatch": f"WITH {_TAGS} SELECT a.page_id, array_to_string(a.s, ',') AS expected, array_to_string(b.s, ',') AS got FROM tags a JOIN tags b ON xor(a.page_id, 1) = b.page_id WHERE a.s <> b.s",
    "usage_rollup": "SELECT book_id, name, round(sum(v), 4) AS total FROM (SELECT user_id AS book_id, event_type AS name, value AS v FROM events UNION ALL SELECT user_id, 'calls', 1.0 FROM events) GROUP BY book_id, name",
    "status_rollup": f"WITH {_CHUNKS} SELECT book_id, count(*) FILTER (WHERE done) AS done, count(*) AS total, count(*) FILTER (WHERE NOT done) AS missing, min(chunk) FILTER (WHERE NOT done) AS first_missing FROM chunk_table GROUP BY book_id",
    "first_gap_prefix": f"WITH {_CHUNKS} SELECT book_id, chunk FROM (SELECT *, min(CAST(done AS INTEGER)) OVER (PARTITION BY book_id ORDER BY chunk) AS so_far FROM chunk_table) WHERE so_far = 1",
    "chapter_runs": """SELECT book_id, file_pos, file, CAST(sum(new) OVER (PARTITION BY book_id ORDER BY file_pos) AS BIGINT) AS chapter
FROM (SELECT source AS book_id, doc_id AS file_pos, lang AS file, CASE WHEN row_number() OVER w > 1 AND lang IS NOT DISTINCT FROM lag(lang) OVER w THEN 0 ELSE 1 END AS new FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))""",
    "skip_files": f"WITH {_LINES} SELECT book_id, file_pos FROM lines GROUP BY book_id, file_pos HAVING NOT bool_or(regexp_matches(text, '(?i)licen[cs]e|rights reserved')) AND NOT contains(book_id || '/' || file_pos, '/13')",
    "short_runs": rf"""WITH c AS (SELECT page_id, i, {_collapsed('l[i]')} AS text FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a[^>]*>([^<]*)', 1) AS l FROM pages))),
s AS (SELECT *, {_words('text')} <= 3 AND NOT regexp_matches(text, '[.!?…]["”»)]*$') AS short FROM c),
r AS (SELECT *, sum(CASE WHEN short AND coalesce(last, false) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS run FROM (SELECT *, lag(short) OVER (PARTITION BY page_id ORDER BY i) AS last FROM s)),
g AS (SELECT *, lag(text) OVER (PARTITION BY page_id, run ORDER BY i) AS before FROM r WHERE regexp_matches(text, '{_L}'))
SELECT page_id, CAST(run AS BIGINT) AS run, string_agg(CASE WHEN before IS NULL THEN '' WHEN regexp_matches(before, '[,:;–—]$') THEN ' ' ELSE ', ' END || text, '' ORDER BY i) AS text FROM g GROUP BY page_id, run""",
    "note_join": f"""WITH m AS (SELECT doc_id AS file_pos, text, n_chars % 7 AS f, n_chars % 60 AS id FROM documents WHERE regexp_matches(text, '{_L}') AND NOT coalesce(source LIKE '%1', false)),
b AS (SELECT item_id % 7 AS f, item_id AS id, CASE WHEN regexp_matches(text, '{_L}') THEN text ELSE '' END AS text FROM benchmark), o AS (SELECT f, arg_min(text, id) AS text FROM b GROUP BY f)
SELECT file_pos, CAST(0 AS INTEGER) AS sub, text FROM m
UNION ALL
SELECT m.file_pos, CAST(1 AS INTEGER), 'Note: ' || coalesce(b.text, o.text) FROM m LEFT JOIN b ON b.f = m.f AND b.id = m.id LEFT JOIN o ON o.f = m.f WHERE coalesce(b.text, o.text) IS NOT NULL""",
    "speech_text": f"""SELECT page_id, {_domain(_bare(rf"regexp_replace(regexp_replace(regexp_replace(concat_ws(' ', url, html), '<br n=[\"]\d+[\"]/>', ' ', 'g'), '<sup n=[\"]\d+[\"]>.*?</sup>', '', 'g'), '<a n=[\"]\d+[\"]>[^<\p{{L}}\p{{Nl}}\p{{No}}]*</a>', '', 'g')"))} AS text FROM pages""",
    "prepare_text": rf"""WITH {_LINES} SELECT book_id, file_pos, idx, regexp_replace(regexp_replace({_HEADING}, '_{{2,}}', '', 'g'), '{_WS}*\((?:pp?|o|old)\.{_WS}*{_PAGES}\)|{_WS}*\({_PAGES}\.{_WS}*o(?:ld)?\.\)', '', 'g') AS text
FROM (SELECT *, (CASE WHEN words > 8 THEN (words % 10) || '. ' ELSE '2.3. ' END) || text || ' (pp. 7–9) __' AS t FROM lines)""",
    "spell_detect": f"WITH {_LINES} SELECT book_id, file_pos, idx, text FROM lines WHERE regexp_matches(text, '{_SPELL}')",
    "piece_keys": f"WITH {_LINES} SELECT DISTINCT text, substr(sha1(text), 1, 16) AS piece_key, CAST('0x' || substr(sha1(text), 1, 8) AS BIGINT) + 2 AS seed, CAST(greatest(400, floor(length(text) * CAST(0.12 AS DOUBLE) * CAST(25 AS DOUBLE))) AS INTEGER) AS frames FROM lines",
    "missing_pieces": f"""WITH {_LINES}, s AS (SELECT DISTINCT text FROM lines JOIN labels ON doc_id = file_pos AND quality = 1)
SELECT substr(sha1(text), 1, 16) AS piece_key, text, file_pos, idx FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY file_pos, idx) AS rn FROM lines WHERE text NOT IN (SELECT text FROM s)) WHERE rn = 1""",
    "length_batches": """SELECT doc_id, w AS window, (n - 1) // 8 AS batch, (n - 1) % 8 AS place FROM (
  SELECT doc_id, w, row_number() OVER (PARTITION BY w ORDER BY length(text), rn) AS n FROM (SELECT *, (rn - 1) // 32 AS w FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL)))""",
    "fixed_batches": f"WITH {_LINES} SELECT book_id, file_pos, idx, (row_number() OVER (ORDER BY book_id, file_pos, idx) - 1) // 60 AS batch FROM lines WHERE regexp_matches(text, '{_SPELL}')",
    "best_take": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1",
    "chapter_offsets": "SELECT source AS book_id, doc_id AS chapter, n_chars AS ms, CAST(sum(n_chars) OVER w - n_chars AS BIGINT) AS start_ms, CAST(sum(n_chars) OVER w AS BIGINT) AS end_ms FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
    "judge_report": "SELECT source, count(*) FILTER (WHERE quality IS NOT NULL OR toxic IS NOT NULL) AS judges, coalesce(avg((coalesce(quality, 0) + coalesce(toxic, 0)) / 2.0) FILTER (WHERE quality IS NOT NULL OR toxic IS NOT NULL), 0.0) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "price_report": "SELECT event_type, round(sum(value) / (count(*) / 250.0) * 10, 4) AS ten_pages, round(sum(value) / (count(*) / 250.0) * 300, 4) AS book FROM events GROUP BY event_type",
    "log_counters": "SELECT conv_id, CAST(sum((length(text) - length(replace(text, 'th', ''))) // 2) AS BIGINT) AS retries, CAST(sum((length(text) - length(replace(text, 'an', ''))) // 2) AS BIGINT) AS splits FROM conversations GROUP BY conv_id",
    "spoken_lookup": f"WITH {_LINES} SELECT book_id, file_pos, idx, CASE WHEN regexp_matches(text, '{_SPELL}') THEN regexp_replace(text, '[0-9]', '#', 'g') ELSE text END AS text FROM lines",
    "label_translate": f"""WITH l AS (SELECT page_id, {_collapsed("regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[&;]', '', 'g')")} AS label FROM pages)
SELECT page_id, '<ncx><docTitle><text>' || CASE WHEN count(*) OVER (PARTITION BY label) > 1 AND page_id % 3 <> 0 AND label <> '' THEN '[A &amp; ' || label || ']' ELSE ' ' || label END || '</text></docTitle></ncx>' AS data FROM l""",
    "slug_urls": rf"""SELECT page_id, coalesce(nullif(lower(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'book') AS slug,
       regexp_replace(regexp_replace(url, '([^/])\.[^./]+$', '\1'), '[^\p{{L}}\p{{N}}\p{{M}}_.-]+', '_', 'g') AS output_name, regexp_replace(url, '([=;#\\\n])', '\\\1', 'g') AS escaped,
       '''' || replace(url, '''', '''\''''') || '''' AS quoted, {_domain('url')} AS domain FROM pages""",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE starts_with(props, '{')",
    "glossary_terms": r"""WITH t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM documents WHERE text IS NOT NULL)),
d AS (SELECT doc_id, w, min(i) AS i, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'characters' ELSE 'terms' END AS kind FROM t GROUP BY doc_id, w)
SELECT doc_id, kind, CAST(row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) - 1 AS INTEGER) AS place, w AS source, 'HU ' || w AS hu, CASE WHEN kind = 'terms' THEN length(w) > 8 END AS keep_original FROM d""",
    "xhtml_segments": f"WITH {_LINES} SELECT book_id, file_pos, idx, 'p' AS tag, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS src, words FROM lines",
    "inline_markup": f"""WITH {_LINES}, s AS (SELECT book_id, file_pos, idx, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS l, text FROM lines),
t AS (SELECT *, regexp_extract(l, '^[^ ]*') AS a, {_SHOWN.format("substr(l, length(regexp_extract(l, '^[^ ]*')) + 2)")} AS b FROM s)
SELECT book_id, file_pos, CAST(row_number() OVER (PARTITION BY book_id, file_pos ORDER BY idx) - 1 AS INTEGER) AS idx, {_SHOWN.format('a')} || ' <em n="1">' || CASE WHEN b = '' THEN '<b n="2"/>' ELSE '<b n="2">' || b || '</b>' END || '</em><br n="3"/>!<svg n="4"/>' AS src,
       {_words("regexp_extract(text, '^[^ ]*') || ' ' || substr(text, length(regexp_extract(text, '^[^ ]*')) + 2) || '!'")} AS words, '1 em,2 b,3 br,4 svg' AS signature FROM t""",
    "write_back": f"""WITH d AS (SELECT source AS book_id, doc_id AS file_pos, unnest(string_split(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
p AS (SELECT book_id, file_pos, i, regexp_extract(l, '^[^ ]*') AS a, l FROM d)
SELECT book_id, file_pos, sha1('<html lang="hu" xml:lang="hu"><body>' || string_agg('<p>' || CASE WHEN regexp_matches(l, '{_L}') THEN '<br/><svg><text>no</text></svg><em class="k">' || {_SHOWN.format('a')} || '</em>'
  ELSE a || ' <em class="k"><b>' || substr(l, length(a) + 2) || '</b></em><!-- c --><br/>!<svg><text>no</text></svg>' END || '</p>', '' ORDER BY i) || '</body></html>') AS digest FROM p GROUP BY book_id, file_pos""",
    "label_union": f"""WITH u AS (SELECT page_id, {_collapsed('url')} AS url FROM pages)
SELECT page_id, CAST(0 AS INTEGER) AS source, CAST(0 AS INTEGER) AS pos, url AS label, CAST(NULL AS VARCHAR) AS href, false AS toc, false AS skip FROM u
UNION ALL SELECT page_id, 1, 0, 'Part of ' || url, 'd/x.xhtml', true, false FROM u
UNION ALL SELECT page_id, 1, 1, 'Cover', 'd/z', false, true FROM u
UNION ALL SELECT page_id, 2, 0, url, NULL, false, false FROM u UNION ALL SELECT page_id, 2, 1, 'All', NULL, false, false FROM u""",
    "translate_echo": f"""WITH RECURSIVE {_LINES}, files AS (
  SELECT book_id, file_pos, sum(words) AS w, row_number() OVER (PARTITION BY book_id ORDER BY file_pos) AS rn FROM lines GROUP BY book_id, file_pos
), groups AS (
  SELECT book_id, file_pos, rn, 0 AS g, w AS n FROM files WHERE rn = 1
  UNION ALL
  SELECT f.book_id, f.file_pos, f.rn, CASE WHEN g.n + f.w > 8000 THEN g.g + 1 ELSE g.g END, CASE WHEN g.n + f.w > 8000 THEN f.w ELSE g.n + f.w END
  FROM groups g JOIN files f ON f.book_id = g.book_id AND f.rn = g.rn + 1
), long AS (SELECT book_id, file_pos FROM files WHERE w > 8000), {_parts(8000, 'long')}, numbered AS (
  SELECT l.*, CAST(dense_rank() OVER (PARTITION BY l.book_id ORDER BY g.g, coalesce(p.part, 0)) AS INTEGER) AS chunk
  FROM lines l JOIN groups g ON g.book_id = l.book_id AND g.file_pos = l.file_pos LEFT JOIN part_of p ON p.book_id = l.book_id AND p.file_pos = l.file_pos AND p.idx = l.idx
)
SELECT book_id, chunk, CAST(count(*) AS INTEGER) AS segments, sha1(string_agg('HU ' || replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10) ORDER BY file_pos, idx)) AS digest FROM numbered GROUP BY book_id, chunk""",
    "store_snapshots": """WITH r AS (SELECT source AS book_id, doc_id AS chunk, CAST(n_chars AS BIGINT) AS size, lang = 'de' AND source IS NOT NULL AS german FROM documents)
SELECT book_id, chunk, size, CASE WHEN chunk % 3 = 0 THEN 'first' ELSE 'second' END AS step, 'before' AS at FROM r WHERE chunk % 3 < 2
UNION ALL
SELECT book_id, chunk, CASE WHEN german THEN 2 * size ELSE size END, CASE WHEN german THEN 'again' WHEN chunk % 3 = 0 THEN 'first' ELSE 'second' END, 'now' FROM r WHERE chunk % 3 < 2 AND coalesce(book_id, '') NOT LIKE '%1'
UNION ALL
SELECT book_id, chunk, size, 'last', 'now' FROM r WHERE chunk % 3 = 2""",
    "stream_release": """WITH n AS (SELECT coalesce(source, '') AS book_id, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS chunk FROM documents),
a AS (SELECT *, chunk <= 7 OR doc_id IN (SELECT doc_id FROM labels) AS here FROM n)
SELECT book_id, chunk FROM (SELECT *, bool_and(here) OVER (PARTITION BY book_id ORDER BY chunk) AS ready FROM a) WHERE ready""",
    "event_sequences": "SELECT event_id, lag(event_type) OVER w AS before, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
}
