"""Blocks of text: out of pages, out of plain documents, and back into pages."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.markup import HEADINGS, NOTE_TYPES, REFERENCE_TYPES, SKIP_TYPES, Document, Node, language_edits, numbered, parse, rewrite, segments, spliced
from quire.sources.epub import resolve

SEGMENTS = (
    "book_id string, file string, file_pos long, idx int, tag string, src string, reference boolean, heading boolean, skip boolean, "
    "note struct<file: string, id: string>, refs array<struct<file: string, id: string>>"
)
LABELS = "book_id string, source int, file string, pos int, label string, href string, toc boolean, skip boolean"


def lines(docs: DataFrame, book: str = "source", file: str = "doc_id", text: str = "text") -> DataFrame:
    """(book_id, file_pos, idx, text, words): the lines with a letter of plain documents; idx counts all lines."""
    split = docs.select(F.col(book).alias("book_id"), F.col(file).alias("file_pos"), F.posexplode(F.split(text, "\n")).alias("idx", "text"))
    return split.where(T.has_letter("text")).withColumn("words", T.word_count("text"))


def first_places(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(text, first, copies): each distinct text with the place it comes first and how often it comes."""
    return rows.groupBy(text).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))


def _notes(node: Node, file: str) -> tuple[dict | None, list[dict], bool]:
    """(the note that a segment is of, the notes it refers to, whether it is reference matter)."""
    above = [a for a in node.up() if a.meanings]
    note = next(({"file": file, "id": a.attributes.get("id", "")} for a in above if a.meanings & NOTE_TYPES), None)
    refs = []
    for a in node.walk():
        if a.tag == "a" and "noteref" in a.meanings and a.attributes.get("href"):
            where, name = resolve(posixpath.dirname(file), a.attributes["href"])
            refs.append({"file": where or file, "id": name})
    return note, refs, any(a.meanings & REFERENCE_TYPES for a in above)


def _page_rows(book: str, file: str, pos: int, data: bytes) -> Iterator[tuple]:
    document = parse(data)
    body = next((n for n in document.root.walk() if n.tag == "body"), None)
    meant = any(n.meanings for n in document.root.walk())
    skip = meant and body is not None and any(n.meanings & SKIP_TYPES for n in body.walk())
    for idx, node in enumerate(segments(document)):
        note, refs, reference = _notes(node, file) if meant else (None, [], False)
        yield book, file, pos, idx, node.tag, numbered(node), reference, node.tag in HEADINGS, skip, note, refs


_POINTER = pa.struct([("file", pa.string()), ("id", pa.string())])
_COLUMNS = {
    "book_id": pa.string(), "file": pa.string(), "file_pos": pa.int64(), "idx": pa.int32(), "tag": pa.string(), "src": pa.string(),
    "reference": pa.bool_(), "heading": pa.bool_(), "skip": pa.bool_(), "note": _POINTER, "refs": pa.list_(_POINTER),
}
#: Segments that a task gathers before it passes them on.
ROWS_AT_ONCE = 2000


def page_segments(pages: DataFrame, references: bool = False) -> DataFrame:
    """The segments of pages (book_id, file, file_pos, data): content as numbered markup, and what it is.

    idx counts all of a page's segments; bibliographies and indexes are then left
    out unless ``references``. skip says that the page is marked as one that isn't
    read aloud. words counts the plain text.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def passed() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(_COLUMNS)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True)], list(_COLUMNS))

        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += _page_rows(*own)
                if len(rows) >= ROWS_AT_ONCE:
                    yield passed()
                    rows.clear()
        yield passed()

    found = pages.select("book_id", "file", F.col("file_pos").cast("long"), "data").mapInArrow(extract, SEGMENTS)
    kept = found if references else found.where(~F.col("reference"))
    return kept.withColumn("words", T.word_count(T.plain_text("src")))


def book_pages(entries: DataFrame, spine: DataFrame) -> DataFrame:
    return spine.join(entries.select("book_id", F.col("entry").alias("file"), "data"), ["book_id", "file"])


def _translated(data: bytes, translations: dict[int, str]) -> bytes:
    document = parse(data)
    nodes = segments(document)
    return rewrite(document, [(nodes[i].inner, nodes[i].close, spliced(document, nodes[i], markup)) for i, markup in translations.items()])


def written_back(pages: DataFrame, translations: DataFrame, language: str = "hu") -> DataFrame:
    """(book_id, entry, data): each page with its translations (book_id, file, idx, markup) put in and the language stated.

    Every page is rewritten, also one without translations; a page and its
    translations meet in one task.
    """

    def build(page: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = []
        found = dict(zip(own["idx"], own["markup"], strict=True))
        for book, file, data in page[["book_id", "file", "data"]].itertuples(index=False, name=None):
            document = parse(_translated(data, found))
            rows.append((book, file, rewrite(document, language_edits(document, language))))
        return pd.DataFrame(rows, columns=["book_id", "entry", "data"])

    keys = ["book_id", "file"]
    translations = translations.select(*keys, "idx", "markup")
    return pages.select(*keys, "data").groupBy(*keys).cogroup(translations.groupBy(*keys)).applyInPandas(build, "book_id string, entry string, data binary")


def _label_nodes(kind: str, document: Document) -> list[tuple[Node, bool]]:
    """The elements of a file that hold labels, and whether each is of the table of contents."""
    found: list[tuple[Node, bool]] = []
    if kind == "opf":
        return [(n, False) for n in document.root.walk() if n.tag == "title"]
    if kind == "nav":
        tables = [n for n in document.root.walk() if n.tag == "nav"]
        toc = next((n for n in tables if "toc" in n.meanings), None)
        for n in document.root.walk():
            if n.tag == "a" and any(a.tag == "nav" for a in n.up()) and n.text().split():
                found.append((n, any(a is toc for a in n.up())))
        return found
    labels = [n for n in document.root.walk() if n.tag == "text" and n.parent is not None and n.text().split()]
    return [(n, False) for part in ("navLabel", "docTitle") for n in labels if n.parent.tag == part]


def label_files(entries: DataFrame, navigation: DataFrame) -> DataFrame:
    """(book_id, source, kind, file, data): package, table of contents and old table of contents, in this order."""
    kinds = F.array(*[F.struct(F.lit(i).alias("source"), F.lit(k).alias("kind"), F.col(k).alias("file")) for i, k in enumerate(("opf", "nav", "ncx"))])
    files = navigation.select("book_id", F.inline(kinds)).where("file IS NOT NULL")
    return files.join(entries.select("book_id", F.col("entry").alias("file"), "data"), ["book_id", "file"]).select("book_id", "source", "kind", "file", "data")


def labels(files: DataFrame) -> DataFrame:
    """The labels of label_files in order, with what they lead to; skip: the link is marked as leading to a page that isn't read."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, source, kind, file, data in batch.itertuples(index=False, name=None):
                for pos, (node, toc) in enumerate(_label_nodes(kind, parse(data))):
                    href = node.attributes.get("href")
                    where = resolve(posixpath.dirname(file), href)[0] if href else None
                    rows.append((book, source, file, pos, " ".join(node.text().split()), where, toc, bool(node.meanings & SKIP_TYPES)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LABELS.split(", ")])

    return files.mapInPandas(extract, LABELS)


def relabelled(files: DataFrame, translated: DataFrame, language: str = "hu") -> DataFrame:
    """(book_id, entry, data): label_files with labels replaced where ``translated`` (book_id, label, translation) has a text for them."""

    def build(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        by = {a: b for a, b in zip(texts["label"], texts["translation"], strict=True) if b}
        rows = []
        for book, kind, file, data in own[["book_id", "kind", "file", "data"]].itertuples(index=False, name=None):
            document = parse(data)
            edits = []
            for node, _ in _label_nodes(kind, document):
                new = by.get(" ".join(node.text().split()))
                if new and node.close < node.end:
                    edits.append((node.inner, node.close, new.replace("&", "&amp;").replace("<", "&lt;").encode()))
            if kind == "opf":
                edits += [(n.inner, n.close, language.encode()) for n in document.root.walk() if n.tag == "language" and n.close < n.end]
            out = rewrite(document, edits)
            if kind == "nav":
                out = rewrite(again := parse(out), language_edits(again, language))
            rows.append((book, file, out))
        return pd.DataFrame(rows, columns=["book_id", "entry", "data"])

    return files.groupBy("book_id").cogroup(translated.select("book_id", "label", "translation").groupBy("book_id")).applyInPandas(build, "book_id string, entry string, data binary")
