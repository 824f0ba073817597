"""EPUB archives as tables of entries: an index of what they hold, reading what a step asks for, a data source, and writing.

An archive lists its entries at its end. That list makes the index; an entry is
then read by its place, so a step that needs a few small files reads no others.
On stores that only Spark reads an archive comes whole, but only what is asked
for is unpacked.
"""

from __future__ import annotations

import io
import os
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quire.functions.markup import DC, Node, parse

ENTRIES = "book_id string, ord int, entry string, stored boolean, data binary"
INDEX = "book_id string, path string, ord int, entry string, stored boolean, size long"
#: Bytes of entries that a task hands on at once.
HANDED_BYTES = 1 << 24
PACKAGES = "book_id string, opf string, kind string, pos int, id string, href string, media_type string, properties string, text string"
# Media types of a book's pages and of its old table of contents.
PAGE_TYPES = ("application/xhtml+xml", "text/html")
NCX_TYPE = "application/x-dtbncx+xml"
CONTAINER = "META-INF/container.xml"


def resolve(base: str, href: str) -> tuple[str, str]:
    """(file, fragment) of a reference from within the folder ``base``; an empty path stays empty: the same file."""
    path, _, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(base, unquote(path))) if path else "", fragment


def book_name(path: str) -> str:
    return posixpath.basename(unquote(path)).removesuffix(".epub")


def _mounted(path: str) -> bool:
    """Whether a path is one of a folder that all machines mount, as Spark itself takes file paths."""
    return path.startswith(("/", "file:"))


def _local(path: str) -> str:
    return unquote(path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") else path


def _listed(files: Iterator[tuple[str, bytes | None]]) -> Iterator[tuple]:
    """INDEX of archives, by path or by content; of an archive given by its path only the list at its end is read."""
    for path, content in files:
        with zipfile.ZipFile(io.BytesIO(content) if content is not None else _local(path)) as z:
            for i, info in enumerate(z.infolist()):
                yield book_name(path), path, i, info.filename, info.compress_type == zipfile.ZIP_STORED, info.file_size


def _unpacked(archive: str | io.IOBase, places: set[int] | None = None, keep=lambda info: True) -> Iterator[tuple]:
    """(place, name, stored, data) of an archive's entries at these places; no other is read."""
    with zipfile.ZipFile(archive) as z:
        for i, info in enumerate(z.infolist()):
            if (places is None or i in places) and keep(info):
                yield i, info.filename, info.compress_type == zipfile.ZIP_STORED, z.read(info)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return files.select("path", (F.lit(None).cast("binary") if _mounted(path) else F.col("content")).alias("content"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """INDEX of every archive below a path that Spark can read."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_listed(zip(batch["path"], batch["content"], strict=True)), columns=[c.split()[0] for c in INDEX.split(", ")])

    return _files(spark, path).mapInPandas(listed, INDEX)


def read_entries(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """The entries of every archive below a path that Spark can read, in their order, or those that ``wanted`` lists (path, ord, as the index has them). An archive is unpacked in one task, some entries at a time."""
    files = _files(spark, path)
    if wanted is None:
        asked = files.withColumn("places", F.lit(None).cast("array<int>"))
    else:
        asked = files.join(wanted.groupBy("path").agg(F.collect_set("ord").alias("places")), "path")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["book_id", "ord", "entry", "stored", "data"])
        for batch in batches:
            for where, content, places in batch[["path", "content", "places"]].itertuples(index=False, name=None):
                rows, held = [], 0
                for row in _unpacked(io.BytesIO(content) if content is not None else _local(where), set(places) if places is not None else None):
                    rows.append((book_name(where), *row))
                    held += len(row[-1])
                    if held > HANDED_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                yield frame(rows)

    return asked.mapInPandas(unpack, ENTRIES)


class EpubDataSource(DataSource):
    """spark.read.format("epub").load(folder), and df.write.format("epub").save(folder), for folders every executor mounts.

    With option("pushdown", "true"), and spark.sql.python.filterPushdown.enabled,
    conditions on book_id and entry reach the reader.
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    """A partition for each archive. Comparisons of book_id with a value leave archives out, those of entry what is read of them."""

    def __init__(self, path: str):
        self.path = _local(path)
        self.tests: list[tuple[str, str, object]] = []

    def _passes(self, column: str, value: str) -> bool:
        tests = {"is": lambda x: value == x, "in": lambda x: value in x, "starts": value.startswith, "ends": value.endswith, "holds": lambda x: x in value}
        return all(tests[kind](x) for name, kind, x in self.tests if name == column)

    def partitions(self) -> list[InputPartition]:
        names = [self.path] if self.path.endswith(".epub") else [os.path.join(self.path, x) for x in sorted(os.listdir(self.path)) if x.endswith(".epub")]
        return [InputPartition(x) for x in names if self._passes("book_id", book_name(x))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in _unpacked(partition.value, keep=lambda info: self._passes("entry", info.filename)):
            yield book_name(partition.value), *row


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "holds"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind is None or f.attribute not in (("book_id",), ("entry",)):
                yield f
            else:
                self.tests.append((f.attribute[0], kind, f.value))


class _Writer(DataSourceWriter):
    """Writes the books of each task entry by entry; rows of a book must come one after another, ``mimetype`` first (see write_books). Files appear under their names on commit."""

    def __init__(self, path: str):
        self.path = _local(path)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        done: dict[str, tuple[str, str]] = {}
        name, out = None, None
        try:
            for row in rows:
                if out is None or row.book_id != name:
                    if out is not None:
                        out.close()
                    name = row.book_id
                    if name in done:
                        raise ValueError(f"the entries of {name} don't come one after another")
                    temporary = os.path.join(self.path, f".{name}-{TaskContext.get().taskAttemptId()}.tmp")
                    done[name] = (temporary, os.path.join(self.path, f"{name}.epub"))
                    out = zipfile.ZipFile(temporary, "w")
                elif row.entry == "mimetype":
                    raise ValueError(f"mimetype isn't the first entry of {name}")
                _add(out, row.entry, row.stored, bytes(row.data))
            if out is not None:
                out.close()
        except BaseException:
            for temporary, _ in done.values():
                if os.path.exists(temporary):
                    os.remove(temporary)
            raise
        return _Written(list(done.values()))

    def commit(self, messages) -> None:
        for message in messages:
            for a, b in message.files if message else ():
                if not os.path.exists(a):
                    raise FileNotFoundError(f"{a} was written by an executor and isn't here: {self.path} must be mounted on all machines")
                os.replace(a, b)

    def abort(self, messages) -> None:
        for message in messages:
            for a, _ in message.files if message else ():
                os.remove(a)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _add(out: zipfile.ZipFile, name: str, stored: bool, data: bytes) -> None:
    out.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if stored or name == "mimetype" else zipfile.ZIP_DEFLATED)


def archive(entries: list[tuple[int, str, bool, bytes]]) -> bytes:
    """An archive of (place, name, stored, data): the ``mimetype`` entry first and stored, the others in their order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for _, name, stored, data in sorted(entries, key=lambda e: (e[1] != "mimetype", e[0])):
            _add(z, name, stored, data)
    return out.getvalue()


def packed_books(entries: DataFrame) -> DataFrame:
    """(book_id, data): each book's archive, made in one task. Entries of one book must fit there, as a book does."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        own = list(rows[["ord", "entry", "stored", "data"]].itertuples(index=False, name=None))
        return pd.DataFrame({"book_id": rows["book_id"].iloc[:1], "data": [archive(own)]})

    return entries.groupBy("book_id").applyInPandas(pack, "book_id string, data binary")


def write_books(entries: DataFrame, path: str) -> None:
    entries.sparkSession.dataSource.register(EpubDataSource)
    dealt = entries.repartition("book_id").sortWithinPartitions("book_id", F.col("entry") != "mimetype", "ord")
    dealt.write.format("epub").mode("append").save(path)


def overlaid(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """entries with the data of those that ``replaced`` (book_id, entry, data) has."""
    new = replaced.select("book_id", "entry", F.col("data").alias("_new"))
    return entries.join(new, ["book_id", "entry"], "left").select("book_id", "ord", "entry", "stored", F.coalesce("_new", "data").alias("data"))


def _attribute(node: Node, name: str) -> str | None:
    return node.attributes.get(name)


def _package_rows(name: str, opf: str, data: bytes) -> Iterator[tuple]:
    """What a package file lists: its items, the order of pages, titles, authors, and what names a cover."""
    base = posixpath.dirname(opf)
    place: dict[str, int] = {}
    for node in parse(data).root.walk():
        kind = {"item": "item", "itemref": "page", "meta": "meta"}.get(node.tag) or (node.tag if node.namespace == DC and node.tag in ("title", "creator", "language") else None)
        if kind is None:
            continue
        pos = place[kind] = place.get(kind, -1) + 1
        href = _attribute(node, "href")
        key = {"page": _attribute(node, "idref"), "meta": _attribute(node, "content") if _attribute(node, "name") == "cover" else None}.get(kind, _attribute(node, "id"))
        if kind == "meta" and key is None:
            continue
        yield name, opf, kind, pos, key, resolve(base, href)[0] if href is not None else None, _attribute(node, "media-type"), _attribute(node, "properties") or "", " ".join(node.text().split())


def roots(container: DataFrame) -> DataFrame:
    """(book_id, opf): the package file that each book's container names."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["book_id"], batch["data"], strict=True):
                root = next(n for n in parse(data).root.walk() if n.tag == "rootfile")
                rows.append((name, root.attributes["full-path"]))
            yield pd.DataFrame(rows, columns=["book_id", "opf"])

    return container.where(F.col("entry") == CONTAINER).select("book_id", "data").mapInPandas(named, "book_id string, opf string")


def package_rows(entries: DataFrame, opf: DataFrame) -> DataFrame:
    """PACKAGES of the package files among the entries, as ``opf`` (book_id, opf) names them."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for own in zip(batch["book_id"], batch["opf"], batch["data"], strict=True) for r in _package_rows(*own)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PACKAGES.split(", ")])

    found = entries.join(opf, (entries["book_id"] == opf["book_id"]) & (F.col("entry") == F.col("opf")), "left_semi")
    return found.select("book_id", F.col("entry").alias("opf"), "data").mapInPandas(listed, PACKAGES)


def packages(entries: DataFrame) -> DataFrame:
    """The package file of each book as rows: kind is item, page, title, creator, language or meta (a cover's id)."""
    return package_rows(entries, roots(entries))


def manifest(package: DataFrame) -> DataFrame:
    """(book_id, id, href, media_type, properties, pos): a book's items; of several with one id the last counts."""
    items = package.where("kind = 'item'")
    last = F.max_by(F.struct("href", "media_type", "properties", "pos"), "pos")
    return items.groupBy("book_id", "id").agg(last.alias("i")).select("book_id", "id", "i.href", "i.media_type", "i.properties", "i.pos")


def navigation(package: DataFrame) -> DataFrame:
    """(book_id, opf, nav, ncx): where each book's tables of contents are; of several the last."""
    items = package.where("kind = 'item'")
    is_nav = F.array_contains(F.split("properties", r"\s+"), "nav")
    found = items.groupBy("book_id").agg(F.max("opf").alias("opf"), F.max_by("href", F.when(is_nav, F.col("pos"))).alias("nav"), F.max_by("href", F.when(F.col("media_type") == NCX_TYPE, F.col("pos"))).alias("ncx"), F.max(is_nav).alias("_n"), F.max(F.col("media_type") == NCX_TYPE).alias("_x"))
    return found.select("book_id", "opf", F.when(F.col("_n"), F.col("nav")).alias("nav"), F.when(F.col("_x"), F.col("ncx")).alias("ncx"))


def spine(package: DataFrame) -> DataFrame:
    """(book_id, file_pos, file): the pages in reading order; unknown items, other media and the table of contents are left out."""
    pages = package.where("kind = 'page'").select("book_id", F.col("pos").alias("file_pos"), "id")
    known = pages.join(manifest(package).where(F.col("media_type").isin(*PAGE_TYPES)), ["book_id", "id"])
    return known.join(navigation(package), "book_id").where(~F.col("href").eqNullSafe(F.col("nav"))).select("book_id", "file_pos", F.col("href").alias("file"))


def covers(package: DataFrame) -> DataFrame:
    """(book_id, file): the first JPEG or PNG among the items marked as the cover, then the one a meta element names."""
    items = manifest(package).where(F.col("media_type").isin("image/jpeg", "image/png"))
    marked = items.where(F.array_contains(F.split("properties", r"\s+"), "cover-image")).select("book_id", F.lit(0).alias("by"), "pos", "href")
    named = package.where("kind = 'meta' AND pos = 0").select("book_id", "id").join(items, ["book_id", "id"]).select("book_id", F.lit(1).alias("by"), "pos", "href")
    return marked.unionByName(named).groupBy("book_id").agg(F.min_by("href", F.struct("by", "pos")).alias("file"))
