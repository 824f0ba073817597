"""Archives in and out, segments, writing back, labels."""

import io

import pytest

from quire.functions.markup import MarkupError, inline_nodes, numbered, parse, segments, spliced
from quire.operators import segments as S
from quire.sources import epub
from tests import books


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "a.epub").write_bytes(books.book())
    (folder / "sub").mkdir()
    (folder / "sub" / "b.epub").write_bytes(books.book())
    return epub.read_entries(spark, f"file://{folder}").cache()


def test_entries_packages_and_spine(spark, entries):
    assert {r.book_id for r in entries.select("book_id").collect()} == {"a", "b"}
    own = entries.where("book_id = 'a'").orderBy("ord").collect()
    assert [r.entry for r in own] == list(books.ENTRIES)
    assert [r.stored for r in own if r.entry.endswith("jpg")] == [True]
    package = epub.packages(entries).cache()
    assert [tuple(r)[1:] for r in epub.spine(package).where("book_id = 'a'").orderBy("file_pos").collect()] == [(1, "pkg/parts/a b.xhtml"), (3, "pkg/parts/tide.xhtml"), (5, "pkg/parts/remarks.xhtml")]
    assert [tuple(r) for r in epub.navigation(package).orderBy("book_id").collect()] == [(b, "pkg/harbour.opf", "pkg/contents.xhtml", "pkg/old.ncx") for b in "ab"]
    assert [tuple(r) for r in epub.covers(package).orderBy("book_id").collect()] == [("a", "pkg/art/front.jpg"), ("b", "pkg/art/front.jpg")]
    assert sorted(r.text for r in package.where("kind = 'creator'").collect()) == ["Ada Lind"] * 2 + ["Bo Ek"] * 2


def test_segments_of_pages(spark, entries):
    pages = S.book_pages(entries, epub.spine(epub.packages(entries))).where("book_id = 'a'")
    rows = {(r.file.split("/")[-1], r.idx): r for r in S.page_segments(pages).collect()}
    assert sorted(rows) == [("a b.xhtml", i) for i in range(4)] + [("remarks.xhtml", i) for i in range(3)] + [("tide.xhtml", i) for i in range(4)]
    first = rows["a b.xhtml", 0]
    assert (first.tag, first.src, first.heading, first.words) == ("h2", 'The <strong n="1">Harbour</strong> at night', True, 4)
    assert rows["a b.xhtml", 1].src == 'Lamps — seven of them &lt; eight<a n="1">[<sup n="2">7</sup>]</a>.'
    assert (rows["a b.xhtml", 2].src, rows["a b.xhtml", 3].tag) == ('See <svg n="1"/> the<br n="2"/>map <i n="3"/>now.', "td")
    assert [(x.file, x.id) for x in rows["a b.xhtml", 3].refs] == [("pkg/parts/remarks.xhtml", "r2"), ("pkg/parts/remarks.xhtml", "zz")]
    assert [rows["remarks.xhtml", i].note.id for i in range(3)] == ["r1", "r1", "r2"]
    everything = S.page_segments(pages, references=True).where("file LIKE '%tide%'").collect()
    assert sorted((r.idx, r.reference) for r in everything) == [(0, False), (1, False), (2, False), (3, False), (4, True)]


def test_identity_translation_leaves_text_as_it_was(spark, entries):
    pages = S.book_pages(entries, epub.spine(epub.packages(entries)))
    found = S.page_segments(pages, references=True).selectExpr("book_id", "file", "idx", "src AS markup")
    out = {(r.book_id, r.entry): bytes(r.data).decode() for r in S.written_back(pages, found, "hu").collect()}
    assert len(out) == 6
    for name, source in (("a b", books.PART), ("tide", books.TIDE), ("remarks", books.REMARKS)):
        expected = source.replace("&mdash;", "—").replace("<!-- aside -->", "").replace("<?pi x?>", "").replace('lang="en"', 'lang="hu"').replace('lang="la"', 'lang="hu"').replace('lang="hu"><head>', 'lang="hu" xml:lang="hu"><head>')
        assert out["a", f"pkg/parts/{name}.xhtml"] == expected


def test_translations_move_tags_and_keep_attributes():
    document = parse(books.PART.encode())
    nodes = segments(document)
    assert spliced(document, nodes[0], '<strong n="1">Kikötő</strong> &amp; éj') == '<strong class="c">Kikötő</strong> &amp; éj'.encode()
    assert spliced(document, nodes[2], '<i n="3">most</i><br n="2"/>itt <svg n="1"/>') == """<i title='"'>most</i><br/>itt <svg xmlns="http://www.w3.org/2000/svg"><text>no</text></svg>""".encode()
    assert [n.tag for n in inline_nodes(nodes[2])] == ["svg", "br", "i"]


def test_labels(spark, entries):
    navigation = epub.navigation(epub.packages(entries))
    files = S.label_files(entries, navigation)
    rows = S.labels(files).where("book_id = 'a'").orderBy("source", "pos").collect()
    assert [(r.source, r.label, r.href, r.toc, r.skip) for r in rows] == [
        (0, "The Harbour", None, False, False), (1, "The Harbour", "pkg/parts/a b.xhtml", True, False), (1, "Tide", "pkg/parts/tide.xhtml", True, False),
        (1, "List", "pkg/contents.xhtml", False, True), (2, "Tide", None, False, False), (2, "The Harbour", None, False, False),
    ]
    texts = spark.createDataFrame([("a", "The Harbour", "A <kikötő>"), ("a", "Tide", ""), ("a", "List", "Lista")], "book_id string, label string, translation string")
    out = {r.entry: bytes(r.data).decode() for r in S.relabelled(files, texts).where("book_id = 'a'").collect()}
    assert "<dc:title>A &lt;kikötő></dc:title>" in out["pkg/harbour.opf"] and "<dc:language>hu</dc:language>" in out["pkg/harbour.opf"]
    assert ">Lista</a>" in out["pkg/contents.xhtml"] and ">Tide</a>" in out["pkg/contents.xhtml"] and 'xml:lang="hu"' in out["pkg/contents.xhtml"]


def test_writing_and_reading_the_data_source(spark, entries, tmp_path):
    new = spark.createDataFrame([("a", "pkg/look.css", bytearray(b"p {color: red}"))], "book_id string, entry string, data binary")
    epub.write_books(epub.overlaid(entries, new), str(tmp_path))
    got = books.unpacked((tmp_path / "a.epub").read_bytes())
    assert list(got) == ["mimetype", *[n for n in books.ENTRIES if n != "mimetype"]]
    assert got["pkg/look.css"] == b"p {color: red}"
    again = spark.read.format("epub").load(str(tmp_path))
    assert again.count() == 20
    packed = {r.book_id: bytes(r.data) for r in epub.packed_books(entries).collect()}
    assert books.unpacked(packed["b"])["pkg/parts/tide.xhtml"] == books.TIDE.encode()


def test_documents_are_parsed_without_expansion_or_loading():
    bomb = '<!DOCTYPE html [<!ENTITY a "x"><!ENTITY b SYSTEM "file:///etc/passwd">]><html><body><p>t &a;&b;</p></body></html>'
    assert numbered(segments(parse(bomb.encode()))[0]) == "t "
    deep = "<html><body><p>" + "<i>" * 300 + "x" + "</i>" * 300 + "</p></body></html>"
    assert numbered(segments(parse(deep.encode()))[0]).startswith('<i n="1"><i n="2">')
    with pytest.raises(MarkupError):
        parse(b"<p><b></p>")


def test_index_and_the_entries_it_is_asked_for(spark, tmp_path):
    data = bytearray(books.book({**books.ENTRIES, "pkg/art/large.jpg": bytes(300_000)}))
    (tmp_path / "x y.epub").write_bytes(data)
    index = epub.read_index(spark, f"file://{tmp_path}").cache()
    assert [(r.entry, r.size, r.book_id) for r in index.orderBy("ord").collect()][-1] == ("pkg/art/large.jpg", 300_000, "x y")
    asked = index.where("entry LIKE '%.css' OR entry = 'mimetype'").select("path", "ord")
    found = epub.read_entries(spark, f"file://{tmp_path}", asked)
    assert sorted((r.book_id, r.entry, bytes(r.data)) for r in found.collect()) == [("x y", "mimetype", b"application/epub+zip"), ("x y", "pkg/look.css", b"p {}")]

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    file = Counted(data)
    assert [r[1] for r in epub._unpacked(file, {0, 1})] == list(books.ENTRIES)[:2]
    assert file.read_bytes < 3000  # of 300,000


def test_labels_and_metadata_read_no_image(spark, tmp_path):
    from quire.operators.store import Store
    from quire.plans import books as B

    data = books.book({**books.ENTRIES, "pkg/art/other.jpg": b"\xff" * 5000})
    at = data.index(b"\xff" * 5000)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.epub").write_bytes(data[: at + 10] + b"broken" + data[at + 16 :])  # whoever reads it sees a wrong checksum
    store = Store(spark, f"file://{tmp_path}/work")
    B.prepare(spark, f"file://{tmp_path}/in", store, "fiction", "echo")
    assert B.labels(spark, store).count() == 6 and B.metadata(store).first().title == "The Harbour"
    with pytest.raises(Exception, match="Bad CRC"):
        epub.read_entries(spark, f"file://{tmp_path}/in").collect()


def test_filters_reach_the_data_source(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.epub").write_bytes(books.book())
    (tmp_path / "c.epub").write_bytes(b"no archive")
    spark.dataSource.register(epub.EpubDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = spark.read.format("epub").option("pushdown", "true").load(str(tmp_path))
        assert sorted(r.book_id for r in rows.where("book_id IN ('a', 'b') AND entry = 'mimetype'").collect()) == ["a", "b"]
        assert {r.entry for r in rows.where("book_id = 'a' AND entry LIKE 'pkg/parts/%' AND ord > 3").collect()} == {"pkg/parts/tide.xhtml", "pkg/parts/remarks.xhtml"}
        with pytest.raises(Exception, match="not a zip"):
            rows.where("entry LIKE '%.css'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_books_are_written_entry_by_entry(spark, tmp_path):
    rows = spark.createDataFrame([(b, i, n, True, bytearray(d)) for b in "ab" for i, (n, d) in enumerate([("one", b"1"), ("mimetype", b"m"), ("two", b"22")])], epub.ENTRIES)
    epub.write_books(rows, str(tmp_path / "out"))
    expected = epub.archive([(0, "one", True, b"1"), (1, "mimetype", True, b"m"), (2, "two", True, b"22")])
    assert (tmp_path / "out" / "a.epub").read_bytes() == (tmp_path / "out" / "b.epub").read_bytes() == expected
    with pytest.raises(Exception, match="one after another"):
        rows.coalesce(1).sortWithinPartitions("ord").write.format("epub").mode("append").save(str(tmp_path / "wrong"))
    assert not list((tmp_path / "wrong").iterdir())
