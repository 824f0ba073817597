"""Glossaries as files and as rows."""

import json

import pytest

from quire.__main__ import main
from quire.operators import glossaries as G
from quire.operators.store import Store
from quire.plans import books as B
from tests import books

WHOLE = {
    "style_notes": "dry: yes\n# no comment",
    "characters": [{"name": "Anna", "hu": "Anna", "gender": "female", "note": "2001-02-03"}, "Bo"],
    "places": [],
    "terms": [{"source": "ebb", "hu": "apály", "keep_original": True, "note": "x" * 150}, {"source": 7, "hu": None, "keep_original": "maybe"}],
    "address": [{"between": ["A", "B"], "form": "tegez"}],
}


def test_terms(spark):
    texts = [json.dumps(WHOLE), None, "", "no json", "[1]", '{"terms": 3}', '{"terms": [], "terms": [{}]}', '{"places": [null, {"name": "Ó"}]}']
    got = G.terms(spark.createDataFrame(list(enumerate(texts)), "n int, glossary string"))
    rows = sorted(tuple(r) for r in got.select("n", "kind", "place", "source", "hu", "keep_original", "gender").collect())
    assert rows == [
        (0, "characters", 0, "Anna", "Anna", None, "female"),
        (0, "characters", 1, None, None, None, None),
        (0, "terms", 0, "ebb", "apály", True, None),
        (0, "terms", 1, "7", None, None, None),
        (7, "places", 0, None, None, None, None),
        (7, "places", 1, "Ó", None, None, None),
    ]
    with pytest.raises(ValueError, match="clash"):
        G.terms(spark.createDataFrame([("a", "{}")], "hu string, glossary string"))
    assert G.terms(spark.createDataFrame([], "n int, glossary string")).count() == 0


def test_files_keep_what_is_in_them(spark, tmp_path):
    whole = json.dumps(WHOLE, ensure_ascii=False)
    rows = spark.createDataFrame([("a b", whole), ("Könyv+%20", "{}"), ("none", None)], "book_id string, glossary string")
    G.write_files(rows, f"{tmp_path}/g")
    assert sorted(f.name for f in (tmp_path / "g").iterdir()) == ["Könyv+%20.yaml", "a b.yaml"]
    text = (tmp_path / "g" / "a b.yaml").read_text(encoding="utf-8")
    assert text.index("style_notes") < text.index("characters") and "apály" in text
    got = {r.book_id: (r.glossary, r.error) for r in G.read_files(rows, f"{tmp_path}/g").collect()}
    assert got == {"a b": (whole, None), "Könyv+%20": ("{}", None)}


@pytest.mark.parametrize("text", ["- a\n- b", "a: [", "word", "? [1, 2]\n: x", "a: .nan", "a: &x\n  b: *x"])
def test_what_is_no_mapping_is_told(spark, tmp_path, text):
    (tmp_path / "a.yaml").write_text(text)
    (row,) = G.read_files(spark.createDataFrame([("a",), ("a",)], "book_id string"), str(tmp_path)).collect()
    assert row.glossary is None and row.error


def test_an_edited_glossary_rules_the_translation(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.epub").write_bytes(books.book())
    work = ["--work", f"{tmp_path}/work"]
    folder = tmp_path / "work" / "glossaries"
    assert main([*work, "prepare", f"file://{tmp_path}/in", "--profile", "fiction", "--provider", "echo"]) == 0
    assert str(folder) in capsys.readouterr().out and sorted(f.name for f in folder.iterdir()) == ["a.yaml", "b.yaml"]
    store = Store(spark, f"file://{tmp_path}/work")
    before = {r.book_id: r for r in store.read("glossary", B.GLOSSARY).collect()}
    (folder / "a.yaml").write_text("- no\n")
    assert main([*work, "translate"]) == 1 and "a.yaml: not a mapping" in capsys.readouterr().err
    assert {r.book_id: r for r in store.read("glossary", B.GLOSSARY).collect()} == before
    (folder / "a.yaml").write_text("terms:\n- source: ebb\n  hu: apály  # by hand\n", encoding="utf-8")
    assert main([*work, "translate"]) == 0
    after = {r.book_id: r for r in store.read("glossary", B.GLOSSARY).collect()}
    assert after["b"] == before["b"] and after["a"].usage == before["a"].usage
    assert after["a"].glossary == '{"terms": [{"source": "ebb", "hu": "apály"}]}'
    assert [(r.book_id, r.kind, r.source, r.hu) for r in B.glossary_terms(store).where("book_id = 'a'").collect()] == [("a", "terms", "ebb", "apály")]
    files = sorted(str(f) for f in (tmp_path / "work" / "glossary").rglob("*"))
    B.read_glossaries(store, str(folder))
    assert sorted(str(f) for f in (tmp_path / "work" / "glossary").rglob("*")) == files  # nothing new: nothing is written
    again = [*work, "prepare", f"file://{tmp_path}/in", "--profile", "fiction", "--provider", "echo", "--force", "--no-glossary"]
    assert main(again) == 0 and list(folder.iterdir()) == []
