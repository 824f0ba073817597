"""Queries over documents whose lines hold no letters, against their SQL."""

import pytest

from quire.functions.markup import numbered, parse, segments
from quire.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import oracle_rows, rows_of

TEXTS = ["", "\n", "12 34", " ", "-- 7", "One two\n", "\nOne", "One\n\nTwo  three \n1.5\nfour", "_\n٣ 4\nª\n²", None, "A & b\n< c\n<>& d"]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, text, f"src{i % 2}") for i, text in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(folder / "rows"))
    (part,) = (folder / "rows").glob("*.parquet")
    (folder / "tables").mkdir()
    (folder / "tables/documents.parquet").write_bytes(part.read_bytes())
    return str(folder / "tables")


def test_lines_without_letters_are_no_segments(spark, odd_dir):
    found = rows_of(QUERIES["inline_markup"](spark, odd_dir))
    assert found == oracle_rows(ORACLE_SQL["inline_markup"], odd_dir) and len(found[1]) == 10


def test_lines_without_letters_are_written_back_as_they_are(spark, odd_dir):
    found = rows_of(QUERIES["write_back"](spark, odd_dir))
    assert found == oracle_rows(ORACLE_SQL["write_back"], odd_dir) and len(found[1]) == len(TEXTS) - 1


def test_text_inside_opaque_elements_makes_no_segment():
    own = parse(b"<html><body><p>1 <svg><text>no</text></svg></p><p><i>a</i><math><mi>x</mi></math></p><div><img/><object><p>in</p></object></div></body></html>")
    assert [numbered(n) for n in segments(own)] == ['<i n="1">a</i><math n="2"/>', "in"]
