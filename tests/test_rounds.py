"""How many chunks of a book a round of translating takes, and what each sees of the one before it."""

import re

from quire.operators import translation as tr
from quire.operators.providers import ModelError, Result
from quire.operators.store import Store

CHUNKS = "book_id string, chunk int, sources array<string>"


class Counting:
    """Numbers each segment from what the end of the chunk before says; fails at the named ones."""

    def __init__(self, *wrong):
        self.wrong = wrong

    def __call__(self, prompt, system, model):
        before, asked = prompt.split(tr.ASKED)
        if any(f">{x}<" in asked for x in self.wrong):
            raise ModelError("wrong")
        last = int(before.split()[-1].split(":")[1]) if before.strip() else 0
        own = re.findall(r'<seg id="(\d+)">(\w+)</seg>', asked)
        return Result("".join(f'<seg id="{i}">{text}:{last + n}</seg>' for n, (i, text) in enumerate(own, 1)))


def numbers(store):
    return {(r.book_id, r.chunk): [int(x.split(":")[1]) for x in r.translation] for r in tr.translated(store).collect()}


def expected(books):
    return {(b, c): [2 * c - 1, 2 * c] for b, n in books.items() for c in range(1, n + 1)}


def rows(spark, books):
    return spark.createDataFrame([(b, c, [f"{b}{c}x", f"{b}{c}y"]) for b, n in books.items() for c in range(n, 0, -1)], CHUNKS)


def test_rounds_grow_while_calls_are_fast(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/work")
    books = {"a": 40, "b": 9, "c": 1}
    assert tr.translate(rows(spark, books), store, Counting())
    assert numbers(store) == expected(books)
    assert len(store.version("translations").live) == 3  # 1, 8 and the others


def test_slow_rounds_take_one_chunk_a_book(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "ROUND_SECONDS", 0)
    store = Store(spark, f"file://{tmp_path}/work")
    assert tr.translate(rows(spark, {"a": 3, "b": 2}), store, Counting())
    assert numbers(store) == expected({"a": 3, "b": 2}) and len(store.version("translations").live) == 3


def test_a_book_stops_at_a_chunk_that_fails_and_goes_on_from_there(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/work")
    chunks = rows(spark, {"a": 7, "b": 6})
    assert not tr.translate(chunks, store, Counting("a4x"), max_chunks=5)
    assert numbers(store) == expected({"a": 3, "b": 5})
    failed = store.read("translations", tr.TRANSLATIONS).where("translation IS NULL").collect()
    assert [(r.book_id, r.chunk, r.error_kind) for r in failed] == [("a", 4, "error")]
    assert tr.translate(chunks, store, Counting())
    assert numbers(store) == expected({"a": 7, "b": 6})


def test_a_chunk_that_was_there_is_the_context_of_the_next(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/work")
    for text in ("a2y:100", "a2y:100"):  # stored twice
        store.append("translations", spark.createDataFrame([("a", 2, ["a2x:99", text], None, None, "ok")], tr.TRANSLATIONS))
    assert tr.translate(rows(spark, {"a": 4}), store, Counting())
    assert numbers(store) == {("a", 1): [1, 2], ("a", 2): [99, 100], ("a", 3): [101, 102], ("a", 4): [103, 104]}
    assert tr.translated(store).count() == 4
