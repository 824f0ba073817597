"""Chunks released in order by a stream's state, and chapters as their pieces come."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import translation as tr
from quire.operators.narration import wav
from quire.operators.store import Store
from quire.plans import books as B
from quire.streaming.follow import finished, follow, released
from tests import books

CHUNKS = "book_id string, chunk int"


def came(store, *rows):
    announced = [(b, "1", c) for b, c in rows]
    store.append("translations", store.spark.createDataFrame([(b, c, [f"t{c}"], None, None, "ok") for b, c in rows], tr.TRANSLATIONS))
    tr.announce(store, store.spark.createDataFrame(announced, tr.ARRIVALS).coalesce(1))


def test_any_order_of_arrival_gives_what_is_without_a_gap_once(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, f"file://{tmp_path}/s")
    rows = [("a", c) for c in range(1, 7)] + [("b", c) for c in range(1, 4)] + [("c", 2), (None, 1)]
    chunks = spark.createDataFrame([*rows, ("c", 1)], CHUNKS)
    rng.shuffle(rows)
    seen = []
    while rows:  # each time another run of the stream from the same checkpoint
        n = rng.randrange(2, 6)
        own, rows = rows[:n], rows[n:]
        came(store, *own)
        if rng.random() < 0.5:
            came(store, own[0])  # told twice
        last = len(seen)
        follow(spark, store, lambda df: seen.extend((r.book_id, r.chunk) for r in df.collect()), f"{tmp_path}/check", once=True).awaitTermination()
        done = tr.translated(store)
        expected = {(r.book_id, r.chunk) for r in released(chunks.where("book_id IS NOT NULL"), done).where("translation IS NOT NULL").collect()}
        assert {x for x in seen if x[0] is not None} == expected, (last, own)
    assert len(seen) == len(set(seen)) == 10 and (None, 1) in seen
    for book in "ab":
        assert [c for b, c in seen if b == book] == list(range(1, 7 if book == "a" else 4))
    assert not finished(chunks, store)
    came(store, ("c", 1))
    assert finished(chunks.where("book_id IS NOT NULL"), store)


def test_another_edition_begins_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    seen = []
    for edition, numbers in (("1", (1, 2)), ("2", (2,)), ("1", (3,)), ("2", (1,))):
        tr.announce(store, spark.createDataFrame([("a", edition, n) for n in numbers], tr.ARRIVALS))
        follow(spark, store, lambda df: seen.append(sorted((r.edition, r.chunk) for r in df.collect())), f"{tmp_path}/check", once=True).awaitTermination()
    assert [x for x in seen if x] == [[("1", 1), ("1", 2)], [("1", 3)], [("2", 1), ("2", 2)]]


def test_what_was_stored_but_not_announced_is_at_the_next_run(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    chunks = spark.createDataFrame([("a", i, [f"s{i}"]) for i in (1, 2)], "book_id string, chunk int, sources array<string>")

    class Killed(BaseException):
        pass

    def killed(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(tr, "announce", killed)
        with pytest.raises(Killed):
            tr.translate(chunks, store, B.provider("echo").call)
    assert tr.translated(store).count() == 1 and tr.arrivals(store).count() == 0
    assert tr.translate(chunks, store, B.provider("echo").call)
    assert sorted(r.chunk for r in tr.arrivals(store).collect()) == [1, 2]


def speak(pieces):
    sound = bytearray(wav(B.narration.silence(0.01)))
    return pieces.select("piece_key", "text", F.col("text").alias("heard"), F.lit(1.0).alias("score"), F.lit(sound).alias("data"))


def test_chapters_come_while_a_translation_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B.packing.chunks, "__defaults__", (4,))  # the book has several chunks
    store = Store(spark, f"file://{tmp_path}/work")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.epub").write_bytes(books.book())
        B.prepare(spark, f"file://{tmp_path}/{name}", store, "fiction", "echo")
    target = tmp_path / "sound"
    follow_once = lambda: B.narrate_stream(store, speak, f"{tmp_path}/check", once=True, target=str(target)).awaitTermination()
    files = lambda name: {f.name: os.stat(f).st_mtime_ns for f in (target / name).glob("*.wav")} if (target / name).exists() else {}
    B.translate(store, books=["a"], max_chunks=1)
    follow_once()
    first = files("a")
    assert [n[:4] for n in first] == ["0001"] and files("b") == {}
    while not B.translate(store, books=["a"], max_chunks=1):
        pass
    follow_once()
    whole = files("a")
    assert sorted(n[:4] for n in whole) == ["0001", "0002"] or len({n[:4] for n in whole}) == 2
    B.translate(store, books=["b"])
    before = len(store.version("chapters").live)
    follow_once()
    assert files("a") == whole and {n[:4] for n in files("b")} == {"0001", "0002"}  # the other book's files keep their times
    assert len(store.version("chapters").live) == before + 1
    follow_once()
    assert files("a") == whole
