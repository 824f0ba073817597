"""Ordered sequences, packing, validation, translation, narration and streaming, against plain Python and known values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import narration, packing, reports, segments, translation, validation
from quire.operators.ordered import previous, ranked, running, spread
from quire.operators.providers import ModelError, QuotaError, Result, check_ready, chosen_model, echo, provider, register
from quire.operators.store import Store
from quire.sources import epub
from tests import books


def test_sequences_match_plain_python(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(5)) for i in range(400)]
    df = spread(spark.createDataFrame(rows, "g string, i int, v int").repartition(7), ["g"], ["i"])
    df = running(ranked(df, ["g"], ["i"]), ["g"], ["i"], {"total": "v"})
    df = running(previous(df, ["g"], ["i"], {"last": "v"}), ["g"], ["i"], {"before": "v"}, before=True)
    got = {r.i: (r.rank, r.total, r.last, r.before) for r in df.collect()}
    for g in ("hot", "b", None):
        total, last = 0, None
        for n, (_, i, v) in enumerate([r for r in rows if r[0] == g], 1):
            assert got[i] == (n, total + v, last, total)
            total, last = total + v, v


def test_packing_known_values():
    ones = lambda n, x=1: np.full(n, x)
    assert np.bincount(packing.even_parts(ones(9), 4)).tolist() == [3, 3, 3]
    assert np.bincount(packing.even_parts(ones(5, 6), 10)).tolist() == [2, 2, 1]
    assert np.bincount(packing.even_parts(np.array([10, 9000]), 8000)).tolist() == [2]
    assert packing.full_slices(np.array([1, 2, 1, 1, 2, 1, 1, 1]), 4).tolist() == [0, 0, 0, 1, 1, 1, 2, 2]
    assert packing.packed_groups(np.array([3, 1]), 4).tolist() == [0, 0]
    assert packing.packed_groups(np.array([3, 2]), 4).tolist() == [0, 1]
    files, words = np.array([1, 1, 2, 3, 3, 3, 4]), np.array([2, 2, 3, 6, 6, 6, 1])
    assert packing.chunk_numbers(files, words, 8).tolist() == [1, 1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize(("cut", "numbers"), [(packing.FITTING, packing.packed_groups), (packing.REACHING, packing.full_slices)])
def test_spans_put_together_are_the_span_of_the_whole(cut, numbers):
    rng = np.random.default_rng(3)
    for _ in range(400):
        limit = int(rng.integers(1, 12))
        sizes = rng.choice([0, 0, 1, 2, 5, 14], int(rng.integers(1, 30)))
        more = rng.integers(0, 3, len(sizes))
        at = np.flatnonzero(rng.random(len(sizes) - 1) < 0.4) + 1
        spans = [packing.Span.of(s, m, limit, cut) for s, m in zip(np.split(sizes, at), np.split(more, at), strict=True)]
        whole = packing.Span.of(sizes, more, limit, cut)
        assert len(whole.reach) <= 2 * (limit + 2)
        left = right = None
        for span in spans:
            left = left.then(span, limit, cut) if left else span
        for span in spans[::-1]:
            right = span.then(right, limit, cut) if right else span
        for open_ in range(limit + 3):
            want = [int(x) for x in whole.passed(np.asarray(open_), limit, cut)]
            assert all([int(x) for x in s.passed(np.asarray(open_), limit, cut)] == want for s in (left, right))
        assert (left.total, left.more) == (right.total, right.more) == (sizes.sum(), more.sum())
        assert whole.passed(np.asarray(limit + 1), limit, cut)[1] == numbers(sizes, limit)[-1] + 1


@pytest.mark.parametrize(("limit", "fan"), [(1, 64), (7, 2), (40, 3), (100_000, 2)])
def test_hot_book_is_numbered_in_ranges(spark, monkeypatch, limit, fan):
    rng = random.Random(limit)
    rows = [(b, f, i, rng.choice([0, 1, 1, 2, 3, 9])) for b, n in (("hot", 60), ("b", 3), (None, 5)) for f in range(n) for i in range(rng.randrange(1, 9))]
    segs = spark.createDataFrame(rows, "book_id string, file_pos long, idx int, words int").repartition(5)
    ranges = []
    monkeypatch.setattr(packing, "FAN", fan)  # ranges of a book meet on several levels
    monkeypatch.setattr(packing, "spread", lambda *a: ranges.append(spread(*a)) or ranges[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    got = {(r.book_id, r.file_pos, r.idx): (r.chunk, r.slice) for r in packing.chunks(segs, limit).alias("c").join(packing.slices(segs, limit).alias("s"), [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("book_id", "file_pos", "idx")]).select("c.*", "slice").collect()}
    assert len(got) == len(rows)
    for b in ("hot", "b", None):
        own = [r for r in rows if r[0] == b]
        files, words = np.array([r[1] for r in own]), np.array([r[3] for r in own])
        want = zip(packing.chunk_numbers(files, words, limit).tolist(), (packing.full_slices(words, limit) + 1).tolist(), strict=True)
        assert [got[r[:3]] for r in own] == list(want)
    assert all(d.where("book_id = 'hot'").select("_part").distinct().count() > 1 for d in ranges) and len(ranges) == 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_skip_files_meets_labels(spark, tmp_path, monkeypatch):
    from quire.plans import queries

    rows = [(1, "s", "All rights reserved"), (2, "s", "read\nthis"), (3, "s", "a License"), (4, "t", "licence, RIGHTS RESERVED"), (13, "t", "gone")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, own = [], narration.skipped_files
    monkeypatch.setattr(narration, "skipped_files", lambda pages, labels: seen.append(labels) or own(pages, labels))
    assert [tuple(r) for r in queries.skip_files(spark, str(tmp_path)).collect()] == [("s", 2)]
    assert sorted(r.href for r in seen[0].where("skip").collect()) == ["s/1", "t/4"]


def test_slice_texts_and_chunk_ids(spark):
    rows = spark.createDataFrame([("b", 1, 0, "x", 1), ("b", 1, 1, "y", 2), ("b", 2, 0, "z", 1)], "book_id string, file_pos long, idx int, text string, words int")
    assert [tuple(r) for r in packing.slice_texts(rows, 3).orderBy("slice").collect()] == [("b", 1, "x\n\ny"), ("b", 2, "z")]
    assert [r[0] for r in spark.createDataFrame([(7,), (12345,)], "chunk int").select(packing.chunk_id()).collect()] == ["0007", "12345"]


def test_problems_are_told_together(spark):
    source = spark.createDataFrame([("t", "1", ["1 b"]), ("t", "2", []), ("ok", "1", [])], "k string, id string, signature array<string>")
    answer = spark.createDataFrame([("t", "1", ["1 i"]), ("t", "3", []), ("t", "3", []), ("ok", "1", [])], "k string, id string, signature array<string>")
    assert [tuple(r) for r in validation.problems(source, answer, ["k"]).collect()] == [("t", "missing: 2; extra: 3; repeated: 3\ntags of 1 differ: expected 1 b; got 1 i")]


class Scripted:
    """A provider that fails on marked segments: always, or on its first try."""

    def __init__(self):
        self.calls = []

    def __call__(self, prompt, system, model):
        self.calls.append(prompt)
        if "QUOTA" in prompt:
            raise QuotaError("quota")
        if "ONCE" in prompt and "couldn't be used" not in prompt:
            return Result("nothing", {"tokens": 1})
        if "PAIR" in prompt and prompt.count("<seg") > 1:
            raise ModelError("too long")
        return Result("<seg>" if "BAD" in prompt else echo(prompt, system, model).text, {"tokens": 1})


def test_chunks_are_retried_and_halved():
    call = Scripted()
    done, usage, error, kind = translation.translate_chunk(call, ["ONCE", "x <b n=\"1\">y</b>"], ["before"], "g", "s", None)
    assert (done, error, kind) == (["HU ONCE", 'HU x <b n="1">y</b>'], None, "ok")
    assert usage == {"calls": 2.0, "tokens": 2.0} and "before\n" in call.calls[0].split(translation.ASKED)[0]
    done, _, _, kind = translation.translate_chunk(call, ["PAIR a", "PAIR b", "PAIR c"], [], "", "s", None)
    assert (done, kind) == (["HU PAIR a", "HU PAIR b", "HU PAIR c"], "ok") and "HU PAIR b" in call.calls[-1].split(translation.ASKED)[0]
    assert translation.translate_chunk(call, ["fine", "BAD"], [], "", "s", None)[3] == "invalid"
    assert translation.translate_chunk(call, ["QUOTA"], [], "", "s", None)[2:] == ("quota", "quota")


def test_books_are_translated_resumably(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 1, ["one", "two"]), ("a", 2, ["three"]), ("b", 1, ["BAD"]), ("b", 2, ["never"]), ("c", 1, ["x"])], "book_id string, chunk int, sources array<string>")
    store = Store(spark, f"file://{tmp_path}/work")
    assert not translation.translate(chunks, store, Scripted(), max_chunks=1)
    assert {(r.book_id, r.chunk) for r in translation.translated(store).collect()} == {("a", 1), ("c", 1)}
    assert not translation.translate(chunks, store, Scripted())
    assert {(r.book_id, r.chunk): r.translation for r in translation.translated(store).collect()} == {("a", 1): ["HU one", "HU two"], ("a", 2): ["HU three"], ("c", 1): ["HU x"]}
    good = chunks.where("book_id <> 'b'")
    assert translation.translate(good, store, Scripted())
    totals = {(r.book_id, r.name): r.total for r in translation.usage_totals(store.read("translations", translation.TRANSLATIONS)).collect()}
    assert totals["a", "calls"] == 2.0 and totals["b", "calls"] == 4.0
    status = {r.book_id: (r.done, r.total, r.first_missing) for r in reports.status(chunks.join(translation.translated(store).select("book_id", "chunk", "translation"), ["book_id", "chunk"], "left")).collect()}
    assert status == {"a": (2, 2, None), "b": (0, 2, 1), "c": (1, 1, None)}


class Refusing:
    """A provider that has no more quota from some call on."""

    def __init__(self, folder, left):
        self.folder, self.left = folder, left

    def __call__(self, prompt, system, model):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if "QUOTA" in prompt:
            raise QuotaError("quota")
        return echo(prompt, system, model)


def test_a_quota_ends_the_run_of_its_provider(spark, tmp_path):
    rows = [("a", 1, ["QUOTA"], "p"), ("a", 2, ["x"], "p"), ("b", 1, ["y"], "p"), ("b", 2, ["never"], "p"), ("c", 1, ["z"], "q"), ("c", 2, ["w"], "q")]
    chunks = spark.createDataFrame(rows, "book_id string, chunk int, sources array<string>, provider string")
    store = Store(spark, f"file://{tmp_path}/work")
    (tmp_path / "calls").mkdir()
    call = Refusing(str(tmp_path / "calls"), 0)
    assert not translation.translate(chunks, store, {"p": call, "q": echo})
    assert {(r.book_id, r.chunk) for r in translation.translated(store).collect()} == {("b", 1), ("c", 1), ("c", 2)}
    assert len(list((tmp_path / "calls").iterdir())) == 2
    assert translation.translate(chunks, store, echo)
    assert len(store.version("translations").live) > 1
    translation.compact(store)
    assert translation.translated(store).count() == 6 and len(store.version("translations").live) == 1


def test_context_is_the_end_of_the_chunk_before(spark):
    chunks = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["y"])], "book_id string, chunk int, sources array<string>")
    done = spark.createDataFrame([("a", 1, [f"t{i}" for i in range(12)])], "book_id string, chunk int, translation array<string>")
    row = translation.next_chunks(chunks, done).first()
    assert (row.chunk, list(row.context)) == (2, [f"t{i}" for i in range(2, 12)])


def test_glossary_labels_and_spelling(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/g")
    rows = spark.createDataFrame([("b", 1, 0, "x", 3), ("b", 1, 1, "y", 1)], "book_id string, file_pos long, idx int, text string, words int")
    answers = lambda prompt, system, model: Result('text {"terms": ["%s"]} more' % prompt.split("\n")[1], {"t": 2})
    translation.glossary_parts(rows, store, answers, limit=3)
    translation.glossary_parts(rows, store, lambda *a: (_ for _ in ()).throw(AssertionError("asked again")), limit=3)
    assert [tuple(r) for r in store.read("glossary_parts", translation.PARTS).orderBy("slice").collect()] == [("b", 1, '{"terms": ["x"]}', {"calls": 1.0, "t": 2.0}), ("b", 2, '{"terms": ["y"]}', {"calls": 1.0, "t": 2.0})]
    merged = translation.merged_glossary(store, lambda prompt, system, model: Result('{"n": %d}' % prompt.count("terms"))).collect()
    assert [tuple(r) for r in merged] == [("b", '{"n": 2}', {"calls": 1.0})]
    labels = spark.createDataFrame([("a", 0, 0, "A"), ("a", 1, 0, "B"), ("a", 1, 1, "A"), ("b", 0, 0, "X")], "book_id string, source int, pos int, label string")
    call = lambda prompt, system, model: Result('["a", "b"]')
    got = translation.translated_labels(labels, call)
    assert sorted(map(tuple, got.where("label IS NOT NULL").select("book_id", "label", "translation").collect())) == [("a", "A", "a"), ("a", "B", "b")]
    assert sorted((r.book_id, r.total) for r in translation.usage_totals(got).collect()) == [("a", 1.0), ("b", 1.0)]
    texts = spark.createDataFrame([("1 a", 1), ("2 b", 2), ("none", 3), ("1 a", 4), ("3 known", 5)], "text string, seq long").coalesce(1)
    known = spark.createDataFrame([("3 known", "three")], "text string, spoken string")
    assert sorted(map(tuple, translation.spelled(texts, known, echo, size=60).select("text", "spoken").collect())) == [("1 a", "1 a"), ("2 b", "2 b")]
    wrong = translation.spelled(texts.withColumn("book_id", F.lit("x")), known, lambda *a: Result("no list", {"t": 5})).collect()
    assert [tuple(r) for r in wrong] == [(None, None, "x", {"calls": 1.0, "t": 5.0})]


def test_providers():
    register("strict", echo, needs_model=True, ready=lambda: "no key")
    assert chosen_model("echo", None) is None and chosen_model("strict", "m") == "m" and provider("strict").light_model is None
    for wrong in (lambda: provider("none"), lambda: chosen_model("strict", None), lambda: check_ready("strict")):
        with pytest.raises(ModelError):
            wrong()


def test_split_text_rejoins_and_stays_short():
    rng = random.Random(3)
    for _ in range(100):
        text = " ".join("x" * rng.randrange(1, 40) + rng.choice(["", "", "", ".", ",", "…", ";"]) for _ in range(rng.randrange(1, 200)))
        parts = narration.split_text(text, 120)
        assert " ".join(parts) == text and max(map(len, parts)) <= 120
    assert narration.split_text("y" * 400) == ["y" * 400]
    assert narration.split_text("a. " + "b " * 200 + "c. d.", 350)[0] == "a."


def test_a_book_is_narrated(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(books.book())
    entries = epub.read_entries(spark, f"file://{tmp_path}")
    package = epub.packages(entries)
    found = segments.page_segments(segments.book_pages(entries, epub.spine(package))).cache()
    texts = found.withColumn("text", narration.T.speech_text("src"))
    labels = segments.labels(segments.label_files(entries, epub.navigation(package)))
    skipped = narration.skipped_files(found.select("book_id", "file", "skip"), labels)
    assert [r.file for r in skipped.collect()] == ["pkg/contents.xhtml"]
    read = narration.chapters(narration.flow(texts, skipped, note_label="Note: ")).cache()
    rows = read.orderBy("file_pos", "idx", "sub").collect()
    assert [(r.chapter, r.text) for r in rows] == [
        (1, "The Harbour at night"), (1, "Lamps — seven of them < eight."), (1, "Note: First remark. Still first."), (1, "See the map now."), (1, "Old and lost."),
        (1, "Note: Second remark."), (1, "Note: First remark. Still first."), (2, "Tide"), (2, "ebb"), (2, "falls"), (2, "flow"),
    ]
    assert [tuple(r)[1:] for r in narration.chapter_titles(read).orderBy("chapter").collect()] == [(1, "pkg/parts/a b.xhtml", "The Harbour at night"), (2, "pkg/parts/tide.xhtml", "Tide")]
    none = spark.createDataFrame([], "text string, spoken string")
    stored = spark.createDataFrame([], "piece_key string")
    known = spark.createDataFrame([("Lamps — seven of them < eight.", "Seven lamps.")], "text string, spoken string")
    pieces = narration.narration(read, known, stored).cache()
    got = [(r.chapter, r.text, r.pause) for r in pieces.orderBy("chapter", "run", "part").collect()]
    assert got[1] == (1, "Seven lamps.", 0.6) and got[0][2] == 1.2 and got[-1] == (2, "ebb, falls, flow", 0.6)
    old = spark.createDataFrame([(narration.split_text(t)[0],) for t in ("ebb", "falls", "flow")], "text string").select(narration.T.piece_key("text").alias("piece_key"))
    again = narration.narration(read, none, old)
    assert [r.text for r in again.where("chapter = 2").orderBy("run", "sub_order", "part").collect()] == ["Tide", "ebb", "falls", "flow"]

    missing = narration.missing(pieces, stored, ["book_id", "chapter", "run", "part"])
    assert missing.count() == len({t for _, t, _ in got})
    chapters = narration.chapter_titles(read)
    keys = pieces.where("chapter = 1").select("piece_key").distinct()
    assert [tuple(r)[1:] for r in narration.complete_chapters(chapters, pieces, keys).orderBy("chapter").collect()] == [(1, True), (2, False)]
    audio = pieces.select("piece_key").distinct().collect()
    sound = spark.createDataFrame([(r[0], bytearray(narration.wav(np.full(240, 5)))) for r in audio], "piece_key string, data binary")
    made = {r.chapter: r for r in narration.chapter_audio(pieces, sound).collect()}
    expected = [np.full(240, 5), narration.silence(1.2), np.full(240, 5), narration.silence(0.6), narration.silence(2.0)]
    assert (narration.samples(bytes(made[2].data)) == np.concatenate(expected)).all()
    assert made[2].ms == 3820
    marks = narration.offsets(narration.chapter_audio(pieces, sound).select("book_id", "chapter", "ms"), ["book_id"], ["chapter"]).join(chapters, ["book_id", "chapter"])
    text = narration.chapter_metadata(marks.selectExpr("*", "'A=B' AS book_title", "'Some One' AS artists")).first().metadata
    assert text.startswith(";FFMETADATA1\ntitle=A\\=B\n") and f"START={made[1].ms}\nEND={made[1].ms + 3820}\ntitle=Tide\n" in text
    assert [len(r.keys_) for r in narration.manifests(pieces).withColumnRenamed("keys", "keys_").orderBy("chapter").collect()] == [len([g for g in got if g[0] == c]) for c in (1, 2)]


def test_audio_and_takes(spark):
    assert narration.pcm(np.array([2.0, -2.0, 0.5])).tolist() == [32767, -32767, 16383]
    assert len(narration.silence(0.6)) == 14400
    takes = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.9), ("p", 2, 0.9), ("q", 0, 0.2), ("q", 1, 0.2)], "key string, attempt int, score double")
    assert sorted(map(tuple, narration.best_takes(takes, ["key"]).collect())) == [("p", 1, 0.9), ("q", 0, 0.2)]
    assert sorted((r.key, r.attempt) for r in narration.accepted_attempts(takes, ["key"]).collect()) == [("p", 0), ("p", 1), ("q", 0), ("q", 1)]
    assert [r.key for r in narration.suspects(narration.best_takes(takes, ["key"])).collect()] == ["q"]


def test_reports(spark):
    scores = spark.createDataFrame([("m", 8, 9, None, 7), ("m", None, None, None, None), ("n", None, None, None, None)], "run string, a int, b int, c int, d int")
    assert sorted(map(tuple, reports.judged(scores, ["run"], ["a", "b", "c", "d"]).collect())) == [("m", 1, 6.0), ("n", 0, 0.0)]
    ok = spark.createDataFrame([("x", 0, ["a"]), ("y", 0, []), ("z", 1, ["a"]), ("w", 0, None)], "run string, code int, t array<string>")
    assert {r.run: r.ok for r in ok.groupBy("run").agg(reports.run_ok(F.col("code"), F.col("t")).alias("ok")).collect()} == {"x": True, "y": False, "z": False, "w": False}
