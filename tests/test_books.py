"""Whole books through all steps, with providers and a voice that need no model."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.operators.narration import wav
from quire.operators.providers import Result, echo, register
from quire.operators.store import Store
from quire.plans import books as B
from tests import books


def speak(pieces):
    """A voice of silence that hears what it said, but for the text of the heading."""
    sound = bytearray(wav(B.narration.silence(0.01)))
    score = F.when(F.col("text").startswith("HU Tide"), 0.5).otherwise(1.0)
    return pieces.select("piece_key", "text", F.col("text").alias("heard"), score.alias("score"), F.lit(sound).alias("data"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("whole")
    (out / "in").mkdir()
    (out / "in" / "a.epub").write_bytes(books.book())
    return out


def test_steps(spark, folder):
    store = Store(spark, f"file://{folder}/work")
    path = f"file://{folder}/in"
    with pytest.raises(B.BookError):
        B.prepare(spark, path, store, "poetry", "echo")
    B.prepare(spark, path, store, "fiction", "echo")
    with pytest.raises(B.BookError, match="already"):
        B.prepare(spark, path, store, "fiction", "echo")
    with pytest.raises(B.BookError, match="1 chunks aren't translated"):
        B.build(store, f"{folder}/out")
    B.glossary(store)
    assert B.translate(store, call=B.provider("echo").call)
    B.build(store, f"{folder}/out")
    got = books.unpacked((folder / "out" / "a.epub").read_bytes())
    assert next(iter(got)) == "mimetype" and set(got) == set(books.ENTRIES)
    assert 'HU The <strong class="c">Harbour</strong> at night' in got["pkg/parts/a b.xhtml"].decode()
    assert "<p>Listed matter" in got["pkg/parts/tide.xhtml"].decode()

    chapters = {r.chapter: (r.complete, r.title) for r in B.narrate(store, speak).collect()}
    assert chapters == {1: (True, "HU The Harbour at night"), 2: (True, "HU Tide")}
    assert [r.text for r in B.report(store).collect()] == ["HU Tide"]
    count = store.read("pieces", B.PIECES).count()
    B.narrate(store, speak).collect()
    assert store.read("pieces", B.PIECES).count() == count
    B.narrate_stream(store, speak, f"{folder}/check", once=True).awaitTermination()
    assert store.read("pieces", B.PIECES).count() == count
    about = B.metadata(store).first()
    assert (about.title, about.artists, about.cover, bytes(about.image)) == ("The Harbour", "Ada Lind, Bo Ek", "pkg/art/front.jpg", b"\xff\xd8")
    assert about.toc == {"pkg/parts/a b.xhtml": "The Harbour", "pkg/parts/tide.xhtml": "Tide"}
    sound, marks = B.audiobook(store)
    made = sound.orderBy("chapter").collect()
    assert [(r.chapter, r.title) for r in made] == [(1, "The Harbour"), (2, "Tide")] and made[1].start_ms == made[0].end_ms
    assert "title=The Harbour\n" in marks.first().metadata
    row = B.status(store).first()
    assert (row.book_id, row.done, row.total, row.glossary) == ("a", 1, 1, True)
    assert {r.step: r.total for r in B.usage_log(store).where("name = 'calls'").collect()} == {"translate": 1.0, "glossary": 1.0, "merge": 1.0, "labels": 1.0} and row.usage["calls"] == 4.0
    before = {r.chapter: r.data for r in store.read("chapters", B.CHAPTERS).collect()}
    files = sorted(str(f) for f in (folder / "work" / "chapters").rglob("*.parquet"))
    B.audiobook(store)
    assert sorted(str(f) for f in (folder / "work" / "chapters").rglob("*.parquet")) == files  # nothing changed: no chapter is made anew
    store.append("spoken", spark.createDataFrame([("HU falls", "HU drops", None, None)], B.SPOKEN))
    store.append("pieces", speak(spark.createDataFrame([("HU Tide",)], "text string").withColumn("piece_key", F.lit("other"))))
    B.narrate(store, speak).collect()
    B.audiobook(store)
    after = {r.chapter: r.data for r in store.read("chapters", B.CHAPTERS).collect()}
    assert set(after) == set(before) and after[1] == before[1]
    sound, marks = B.audiobook(store)
    B.write_audio(sound, marks, f"{folder}/audio")
    assert sorted(f.name for f in (folder / "audio" / "a").iterdir()) == ["0001-The_Harbour.wav", "0002-Tide.wav", "metadata.txt"]


class Named:
    """A provider that says who it is and what it was asked with."""

    def __init__(self, name):
        self.name = name

    def __call__(self, prompt, system, model):
        found = echo(prompt, system, model)
        kind = "fiction" if system == B.SYSTEMS["fiction"] else "nonfiction" if system == B.SYSTEMS["nonfiction"] else "other"
        return Result(found.text.replace("HU ", f"{self.name}/{model}/{kind} "), found.usage)


def test_each_book_is_worked_on_by_its_own_provider_and_model(spark, folder):
    register("one", Named("one"))
    register("two", Named("two"), needs_model=True)
    store = Store(spark, f"file://{folder}/settings")
    (folder / "more").mkdir()
    (folder / "more" / "x.epub").write_bytes(books.book())
    B.prepare(spark, f"file://{folder}/in", store, "fiction", "one", book_id="first")
    B.prepare(spark, f"file://{folder}/more", store, "nonfiction", "two", "m2")
    with pytest.raises(B.BookError, match="one book alone"):
        B.prepare(spark, f"file://{folder}", store, "fiction", "one", book_id="z")
    B.glossary(store, books=["first"])
    assert [r.book_id for r in store.read("glossary", B.GLOSSARY).collect()] == ["first"]
    B.glossary(store, books=["x"])
    assert sorted(r.book_id for r in store.read("glossary", B.GLOSSARY).collect()) == ["first", "x"]
    assert B.translate(store)
    got = {r.book_id: r.translation[0] for r in B.tr.translated(store).collect()}
    assert got == {"first": 'one/None/fiction The <strong n="1">Harbour</strong> at night', "x": 'two/m2/nonfiction The <strong n="1">Harbour</strong> at night'}
    assert {r.book_id for r in store.read("labels", B.LABELS).collect()} == {"first", "x"}
    B.build(store, f"{folder}/both")
    assert {f.name for f in (folder / "both").iterdir()} == {"first.epub", "x.epub"}
    B.prepare(spark, f"file://{folder}/in", store, "nonfiction", "one", known="replace", book_id="first")
    assert {r.book_id: r.profile for r in B.state(store).collect()} == {"first": "nonfiction", "x": "nonfiction"}
    assert {r.book_id for r in B.tr.translated(store).collect()} == {"x"}


def test_commands(spark, folder, capsys):
    work = ["--work", f"{folder}/other"]
    run = [*work, "run", f"file://{folder}/in", "--profile", "nonfiction", "--target", f"{folder}/second"]
    assert main(run) == 1 and "name a provider" in capsys.readouterr().err
    assert main([*run, "--provider", "echo", "--max-chunks", "0"]) == 0 and "chunks are left" in capsys.readouterr().out
    assert not (folder / "second").exists()
    assert main(run) == 0 and "all chunks are translated" in capsys.readouterr().out  # goes on where it was
    assert (folder / "second" / "a.epub").exists()
    assert main(run) == 0
    assert main([*work, "status"]) == 0 and "a: 1 of 1 chunks" in capsys.readouterr().out
    assert main([*work, "prepare", f"file://{folder}/in", "--profile", "fiction", "--provider", "echo"]) == 1
    assert main([*work, "prepare", f"file://{folder}/in", "--profile", "fiction", "--provider", "echo", "--force", "--no-glossary"]) == 0
    assert main([*work, "translate", "--provider", "none"]) == 1
    assert main([*work, "translate"]) == 0
    assert main([*work, "audio", "--voice", "none", "--audio-target", f"{folder}/sound"]) == 1
    assert main([*work, "audio", "--voice", "silent", "--skip", "tide", "--follow", "--seconds", "0.5", "--audio-target", f"{folder}/sound"]) == 0
    assert sorted(f.name for f in (folder / "sound" / "a").iterdir()) == ["0001-The_Harbour.wav", "metadata.txt"]
    settings = folder / "providers.json"
    program = "import sys, re, json; print('log'); print(json.dumps({'answer': {'text': ' '.join(re.findall('(?s)<seg.*', sys.stdin.read())) or '{}'}, 'n': {'in': 3, 'cache': 4}}))"
    settings.write_text(json.dumps({"tool": {"command": [sys.executable, "-c", program], "answer": "answer.text", "usage": {"input_tokens": ["n.in", "n.cache"]}}, "web": {"url": "http://127.0.0.1:9/", "key": "NO_SUCH_KEY"}}))
    trial = ["--providers", str(settings), "--work", f"{folder}/trial"]
    capsys.readouterr()
    assert main([*trial, "benchmark", f"file://{folder}/in", "echo", "tool:x", "--profile", "fiction"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [(x["spec"], x["ok"]) for x in lines] == [("echo", True), ("tool:x", True)]
    judge = "import sys, json; asked = sys.stdin.read(); print(json.dumps({'answer': json.dumps({x: {'accuracy': 8, 'fluency': 6, 'style': 7, 'consistency': 7} for x in 'AB' if '# Version ' + x in asked})}))"
    settings.write_text(json.dumps({"referee": {"command": [sys.executable, "-c", judge], "answer": "answer"}}))
    capsys.readouterr()
    assert main([*trial, "judge", "referee", "--profile", "fiction"]) == 0
    assert main([*trial, "judge", "referee", "--profile", "nonfiction"]) == 1  # nothing was translated for it
    assert main([*trial, "report", "--profile", "fiction", "--subscription", "tool"]) == 0
    told = [x for x in capsys.readouterr().out.splitlines() if "of 10" in x]
    assert [x.split(",")[0] for x in told] == ["echo: 7.0 of 10 by 1 judges", "tool:x: 7.0 of 10 by 1 judges"] and "by subscription" in told[1]
    settings.write_text(json.dumps({"web": {"url": "http://127.0.0.1:9/", "key": "NO_SUCH_KEY"}}))
    assert main([*trial, "prepare", f"file://{folder}/in", "--profile", "fiction", "--provider", "web", "--model", "m"]) == 1
