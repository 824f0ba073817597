"""python -m quire COMMAND: the steps of quire.plans.books over a store."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quire.operators.providers import ModelError
from quire.operators.remote import register_settings
from quire.operators.store import Store
from quire.operators.voices import spoken_by, voice_loader
from quire.plans import benchmark, books
from quire.streaming.follow import wait_until_finished

COMMANDS = ("run", "prepare", "glossary", "translate", "build", "audio", "status", "benchmark", "judge", "report")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire", description="Translate books and prepare them for narration.")
    out.add_argument("--work", default=os.environ.get("QUIRE_WORK", "work"), help="the store: a folder that all executors share")
    out.add_argument("--providers", help="a JSON file of providers by name: see quire.operators.remote.register_settings")
    commands = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        if name in ("run", "prepare", "benchmark"):
            p.add_argument("path", help="archives, or folders of them")
            p.add_argument("--profile", choices=books.PROFILES, required=True)
        elif name in ("judge", "report"):
            p.add_argument("--profile", choices=books.PROFILES, required=True)
        else:
            p.add_argument("books", nargs="*", help="names of books; all if none")
        if name in ("run", "prepare"):
            p.add_argument("--references", action="store_true", help="also bibliographies and indexes")
            p.add_argument("--no-glossary", action="store_true")
            p.add_argument("--id", help="the name of the one book there")
            p.add_argument("--provider", required=name == "prepare", help="stored with the book; echo repeats the source and needs no model")
        if name == "prepare":
            p.add_argument("--force", action="store_true", help="prepare again what the store has, and lose what is stored of it")
        if name in ("run", "build"):
            p.add_argument("--target", required=True, help="a folder for the translated archives")
            p.add_argument("--partial", action="store_true", help="also with chunks that aren't translated")
        if name in ("run", "translate"):
            p.add_argument("--max-chunks", type=int)
        if name == "run":
            p.add_argument("--yes", action="store_true", help="don't wait for a look at the glossary")
            p.add_argument("--no-audio", action="store_true")
        if name in ("run", "audio"):
            p.add_argument("--voice", help="a registered voice, or module:name", required=name == "audio")
            p.add_argument("--skip", action="append", default=[], help="files whose names hold this aren't read aloud")
            p.add_argument("--audio-target", help="a folder for chapters and marks", required=name == "audio")
        if name == "audio":
            p.add_argument("--follow", action="store_true", help="keep up with a running translation until it is done")
            p.add_argument("--seconds", type=float, default=60)
        if name in ("glossary", "translate"):
            p.add_argument("--provider", help="instead of the books' own")
        if name in ("run", "prepare", "glossary", "translate"):
            p.add_argument("--model")
            p.add_argument("--glossaries", help="a mounted folder for glossaries as YAML files, which are read again before translating; in the store if not named")
        if name == "benchmark":
            p.add_argument("specs", nargs="+", help="provider or provider:model; they run at the same time")
            p.add_argument("--most-seconds", type=float, help="a specification that takes longer is ended")
        if name == "judge":
            p.add_argument("judges", nargs="+", help="provider or provider:model")
        if name == "report":
            p.add_argument("--subscription", action="append", default=[], help="a provider that isn't paid by use")
    return out


def _narrate(store: Store, a: argparse.Namespace, named: list[str] | None, follow: bool) -> None:
    speak = spoken_by(voice_loader(a.voice), a.voice)
    if follow:
        chunks = books._chunks(store, named).select("book_id", "chunk")
        query = books.narrate_stream(store, speak, f"{store.path}/_follow-{time.time_ns()}", seconds=a.seconds, skip=a.skip, books=named, target=a.audio_target)
        wait_until_finished(query, chunks, store, a.seconds)
    told = books.narrate(store, speak, skip=a.skip, books=named)
    print(*[f"{r.book_id} {r.chapter} {r.title}: {'complete' if r.complete else 'incomplete'}" for r in told.orderBy("book_id", "chapter").toLocalIterator()], sep="\n")
    books.write_audio(*books.audiobook(store, named, a.skip), a.audio_target)


def _work(a: argparse.Namespace) -> str:
    return a.work if "://" in a.work else f"file://{os.path.abspath(a.work)}"


def _glossaries(a: argparse.Namespace) -> str | None:
    """Where the glossaries lie as files: the folder named, else one in the store, if that is a mounted folder."""
    if a.glossaries:
        return os.path.abspath(a.glossaries)
    work = _work(a)
    return os.path.join(work.removeprefix("file://"), "glossaries") if work.startswith("file://") else None


def _write_glossaries(store: Store, a: argparse.Namespace, named: list[str] | None) -> None:
    if _glossaries(a):
        books.write_glossaries(store, _glossaries(a), named)
        print(f"glossaries to read and edit: {_glossaries(a)}")


def _prepare(spark: SparkSession, store: Store, a: argparse.Namespace) -> list[str]:
    """Prepares what the store lacks, or with --force all, and gives the names of all books of the path."""
    known = {"run": "keep", "prepare": "replace" if getattr(a, "force", False) else "refuse"}[a.command]
    entries = books.epub.read_index(spark, a.path).select("book_id").distinct()
    names = [a.id] if a.id else [r[0] for r in entries.toLocalIterator()]
    new = set(names) - {r[0] for r in books._of(books.state(store), names).select("book_id").toLocalIterator()}
    if new or known != "keep":
        if not a.provider:
            raise books.BookError(f"name a provider for {', '.join(sorted(new)[:5])}; echo repeats the source and needs no model")
        books.prepare(spark, a.path, store, a.profile, a.provider, a.model, a.references, known, a.id)
        folder = _glossaries(a)
        if known == "replace" and folder:  # what was edited belonged to what is gone
            for name in names:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(os.path.join(folder, f"{name}.yaml"))
        if not a.no_glossary:
            books.glossary(store, books=names)
            _write_glossaries(store, a, names)
            if a.command == "run" and not a.yes and sys.stdin.isatty():
                input(f"The glossaries are in {_glossaries(a)}, to be edited there. Enter goes on: ")
    return names


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("quire").config("spark.scheduler.mode", "FAIR").getOrCreate()
    if a.providers:
        with open(a.providers, encoding="utf-8") as f:
            register_settings(json.load(f))
    store = Store(spark, _work(a))
    named = getattr(a, "books", None) or None
    try:
        if a.command in ("run", "prepare"):
            named = _prepare(spark, store, a)
        if a.command == "glossary":
            books.glossary(store, a.provider, a.model, named)
            _write_glossaries(store, a, named)
        done = True
        if a.command in ("run", "translate"):
            if _glossaries(a) and os.path.isdir(_glossaries(a)):
                books.read_glossaries(store, _glossaries(a), named)
            done = books.translate(store, a.provider, a.model, named, a.max_chunks)
            print("all chunks are translated" if done else "chunks are left; the same command goes on")
        if a.command == "build" or a.command == "run" and (done or a.partial):
            books.build(store, a.target, named, a.partial)
        if a.command == "audio" or a.command == "run" and a.voice and a.audio_target and not a.no_audio:
            _narrate(store, a, named, getattr(a, "follow", False))
        if a.command == "status":
            for r in books.status(store, named).orderBy("book_id").toLocalIterator():
                print(f"{r.book_id}: {r.done} of {r.total} chunks{'' if r.first_missing is None else f', first missing {r.first_missing}'}, {'a' if r.glossary else 'no'} glossary, {r.usage or {}}")
        if a.command == "benchmark":
            for r in benchmark.benchmark(spark, a.path, _work(a), a.profile, a.specs, a.most_seconds).orderBy("spec").collect():
                print(json.dumps(r.asDict()))
        if a.command == "judge":
            for r in benchmark.judge(spark, _work(a), a.profile, a.judges).orderBy("spec", "judge", "criterion").toLocalIterator():
                print(json.dumps(r.asDict()))
        if a.command == "report":
            for r in benchmark.report(spark, _work(a), a.profile, tuple(a.subscription)).collect():
                print(benchmark.line(r))
    except (books.BookError, ModelError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
