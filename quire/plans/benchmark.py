"""Models side by side: each specification translates the same books in a store of its own, judges score blindly, and a report.

A specification is ``provider`` or ``provider:model``. What comes of it is kept
in tables below the work folder, so judging and the report are runs of their own.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import translation as tr
from quire.operators import trials
from quire.operators.common import written
from quire.operators.providers import check_ready, chosen_model, provider
from quire.operators.store import Store
from quire.plans import books

RUNS = "spec string, profile string, ok boolean, seconds double, words long, calls double, cost double, error string"
SCORES = "book_id string, spec string, judge string, criterion string, score double"
CRITERIA = {"fiction": ("accuracy", "fluency", "style", "consistency"), "nonfiction": ("accuracy", "fluency", "terminology", "consistency")}
Done = TypeVar("Done")


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], Done]], seconds: float | None = None) -> dict[str, Done | Exception]:
    """Runs each job in a thread and a scheduler pool of its own, and gives what it returned or the error that ended it.

    Its Spark jobs carry its tag; where it fails, or takes more than ``seconds``,
    these are cancelled and no others. Pools share the cluster evenly where
    spark.scheduler.mode is FAIR.
    """
    out: dict[str, Done | Exception] = {}
    tags = {name: "side-" + re.sub(r"\W+", "-", name) + f"-{i}" for i, name in enumerate(jobs)}

    def run(name: str) -> None:
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", tags[name])
        context.addJobTag(tags[name])
        try:
            out.setdefault(name, jobs[name]())
        except Exception as e:
            out.setdefault(name, e)
            context.cancelJobsWithTag(tags[name])

    threads = {name: InheritableThread(target=run, args=(name,), session=spark) for name in jobs}
    for thread in threads.values():
        thread.start()
    end = None if seconds is None else time.monotonic() + seconds
    for name, thread in threads.items():
        thread.join(None if end is None else max(0.0, end - time.monotonic()))
        if thread.is_alive():
            out.setdefault(name, TimeoutError(f"{name} took more than {seconds} seconds"))
            while thread.is_alive():  # it may be between two jobs
                spark.sparkContext.cancelJobsWithTag(tags[name])
                thread.join(1)
    return out


def own_store(spark: SparkSession, work: str, spec: str) -> Store:
    return Store(spark, f"{work}/benchmark-{''.join(c if c.isalnum() else '-' for c in spec)}")


def kept(spark: SparkSession, work: str) -> Store:
    """The store of runs and scores."""
    return Store(spark, f"{work}/benchmark")


def _translated(spark: SparkSession, path: str, work: str, profile: str, spec: str) -> tuple:
    """A row of RUNS: glossary, translation and labels of every book; what is there already costs nothing again."""
    name, _, model = spec.partition(":")
    store = own_store(spark, work, spec)
    books.prepare(spark, path, store, profile, name, model or None, known="keep")
    began = time.perf_counter()
    books.glossary(store)
    done = books.translate(store)
    took = time.perf_counter() - began
    words = store.read("segments", books.SEGMENTS).agg(F.sum("words")).first()[0]
    usage = {r.name: r.total for r in books.usage_log(store).groupBy("name").agg(F.sum("total").alias("total")).collect()}  # a row for each counter
    return spec, profile, done, took, words, usage.get("calls"), usage.get("cost_usd"), None


def benchmark(spark: SparkSession, path: str, work: str, profile: str, specs: list[str], seconds: float | None = None) -> DataFrame:
    """RUNS of these specifications, which are worked on at the same time; seconds are a specification's, for all its books. One that fails has its error and leaves the others whole."""
    found = side_by_side(spark, {spec: lambda spec=spec: _translated(spark, path, work, profile, spec) for spec in dict.fromkeys(specs)}, seconds)
    rows = [x if isinstance(x, tuple) else (spec, profile, False, None, None, None, None, f"{type(x).__name__}: {x}"[:2000]) for spec, x in found.items()]
    runs = spark.createDataFrame(rows, RUNS)
    kept(spark, work).replace_rows("runs", RUNS, runs, runs.select("spec", "profile"))
    return runs


def _texts(spark: SparkSession, work: str, specs: list[str]) -> DataFrame:
    """(book_id, source, translations): whole texts. These are books that fit in a prompt."""
    whole = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"]), "\n\n")
    first = own_store(spark, work, specs[0])
    source = first.read("segments", books.SEGMENTS).groupBy("book_id").agg(whole(F.struct("file_pos", "idx", T.plain_text("src").alias("text"))).alias("source"))
    out = None
    for spec in specs:
        done = tr.translated(own_store(spark, work, spec)).select("book_id", "chunk", F.posexplode("translation").alias("n", "markup"))
        own = done.groupBy("book_id").agg(whole(F.struct("chunk", "n", T.plain_text("markup").alias("text"))).alias("text")).withColumn("spec", F.lit(spec))
        out = own if out is None else out.unionByName(own)
    return source.join(out.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("spec", "text"))).alias("translations")), "book_id")


def judge(spark: SparkSession, work: str, profile: str, judges: list[str]) -> DataFrame:
    """SCORES of the translations that are whole, by each judge, who sees letters alone. They take the place of the judge's earlier ones."""
    specs = sorted(r.spec for r in kept(spark, work).read("runs", RUNS).where((F.col("profile") == profile) & F.col("ok")).select("spec").collect())
    if not specs:
        raise books.BookError(f"no specification has translated for {profile} yet")
    callers = {}
    for name in judges:
        own, _, model = name.partition(":")
        check_ready(own)
        callers[name] = (provider(own).call, chosen_model(own, model or None))
    asked = written(trials.judge(_texts(spark, work, specs), callers, list(CRITERIA[profile])), "judged")
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in CRITERIA[profile]])).alias("s")
    scores = asked.select("book_id", "spec", "judge", listed).select("book_id", "spec", "judge", "s.criterion", "s.score")
    kept(spark, work).replace_rows("scores", SCORES, scores, scores.select("spec", "judge").distinct())
    return scores


def report(spark: SparkSession, work: str, profile: str, subscriptions: tuple[str, ...] = ()) -> DataFrame:
    """(spec, provider, model, score, judges, ten_pages, book, seconds), best first: what was stored of a profile's runs."""
    store = kept(spark, work)
    runs = store.read("runs", RUNS).where((F.col("profile") == profile) & F.col("ok"))
    scores = store.read("scores", SCORES).groupBy("spec", "judge", "book_id").pivot("criterion", list(CRITERIA[profile])).agg(F.first("score"))
    return trials.results(runs, scores, list(CRITERIA[profile]), F.col("words"), subscriptions)


def line(row) -> str:
    """A row of the report as text."""
    price = "by subscription" if row.ten_pages is None else f"{row.ten_pages} for 10 pages, {row.book} for a book"
    return f"{row.spec}: {row.score:.1f} of 10 by {row.judges} judges, {price}, {row.seconds:.1f} s"

