"""Comparing models: judges who see versions without names, and the table of results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.answers import first_json
from quire.functions.text import provider_spec
from quire.operators.providers import Provider
from quire.operators.reports import judged, prices


def blind_letters(specs: list[str], judge: str) -> dict[str, str]:
    """Letters for the models, in an order that only the judge's name decides: by a hash of both."""
    place = {spec: hashlib.sha256(f"{judge}\n{spec}".encode()).digest() for spec in specs}
    return {chr(ord("A") + i): spec for i, spec in enumerate(sorted(place, key=place.__getitem__))}


def blind_prompt(source: str, translations: dict[str, str], letters: dict[str, str]) -> str:
    """The source and each translation under its letter."""
    parts = ["# Source", source]
    for letter, spec in letters.items():
        parts += [f"# Version {letter}", translations[spec]]
    return "\n\n".join(parts)


def judged_by(judge: str, source: str, translations: dict[str, str], criteria: list[str], call: Provider, model: str | None = None) -> list[tuple[str, str, dict[str, float]]]:
    """(spec, judge, scores) of each translation: one call, which sees letters alone. An unreadable answer is asked for once more; a version that it leaves out has no scores."""
    letters = blind_letters(list(translations), judge)
    prompt = blind_prompt(source, translations, letters)
    system = f"Rate every version from 1 to 10 by {', '.join(criteria)}. Answer with one JSON object: letter, then criterion, then number."
    for attempt in (1, 2):
        try:
            found = first_json(call(prompt, system, model).text, "{")
            break
        except ValueError:
            if attempt == 2:
                raise
    given = {letter: found.get(letter) if isinstance(found.get(letter), dict) else {} for letter in letters}
    return [(spec, judge, {c: float(given[x][c]) for c in criteria if isinstance(given[x].get(c), int | float)}) for x, spec in letters.items()]


def judge(books: DataFrame, judges: dict[str, tuple[Provider, str | None]], criteria: list[str]) -> DataFrame:
    """(book_id, spec, judge and the criteria): each judge's scores of each book's translations. To be written before use.

    books: book_id, source and translations, a map from specifications to whole translations.
    """
    schema = "book_id string, spec string, judge string, " + ", ".join(f"`{c}` double" for c in criteria)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, source, translations, name in batch.itertuples(index=False, name=None):
                call, model = judges[name]
                rows += [(book, spec, who, *(scores.get(c) for c in criteria)) for spec, who, scores in judged_by(name, source, dict(translations), criteria, call, model)]
            yield pd.DataFrame(rows, columns=["book_id", "spec", "judge", *criteria]).astype({c: "float64" for c in criteria})

    asked = books.select("book_id", "source", "translations", F.explode(F.array(*map(F.lit, judges))).alias("judge"))
    return asked.mapInPandas(ask, schema)


def results(runs: DataFrame, scores: DataFrame, criteria: list[str], words: Column, subscriptions: tuple[str, ...] = ()) -> DataFrame:
    """(spec, provider, model, score, judges, ten_pages, book, seconds), best first. runs: spec, ok, seconds, cost; scores: spec, judge and the criteria.

    Providers paid by subscription have no price.
    """
    provider, model = provider_spec("spec")
    ten, book = prices(F.col("cost"), words)
    paid = ~provider.isin(*subscriptions) if subscriptions else F.lit(True)
    own = judged(runs.select("spec").join(scores, "spec", "left"), ["spec"], criteria)
    table = runs.join(own, "spec").select("spec", provider.alias("provider"), model.alias("model"), "score", "judges", F.when(paid, F.round(ten, 3)).alias("ten_pages"), F.when(paid, F.round(book, 2)).alias("book"), "seconds")
    return table.orderBy(F.desc("score"), "spec")
