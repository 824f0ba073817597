"""Glossaries as files that a person edits, and as rows of names and terms.

What a model answers is asked for, not guaranteed, so a glossary is kept as JSON
of any shape; it is read as VARIANT, where what is absent or of another type is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quire.functions.answers import yaml_object, yaml_text
from quire.operators.common import mounted, put

# The lists of a glossary, and what names an item of each.
NAMES = {"characters": "name", "places": "name", "terms": "source"}


def write_files(glossaries: DataFrame, folder: str) -> None:
    """A file ``<book_id>.yaml`` for each row with a glossary, in a folder that all executors mount; older ones are replaced."""
    with mounted(folder) as place:

        def write(rows: Iterator[Row]) -> None:
            for r in rows:
                put(place(f"{r.book_id}.yaml"), r.text.encode())

        glossaries.where("glossary IS NOT NULL").select("book_id", yaml_text("glossary").alias("text")).foreachPartition(write)


def read_files(books: DataFrame, folder: str) -> DataFrame:
    """(book_id, glossary, error) of the books that have a file in a folder that all executors mount: JSON, or why it can't be read.

    To be written before use: files change.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book in batch["book_id"]:
                try:
                    with open(f"{folder}/{book}.yaml", "rb") as f:
                        rows.append((book, f.read().decode("utf-8-sig", "replace")))
                except FileNotFoundError:
                    continue
            yield pd.DataFrame(rows, columns=["book_id", "text"])

    texts = books.select("book_id").distinct().mapInPandas(read, "book_id string, text string")
    return texts.select("book_id", yaml_object("text").alias("y")).select("book_id", F.col("y.value").alias("glossary"), F.col("y.error").alias("error"))


def _items(whole: Column, kind: str, name: str) -> Column:
    items = F.coalesce(F.try_variant_get(whole, f"$.{kind}", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(items, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.try_variant_get(x, f"$.{name}", "string").alias("source"), x.alias("item")))


def terms(glossaries: DataFrame, column: str = "glossary") -> DataFrame:
    """A row for each item of a glossary's lists: the other columns, then kind, place (from 0 in its list), source, hu, keep_original, note, gender.

    Items that aren't objects have nulls; a glossary that is null, no JSON, has
    a key twice or has no such list has no rows. All in the JVM, without a
    shuffle. A further column of one of the new names is an error.
    """
    others = [c for c in glossaries.columns if c != column]
    clash = set(others) & {"kind", "place", "source", "hu", "keep_original", "note", "gender"}
    if clash:
        raise ValueError(f"columns clash: {', '.join(sorted(clash))}")
    whole = F.try_parse_json(column)
    lists = [_items(whole, kind, name) for kind, name in NAMES.items()]
    found = glossaries.select(*others, F.explode(F.concat(*lists)).alias("_t"))
    field = lambda name, kind: F.try_variant_get("_t.item", f"$.{name}", kind).alias(name)
    return found.select(*others, "_t.kind", "_t.place", "_t.source", field("hu", "string"), field("keep_original", "boolean"), field("note", "string"), field("gender", "string"))
