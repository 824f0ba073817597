"""Every query of the library's own operators, against its SQL, over whole tables."""

import hashlib
import re

import numpy as np
import pytest

from quire.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import oracle_rows, rows_of, types_of

SAME = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    if name not in ORACLE_SQL:
        assert found.count() > 0
        return
    columns, rows = rows_of(found)
    expected_columns, expected = oracle_rows(ORACLE_SQL[name], sf_dir)
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert {c: SAME.get(t, t) for c, t in found.dtypes} == types_of(ORACLE_SQL[name], sf_dir)


def cut_at(text, limit, kinds=(r"(?<=[.!?…])\s", r"(?<=[;:,–])\s", r"\s")):
    """Pieces of a text with single spaces, by looking at every place where it may be cut."""
    if len(text) <= limit or not kinds:
        return [text]
    places = [m.start() for m in re.finditer(kinds[0], text)] + [len(text)]
    out, start = [], 0
    while start < len(text):
        fits = [p for p in places if p > start and p - start <= limit]
        end = max(fits) if fits else min(p for p in places if p > start)
        out += cut_at(text[start:end], limit, kinds[1:])
        start = end + 1
    return out


def test_split_long_pieces_matches_brute_force(spark, sf_dir):
    texts = {(r.file_pos, r.idx): r.text for r in QUERIES["segments_explode"](spark, sf_dir).collect()}
    found = {}
    for r in QUERIES["split_long_pieces"](spark, sf_dir).collect():
        found.setdefault((r.file_pos, r.idx), []).append((r.part, r.text, r.pause, r.piece_key))
    assert set(found) == set(texts)
    for at, own in found.items():
        expected = cut_at(" ".join(texts[at].split()), 350)
        pauses = [1.2] * len(expected) if at[1] == 0 else [0.25] * (len(expected) - 1) + [0.6]
        assert sorted(own) == [(i, t, p, hashlib.sha1(t.encode()).hexdigest()[:16]) for i, (t, p) in enumerate(zip(expected, pauses))]


def matching(a, b):
    """Letters in the longest common block, the first in a and then in b, and in what is left of it and right of it."""
    if not len(a) or not len(b):
        return 0
    best = (0, 0, 0)
    runs = np.zeros(len(b) + 1, int)
    for i, x in enumerate(a):
        runs[1:] = np.where(b == x, runs[:-1] + 1, 0)
        j = int(runs.argmax())
        if runs[j] > best[0]:
            best = (int(runs[j]), i + 1, j)
    size, i, j = best
    return size and size + matching(a[: i - size], b[: j - size]) + matching(a[i:], b[j:])


def test_similarity_best_matches_brute_force(spark, sf_dir):
    items = {r.item_id: " ".join(re.findall(r"[^\W\d_]+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if not re.search(r"\d", r.text)}
    letters = {k: np.array(list(t)) for k, t in items.items()}
    got = {r.item_id: r.score for r in QUERIES["similarity_best"](spark, sf_dir).collect()}
    pairs = sorted((len(items[k]) * len(items[k ^ 1]), k) for k in items if k ^ 1 in items)[:8]
    assert len(pairs) == 8
    for _, k in pairs:
        assert got[k] == round(2 * matching(letters[k], letters[k ^ 1]) / (len(items[k]) + len(items[k ^ 1])), 6)
