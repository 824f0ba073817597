import hashlib
import re
from fractions import Fraction

import pytest

from quire.llm import mixing

DOCS = "doc_id long, text string, source string, size int, position string, target double"


def fair(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = set()
    while True:
        rest = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in stopped)
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        above = {s for s in rest if share[s] > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s] if s in stopped else share[s]) for s in names}
        stopped |= above


def check(rows, mix):
    """rows: (doc_id, text, source); mix: the operator's rows."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = fair(sizes)
    key = repr
    assert sorted(((r.doc_id, r.source, r.size) for r in mix), key=key) == sorted(((d, s, size(t)) for d, t, s in rows), key=key)
    taken = dict.fromkeys(sizes, 0)
    order = {}
    for r in mix:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert r.taken == sum(v.words for v in r.visits) <= 3 * r.size and all(0 < v.words <= r.size for v in r.visits)
        assert [v.epoch for v in r.visits] == list(range(len(r.visits))) and [v.position for v in r.visits] == sorted(v.position for v in r.visits)
        assert (r.position is None) == (not r.visits) and (not r.visits or r.position == r.visits[0].position)
        taken[r.source] += r.taken
        order.setdefault(r.source, []).extend((v.epoch, hashlib.md5(str(r.doc_id).encode() if r.doc_id is not None else b"").hexdigest(), v.position) for v in r.visits)
    for s in sizes:
        assert taken[s] == int(target[s] + 0.5), s  # the last document is cut
        assert sorted(p for *_, p in order.get(s, [])) == [p for *_, p in sorted(order.get(s, []))]  # by the order of the source
    places = [r.position for r in mix]
    assert places == sorted(places, key=lambda p: (p is None, p or 0))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mixing.mixed(docs)
    rows = mix.collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], rows)
    assert rows == mixing.mixed(docs.repartition(7)).collect()
    visits = mixing.training_order(mix).collect()
    assert sum(r.words for r in visits) == sum(r.taken for r in rows)
    assert [r.position for r in visits] == sorted(r.position for r in visits)


def test_edge_cases(spark, monkeypatch):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "q", None), (4, "w " * 30000, "big"), (5, "  a\x0bb", "big"), (6, " ", "empty"), (7, None, "empty"), (8, "one", ""), (8, "one two", "")]
    rows += [(100 + i, "k " * (i % 5), "many") for i in range(200)] + [(900 + i, "same text here", f"s{i % 9}") for i in range(60)]
    df = spark.createDataFrame([(*r, 9, "p", 1.0) for r in rows], DOCS)
    check(rows, mixing.mixed(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    check(rows, mixing.mixed(df).collect())
    assert mixing.mixed(df.limit(0)).count() == 0
    empty = mixing.mixed(df.where("source = 'empty'")).collect()
    assert [(r.target, r.taken, r.position) for r in empty] == [(0.0, 0, None)] * 2


def test_one_source_gives_all_of_itself_once(spark):
    rows = [(i, "a b " * i, "s") for i in range(50)]
    mix = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.taken == r.size == 2 * r.doc_id for r in mix)


@pytest.mark.parametrize("schedule", [((0, 1), (1, 1)), ((0, 0), (1, 2)), ((0, 3), (0.25, 0), (0.75, 0), (1, 1)), ((0, 2), (1, 0))])
def test_positions_invert_the_demand(spark, schedule):
    from pyspark.sql import functions as F

    rows = spark.range(1001).select((F.col("id") / 1000).alias("u")).select("u", mixing.time_of(F.col("u"), schedule).alias("t")).collect()

    def demand(t, n=20000):
        weight = lambda x: next(a[1] + (b[1] - a[1]) * (x - a[0]) / (b[0] - a[0]) for a, b in zip(schedule, schedule[1:]) if x <= b[0])
        return sum(weight((i + 0.5) * t / n) for i in range(n)) * t / n

    whole = demand(1)
    assert [r.t for r in rows] == sorted(r.t for r in rows) and rows[0].t == 0
    for r in rows[::100]:
        assert demand(r.t) / whole == pytest.approx(r.u, abs=1e-4)


def test_schedules_are_checked():
    for bad in (((0, 1),), ((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, 1), (0, 2), (1, 1)), ((0, -1), (1, 2))):
        with pytest.raises(ValueError):
            mixing.pieces_of(bad)
