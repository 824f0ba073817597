import math

import numpy as np
import pytest

from quire.llm import hard_negatives as hn


def brute(rows, every=50):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = ([math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (own, label) in good.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v)), c, other) for c, (v, other) in good.items() if c != a and len(v) == len(own))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(-t, n) for t, n, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, i + 1, n, -s, t) for i, (t, n) in enumerate(hard[:3])]
    return sorted(out)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_ROWS", 150)
    monkeypatch.setattr(hn, "SHARD_VALUES", 200 * 64)
    monkeypatch.setattr(hn, "BLOCK_VALUES", 3 * 64)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    found = sorted(map(tuple, hn.embedding_hard_negatives(table).collect()))
    assert found == brute(rows)
    assert len(found) > 50


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(400)]  # many ties
    rows += [(450, None, 1), (451, [1.0] * 5, None), (500, [1.0, None, 1.0, 1.0, 1.0], 1), (550, [float("nan")] * 5, 1), (None, [1.0] * 5, 1), (600, [1.0, 2.0], 1), (601, [3.0, 2.0], 1), (602, [2.0, 2.0], 2), (650, [], 1), rows[7], rows[50]]
    rows += [(700 + i, [1.0, 1.0, 0.0, 0.0, 0.0], 1) for i in range(30)]  # copies
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, rank int")
    assert sorted(map(tuple, hn.embedding_hard_negatives(table).collect())) == brute(rows)
    assert hn.embedding_hard_negatives(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 300, 2**20])
def test_intervals_lose_nothing(size):
    rng = np.random.default_rng(size % 89)
    vectors = rng.integers(-size, size, (400, 19), endpoint=True)
    vectors[:50] = vectors[0] + rng.integers(-1, 2, (50, 19))
    planes = hn.Planes(vectors)
    assert sum(len(p) for p in planes.planes) == planes.bits * 3
    for query in (vectors[0], vectors[1], -vectors[2], np.zeros(19, np.int64)):
        exact = vectors.astype(object) @ query.astype(object)
        top = int(max(exact))
        for ranges in ([(-(2**63), 2**63 - 1)], [(top // 2, top * 95 // 100), (top // 3, top // 2)], [(top + 1, top + 2)]):
            alive = np.flatnonzero(rng.random(400) < 0.9)
            at, score = hn.best_within(query, planes, alive, ranges, 3)
            assert all(exact[a] == s for a, s in zip(at, score.tolist()))
            for a, b in ranges:
                inside = sorted((s for s in exact[alive] if a <= s <= b), reverse=True)
                least = inside[min(3, len(inside)) - 1] if inside else None
                assert {i for i in alive if inside and least <= exact[i] <= b} <= set(at.tolist())


def test_most_candidates_are_dropped_before_the_last_plane():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 32, (3000, 64))).astype(np.int64)
    at, _ = hn.best_within(vectors[0], hn.Planes(vectors), np.arange(1, 3000), [(-(2**63), 2**63 - 1)], 5)
    assert len(at) < 20


def test_large_components_are_exact_or_end_the_job(spark):
    rows = [(0, [2.0**20, 1.0], 1), (1, [2.0**20, 2.0], 1), (2, [2.0**19, 2.0], 2), (3, [2.0**19, -3.0], 2)]
    table = lambda own: spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hn.embedding_hard_negatives(table(rows)).collect())) == brute(rows)
    for large in (2.0**30, 2.0**60):
        with pytest.raises(Exception, match="OverflowError|beyond 64 bits"):
            hn.embedding_hard_negatives(table([(0, [large], 1), (1, [large], 2), (8, [large], 2)])).collect()
