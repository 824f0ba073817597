import math

import numpy as np
import pytest

from quire.llm import topk


def brute(rows, every=100, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q, a in good.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good.items() if c != q and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 150)
    monkeypatch.setattr(topk, "SHARD_ROWS", 200)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(map(tuple, topk.embedding_top_k(table).collect())) == brute(rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]  # many ties
    rows += [(200, None), (300, [1.0, None, 1.0, 1.0]), (301, [float("nan")] * 4), (400, [float("inf")] * 4), (None, [1.0] * 4), (500, [1.0, 2.0]), (501, [3.0, 2.0]), (600, []), rows[7], rows[0]]
    table = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(map(tuple, topk.embedding_top_k(table).collect())) == brute(rows)
    assert topk.embedding_top_k(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 10, 2**24, 2**28])
def test_bounds_lose_nothing(size):
    rng = np.random.default_rng(size % 97)
    q, c = rng.integers(-size, size, (5, 37), endpoint=True), rng.integers(-size, size, (300, 37), endpoint=True)
    c[:40] = q[0] + rng.integers(-1, 2, (40, 37))  # scores that differ by less than doubles tell
    own = rng.random((5, 300)) < 0.1
    for i, (at, score) in enumerate(topk.branch_and_bound(q, c, own, 10)):
        exact = c.astype(object) @ q[i].astype(object)
        best = sorted(exact[~own[i]], reverse=True)[:10]
        assert sorted(score.tolist(), reverse=True)[:10] == best
        assert all(exact[a] == s for a, s in zip(at, score.tolist()))
        assert set(at) >= {j for j in range(300) if not own[i][j] and exact[j] > best[-1]}
        assert len(at) < 300 or size == 1


def test_a_score_beyond_64_bits_ends_the_job():
    q = np.full((1, 4), 2**40)
    with pytest.raises(OverflowError):
        list(topk.branch_and_bound(q, np.repeat(q, 3, 0), np.zeros((1, 3), bool), 2))


def test_a_component_beyond_64_bits_ends_the_job(spark):
    rows = [(0, [1 / 1024, 0.0]), (1, [1e30, 0.0]), (2, [5e29, 0.0])]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.embedding_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    rows = [(0, [1 / 1024, 0.0]), (1, [2.0**52, 0.0]), (2, [2.0**52 - 1, 0.0])]
    assert sorted(map(tuple, topk.embedding_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == brute(rows)
