import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import packing, tokens
from quire.llm.common import tables_written

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIB.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (0, "a short one", "x", 1),
        (1, None, "x", 2),
        (2, "", "x", 3),
        (3, "word " * 5000, None, 4),
        (4, "end <|endoftext|> inside", "x", 5),
        (5, "中文 text и кириллица", "x", 6),
        (6, "tie", "x", 7),
        (6, "tie", "x", 7),
        (None, "no key", "x", 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, length int")


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_every_common_character_gets_the_librarys_ids():
    common = [chr(c) for c in [*range(1, 0x300), *range(0x2000, 0x20C0)]]
    texts = [f"a {c}b{c} 1{c}{c} {c} {c}\n{c}'s" for c in common]
    column = pa.array(texts)
    assert not tokens.uncommon(column).any()
    assert list(tokens.Encoder(PATH).ids(column)) == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(docs):
    rows = packing.pack_exact_complement(docs).collect()
    expected = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        own = ids(text)
        for i, (start, n) in enumerate(packing.cut(len(own), 2048)):
            expected[doc_id, i, start, n, zlib.crc32(np.array(own[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert check_layout(rows, 2048) == -(-sum(r.length for r in rows) // 2048)


def test_matrices_hold_the_documents(docs, spark):
    rows = packing.packed_matrices(docs, capacity=64).collect()
    got = {}
    for r in rows:
        matrix = np.frombuffer(r.input_ids, "<u2")
        assert len(matrix) == 64 and r.n_tokens <= 64
        assert list(r.cu_seqlens)[0] == 0 and list(r.cu_seqlens)[:-1] == list(r.position_resets) and r.cu_seqlens[-1] == r.n_tokens
        assert not matrix[r.n_tokens :].any()
        for p, a, b in zip(r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert b - a == p.length
            got.setdefault((p.doc_id, p.start), []).append(matrix[a:b].tolist())
    for doc_id, text in docs.select("doc_id", "text").collect():
        parts = [got[k].pop() for k in sorted((k for k in got if k[0] == doc_id), key=lambda k: k[1])]
        assert sum(parts, []) == ids(text)


@pytest.mark.parametrize("n", [10, 3000])
@pytest.mark.parametrize("plan", [packing.plan_exact_complement, packing.plan_best_fit_decreasing])
def test_plans_place_everything_once(plan, n):
    rng = np.random.default_rng(n)
    counts = Counter(np.minimum(rng.lognormal(5, 1.2, n).astype(int) + 1, 2048).tolist())
    out = plan(dict(counts))
    placed, sequences = Counter(), {}
    for length, rank, count, sequence, offset in out.runs:
        placed[length] += count
        for i in range(count):
            sequences.setdefault(sequence + i, []).append((offset, length))
    assert placed == counts
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert len(sequences) == out.sequences <= least * 1.02 + 2


def test_best_fit_matches_a_plain_best_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    bins = []
    for x in lengths:
        fits = [i for i, left in enumerate(bins) if left >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(100 - x)
    assert packing.plan_best_fit_decreasing(dict(Counter(lengths)), 100).sequences == len(bins)


def test_capacity_tree_finds_the_least_capacity():
    tree = packing.CapacityTree(20)
    for x in (3, 8, 20):
        tree.add(x, 1)
    assert [tree.at_least(x) for x in (1, 3, 4, 9, 20)] == [3, 3, 8, 20, 20]
    tree.add(20, -1)
    assert tree.at_least(9) is None


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert packing.pack_exact_complement(none).count() == 0
    assert packing.packed_matrices(none).count() == 0
    assert json.loads(none.schema.json())["fields"]


def test_pieces_are_the_only_table_and_no_list_of_ids_is_gathered(docs, capsys):
    for pack in (packing.packed_matrices, packing.pack_exact_complement):
        first = tables_written()
        pack(docs).explain()
        plan = capsys.readouterr().out
        assert tables_written() == first + 1 and "HashAggregate" in plan
        assert "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_sequences_go_across_batches_and_hold_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "MATRIX_BYTES", 1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        rows = packing.packed_matrices(spark.createDataFrame([(f"k{i}", None if i % 2 else "") for i in range(300)], "k string, t string"), "t", "k", capacity=100).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.sequence_id for r in rows) == [0, 1, 2] and sorted(p.k for r in rows for p in r.pieces) == sorted(f"k{i}" for i in range(300))
    assert all(r.n_tokens == 100 and list(r.cu_seqlens) == list(range(101)) and list(r.position_resets) == list(range(100)) for r in rows)


def test_many_ranks_are_joined_without_a_hint(docs, monkeypatch, capsys):
    expected = packing.pack_exact_complement(docs)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    found = packing.pack_exact_complement(docs)
    for df, hinted in ((expected, True), (found, False)):
        df.explain(True)
        assert ("strategy=broadcast" in capsys.readouterr().out) == hinted
    rows = found.collect()
    assert len(rows) == expected.count() and check_layout(rows, 2048) == -(-sum(r.length for r in rows) // 2048)
