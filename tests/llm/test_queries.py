"""The queries that SQL can't express, as queries over whole tables, against what they are to give."""

import hashlib
import zlib

import numpy as np
import pytest

from quire.llm import packing
from quire.llm.queries import QUERIES
from quire.llm.tokens import library
from tests.llm import test_secrets, test_token_counts


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    encode = library(packing.default_path()).encode
    return {k: [*encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}


def check_pieces(pieces, ids):
    """Each document in its pieces, whole and in order."""
    by = {}
    for doc, piece, start, length, crc in pieces:
        by.setdefault(doc, []).append((piece, start, length, crc))
    assert set(by) == set(ids)
    for doc, own in by.items():
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (n, at) and crc == zlib.crc32(np.array(ids[doc][at : at + length], "<u4").tobytes())
            assert length == 2048 or n == 0 or len(own) == 1
            at += length
        assert at == len(ids[doc])


def test_op2_token_matrices(spark, sf_dir, ids):
    found, pieces = QUERIES["op2_token_matrices"](spark, sf_dir).collect(), []
    for r in found:
        row = np.frombuffer(bytes(r.input_ids), "<u2")
        assert len(row) == 2048 and not row[r.n_tokens :].any() and r.cu_seqlens[-1] == r.n_tokens
        assert r.cu_seqlens[:-1] == r.position_resets and r.cu_seqlens[0] == 0
        for p, a, b in zip(r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert row[a:b].tolist() == ids[p.doc_id][p.start : p.start + p.length]
            pieces.append((p.doc_id, p.piece, p.start, p.length, p.ids_crc32))
    check_pieces(pieces, ids)
    assert len(found) <= -(-sum(map(len, ids.values())) // 2048) * 1.02 + 1


def test_op3_best_fit_packing(spark, sf_dir, ids):
    found = QUERIES["op3_best_fit_packing"](spark, sf_dir).collect()
    check_pieces([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], ids)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op7_secret_scan(spark, sf_dir, texts):
    found = QUERIES["op7_secret_scan"](spark, sf_dir).collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    for r in found:
        spans = test_secrets.brute(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.base_sha256, r.n_assign + r.n_access + r.n_hex) == (hashlib.sha256(base.encode()).hexdigest(), len(spans))
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_op8_token_counts(spark, sf_dir, texts):
    found = QUERIES["op8_token_counts"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r.doc_id] or ""
        n = test_token_counts.lib(text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
        assert r.limit_tokens <= 2048 and r.limit_tokens == test_token_counts.lib(text[: r.limit_chars])
        assert r.limit_chars == len(text) if n <= 2048 else test_token_counts.lib(text[: r.limit_chars + 1]) > 2048


def test_op10_language_id(spark, sf_dir, texts):
    found = QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in found} == set(texts) and len(found) == len(texts)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {*langs.values(), "und"} - {None}
    held = [r for r in found if r.held_out and langs[r.doc_id] is not None and any(map(str.isalpha, texts[r.doc_id] or ""))]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.9
