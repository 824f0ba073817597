import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import langid
from quire.llm.secrets import RULES
from quire.llm.tokens import library
from tests.llm import test_decontaminate, test_jaccard


def brute_redact(text):
    spans = []
    for rule in RULES:
        spans += [m.span() for m in rule.compiled().finditer(text or "") if m.end(rule.group) - m.start(rule.group) >= rule.least]
    covered = set()
    joins = []
    for a, b in sorted(spans):
        if joins and a < joins[-1][1]:
            joins[-1][1] = max(b, joins[-1][1])
        else:
            joins.append([a, b])
    for a, b in reversed(joins):
        text = text[:a] + "[secret]" + text[b:]
    assert not covered
    return text


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-1, None, "en", "x", 0), (-2, "", "en", "x", 0), (-3, "1234 !?", "en", "x", 7), (-4, 'token = "abcdef123456" and AKIA' + "A1" * 10 + " in plain words of the text", "en", "x", 71), (None, "the words of a text without a key", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf_dir).cache())
    before, first, second, third, fourth, last = ([r.asDict() for r in s.collect()] for s in steps)

    by_id = lambda rows: sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    told = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert by_id(first) == by_id([r for r in before if told[r["doc_id"]].lang_pred != "und" and told[r["doc_id"]].score >= 0.5])
    component = {k: c for k, _, c in test_jaccard.brute([(r["doc_id"], r["text"]) for r in first])}
    assert by_id(second) == by_id([r for r in first if r["doc_id"] is None or component[r["doc_id"]] == r["doc_id"]])
    hit = {k for k, *_, contaminated in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in second], items) if contaminated}
    assert hit and by_id(third) == by_id([r for r in second if r["doc_id"] not in hit])
    expected = []
    for r in third:
        text = brute_redact(r["text"])
        expected.append(r | {"text": text, "n_chars": len(text)})
    assert by_id(fourth) == by_id(expected) != by_id(third)

    encode = library(corpus_pipeline.packing.default_path()).encode
    pieces = {}
    for r in last:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == {r["doc_id"] for r in fourth}
    total = 0
    for r in fourth:
        ids = encode(r["text"], add_special_tokens=False).ids + [0]
        at = 0
        for start, length, crc in sorted(pieces[r["doc_id"]]):
            assert start == at and crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length]))
            at += length
        assert at == len(ids)
        total += at
    sequences = {}
    for r in last:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_run_writes_each_stage_and_returns_the_last(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(found.columns)
    assert re.search("best_fit_packing", found.inputFiles()[0])
    assert found.agg(F.count("*")).first()[0] > 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert stage[1](spark, docs, sf_dir).collect() == []


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_columns_of_any_name(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = "_lang _score _gone _key _text _k _h _t _label _v doc h k n own hits spans window items component_id lang_pred score held_out piece length kept `a.b`".split()
    wide = docs.selectExpr("*", *[f"'{i}' AS {n}" for i, n in enumerate(names)])
    got, plain = stage[1](spark, wide, sf_dir), stage[1](spark, docs, sf_dir)
    if stage is not corpus_pipeline.STAGES[-1]:
        assert got.columns == wide.columns and [t for _, t in got.dtypes] == [t for _, t in wide.dtypes]
        assert {tuple(r)[5:] for r in got.collect()} == {tuple(str(i) for i in range(len(names)))}
    own = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(tuple, got.select(*own).collect()), key=repr) == sorted(map(tuple, plain.select(*own).collect()), key=repr)
