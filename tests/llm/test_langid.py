import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import langid


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()


def test_held_out_accuracy(result):
    docs, rows = result
    assert len(rows) == docs.count()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # calibrated: the mean score is near the accuracy
    assert abs(np.mean([r.score for r in out]) - np.mean([r.lang_pred == r.lang for r in out])) < 0.05


def test_edge_cases(spark):
    rows = [(i, ("el gato come pan " if i % 2 else "the cat eats bread ") * 5, "es" if i % 2 else "en", "z") for i in range(80)]
    rows += [(200, None, "en", "z"), (201, "", "es", "z"), (202, "1234 !!", "en", "z"), (203, "the cat", None, "z"), (None, "the cat", "xx", "z"), (5, rows[5][1], "es", "z"), (204, "the cat eats " * 100000, "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert by[203].lang_pred == "en" and by[None].lang_pred == "en" and by[204].lang_pred == "en" and by[5].lang_pred == "es"
    assert {r.lang_pred for r in got} <= {"en", "es", "und"}  # the row without a key isn't learned from
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, "lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_ngrams_stay_within_their_text():
    alone = [next(iter(langid.ngram_runs(pa.array([t])))).slots.tolist() for t in ("abc", "é1x")]
    run = next(iter(langid.ngram_runs(pa.array(["abc", None, "é1x"]))))
    assert run.slots[run.bounds[0] : run.bounds[1]].tolist() == alone[0]
    assert run.slots[run.bounds[2] : run.bounds[3]].tolist() == alone[1]
    assert run.letters.tolist() == [3, 0, 2]


def test_regularisation_leaves_sparse_weights():
    rng = np.random.default_rng(1)
    rows = [(np.array([k, 10 + int(rng.integers(50))]), np.array([1.0, 1.0]), k) for k in rng.integers(0, 2, 400).tolist()]
    dense, sparse = (langid.fit_ftrl(rows, 2, l1=v) for v in (0.0, 2.0))
    assert np.count_nonzero(sparse) < np.count_nonzero(dense)
    assert sparse[0, 0] > sparse[0, 1] and sparse[1, 1] > sparse[1, 0]


def test_temperature_softens_overconfident_scores():
    labels = np.array([0, 0, 0, 1])
    scores = np.array([[20.0, 0.0]] * 4)
    assert langid.fit_temperature(scores, labels) > 5


def test_a_text_counts_the_same_whatever_text_is_next():
    import numpy as np
    import pyarrow as pa

    alone = {t: next(langid.ngram_runs(pa.array([t]))).slots for t in ("abc", "", "é x")}
    for texts in (["abc", "é x", ""], ["", "abc", "abc", "é x"], ["é x", "zzz", "abc", "y"]):
        run = next(langid.ngram_runs(pa.array(texts)))
        for t, a, b in zip(texts, run.bounds, run.bounds[1:], strict=False):
            if t in alone:
                assert np.array_equal(run.slots[a:b], alone[t])


def grams(text):
    """Slots of a text's n-grams, one by one: letters in lower case, all else as space, three spaces beyond the end."""
    codes = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text]
    out = []
    for i in range(len(codes) + 3):
        h = 0
        for order in (1, 2, 3):
            code = codes[i + order - 1] if i + order - 1 < len(codes) else 32
            h = (h * 0x01000193 + code * 0x9E3779B1) % 2**32
            x = h ^ (order * 0x85EBCA6B % 2**32)
            x = (x ^ x >> 16) * 0x7FEB352D % 2**32
            out.append((x ^ x >> 15) % 65536)
    return out


def brute_identify(rows, place):
    """Predictions of a model learned feature by feature, weight by weight."""
    kept = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[1] is not None and r[2] is not None]
    classes = sorted({r[2] for r in kept})
    shares = [{s: own.count(s) / len(own) for s in own} for own in (grams(r[1]) for r in kept)]
    df = {}
    for own in shares:
        for s in own:
            df[s] = df.get(s, 0) + 1
    idf = lambda s: math.log((1 + len(kept)) / (1 + df.get(s, 0))) + 1
    fit, calibrate, seen = [], [], {}
    for k, c in enumerate(classes):
        order = sorted((r for r in zip(kept, shares, strict=True) if r[0][2] == c and any(x.isalpha() for x in r[0][1])), key=lambda r: place[r[0][0]])
        for i, (_, own) in enumerate(order):
            row = ({s: v * idf(s) * 100 for s, v in sorted(own.items())}, k)
            (calibrate if i % 4 == 3 else fit).append(row)
    z, n = {}, {}
    weight = lambda s, k: 0.0 if abs(z.get((s, k), 0)) <= 0.002 else (math.copysign(0.002, z[s, k]) - z[s, k]) / ((0.1 + math.sqrt(n[s, k])) / 0.5 + 1e-4)

    def softmax(score):
        e = [math.exp(x - max(score)) for x in score]
        return [x / sum(e) for x in e]

    for epoch in range(4):
        for i in np.random.default_rng(epoch).permutation(len(fit)):
            x, label = fit[i]
            w = {(s, k): weight(s, k) for s in x for k in range(len(classes))}
            p = softmax([sum(v * w[s, k] for s, v in x.items()) for k in range(len(classes))])
            for s, v in x.items():
                for k in range(len(classes)):
                    g, old = v * (p[k] - (k == label)), n.get((s, k), 0.0)
                    n[s, k] = old + g * g
                    z[s, k] = z.get((s, k), 0.0) + g - (math.sqrt(n[s, k]) - math.sqrt(old)) / 0.5 * w[s, k]
    scores = lambda x: [sum(v * weight(s, k) for s, v in x.items()) for k in range(len(classes))]
    told = [(scores(x), k) for x, k in calibrate]
    loss = lambda t: sum((max(s) - s[k]) / t + math.log(sum(math.exp((v - max(s)) / t) for v in s)) for s, k in told)
    best = min((math.exp(x / 200) for x in range(-600, 601)), key=loss) if told else 1.0
    out = {}
    for key, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            out[key] = ("und", 0.0)
            continue
        own = grams(text)
        p = softmax([v / best for v in scores({s: own.count(s) / len(own) * idf(s) * 100 for s in set(own)})])
        out[key] = (classes[p.index(max(p))], max(p))
    return out


def test_identify_matches_brute_force(spark):
    rng = random.Random(6)
    words = {"en": "the cat eats bread and house of green".split(), "es": "el gato come pan y casa de verde ñandú".split(), "de": "die Katze isst Brot und Häuser grün".split()}
    rows = []
    for i in range(70):
        lang = rng.choice(sorted(words))
        mixed = words[lang] + words[rng.choice(sorted(words))][:3]
        rows.append((i, " ".join(rng.choice(mixed) for _ in range(rng.randrange(2, 12))), lang if rng.random() < 0.9 else None))
    rows += [(100, None, "en"), (101, "12 !", "en"), (102, "", "es"), (103, "Ǆ İ", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    place = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))).collect()}
    expected = brute_identify(rows, place)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert max(abs(got[k][1] - expected[k][1]) for k in got) < 0.01


def test_the_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"word{i} " * (1 + i % 5), "ab"[i % 2]) for i in range(200)] + [(900, "rare", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 3 * 3 * 60 * 8)
    model = langid.learn(docs)
    assert model.classes == ["a", "b", "c"]


def test_every_language_is_learned_or_the_job_ends(spark, monkeypatch):
    names = [f"l{i:03}" for i in range(300)]
    rows = [(i * 10 + j, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}x", "und the", f"q{chr(97 + i // 26)}{chr(97 + i % 26)}"] * 3), name) for i, name in enumerate(names) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert model.classes == names
    found = langid.predict(docs, model, keep=["lang"]).collect()
    right = {n: [r.lang_pred == n for r in found if r.lang == n] for n in names}
    assert sum(map(all, right.values())) > 290
    monkeypatch.setattr(langid, "LANGUAGES", 299)
    with pytest.raises(ValueError, match="more than 299 languages"):
        langid.learn(docs)
