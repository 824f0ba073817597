import re
from collections import Counter, defaultdict

from quire.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, value int, rank string"


def brute(rows, least=3, best=200):
    """From texts alone, over every kept term of every pair."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: counts[lang, s] for x, s in groups if x == lang}

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q = p(sum(own.values(), Counter()))
        shares = {s: p(c) for s, c in own.items()}
        for s, a in shares.items():
            pairs = [(o, sum((a[t] - b[t]) ** 2 // b[t] for t in kept)) for o, b in shares.items() if o != s]
            terms = [(t, (a[t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and a[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, best)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def found(df, **more):
    return sorted(map(tuple, dv.source_divergence(df, **more).collect()))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(docs) == brute([(r.text, r.lang, r.source) for r in docs.collect()])


def test_edge_cases(spark):
    rows = [("a A b", "en", "s"), ("a b é É", "en", "s"), ("a c d_e", "en", "t"), ("a c", None, None), (None, "en", "u"), ("", "de", "s"), ("x", "de", "t"), ("1 2", "fr", "only"), ("é", "en", "t"), ("É é\x00é", "en", "z")]
    rows += [("a b é a", "en", "s")] * 4 + [("one two", "xx", "one")] * 3 + [("b", None, ""), ("a", "", None), ("a", "", "k")]
    rows += [("word " * 60000 + "Z" * 50000, "en", "long")] * 3 + [("\U0001f600\U0001f600 Ａ", "en", s) for s in "stu"]
    df = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], DOCS)
    expected = brute(rows)
    assert found(df) == expected
    assert any(r[2] == "pair" and r[4] == 0 for r in expected if r[0] == "de")  # no kept terms
    assert found(df.limit(0)) == []


def test_tasks_that_hold_little_and_many_shards_give_the_same(spark, sf_dir, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    whole = found(docs, best=7)
    monkeypatch.setattr(dv, "HELD_ROWS", 50)
    monkeypatch.setattr(dv, "SHARD_ROWS", 500)
    monkeypatch.setattr(dv, "BROADCAST_ROWS", 0)
    assert found(docs, best=7) == whole == brute([(r.text, r.lang, r.source) for r in docs.collect()], best=7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_counts_beyond_64_bits_of_products(spark):
    p = spark.range(1).selectExpr(dv._probability("cast(20000000000 AS long)", "cast(30000000000 AS long)", "cast(5 AS long)") + " AS p").first().p
    assert p == 1 + 1000000000 * 20000000001 // 30000000005
