import random
import re

import pytest

from quire.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc, n_shingles, component) of each distinct key and number of shingles."""
    rows = [(k, shingles(t)) for k, t in rows if k is not None]
    at = {k: k for k, _ in rows}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            both = len(x & y)
            if both and 100 * both >= 80 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                at[hi] = lo
    return sorted({(k, len(s), root(k)) for k, s in rows})


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind > 0)] = [f"e{rng.randrange(10**6)}"] * (kind < 2)
        words = words or ["x"]
    return words


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    boiler = fresh(40)
    rows = []
    for i in range(60):
        n = rng.choice([4, 5, 7, 8, 9, 12, 15, 19, 20, 30, 60, 64, 68, 100, 250, 300, 900])
        first = fresh(n)
        if rng.random() < 0.3:
            first = boiler[: rng.randrange(40)] + first
        group = [first]
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            group.append(edited(rng, rng.choice(group), rng.randrange(max(2, len(first) // 25 + 2))))
        rows += [" ".join(g).title() if rng.random() < 0.2 else "\n".join(g) for g in group]
    cluster = fresh(200)
    rows += [" ".join(edited(rng, cluster, rng.randrange(1, 9))) for _ in range(60)]
    rows += [" ".join([*boiler, *fresh(rng.randrange(1, 30))]) for _ in range(60)]
    rows += [" ".join(first)] * 5 + [None, "", " \t\n", "one", "ONE", "one two", "one two three four", "a " * 500, "a " * 700]
    ids = rng.sample(range(10**6), len(rows))
    found = list(zip(ids, rows, strict=True))
    # rows repeated in key and text, a key with two texts, and one without a key
    return found + [found[3], (found[4][0], rows[10]), (found[20][0], rows[40]), (None, rows[5]), (found[-1][0], "one")]


@pytest.mark.parametrize(("seed", "limit"), [(1, 500_000), (2, 0)])
def test_components_match_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, h string").repartition(5)
    got = sorted(map(tuple, jaccard.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_every_link_is_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows = [r for r in dict(r for r in corpus(4) if r[0] is not None).items()]
    links, copies = jaccard.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    first, sets = {}, {}
    for k, s in sorted((k, frozenset(shingles(t))) for k, t in rows):
        sets[k] = s
        first.setdefault(s, k)
    assert {(r.doc, r["first"]) for r in copies.collect()} == {(k, first[s]) for k, s in sets.items() if s and first[s] != k}
    own = sorted(first.values())
    expected = {(a, b) for i, b in enumerate(own) for a in own[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(expected) > 300 and sorted(map(tuple, links.collect())) == sorted(expected)


def test_documents_that_are_all_alike_or_share_a_passage(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, "same text for every one of these documents here") for i in range(300)]
    rows += [(1000 + i, passage + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(25))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute(rows)


def test_hot_cells(spark):
    """More documents of one cell in one pack than are sent together."""
    rng = random.Random(8)
    first = [f"v{rng.randrange(500)}" for _ in range(60)]
    rows = [(i, " ".join(edited(rng, first, rng.randrange(1, 5)))) for i in rng.sample(range(10**5), 420)]
    rows += [(10**6 + i, " ".join([*first[:20], *(f"q{rng.randrange(60)}" for _ in range(30))])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute(rows)


def test_values_that_are_hot_in_a_pack_count_as_saturated(spark, monkeypatch):
    import numpy as np

    from quire.llm import meeting

    monkeypatch.setattr(meeting, "HOT", 4)
    monkeypatch.setattr(meeting, "TOGETHER", 3)
    pairs = [(h, d) for h in range(30) for d in range(h % 9 + 1)] + [(2**63 + 5, d) for d in range(7)] + [(2**63 + 9, 1)]
    h, d = (np.array(x, t) for x, t in zip(zip(*pairs), (np.uint64, np.int64)))
    order = np.random.default_rng(1).permutation(len(h))
    rows = [tuple(bytearray(x) if isinstance(x, bytes) else x for x in r.values()) for part in np.array_split(order, 3) for b in meeting.pack(h[part], d[part]) for r in b.to_pylist()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    got = jaccard.counted(spark.createDataFrame(rows, meeting.PACKED)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.h % 2**64, r.doc) for r in got) == sorted((x, y) for x, y in pairs if x > 2**63 or x % 9)
    n = {}
    for r in got:
        n.setdefault(r.h % 2**64, set()).add(r.n)
    assert all(len(x) == 1 and x <= {k % 9 + 1, jaccard.SATURATED} for k, x in n.items() if k < 2**63)


def test_texts_that_differ_in_an_orderly_way(spark):
    one, other = "a", "b"
    while len(one) < 1024:
        one, other = one + other, other + one
    rows = [(1, f"{one} one two three four five"), (2, f"{other} one two three four five"), (3, f"{one} one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute(rows) == [(1, 2, 1), (2, 2, 2), (3, 2, 1)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = jaccard.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert found.collect() == []


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(4, text, "x"), (2, text + " more", "y"), (9, "alone", "z"), (None, text, "n")], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.one_of_each(docs).collect()) == [(0, "n"), (2, "y"), (9, "z")]


def test_every_similar_pair_shares_a_kept_cell():
    """The pigeonhole bound, without Spark: pairs at the threshold, of sizes across a band's edge."""
    import numpy as np

    rng = np.random.default_rng(3)
    for bands in (jaccard.Bands(80, 0.5, 1 / 32), jaccard.Bands(80, 2.0, 1.0)):
        for n in (4, 5, 9, 13, 15, 16, 18, 60, 63, 64, 70, 79, 200, 255, 300):
            for _ in range(30):
                a = rng.integers(0, 2**63, n, dtype=np.uint64)
                b = a.copy()
                while True:
                    c = b[rng.permutation(len(b))][int(rng.integers(2)) :] if rng.random() < 0.5 else np.append(b, rng.integers(0, 2**63, dtype=np.uint64))
                    if not jaccard.similar(np.stack([np.sort(a)] * 2), np.stack([np.sort(c)] * 2), 80):
                        break
                    b = c
                x, y = (np.concatenate([v for v in jaccard.cells(np.sort(s), bands) if not v[0] >> np.uint64(63)]) for s in (a, b))
                assert np.intersect1d(x, y).size
