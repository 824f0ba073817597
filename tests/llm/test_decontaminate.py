import hashlib
import random
import re

import pytest

from quire.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        if k is None or not w:
            continue
        n = min(10, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = set()
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in range(1, 11):
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.add((k, len(w), len(hit), len(found), digest, bool(hit)))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    vocab = ["Alpha", "beta", "ÉCOLE", "école", "gamma-ray", "x1", "delta", "ΑΣ", "σ", "straße"] + [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(20)] + [(50, text(9)), (51, "rare word"), (52, "solo!"), (53, ""), (54, None), (None, text(12)), (55, items_copy := text(15)), (56, items_copy), (57, "loop " * 14)]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(30)) for _ in range(2)]
        item = words(rng.choice(items)[1])
        a = rng.randrange(max(1, len(item) - 9))
        parts.insert(1, ", ".join(item[a : a + rng.randrange(8, 14)]).title() if rng.random() < 0.5 else "")
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "?!"), (203, text(20000)), (204, "loop " * 30), (205, "a rare word here; Solo"), (206, "rare wordy"), docs[3], (None, items[2][1]), (3, items[4][1])]
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 0])
def test_hits_match_brute_force(spark, tables, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, items = tables
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, hits int")
    got = [tuple(r) for r in decontaminate.contamination_digest(decontaminate.find_contamination(d, b)).collect()]
    assert set(got) == brute(docs, items)
    assert len(got) == len(set(docs))
    plan = decontaminate.contamination_digest(decontaminate.find_contamination(d, b))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = decontaminate.contamination_digest(decontaminate.find_contamination(d, b.limit(0))).collect()
    assert {(r.n_hit, r.contaminated) for r in clean} == {(0, False)} and len(clean) == len(set(docs))
    assert decontaminate.find_contamination(d.limit(0), b).count() == 0


@pytest.mark.parametrize("lengths", [range(1, 10), [5]])
def test_short_items_in_short_documents(spark, lengths):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in lengths] + [(20, " ".join(f"long{j}" for j in range(12)))]
    docs = [(100 * n + m, " ".join(["pad"] * ((m - n) // 2) + [items[i][1]] + ["pad"] * (m - n - (m - n) // 2))) for i, n in enumerate(lengths) for m in range(n, 13)]
    docs += [(m, " ".join(f"long{j}" for j in range(m))) for m in range(1, 13)] + [(50, "i5w0 i5w1 i5w2 i5w3 pad")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contamination_digest(decontaminate.find_contamination(d, b)).collect()}
    assert got == brute(docs, items)
