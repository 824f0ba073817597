import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from quire.llm import secrets

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def text_of(seed):
    rng = random.Random(seed)
    parts = ["token", "API_KEY", "apikey", "Secret", "passwd", "password", "=", ": ", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "f" * 23, "é", "ſecret", "toKen", "x", "\n", "-----BEGIN RSA PRIVATE KEY-----", "abc"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_spans_match_brute_force(spark):
    texts = [text_of(i) for i in range(400)] + [None, "", "secret=token: abcdefgh", "token=" + "a" * 200000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "token=abcdefgh")]
    docs = spark.createDataFrame([(*r, "kind") for r in rows], "doc_id long, text string, spans string")
    got = secrets.secrets_digest(secrets.scan_secrets(docs)).collect()
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        spans = brute(known[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_a_match_holds_its_rules_trigrams(rule):
    def holds(q, low):
        return q if q is True else q in low if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, low) for x in q[1:])

    query = secrets.trigram_query(rule.pattern)
    assert (query is True) == (rule.kind == "hex")
    for i in range(3000):
        text = text_of(i)
        if rule.compiled().search(text):
            assert holds(query, text.lower())


def test_queries_from_patterns():
    assert secrets.trigram_query("abcd") == ("and", "abc", "bcd")
    assert secrets.trigram_query("(abc|xyz)") == ("or", "abc", "xyz")
    assert secrets.trigram_query("a[0-9]*b") is True
    assert secrets.trigram_query("(abc)?d") is True


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.secrets_digest(secrets.scan_secrets(none)).count() == 0


def test_postings_are_those_of_a_scan():
    texts = [text_of(i) for i in range(200)] + ["", "ab", "Éab ſéx", "a" * (1 << 20) + "Token"]
    asked = secrets.Asked([True, ("and", "tok", ("or", "éx", "abc")), "\u017fé"])
    index = secrets.TrigramIndex(pa.array(texts), asked)
    for trigram in ("tok", "abc", "\u017fé"):
        low = "".join(trigram)
        assert index.postings(trigram).tolist() == [i for i, t in enumerate(texts) if low in t.lower() and low.encode() in bytes(secrets._LOWER[b] for b in t.encode())]


def test_a_block_is_indexed_in_one_pass(monkeypatch):
    """No scan of texts for single trigrams: the index alone says which texts a rule's pattern sees."""
    seen = []
    scanner = secrets.Scanner(tuple(r for r in secrets.RULES if r.kind != "hex"))

    class Spy:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, text):
            seen.append(text)
            return self.pattern.finditer(text)

    scanner.patterns = [Spy(p) for p in scanner.patterns]
    monkeypatch.setattr(secrets, "pc", None)  # what scans arrays
    texts = ["nothing here"] * 500 + ["token = abcdefgh", "PASSWORD: xyzxyz", "tok en", "akia", "AKIA" + "A" * 20]
    spans = scanner.spans(pa.array(texts))
    assert [i for i, s in enumerate(spans) if s] == [500, 501, 504]
    assert sorted(set(seen)) == sorted({texts[500], texts[501], texts[503], texts[504]})


@pytest.mark.parametrize("text", ["eyJ" * 700_000 + " .eyJ", "eyJa." * 400_000, "-----BEGIN " * 200_000, "-----BEGIN " + "PRIVATE " * 250_000, "gho_" * 500_000, "token" * 400_000, "token" + " " * 2_000_000, "token= " * 300_000, "AKIA" * 500_000, "ab" * 11 + "x" + "f" * 2_000_000, "secret" + "'" * 2_000_000], ids=lambda t: t[:12])
def test_long_texts_take_a_time_in_proportion(text):
    began = time.perf_counter()
    secrets.Scanner(secrets.RULES).spans(pa.array([text]))
    assert time.perf_counter() - began < 8
