import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def lib(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCéèüßñ0123456789'.,!?-_   \n\t/#$%&*"
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    found += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found += [None, "", " ", "We're he'll they've it's 'tis ''s", "<|endoftext|> a <|x|>", "İstanbul ² ½ ǅ", "中文 и Ελλάς ﬁ", "é café", "!" * 3000, "a" * 3000, "aaaa aaaaaaa b​c\x1cd\x85e"]
    return found


def test_counts_match_the_library(spark, texts):
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(None, "no key", 3), (0, texts[0], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    known = {i: t for i, t, _ in rows}
    for prefixes in (False, True):
        got = tc.over_limit(tc.token_counts(docs, prefixes=prefixes)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (lib(known[r.doc_id]), len((known[r.doc_id] or "").encode()), lib(known[r.doc_id]) > 2048), known[r.doc_id]
    assert tc.token_counts(docs.limit(0)).count() == 0


def test_every_common_character():
    tables = tc._tables(PATH)
    for c in [*range(1, 0x200), *range(0x2000, 0x20C0)]:
        text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s"
        low = text.lower()
        if len(low) == len(text):
            assert sum(tables.counts[w] for w in tc.WORD.findall(low)) == lib(text), hex(c)


def test_words_of_many_kinds(texts):
    tables, rng = tc._tables(PATH), random.Random(1)
    words = {w for t in texts if t for w in tc.WORD.findall(t.lower())}
    words |= {"".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 30))) for _ in range(5000)}
    vocab = sorted(t.removesuffix("</w>") for t in tables.vocab if t.isascii() and t.removesuffix("</w>").isalpha())
    words |= {rng.choice(vocab).lower() + rng.choice(vocab).lower() for _ in range(5000)}
    for w in words:
        assert tables.whole(w) == lib(w), w


def test_prefix_tables(texts):
    for text in texts[-9:-6] + ["the quick onenerth wasn't they're", "1234 abc"]:
        if text and "<|" not in text and len(text) == len(text.lower()):
            ends, at = tc.prefix_table(text, False, PATH)
            for n, end in zip(at, ends):
                assert n == lib(text[:end])
            for budget in range(lib(text) + 2):
                chars, n = tc.longest_prefix(text, ends, at, budget, PATH)
                assert n == lib(text[:chars]) <= budget
                assert all(lib(text[:i]) > budget for i in range(chars + 1, len(text) + 1))


def test_prefixes_inside_words():
    for word in ("onenerth", "étionner", "'re", "'ll", "!!!!??", "internationalization"):
        assert tc._tables(PATH).prefixes(word) == [lib(word[:i]) for i in range(len(word) + 1)]


@pytest.mark.parametrize("budget", [0, 1, 3, 11, 40])
def test_budgets_are_answered_from_the_table(spark, texts, budget):
    own = [*texts[:60], *[t[:300] for t in texts[300:340] if t], *texts[-11:-4], "мир" * 30, "中文" * 30 + " 'Re", "x <|endoftext|> " * 9, "İ" * 40]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id int, text string").repartition(3)
    for r in tc.token_counts(docs, budget=budget).collect():
        text = own[r.doc_id] or ""
        fits = max(i for i in range(len(text) + 1) if lib(text[:i]) <= budget)
        assert (r.budget_chars, r.budget_tokens, r.n_tokens) == (fits, lib(text[:fits]), lib(text)), text


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(tc, "KEPT_PAIRS", 50)
    tables = tc.WordTables(PATH)
    for word in ("internationalization", "onenerth", "étionner", "unbelievableness") * 3:
        assert tables.whole(word) == lib(word)
    assert len(tables.apart) <= 50


@pytest.mark.parametrize("text", ["м" * 95, "中文字符没有空格", "  Привет, мир! ΑΣ όδοςΣ", "مرحبا بالعالم 😀😀x", "İstanbul e\u0301te\u0301 ab", "ab <|endoftext|> 中文", "中文's 日本語123 'Re", "ﬁne한국어"])
def test_longest_prefix_of_other_scripts(text):
    ends, at = tc.prefix_table(text, True, PATH)
    for budget in range(lib(text) + 2):
        fits = max(i for i in range(len(text) + 1) if lib(text[:i]) <= budget)
        assert tc.longest_prefix(text, ends, at, budget, PATH) == (fits, lib(text[:fits])), budget


ODD = [
    "e\u0301te\u0301 cafe\u0301s", "a\u0323\u0302b\u0302\u0323c", "x\u0301y\u0323\u0301z", "か\u3099き\u3099は\u309aん\u3099", "\u1112\u1161\u11ab\u1100\u1173\u11af\u1112\u1161", "\u1100\u1161\u1100", "İi\u0307I\u0307",
    "\u0301\u0301ab e\u0301", "n\u0303o\u0308 <|x|> u\u0308u\u0308", "日e\u0301本\u3099語", "ΣΑΣ\u0301ς", "\u09c7\u09be\u09c7\u09d7क\u093c", "ﬀ\u0301ﬁ", "'\u0301re's\u0301", "1\u03012\u0301", "Å\u0301ngstro\u0308m\u200d\u0308",
]


@pytest.mark.parametrize("text", ODD)
def test_prefixes_of_composed_characters(text):
    ends, at = tc.prefix_table(text, True, PATH)
    for budget in range(lib(text) + 2):
        fits = max(i for i in range(len(text) + 1) if lib(text[:i]) <= budget)
        assert tc.longest_prefix(text, ends, at, budget, PATH) == (fits, lib(text[:fits])), budget


def test_random_words_of_composed_characters():
    rng = random.Random(8)
    parts = ["e\u0301", "o\u0308", "u", "n\u0303", "s", "a\u0323\u0302", "か\u3099", "は\u309a", "ん", "\u1112\u1161\u11ab", "\u1100\u1173", "I\u0307", "я", "и\u0306", "x\u0301"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 12)))
        ends, at = tc.prefix_table(text, True, PATH)
        for budget in range(lib(text) + 1):
            fits = max(i for i in range(len(text) + 1) if lib(text[:i]) <= budget)
            assert tc.longest_prefix(text, ends, at, budget, PATH) == (fits, lib(text[:fits])), (text, budget)


@pytest.mark.parametrize("part", ["e\u0301te\u0301", "か\u3099は\u309a", "\u1112\u1161\u11ab\u1100\u1173\u11af"])
def test_very_long_words_take_seconds(part):
    text = part * (100_000 // len(part))
    began = time.perf_counter()
    ends, at = tc.prefix_table(text, True, PATH)
    fits, n = tc.longest_prefix(text, ends, at, tc.LIMIT, PATH)
    assert time.perf_counter() - began < 30
    assert n == lib(text[:fits]) <= tc.LIMIT < lib(text[: fits + 9])
