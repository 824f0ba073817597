"""Token counts of every prefix of a text, by dynamic programming.

The tokenizer lower-cases a text, splits it into words and merges each word's
bytes by rank. So the count at the end of a word is a sum over words, and the
count inside a word comes from a table over its prefixes: the encoding of a
prefix ends in the one token that merges with nothing of the encoding before
it, so each prefix takes its count from a shorter one. With the tables, the
length of a prefix, or the longest prefix within a budget, is looked up and
nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import library, uncommon

LIMIT = 2048
#: Words whose counts a worker keeps; a cache only.
KEPT_WORDS = 400_000
#: Pairs of tokens of which a worker keeps whether they merge; a cache only.
KEPT_PAIRS = 2_000_000
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_LAST = "</w>"
#: Texts of characters below U+0200 stay below U+0300 in lower case.
LEAD = 0xC8


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _class(kinds: str) -> str:
    """A character class of the common code points whose category starts so."""
    points = [c for c in (*range(0x300), *range(0x2000, 0x20C0)) if unicodedata.category(chr(c))[0] in kinds]
    return "".join(f"\\U{c:08x}" for c in points)


#: Separators, and the white space among the control characters.
_SPACES = r"\t\n\x0b\x0c\r\x85" + _class("Z")
WORD = re.compile("|".join((*_CONTRACTIONS, f"[{_class('L')}]+", f"[{_class('N')}]", f"[^{_SPACES}{_class('LN')}]+")))


class WordTables:
    """Prefix tables of single words under one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): i for i, (a, b) in enumerate(pairs)}
        #: What each token is merged from, and when.
        self.parts = {self.vocab[a + b]: (self.vocab[a], self.vocab[b], i) for i, (a, b) in reversed(list(enumerate(pairs)))}
        #: The longest token that ends in two letters, within a word and at its end; no entry: one letter.
        self.within: dict[str, int] = {}
        self.at_end: dict[str, int] = {}
        for t in self.vocab:
            reach, own = (self.at_end, t.removesuffix(_LAST)) if t.endswith(_LAST) else (self.within, t)
            reach[own[-2:]] = max(reach.get(own[-2:], 1), len(own))
        self.longest = max(*self.within.values(), *self.at_end.values())
        self.letters = _byte_letters()
        self.apart: dict[int, bool] = {}
        self.counts: dict[str, int] = _Counts(self)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves tokens a and b, side by side, as they are.

        Goes back in time over how a's end and b's start came about; they don't
        stay if at some moment the two pieces then meeting had a merge that came
        before what either was merged into.
        """
        found = self.apart.get(a << 20 | b)
        if found is not None:
            return found
        x, y, until_x, until_y = a, b, len(self.rank) + 1, len(self.rank) + 1
        while True:
            m = self.rank.get((x, y))
            if m is not None and m < until_x and m <= until_y:
                found = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                found = True
                break
            if py is None or (px is not None and px[2] > py[2]):
                x, until_x = px[1], px[2]
            else:
                y, until_y = py[0], py[2]
        if len(self.apart) >= KEPT_PAIRS:
            self.apart.clear()
        self.apart[a << 20 | b] = found
        return found

    def _inner(self, w: str) -> tuple[list[int], list[int]]:
        """For each prefix not ending a word: its last token and its count."""
        vocab, apart, reach = self.vocab, self.stay_apart, self.within
        last, count = [-1] * (len(w) + 1), [0] * (len(w) + 1)
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - reach.get(w[max(0, i - 2) : i], 1)), i):
                t = vocab.get(w[j:i])
                if t is not None and (not j or apart(last[j], t)):
                    last[i], count[i] = t, count[j] + 1
                    break
        return last, count

    def _ending(self, w: str, i: int, last: list[int], count: list[int]) -> int:
        """The count of the prefix of i letters as a whole word."""
        for j in range(max(0, i - self.at_end.get(w[max(0, i - 2) : i], 1)), i):
            t = self.vocab.get(w[j:i] + _LAST)
            if t is not None and (not j or self.stay_apart(last[j], t)):
                return count[j] + 1
        return 0

    def after(self, w: str, at: int, more: str, last: list[int], count: list[int]) -> int:
        """The count of the prefix of ``at`` letters and then ``more`` as a whole word, from the tables of w."""
        if not more:
            return self._ending(w, at, last, count) if at else 0
        first = max(0, at - self.longest)
        near, lasts, counts = w[first:at] + more, last[first : at + 1], count[first : at + 1]
        for i in range(at - first + 1, len(near)):
            for j in range(max(0, i - self.within.get(near[max(0, i - 2) : i], 1)), i):
                t = self.vocab.get(near[j:i])
                if t is not None and (not first + j or self.stay_apart(lasts[j], t)):
                    lasts.append(t)
                    counts.append(counts[j] + 1)
                    break
        for j in range(max(0, len(near) - self.at_end.get(near[-2:], 1)), len(near)):
            t = self.vocab.get(near[j:] + _LAST)
            if t is not None and (not first + j or self.stay_apart(lasts[j], t)):
                return counts[j] + 1
        return 0

    def whole(self, word: str) -> int:
        w = "".join(map(self.letters.__getitem__, word.encode()))
        last, count = self._inner(w[:-1])
        return self._ending(w, len(w), last, count)

    def prefixes(self, word: str) -> list[int]:
        """The count of each prefix of 0, 1, ... characters of a word, as where a text ends there."""
        if word in _CONTRACTIONS and len(word) == 3:  # cut in the middle, it is a mark and a word
            return [0, self.counts["'"], self.counts["'"] + self.counts[word[1]], self.counts[word]]
        w = "".join(map(self.letters.__getitem__, word.encode()))
        last, count = self._inner(w)
        ends = np.cumsum([0] + [len(c.encode()) for c in word]).tolist()
        return [self._ending(w, i, last, count) for i in ends]


class _Counts(dict):
    def __init__(self, tables: WordTables):
        self.tables = tables

    def __missing__(self, word: str) -> int:
        n = self[word] = self.tables.whole(word)
        return n


@lru_cache(maxsize=2)
def _tables(path: str) -> WordTables:
    return WordTables(path)


def _words(text: str, odd: bool) -> list[re.Match] | None:
    """The words of a text the tables hold for; None where the library must split it."""
    if odd or "<|" in text:
        return None
    low = text.lower()
    return list(WORD.finditer(low)) if len(low) == len(text) else None


def prefix_table(text: str, odd: bool, path: str) -> tuple[list[int], list[int]]:
    """Where words end (in characters), and the tokens up to there."""
    words = _words(text, odd)
    if words is None:
        ends: list[int] = []
        totals: list[int] = []
        found, joining = library(path).encode(text, add_special_tokens=False), _joining()
        last, so_far = None, 0
        for word, (_, end) in zip(found.word_ids, found.offsets, strict=True):
            # no prefix ends between two words of one character, or before a mark that may belong to what is before it
            while end < len(text) and text[end] in joining:
                end += 1
            so_far += 1
            if ends and (ends[-1] == end or word is not None and word == last):
                ends[-1], totals[-1] = end, so_far
            else:
                ends.append(end)
                totals.append(so_far)
            last = word
        return ends, totals
    counts = _tables(path).counts
    return [m.end() for m in words], list(accumulate(counts[m.group()] for m in words))


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, prefixes: bool = False, budget: int | None = None) -> DataFrame:
    """Bytes and tokens of every whole text, from its prefix table.

    Returns key, n_bytes and n_tokens; with ``prefixes``, the table itself:
    word_ends (characters up to each word's end) and tokens_at (tokens up to
    there); with ``budget``, the longest prefix of at most so many tokens, looked
    up in the table: budget_chars and budget_tokens. A null text is empty; a null
    key stays null; repeated rows are counted each; an empty table gives none;
    other columns are not read.
    """
    path = path or default_path()
    added = ["word_ends array<int>", "tokens_at array<int>"] * prefixes + ["budget_chars long", "budget_tokens long"] * (budget is not None)
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", "n_bytes long", "n_tokens long", *added])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _tables(path).counts
        special = [t.content for t in library(path).get_added_tokens_decoder().values()]
        assert all(a.startswith("<|") for a in special), "an added token would go unseen"
        for batch in batches:
            texts = batch.column(1).fill_null("")
            sizes, totals, ends, at, fits = [], [], [], [], []
            for value, odd in zip(texts, uncommon(texts, LEAD), strict=True):
                raw = value.as_buffer()
                own = value.as_py()
                where, sums = prefix_table(own, odd, path)
                sizes.append(raw.size if raw is not None else 0)
                totals.append(sums[-1] if sums else 0)
                if prefixes:
                    ends.append(where)
                    at.append(sums)
                if budget is not None:
                    fits.append(longest_prefix(own, where, sums, budget, path))
                if len(counts) > KEPT_WORDS:
                    counts.clear()
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
            if prefixes:
                columns += [pa.array(x, pa.list_(pa.int32())) for x in (ends, at)]
            if budget is not None:
                columns += [pa.array([f[i] for f in fits], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "n_tokens", *(x.split()[0] for x in added)])

    return docs.select(F.col(key), F.col(text)).mapInArrow(count, schema)


def longest_prefix(text: str | None, word_ends: list[int], tokens_at: list[int], budget: int, path: str | None = None) -> tuple[int, int]:
    """(characters, tokens) of the longest prefix of at most ``budget`` tokens, from the prefix table."""
    text = text or ""
    done = bisect_right(tokens_at, budget)
    before, end = (tokens_at[done - 1], word_ends[done - 1]) if done else (0, 0)
    if done == len(word_ends):
        return len(text), before
    odd = bool(uncommon(pa.array([text]), LEAD)[0])
    words = _words(text, odd)
    if words is None:
        stop = word_ends[done]
        while done and "'" in text[max(0, end - 3) : end]:  # with another end it may begin a contraction
            done -= 1
            before, end = (tokens_at[done - 1], word_ends[done - 1]) if done else (0, 0)
        return _inside_odd(text, end, stop, before, budget, path or default_path())
    word = words[done]
    inside = _tables(path or default_path()).prefixes(word.group())
    fits = [i for i, n in enumerate(inside) if before + n <= budget]
    return (word.start() + fits[-1], before + inside[fits[-1]])


#: Clusters of a letter and its marks up to so many code points have tables; a longer one is encoded for each of its prefixes.
CLUSTER = 64


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """The characters that may change with what stands before them when a text is composed: marks, and the second halves of compositions."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # Hangul vowels and finals
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if unicodedata.combining(c):
            found.add(c)
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


def _inside_odd(text: str, start: int, stop: int, before: int, budget: int, path: str) -> tuple[int, int]:
    """longest_prefix where the library splits the text: it ends from start to before stop, the next word's end.

    The library composes characters before it looks words up, so a prefix that
    ends inside a cluster (a letter and its marks, the parts of a syllable) is the
    word up to the cluster with another end. The tables of the whole composed word
    hold up to there; the few letters of the other end are added to them.
    """
    lib, own = library(path), text[start:stop]
    encoded = lambda part: len(lib.encode(part, add_special_tokens=False).ids)
    joining = _joining()
    starts = [i for i, c in enumerate(own) if not i or c not in joining]
    if "<|" in own or max(np.diff([*starts, len(own)])) > CLUSTER:
        for i in range(stop - 1, start, -1):
            n = before + encoded(text[start:i])
            if n <= budget:
                return i, n
        return start, before
    composed = [lib.normalizer.normalize_str(own[a:b]) for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]
    low = "".join(composed)
    chars_at = [0, *accumulate(map(len, composed))]
    words = [_Word(_tables(path), low[a:b], a, b) for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(low)]
    first = [w.start for w in words]
    so_far = [0, *accumulate(w.count for w in words)]

    def tokens(i: int, k: int) -> int:
        """Of the first i characters, which end in cluster k, or before it."""
        at = chars_at[k]
        end = lib.normalizer.normalize_str(own[starts[k] : i]) if i > starts[k] else ""
        j = bisect_left(first, at) - 1  # the last word that begins before the cluster
        # with another end, a mark and a letter before it may become a contraction, or cease to be one
        mark = next((w for w in words[max(0, j - 2) : j + 1] if w.text[0] == "'" and at - w.start <= 3), None)
        if mark is not None:
            return so_far[words.index(mark)] + encoded(low[mark.start : at] + end)
        if j < 0:
            return encoded(end) if end else 0
        own_word = words[j]
        if own_word.end < at:  # there is a space between
            return so_far[j + 1] + (encoded(end) if end else 0)
        if not end:
            return so_far[j] + own_word.prefix(at - own_word.start, "")
        spans = [p[1] for p in lib.pre_tokenizer.pre_tokenize_str(low[at - 1] + end)]
        joined = spans[0][1] - 1  # characters of the other end that belong to the word
        rest = sum(own_word.tables.whole(end[a - 1 : b - 1]) for a, b in spans[1:])
        return so_far[j] + own_word.prefix(at - own_word.start, end[:joined]) + rest

    k = len(starts) - 1
    for i in range(len(own) - 1, 0, -1):
        while starts[k] > i:
            k -= 1
        n = before + tokens(i, k)
        if n <= budget:
            return start + i, n
    return start, before


class _Word:
    """A composed word, and its tables once they are asked for."""

    def __init__(self, tables: WordTables, text: str, start: int, end: int):
        self.tables, self.text, self.start, self.end = tables, text, start, end
        self.spelled = self._letters(text)
        self.inner: tuple[list[int], list[int]] | None = None
        self.count = self._found(len(self.spelled), "")

    def _letters(self, text: str) -> str:
        return "".join(map(self.tables.letters.__getitem__, text.encode()))

    def _found(self, at: int, more: str) -> int:
        if self.inner is None:
            self.inner = self.tables._inner(self.spelled)
            self.bytes_at = [0, *accumulate(len(c.encode()) for c in self.text)]
        return self.tables.after(self.spelled, at, more, *self.inner)

    def prefix(self, chars: int, end: str) -> int:
        """Tokens of its first characters and another end as a whole word."""
        self._found(0, "")
        return self._found(self.bytes_at[chars], self._letters(end))


def over_limit(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
