"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams that every
match must hold. One pass over the bytes of a block of texts gives an index from
trigram to postings; a rule's query is answered by uniting and intersecting
postings, and only the candidates are matched. A rule without mandatory trigrams
(of those here: hex) scans the block. No rule's matching takes more than a time
in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre  # the parse tree of the standard library's own regular expressions
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.wordhash import RUN_BYTES, texts_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    ignore_case: bool = False  # of ASCII letters

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.ignore_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[opsu]_[A-Za-z0-9]+", 40),
    # possessive, and not inside a longer run: otherwise each eyJ of a run would read it to its end
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
)
RULES = BASE + MORE
#: Texts of a block, which has one index.
BLOCK_ROWS = 2048
#: Exact strings of a part are enumerated up to so many.
_MOST = 64

Query = bool | str | tuple  # True: every text; a trigram; ("and" | "or", queries...)


def _join(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _trigrams(exact: set[str]) -> Query:
    """One of these strings occurs."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(exact)])


def _walk(tree) -> tuple[set[str] | None, Query]:
    """The exact lower-case strings a parse tree matches, where few, and what else its matches must hold."""
    exact: set[str] | None = {""}  # what the items since the last break spell
    whole, needs = True, []
    for op, value in tree:
        own: set[str] | None = None
        query: Query = True
        if op is sre.LITERAL:
            own = {chr(value).lower()} if value < 128 else {chr(value)}
        elif op is sre.SUBPATTERN:
            own, query = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(b) for b in value[1]]
            if all(e is not None for e, _ in parts):
                own = set().union(*(e for e, _ in parts))
            query = _join("or", [_join("and", [q, True if e is None else _trigrams(e)]) for e, q in parts]) if own is None else True
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            e, q = _walk(inner)
            if (low, high) == (0, 1) and e is not None:
                own = e | {""}
            elif low:
                query = q if e is None else _trigrams(e)
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in value:
                if kind is sre.LITERAL and chars is not None:
                    chars.add(chr(x).lower() if x < 128 else chr(x))
                else:
                    chars = None
            own = chars if chars and len(chars) <= 8 else None
        if own is not None and len(own) * len(exact) <= _MOST:
            exact = {a + b for a in exact for b in own}
            continue
        needs += [_trigrams(exact), query] + ([_trigrams(own)] if own is not None else [])
        exact, whole = {""}, False
    if whole:
        return exact, True
    return None, _join("and", [*needs, _trigrams(exact)])


def trigram_query(pattern: str) -> Query:
    """What every match of a pattern holds, as trigrams of the ASCII-lower-cased text; True if it has none."""
    exact, query = _walk(_parser.parse(pattern))
    return query if exact is None else _trigrams(exact)


def _leaves(query: Query) -> set[str]:
    if isinstance(query, bool):
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_leaves, query[1:]))


def _codes(trigram: str) -> list[int]:
    """The byte trigrams, as numbers of 24 bits, of three characters."""
    raw = trigram.encode()
    return [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Asked:
    """The byte trigrams that some queries ask for."""

    def __init__(self, queries: Iterable[Query]):
        self.codes = sorted({c for q in queries for leaf in _leaves(q) for c in _codes(leaf)})
        self.flags = np.zeros(1 << 24, bool)
        self.flags[self.codes] = True


class TrigramIndex:
    """Trigram to postings (sorted row numbers) over a block of texts in ASCII lower case, for the trigrams asked for."""

    def __init__(self, texts: pa.Array, asked: Asked):
        self.size, self.known = len(texts), set(asked.codes)
        data, offsets = texts_of(texts)
        found = []
        for a in range(0, len(data), RUN_BYTES):  # runs overlap by two bytes
            low = _LOWER[data[a : a + RUN_BYTES + 2]].astype(np.uint32)
            code = low[:-2] | low[1:-1] << 8 | low[2:] << 16
            at = np.flatnonzero(asked.flags[code])
            row = np.searchsorted(offsets, a + at, "right") - 1
            whole = a + at + 3 <= offsets[row + 1]
            found.append(np.unique(code[at[whole]].astype(np.int64) << 32 | row[whole]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        code = pairs >> 32
        cuts = np.flatnonzero(np.diff(code, prepend=-1))
        self.lists = {int(code[i]): rows for i, rows in zip(cuts, np.split(pairs & 0xFFFFFFFF, cuts[1:]), strict=False)} if len(pairs) else {}

    def postings(self, trigram: str) -> np.ndarray:
        codes = _codes(trigram)
        assert self.known.issuperset(codes), "the index wasn't asked for this trigram"
        none = np.empty(0, np.int64)
        out = self.lists.get(codes[0], none)
        for c in codes[1:]:
            out = np.intersect1d(out, self.lists.get(c, none), assume_unique=True)
        return out

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings(query)
        lists = [self.answer(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def _full_scan(texts: pa.Array, rule: Rule) -> np.ndarray:
    """Rows that an automaton finds a long enough match in; for whole-pattern repeats of one class."""
    if m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        found = pc.match_substring_regex(texts, f"{m[1]}{{{rule.least}}}", ignore_case=rule.ignore_case)
        return np.flatnonzero(found.to_numpy(zero_copy_only=False))
    return np.arange(len(texts))


class Scanner:
    """What a task needs to find the spans of some rules, made once."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.patterns = [r.compiled() for r in rules]
        self.asked = Asked(self.queries)

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule's place, end) of every match in each text of a block, in this order."""
        index = TrigramIndex(texts, self.asked)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for order, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns, strict=True)):
            rows = _full_scan(texts, rule) if query is True else index.answer(query)
            for row in rows.tolist():
                own = [(m.start(), order, m.end()) for m in pattern.finditer(texts[row].as_py()) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                if own:
                    found.setdefault(row, []).extend(own)
        return [sorted(found.get(i, ())) for i in range(len(texts))]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(i, BLOCK_ROWS)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Finds every rule's spans in whole texts.

    Returns key and spans, an array of (kind, start, end) in code points, end
    exclusive, by start and then by the rules' order. A null text has no spans;
    repeated rows give repeated rows; an empty table none; a null key stays
    null; other columns are not read.
    """
    kind = f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in blocks(batches):
            found = scanner.spans(batch.column(1).fill_null(""))
            spans = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in own] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], [key, "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, kind)


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with every span that a rule finds, or several that overlap, replaced by ``mark``.

    All columns, whatever their names, and rows stay; a null text stays null.
    """
    at = docs.columns.index(text)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in blocks(batches):
            column = batch.column(at)
            found = scanner.spans(column.fill_null(""))
            out = []
            for value, spans in zip(column, found, strict=True):
                whole = value.as_py()
                if spans:
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [whole[end:a], mark]
                        end = max(end, b)
                    whole = "".join([*parts, whole[end:]])
                out.append(whole)
            columns = batch.columns
            columns[at] = pa.array(out, column.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # as Spark passes no column whose name has a dot
    return numbered.mapInArrow(redact, numbered.schema).toDF(*docs.columns)


def secrets_digest(found: DataFrame, key: str = "doc_id", base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and digests of scan_secrets' spans."""
    listed = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    base_spans = f"filter(spans, x -> x.kind IN ({kinds}))"
    counts = [f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) AS long) AS n_{r.kind}" for r in base]
    return found.selectExpr(f"`{key}`", *counts, f"sha2({listed.format(base_spans)}, 256) AS base_sha256", f"{listed.format('spans')} AS spans")
