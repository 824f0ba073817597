"""Near-duplicate documents by the Jaccard similarity of their word shingles: a parity-sketch join.

A document's shingles are dealt by hash into the cells of a sketch, and each
cell is the exclusive-or of its shingles' hashes. A shingle that only one of two
documents has changes one cell, so the number of differing cells is at most the
symmetric difference, which the similarity bounds. By the pigeonhole principle
two similar documents of one size band share cells; how many is known, so of
each document's cells only the rarest need be joined. Candidates pass a bit
sketch of the same kind and are verified on their whole shingle sets.

What is needed is who is connected, not every link: in each set of documents
that share a cell, all are compared with the smallest one first, and pairs are
only formed between documents that this leaves in different components, and
whose sizes allow that they are similar (similar_pairs forms them all and gives
every link). Verification counts shingles that agree
in two independent 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import meeting
from quire.llm.common import materialize, shuffle_partitions, unused
from quire.llm.wordhash import Words, mix, runs

SHINGLE, PERCENT = 5, 80
#: Sizes of a band go up to so many times its smallest.
RATIO = 4
#: Ids that are broadcast; joined by a shuffle beyond.
BROADCAST_ROWS = 500_000
#: A cell that so many documents have counts as just as frequent as any more frequent one.
SATURATED = 4096
#: Documents of one cell, or members of one hub, that one task compares at once.
BLOCK = 256
#: Bits of the sketch that candidates are filtered by.
SKETCH_BITS = 2048
#: Sets of so many are found equal however often their shingles repeat. Those too small for a band must be; larger ones meet in their cells.
SMALL = 32
_U = np.uint64
_BAND_BITS = 5


def shingle_sets(words: Words, size: int, second: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a run; of all words where they are fewer. With ``second``, their second hashes are a second row."""
    count = np.diff(words.first)
    which = (0, 1) if second else (0,)
    found = [words.windows(size, x) for x in which]
    short = {k: [words.windows(k, x) for x in which] for k in np.unique(count[(count > 0) & (count < size)]).tolist()}
    for i in range(words.count):
        a, n = int(words.first[i]), int(count[i])
        if not n:
            own = np.empty((len(which), 0), _U)
        elif n < size:
            own = np.stack([x[a : a + 1] for x in short[n]])
        elif second:
            own = np.stack([x[a : a + n - size + 1] for x in found])
            own = own[:, np.argsort(own[0])]
        else:
            own = np.sort(found[0][a : a + n - size + 1])[None]
        new = np.ones(own.shape[1], bool)
        np.not_equal(own[0, 1:], own[0, :-1], out=new[1:])
        own = own[:, new]
        yield words.row + i, own if second else own[0]


@dataclass(frozen=True)
class Bands:
    """Size bands and, for each, how sketches are laid out.

    Band k has the sizes least * RATIO**k and up, least being the smallest size
    at which two different sets can be similar. A document takes part in its
    own band and, if a document of the band below can be similar to it, there.
    """

    percent: int
    cells: float  # a band's cells, by its largest size
    spare: float  # cells a document may drop, by its band's largest size

    @property
    def least(self) -> int:
        return -(-self.percent // (100 - self.percent))

    def low(self, k: int) -> int:
        return self.least * RATIO**k

    def high(self, k: int) -> int:
        return self.low(k + 1) - 1

    def spares(self, k: int) -> int:
        return 1 + int(self.high(k) * self.spare)

    def layouts(self, n: int) -> list[tuple[int, int, int]]:
        """(band, cells, most that can differ) of each band a set of n shingles takes part in."""
        if n < self.least:
            return []
        k = 0
        while n > self.high(k):
            k += 1
        p = self.percent
        out = [(k, n * (100 - p) // p)]
        if k and n * p <= self.high(k - 1) * 100:
            out.append((k - 1, (n + self.high(k - 1)) * (100 - p) // (100 + p)))
        return [(k, 2 + int(self.high(k) * self.cells), most) for k, most in out]


def cells(own: np.ndarray, bands: Bands) -> Iterator[np.ndarray]:
    """The joined values of a set: non-negative ones for its cells, with the band in the lowest bits, and one negative one.

    Of each band, a set gives its first non-empty cells, as many as can differ
    plus one plus the band's spares. If it has fewer, a negative value says how
    many spares it lacks. Where all its cells could differ, it adds a value for
    each shingle, of which similar sets share at least one.
    """
    top, mixed = own >> _U(32), mix(own)
    for k, m, most in bands.layouts(len(own)):
        part = (top * _U(m)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word = np.bitwise_xor.reduceat(mixed, starts)
        n, spares = len(word), bands.spares(k)
        values = mix(word + (part[starts] + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(k))[: most + 1 + spares]
        if n <= most:
            values = np.concatenate([values, mix(mixed + _U(0xA5A5A5A5 + k))])
            lacks = spares + len(values)
        else:
            lacks = spares - (len(values) - most - 1)
        mask = _U((1 << _BAND_BITS) - 1)
        yield (values >> _U(1)) & ~mask | _U(k)
        if lacks:
            yield np.array([-1 - (lacks << _BAND_BITS | k)], np.int64).view(_U)


def _cells_of(size: int, bands: Bands):
    def of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        keys = batch.column(0).to_numpy()
        for words in runs(batch.column(1), lower=True):
            for row, own in shingle_sets(words, size):
                for values in cells(own, bands):
                    if len(values) == 1 and values[0] >> _U(63):  # a few keys apart, or one value would be very common
                        values = values - _U((int(keys[row]) & 0xFF) << 40)
                    yield values, np.full(len(values), keys[row])

    return of


def counted(packed: DataFrame) -> DataFrame:
    """(doc, h, n) of each value that more than one document has, n being how many, up to SATURATED, as of values that are hot in some pack; of negative ones too."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_d = np.empty(0, _U), np.empty(0, np.int64)  # the last value's documents, while few
        full: int | None = None  # the last value, if it has SATURATED documents

        def out(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            told = (n > 1) | (h >> _U(63) > 0)
            return pa.RecordBatch.from_arrays([pa.array(d[told]), pa.array(h[told].view(np.int64)), pa.array(n[told].astype(np.int32))], ["doc", "h", "n"])

        for batch in batches:
            h, _, kind, d, _ = meeting.unpack(batch)
            apart = kind == meeting.APART
            if apart.any():
                yield out(h[apart], d[apart], np.full(int(apart.sum()), SATURATED))
                h, kind, d = h[~apart], kind[~apart], d[~apart]
            if not len(h):
                continue
            head = np.concatenate([np.zeros(len(held_h), bool), kind == meeting.HEAD])
            h, d = np.concatenate([held_h, h]), np.concatenate([held_d, d])
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(at, len(h)))
            n = np.where(np.logical_or.reduceat(head, at), SATURATED, np.minimum(size, SATURATED))
            if full is not None and int(h[0]) == full:
                n[0] = SATURATED
            else:
                full = None
            last = int(at[-1])
            ready = len(h) if n[-1] >= SATURATED else last
            full = int(h[-1]) if n[-1] >= SATURATED else None
            held_h, held_d = h[ready:], d[ready:]
            if ready:
                yield out(h[:ready], d[:ready], np.repeat(n, size)[:ready])
        if len(held_h):
            yield out(held_h, held_d, np.full(len(held_h), len(held_h)))

    return meeting.by_hash(packed, "kind", "doc").mapInArrow(stream, "doc long, h long, n int")


def _spares(bands: Bands) -> str:
    return f"element_at(array({', '.join(f'{bands.spares(k)}L' for k in range(24))}), cast(k + 1 AS int))"


def _per_document(found: DataFrame) -> DataFrame:
    mask = (1 << _BAND_BITS) - 1
    return found.selectExpr("doc", "h", "n", f"IF(h < 0, (-1 - h) & {mask}, h & {mask}) AS k", f"IF(h < 0, ((-1 - h) >> {_BAND_BITS}) & {(1 << 35) - 1}, 0L) AS lacks")


def with_partners(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The documents that share enough cells with others, taken together, to be similar to one."""
    found = _per_document(counted(meeting.emit(docs, _cells_of(size, bands))))
    shared = found.groupBy("doc", "k").agg(F.expr("count_if(h >= 0) + sum(lacks)").alias("shared"), F.expr("count_if(h >= 0)").alias("any"))
    return shared.where(f"any > 0 AND shared > {_spares(bands)}").select("doc").distinct()


def rarest_cells(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(doc, h): each document's shared cells but as many of the most common ones as it may drop."""
    found = _per_document(counted(meeting.emit(docs, _cells_of(size, bands))))
    own = found.groupBy("doc", "k").agg(F.collect_list(F.when(F.col("h") >= 0, F.struct("n", "h"))).alias("c"), F.sum("lacks").alias("lacks"))
    kept = own.selectExpr("doc", "c", f"cast(greatest(0, size(c) + lacks - {_spares(bands)}) AS int) AS keep").where("keep > 0")
    return kept.selectExpr("doc", "explode(slice(array_sort(c), 1, least(keep, size(c)))) AS c").selectExpr("doc", "c.h AS h").distinct()


def hub_pairs(kept: DataFrame) -> DataFrame:
    """(a, b): each document with the smallest one that shares a cell, or the smallest of its pack where the cell is hot."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = hub = None
        for batch in batches:
            h, _, kind, d, hubs = meeting.unpack(batch)
            hubs = hubs.copy()
            own = np.flatnonzero(kind != meeting.APART)
            if len(own):
                x = h[own]
                at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                least = d[own][at]
                if last_h is not None and int(x[0]) == last_h:
                    least[0] = hub
                hubs[own] = np.repeat(least, np.diff(np.append(at, len(x))))
                last_h, hub = int(x[-1]), int(least[-1])
            other = np.unique(np.stack([hubs, d])[:, hubs != d], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(other[0]), pa.array(other[1])], ["a", "b"])

    rows = kept.select("h", "doc").mapInArrow(_packed, meeting.PACKED)
    return meeting.by_hash(rows, "doc", "kind").mapInArrow(pairs, "a long, b long").distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from meeting.pack(batch.column(0).to_numpy().view(_U), batch.column(1).to_numpy())


def set_sizes(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, s, t): the size of each document's set, and sums of its hashes and of second ones. Equal sets of up to SMALL have equal sums, larger ones only if their texts repeat the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for words in runs(batch.column(1), lower=True):
                count = np.diff(words.first)
                both = {k: [words.windows(k, x) for x in (0, 1)] for k in {size, *count[(count > 0) & (count < size)].tolist()}}
                for row, own in shingle_sets(words, size):
                    a, n = int(words.first[row - words.row]), int(count[row - words.row])
                    k = min(n, size)
                    first, second = (x[a : a + n - k + 1] for x in both[k]) if n else (own, own)
                    if len(own) <= SMALL:
                        second = mix(second[np.unique(first, return_index=True)[1]])
                    rows.append((len(own), int(mix(own).sum().view(np.int64)), int(second.sum().view(np.int64))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc", "n", "s", "t"])

    return docs.mapInArrow(run, "doc long, n long, s long, t long")


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits; each shingle flips one."""
    return np.packbits(np.bincount((own & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, own): each document's shingles, their hashes and then their second ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own for words in runs(batch.column(1), lower=True) for _, own in shingle_sets(words, size, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.shape[1] for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc", "n", "own"])

    return docs.mapInArrow(run, "doc long, n long, own binary")


def read_set(own: bytes) -> np.ndarray:
    return np.frombuffer(own, _U).reshape(2, -1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets, each sorted hashes and their second ones, are."""
    n, m = a.shape[1], b.shape[1]
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    at = np.minimum(np.searchsorted(b[0], a[0]), m - 1)
    both = int(np.count_nonzero((b[0, at] == a[0]) & (b[1, at] == a[1])))
    return both * 100 >= (n + m - both) * percent


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar. The members of a hub a are dealt into groups of about BLOCK, each with a copy of the hub's set."""
    members = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    dealt = pairs.join(members, "a").selectExpr("a", "b", "cast(pmod(xxhash64(b), g) AS int) AS g")
    left = members.selectExpr("a", "explode(sequence(0, g - 1)) AS g").join(sets.withColumnRenamed("doc", "a"), "a").selectExpr("a AS hub", "g AS part", "own AS held")
    right = dealt.join(sets.withColumnRenamed("doc", "b"), "b").selectExpr("a AS hub", "g AS part", "b AS other", "own AS held")

    def verify(hub: pa.Table, others: pa.Table) -> pa.Table:
        found: list[list[int]] = [[], []]
        of = [read_set(x) for x in hub.column("held").to_pylist()]
        for name, b in zip(others.column("other").to_pylist(), others.column("held").to_pylist(), strict=True):
            own = read_set(b)
            if any(similar(x, own, percent) for x in of):
                found[0].append(hub.column("hub")[0].as_py())
                found[1].append(name)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    deal = (shuffle_partitions(pairs.sparkSession), "hub", "part")  # small rows, much work: not to be put together by size
    return left.repartition(*deal).groupBy("hub", "part").cogroup(right.repartition(*deal).groupBy("hub", "part")).applyInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of every document with an edge: the smallest one it is connected with.

    In turns, a document's larger neighbours are linked to its smallest
    neighbour, then its smaller ones, until each component is a star.
    """
    edges = materialize(edges.selectExpr("greatest(a, b) AS x", "least(a, b) AS y").where("x <> y").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.selectExpr("y AS x", "x AS y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).selectExpr("x", "least(x, m) AS m")
        large = both.where("y > x").join(least, "x").selectExpr("y AS x", "m AS y").unionByName(least.where("m < x").selectExpr("x", "m AS y")).distinct()
        large = materialize(large.where("x <> y"), "edges")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        edges = materialize(small.where("y <> m").selectExpr("y AS x", "m AS y").unionByName(least.selectExpr("x", "m AS y")).distinct(), "edges")
    return materialize(edges.selectExpr("x AS doc", "y AS component").unionByName(edges.selectExpr("y AS doc", "y AS component").distinct()), "components")


def _stars(edges: DataFrame) -> bool:
    """Whether each document has one edge to a smaller one, which has none: that is then its component."""
    ends = edges.selectExpr("x AS doc", "1 AS down", "0 AS up").unionByName(edges.selectExpr("y AS doc", "0 AS down", "1 AS up"))
    return ends.groupBy("doc").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0").isEmpty()


def _size_class(percent: int) -> str:
    """Sets whose classes differ by more than one can't be similar."""
    return "n" if percent >= 100 else f"cast(floor(ln(n) / {math.log(100 / percent)!r}) AS long)"


#: Ids of blocks: class * 2**24 + place. A class has fewer than 2**24 blocks of one cell.
_CLASS = 1 << 24


def across(kept: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of different components that share a cell and whose sizes and sketches allow that they are similar.

    A cell's documents are dealt by classes of size into blocks of about BLOCK,
    and each two blocks of one class or of neighbouring ones meet in one group,
    however many documents the cell has.
    """
    known = kept.join(labels, "doc", "left").join(sets.select("doc", "n"), "doc").selectExpr("doc", "h", "coalesce(component, doc) AS component", f"{_size_class(percent)} AS c")
    known = materialize(known, "cells")
    open_cells = known.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("h")
    open_cells = materialize(known.join(open_cells, "h").groupBy("h", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")), "open-cells")
    beside = [open_cells.selectExpr("h", f"c + {d} AS c", f"g AS g{i}") for i, d in enumerate((1, -1))]
    counts = open_cells.join(beside[0], ["h", "c"], "left").join(beside[1], ["h", "c"], "left").selectExpr("h", "c", "g", "coalesce(g0, 0) AS below", "coalesce(g1, 0) AS above")
    rows = materialize(known.join(counts, ["h", "c"]).selectExpr("*", "cast(pmod(xxhash64(doc), g) AS int) AS i"), "open-rows")
    sets = sets.join(rows.select("doc").distinct(), "doc", "left_semi").select("doc", "n", "own")
    bits = SKETCH_BITS // 8
    edges = [0, *(x for x in (4, 8, 16) if x < bits // 8), bits // 8]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sketch(read_set(x)[0]).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc", "n", "bits"])

    sketches = sets.mapInArrow(sketched, "doc long, n long, bits binary")
    same = f"transform(sequence(0, g - 1), j -> struct(c * {_CLASS} + least(i, j) AS p, c * {_CLASS} + greatest(i, j) AS q))"
    up = f"transform(slice(sequence(0, above), 1, above), j -> struct(c * {_CLASS} + i AS p, (c + 1) * {_CLASS} + j AS q))"
    down = f"transform(slice(sequence(0, below), 1, below), j -> struct((c - 1) * {_CLASS} + j AS p, c * {_CLASS} + i AS q))"
    blocks = rows.join(sketches, "doc").selectExpr("h", f"c * {_CLASS} + i AS i", "doc", "component", "n", "bits", f"inline(concat({same}, {up}, {down}))")

    def near(words: list[np.ndarray], x: np.ndarray, y: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows whose sketches differ in at most ``room`` bits. A few words of the sketches at a time, as most pairs differ too much early."""
        for part in words:
            room = room - np.bitwise_count(part[x] ^ part[y]).sum(1, dtype=np.int64)
            x, y, room = x[room >= 0], y[room >= 0], room[room >= 0]
        return x, y

    def meet(rows: pa.Table) -> pa.RecordBatch:
        """The pairs of whole groups, rows of a group side by side: rows one apart, two apart, ..."""
        p, q, i, doc, c, n = (rows.column(x).to_numpy() for x in ("p", "q", "i", "doc", "component", "n"))
        sketches = np.frombuffer(b"".join(rows.column("bits").to_pylist()), _U).reshape(-1, bits // 8)
        words = [np.ascontiguousarray(sketches[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        first = _group_starts(rows)
        after = np.repeat(np.append(first[1:], len(p)), np.diff(np.append(first, len(p)))) - np.arange(len(p)) - 1  # rows of the group after each
        found, waiting, count = [np.empty((2, 0), np.int64)], [], 0
        x = np.arange(len(p))
        for k in range(1, int(after.max(initial=0)) + 1):
            x = x[after[x] >= k]
            y = x + k
            most = (n[x] + n[y]) * (100 - percent) // (100 + percent)  # that can differ
            ok = (c[x] != c[y]) & (doc[x] != doc[y]) & (np.abs(n[x] - n[y]) <= most) & ((p[x] == q[x]) | (i[x] != i[y]))
            waiting.append((x[ok], y[ok], most[ok]))
            count += int(ok.sum())
            if count >= 1 << 14 or k == after.max():
                a, b = near(words, *map(np.concatenate, zip(*waiting, strict=True)))
                found.append(np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])]))
                waiting, count = [], 0
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last group's rows so far: two blocks at most
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            last = int(_group_starts(rows)[-1])
            if last:
                yield meet(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield meet(pa.Table.from_batches(held))

    keys = ["h", "p", "q"]
    dealt = blocks.repartition(shuffle_partitions(kept.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "i", "doc", "component", "n", "bits").mapInArrow(stream, "a long, b long").distinct()


def _group_starts(rows: pa.Table) -> np.ndarray:
    """The first row of each group (h, p, q)."""
    new = np.ones(len(rows), bool)
    h, p, q = (rows.column(x).to_numpy() for x in ("h", "p", "q"))
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    return np.flatnonzero(new)


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) these ids; ids is a written table."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", how)


@dataclass(frozen=True)
class Search:
    """What is known of documents before any two are compared. All are written tables, but for ``same``."""

    sizes: DataFrame  # doc, n and sums: a row for each text
    alone: DataFrame  # doc, first: documents of a smaller one's set, left out of the search
    same: DataFrame  # a, b: other documents of equal sets
    kept: DataFrame  # doc, h: cells in which similar documents meet
    sets: DataFrame  # doc, n, own


def _search(docs: DataFrame, text: str, key: str, shingle: int, percent: int) -> Search:
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sizes = materialize(set_sizes(rows, shingle), "sizes")
    same = ["n", "s", "t"]
    several = sizes.where("n > 0").groupBy(*same).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    plural = materialize(sizes.distinct().groupBy("doc").count().where("count > 1").select("doc"), "several-texts")
    copies = materialize(sizes.join(materialize(several, "firsts"), same).where("doc > first").select("doc", "first").distinct(), "copies")
    alone = materialize(copies.join(plural, "doc", "left_anti"), "copies-alone")

    coarse, fine = Bands(percent, 0.5, 1 / 32), Bands(percent, 2.0, 1.0)
    searched = _only(rows, alone.select("doc"), "left_anti")
    partners = materialize(with_partners(searched, shingle, coarse), "partners")
    left = _only(searched, partners, "left_semi")
    kept = materialize(rarest_cells(left, shingle, fine), "rarest-cells")
    candidates = materialize(kept.select("doc").distinct(), "candidates")
    sets = materialize(full_sets(_only(left, candidates, "left_semi"), shingle), "sets")
    return Search(sizes, alone, copies.join(plural, "doc", "left_semi").selectExpr("first AS a", "doc AS b"), kept, sets)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Groups documents connected by links: 100 * shared shingles >= percent * all shingles of the two.

    Words are runs of other than ASCII white space, with A-Z in lower case.
    Returns key, n_shingles (distinct shingles) and component_id (the smallest
    key of the group). A text of fewer words than a shingle is one shingle; one
    without words, or null, links with nothing. Rows without a key are left
    out; a key with several texts is one document that any of them can link, with
    a row for each number of shingles. An empty table gives none; other columns
    are not read. Keys are integers.
    """
    own = _search(docs, text, key, shingle, percent)
    hubs = materialize(hub_pairs(own.kept), "hub-pairs")
    edges = materialize(linked(hubs, own.sets, percent).unionByName(own.same), "links")
    labels = components(edges)
    others = materialize(across(own.kept, labels, own.sets, percent).join(hubs, ["a", "b"], "left_anti"), "pairs-across")
    if not others.isEmpty():
        labels = components(edges.unionByName(linked(others, own.sets, percent)))

    named = own.sizes.select("doc", "n").distinct().join(own.alone, "doc", "left").selectExpr("doc", "n", "coalesce(first, doc) AS first")
    return named.join(labels.withColumnRenamed("doc", "first"), "first", "left").selectExpr(f"doc AS `{key}`", "n AS n_shingles", "coalesce(component, first) AS component_id")


def similar_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """((a, b), (doc, first)): every link between different sets, a < b, and which document of a smaller key each left-out copy equals.

    Of documents with equal sets the smallest stands for all. Their number grows
    with the square of a cluster of near copies, as the result does: where only
    groups are asked for, near_duplicates is the cheaper question. Edge cases as
    there.
    """
    own = _search(docs, text, key, shingle, percent)
    unlabelled = own.kept.limit(0).selectExpr("doc", "doc AS component")
    pairs = materialize(across(own.kept, unlabelled, own.sets, percent), "pairs")
    links = linked(pairs, own.sets, percent).unionByName(own.same).selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    return materialize(links, "links"), own.alone


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are the smallest of their group; those without a key stay, as do all columns, whatever their names."""
    name = unused(docs, "_gone")
    found = materialize(near_duplicates(docs, text, key).where(F.col("component_id") != F.col(key)).select(F.col(key).alias(name)).distinct(), "duplicates")
    gone = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""
