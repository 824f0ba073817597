"""Packing documents' tokens into sequences of a fixed capacity.

How many sequences are needed, and what goes where, depends on the pieces only
through their lengths. So the planners below work on the number of pieces of
each length - a table of at most ``capacity`` rows, whatever the corpus - and
give *runs*: the pieces of one length with ranks ``rank .. rank + count`` go to
the sequences ``sequence .. sequence + count``, all at one offset. Spark then
ranks the pieces of each length and looks up the run of each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import materialize
from quire.llm.tokens import Encoder, added_tokens, default_path, library

CAPACITY, END = 2048, 0
#: Texts that a task holds as strings.
TEXTS_AT_ONCE = 1024
#: Bytes of the matrix rows that a task makes at once, one row at least.
MATRIX_BYTES = 1 << 23
Run = tuple[int, int, int, int, int]  # length, rank, count, sequence, offset


class Runs:
    """Collects runs and keeps the next free rank of each length and sequence."""

    def __init__(self):
        self.runs: list[Run] = []
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count

    def together(self, lengths: list[int], times: int) -> None:
        """``times`` new sequences, each of these lengths in this order."""
        offset = 0
        for x in lengths:
            self.put(x, times, self.sequences, offset)
            offset += x
        self.sequences += times


class CapacityTree:
    """Segment tree over capacities 0 .. n: the smallest one at or above x that has open sequences."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.has = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        i = self.size + capacity
        while i:
            self.has[i] += change
            i >>= 1

    def at_least(self, x: int) -> int | None:
        i = self.size + x
        if self.has[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.has[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


class SortedCapacities:
    """The same by a sorted list, for the few capacities that residuals leave open."""

    def __init__(self):
        self.open: list[int] = []
        self.count: dict[int, int] = defaultdict(int)

    def add(self, capacity: int, change: int) -> None:
        before = self.count[capacity]
        self.count[capacity] += change
        if not before:
            insort(self.open, capacity)
        elif not before + change:
            self.open.remove(capacity)

    def at_least(self, x: int) -> int | None:
        i = bisect_left(self.open, x)
        return self.open[i] if i < len(self.open) else None


def best_fit(counts: dict[int, int], capacity: int, out: Runs, search) -> Runs:
    """Best-fit decreasing over counts: sequences that look alike are kept, and filled, as one range."""
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity left -> (first sequence, how many)

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            ranges[left].append((first, n))
            search.add(left, n)

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        todo = counts[length]
        while todo and (left := search.at_least(length)) is not None:
            first, n = ranges[left].pop()
            search.add(left, -n)
            took = min(todo, n)
            out.put(length, took, first, capacity - left)
            leave(left - length, first, took)
            leave(left, first + took, n - took)
            todo -= took
        each = capacity // length
        full, rest = divmod(todo, each)
        for n, of in ((full, each), (1 if rest else 0, rest)):
            if n:
                first = out.sequences
                out.together([length] * of, n)
                leave(capacity - of * length, first, n)
    return out


def plan_best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> Runs:
    return best_fit(counts, capacity, Runs(), CapacityTree(capacity))


class SumIndex:
    """Which single lengths, pairs and triples of lengths make a sum, under the counts that are left.

    Pairs are indexed by their sum: for each, the larger lengths in rising order,
    two bytes each, at most capacity**2 / 4 in all. A triple is a length and an
    indexed pair of what it lacks. Pairs of which a length is used up are dropped
    from a sum's list when a search has passed over many of them.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for x, n in counts.items():
            self.have[x] = n
        self.held: list[int] = []
        self.present = np.flatnonzero(self.have)
        self.pairs: list[np.ndarray] = []
        there = self.have > 0
        for total in range(capacity + 1):
            high = self.present[np.searchsorted(self.present, (total + 1) // 2) : np.searchsorted(self.present, total)]
            self.pairs.append(high[there[total - high]].astype(np.uint16))

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the larger one as large as can be, at most ``most``."""
        own, have = self.pairs[total], self.have
        first = int(np.searchsorted(own, most, "right")) - 1
        for i in range(first, -1, -1):
            high = int(own[i])
            if have[high] > 0 and have[total - high] > 0 and (high * 2 != total or have[high] > 1):
                if first - i > 8:
                    left = own[i : first + 1].astype(np.int64)
                    # what is held for the sequence in the making is at least one, so nothing that comes back is dropped
                    kept = left[(self.spare(left) > 0) & (self.spare(total - left) > 0)]
                    self.pairs[total] = np.concatenate([own[:i], kept.astype(np.uint16), own[first + 1 :]])
                return high, total - high
        return None

    def spare(self, lengths: np.ndarray) -> np.ndarray:
        """Counts with what is held for the sequence in the making."""
        return self.have[lengths] + np.isin(lengths, self.held)

    def hold(self, *lengths: int) -> None:
        self.held = [*self.held, *lengths]
        for x in lengths:
            self.have[x] -= 1

    def free(self) -> None:
        for x in self.held:
            self.have[x] += 1
        self.held = []

    def filling(self, gap: int, most: int) -> list[int] | None:
        """One, two or three available lengths, none above ``most``, that fill a gap exactly."""
        if gap <= most and self.have[gap] > 0:
            return [gap]
        if found := self.pair(gap, most):
            return list(found)
        low, high = np.searchsorted(self.present, [(gap + 2) // 3, min(most, gap - 2) + 1])
        for x in self.present[low:high][::-1].tolist():
            if self.have[x] > 0:
                self.hold(x)
                found = self.pair(gap - x, x)
                self.have[x] += 1
                self.held.pop()
                if found:
                    return [x, *found]
        return None


def plan_exact_complement(counts: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """Fills gaps exactly by one, two or three pieces while counts allow, then best-fits what is left.

    From the longest length down, each is completed by a single length, else by
    a pair, else by a triple whose sum is the gap, as the index of sums has them. A
    combination is used as often as the counts of its members allow.
    """
    out, index = Runs(), SumIndex(counts, capacity)
    have = index.have
    if have[capacity]:
        out.together([capacity], int(have[capacity]))
        have[capacity] = 0
    residual: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            index.hold(length)
            found = index.filling(capacity - length, length)
            index.free()
            if not found:
                residual[length] = int(have[length])
                have[length] = 0
                break
            lengths = [length, *found]
            times = min(int(have[x]) // lengths.count(x) for x in lengths)
            out.together(lengths, times)
            for x in lengths:
                have[x] -= times
    return best_fit(residual, capacity, out, SortedCapacities())


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first shorter where it doesn't come out even."""
    if n <= capacity:
        return [(0, n)]
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


#: Rank bases are broadcast up to so many rows (about 140 bytes each as Spark holds them), joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def token_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenizes every text, ends it by ``end`` and cuts what is longer than ``capacity``.

    Returns key, piece, start, length, ids_crc32, the task that made the row and
    the row's rank among those of its length there, and, if asked for, ids
    (little-endian unsigned 16-bit, 32-bit for larger vocabularies).
    A null text counts as empty; a null key stays null; other columns are not
    read. To be materialized before use: ranks hold within one run.
    """
    path = path or default_path()
    names = [key, "piece", "start", "length", "ids_crc32", "_task", "_rank"] + ["ids"] * with_ids
    kinds = [docs.schema[key].dataType.simpleString(), "int", "long", "long", "long", "int", "long"] + ["binary"] * with_ids
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    added = added_tokens(path)
    width = "<u2" if library(path).get_vocab_size() <= 1 << 16 else "<u4"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, ranks = Encoder(path, added), TaskContext.get().partitionId(), defaultdict(int)
        for batch in (b.slice(i, TEXTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, TEXTS_AT_ONCE)):
            rows: list[tuple] = []

            def flush(kind=batch.schema.field(0).type):
                columns = list(zip(*rows, strict=True)) or [()] * 8
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)][: len(names)], names)

            for k, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                ids.append(end)
                ids = np.array(ids, "<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((k, i, start, length, zlib.crc32(own.tobytes()), task, ranks[length], own.astype(width).tobytes() if with_ids else None))
                    ranks[length] += 1
                if with_ids and len(rows) > 2000:
                    yield flush()
                    rows.clear()
            yield flush()

    return docs.select(F.col(key), F.col(text)).mapInArrow(pieces, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def task_counts(pieces: DataFrame) -> DataFrame:
    """Pieces of each length in each task."""
    return pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))


def length_counts(pieces: DataFrame) -> tuple[dict[int, int], int]:
    """Pieces of each length, which come as as many rows as there are lengths, and how many rows task_counts has."""
    rows = task_counts(pieces).groupBy("length").agg(F.sum("_n"), F.count("*")).collect()
    return {r[0]: r[1] for r in rows}, sum(r[2] for r in rows)


def assign(pieces: DataFrame, plan: Callable[[dict[int, int]], Runs]) -> DataFrame:
    """Adds sequence_id and offset to materialized pieces, by the rank of each among those of its length.

    The rank is the rank within the piece's task after all pieces of this length
    in earlier tasks; so a length that a third of all pieces have needs no
    gathering of its rows.
    """
    counts, rows = length_counts(pieces)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = task_counts(pieces).select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if rows <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    at = _lookup(plan(counts).runs)(F.col("length"), F.col("_base") + F.col("_rank"))
    kept = [c for c in pieces.columns if c not in ("_task", "_rank")]
    return pieces.join(starts, ["length", "_task"]).withColumn("_at", at).select(*kept, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def _lookup(runs: list[Run]):
    """The runs are at most a few for each length up to the capacity, however large the corpus."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shift = 44  # up to 2**44 pieces of one length
    keys = (table[:, 0] << shift) | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def lookup(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (length << shift) | rank, "right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank - table[at, 1], "offset": table[at, 4]})

    return lookup


def pack_exact_complement(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Packs every document into as few sequences as exact-complement hashing finds.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset: one row a
    piece. Sequences have no gaps between pieces. A null or empty text is one
    piece holding the end token; repeated rows are packed as often as they
    occur; ties go by the order of rows in their task; an empty table gives no
    rows; other columns are not read. A null key stays null.
    """
    pieces = materialize(token_pieces(docs, text, key, capacity, end, path), "pieces")
    return assign(pieces, lambda counts: plan_exact_complement(counts, capacity))


def sequence_rows(batches: Iterator[pa.RecordBatch], capacity: int, width: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Matrix rows from pieces that come sorted by sequence and offset; the last sequence of a batch waits for the next one."""
    at_once, rest = max(1, MATRIX_BYTES // (width * capacity)), None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        of = rest.column(0).to_numpy()
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for i in range(0, len(cuts), at_once):
            first = int(cuts[i - 1]) if i else 0
            yield _matrix_rows(rest.slice(first, int(cuts[min(i + at_once, len(cuts)) - 1]) - first), capacity, width, names)
        if len(cuts):
            rest = rest.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield _matrix_rows(rest, capacity, width, names)


def _matrix_rows(pieces: pa.RecordBatch, capacity: int, width: int, names: list[str]) -> pa.RecordBatch:
    """Whole sequences, one row each. Columns: sequence_id, offset, key, piece, start, length, ids_crc32, ids."""
    of, offset, length = (pieces.column(i).to_numpy() for i in (0, 1, 5))
    ends = offset + length
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    edges = np.r_[firsts, len(of)]
    n, n_tokens = len(firsts), ends[edges[1:] - 1]

    ids = pieces.column(7).cast(pa.large_binary())
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    matrix = np.zeros((n, width * capacity), np.uint8)
    matrix[np.arange(width * capacity) < width * n_tokens[:, None]] = np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]]
    places = pa.py_buffer(np.arange(n + 1, dtype=np.int64) * (width * capacity))

    cumulative = np.zeros(len(of) + n, np.int64)
    cumulative[np.arange(len(of)) + np.repeat(np.arange(n), np.diff(edges)) + 1] = ends
    lists = pa.array(edges, pa.int32())
    columns = [
        pa.array(of[firsts], pa.int64()),
        pa.array(n_tokens, pa.int64()),
        pa.Array.from_buffers(pa.large_binary(), n, [None, places, pa.py_buffer(matrix)]).cast(pa.binary()),
        pa.ListArray.from_arrays(pa.array(edges + np.arange(n + 1), pa.int32()), pa.array(cumulative)),
        pa.ListArray.from_arrays(lists, pa.array(offset, pa.int64())),
        pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(pieces.columns[2:7], pieces.schema.names[2:7])),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def packed_matrices(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """Best-fit-decreasing packing into rows of ``capacity`` ids.

    Returns one row a sequence: sequence_id, n_tokens, input_ids (binary: the
    little-endian ids, 16-bit for vocabularies up to 65,536, padded by zero to
    the capacity), cu_seqlens (array: 0, then where each piece ends),
    position_resets (array: where positions start again at 0: each piece's
    first place) and pieces (array of key, piece, start, length, ids_crc32 in
    their order, from which each document can be put together without loss).
    Pieces are sorted within partitions, and a task holds one Arrow batch of
    them and a sequence; see quire.llm.common.bound_batches.
    Edge cases as in pack_exact_complement.
    """
    path = path or default_path()
    width = 2 if library(path).get_vocab_size() <= 1 << 16 else 4
    pieces = materialize(token_pieces(docs, text, key, capacity, end, path, with_ids=True), "pieces")
    placed = assign(pieces, lambda counts: plan_best_fit_decreasing(counts, capacity))
    parts = ["piece", "start", "length", "ids_crc32"]
    rows = placed.select("sequence_id", "offset", key, *parts, "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    piece = T.StructType([placed.schema[c] for c in (key, *parts)])
    kinds = {"sequence_id": T.LongType(), "n_tokens": T.LongType(), "input_ids": T.BinaryType(), "cu_seqlens": T.ArrayType(T.LongType()), "position_resets": T.ArrayType(T.LongType()), "pieces": T.ArrayType(piece)}
    return rows.mapInArrow(lambda batches: sequence_rows(batches, capacity, width, list(kinds)), T.StructType([T.StructField(n, k) for n, k in kinds.items()]))
