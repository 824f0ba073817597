"""Cutting a book's segments into chunks, parts and slices by their words.

Where a group ends depends on where it began, which no window frame can say. So
a book is dealt by ranges of its order, and each range says how many groups start
in it, and what is open at its end, for every place the first cut in it can have;
there are no more such places than words in one group. What two ranges say can be
put together into what both say as one, so ranges meet by a tree: never more than
FAN of them in one task, however long the book is. Then each range knows what is
open where it begins, and is numbered by itself. No task holds more than a range
of a book, FAN summaries, or one file; texts stay where they are, and are read
once: their words are written as numbers first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.common import written
from quire.operators.ordered import PART, spread

CHUNK_WORDS, SLICE_WORDS = 8000, 40000
#: Ranges of a book, or of what was put together from them, that meet in one task.
FAN = 64


def packed_groups(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Group numbers of items taken in order, each group of at most ``limit`` in all; an item beyond it is alone."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.zeros(len(sizes), np.int64)
    i = 0
    while i < len(sizes):
        starts[i] = 1
        i = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
    return np.cumsum(starts) - 1


def even_parts(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Part numbers of items taken in order: as few parts as the limit allows, each closed once it has an even share."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    parts = max(1, -(-int(total[-1]) // limit))
    cuts = [0]
    while len(cuts) < parts:
        cuts.append(min(len(sizes), int(np.searchsorted(total, total[cuts[-1]] + total[-1] / parts, "left"))))
    starts = np.bincount([c for c in set(cuts) if c < len(sizes)], minlength=len(sizes))[: len(sizes)]
    return np.cumsum(starts) - 1


def full_slices(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Slice numbers of items taken in order, each slice closed once it has reached the limit."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.zeros(len(sizes), np.int64)
    i = 0
    while i < len(sizes):
        starts[i] = 1
        i = int(np.searchsorted(total, total[i] + limit, "left"))
    return np.cumsum(starts) - 1


def chunk_numbers(files: np.ndarray, words: np.ndarray, limit: int) -> np.ndarray:
    """Chunk numbers, from 1, of a book's segments in order: whole files while they fit, longer files in even parts."""
    first = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]]))
    size = np.add.reduceat(words, first)
    group = packed_groups(size, limit)
    span = np.diff(np.append(first, len(files)))
    part = np.zeros(len(files), np.int64)
    for i in np.flatnonzero(size > limit):
        part[first[i] : first[i] + span[i]] = even_parts(words[first[i] : first[i] + span[i]], limit)
    at = np.stack([np.repeat(group, span), part])
    return np.cumsum(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(0)]))


@dataclass(frozen=True)
class Cut:
    """How groups end. ``after``: where the next group starts, from running sums (0 first) and the sum at which the open one
    began. ``enters``: which of a range's places is cut first, from the sums before the places, the range's sum and what is
    open where it begins; the number of places where none is."""

    after: Callable[[np.ndarray, np.ndarray | int, int], np.ndarray]
    enters: Callable[[np.ndarray, int, np.ndarray | int, int], np.ndarray]


def _place_that_fits(reach: np.ndarray, total: int, open_: np.ndarray | int, limit: int) -> np.ndarray:
    left = limit - np.asarray(open_)
    return np.where(total <= left, len(reach), np.maximum(0, np.searchsorted(reach, left, "right") - 1))


#: As packed_groups and as full_slices do.
FITTING = Cut(lambda total, at, limit: np.searchsorted(total, np.asarray(at) + limit, "right") - 1, _place_that_fits)
REACHING = Cut(lambda total, at, limit: np.searchsorted(total, np.asarray(at) + limit, "left"), lambda reach, total, open_, limit: np.searchsorted(reach, limit - np.asarray(open_), "left"))


@dataclass(frozen=True)
class Span:
    """A stretch of a book as a function of what is open where it begins.

    ``reach`` are the sums before the places that can be cut first: those up to
    the limit and one beyond, of places with equal sums the first and the last.
    ``starts`` is how many groups start from such a cut on, ``open`` what is
    open at the end then. ``total`` and ``more`` are sums of the whole stretch.
    """

    total: int
    more: int
    reach: np.ndarray
    starts: np.ndarray
    open: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, more: np.ndarray, limit: int, cut: Cut) -> Span:
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = _places(total[:-1], limit)
        reach, starts, last = total[at], np.zeros(len(at), np.int64), at.copy()
        while (alive := at < len(sizes)).any():
            last[alive] = at[alive]
            starts += alive
            at[alive] = np.maximum(at[alive] + 1, cut.after(total, total[at[alive]], limit))
        return Span(int(total[-1]), int(more.sum()), reach, starts, total[-1] - total[last])

    def passed(self, open_: np.ndarray, limit: int, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """What is open at the end, and the groups that started, for what is open at the beginning."""
        place = cut.enters(self.reach, self.total, open_, limit)
        inside = place < len(self.reach)
        place = np.where(inside, place, 0)
        return np.where(inside, self.open[place], open_ + self.total), np.where(inside, self.starts[place], 0)

    def then(self, other: Span, limit: int, cut: Cut) -> Span:
        """This stretch and the one behind it as one. Associative."""
        open_, started = other.passed(self.open, limit, cut)
        reach = np.concatenate([self.reach, self.total + other.reach])
        kept = _places(reach, limit)
        starts, open_ = np.concatenate([self.starts + started, other.starts]), np.concatenate([open_, other.open])
        return Span(self.total + other.total, self.more + other.more, reach[kept], starts[kept], open_[kept])


def _places(reach: np.ndarray, limit: int) -> np.ndarray:
    """Which of ascending sums a Span keeps."""
    reach = reach[: np.searchsorted(reach, limit, "right") + 1]
    new = np.diff(reach) > 0
    return np.flatnonzero(np.append(True, new) | np.append(new, True))


def _numbered(items: DataFrame, order: list[str], limit: int, cut: Cut, name: str) -> DataFrame:
    """(book_id, order, name): the number, from 1, of the group of each item; items: book_id, order, words and more, by which numbers rise after an item."""
    kind = items.schema["book_id"].dataType.simpleString()
    dealt = spread(items.select("book_id", *order, F.col("words").cast("long").alias("words"), F.col("more").cast("long").alias("more")), ["book_id"], order)
    keys, spans = [PART, "book_id"], f"{PART} int, book_id {kind}, total long, more long, reach array<long>, starts array<long>, open array<long>"

    def row(rows: pd.DataFrame, span: Span) -> pd.DataFrame:
        return rows[keys].head(1).assign(total=span.total, more=span.more, reach=[span.reach], starts=[span.starts], open=[span.open])

    def spans_of(rows: pd.DataFrame) -> Iterator[Span]:
        for r in rows.sort_values(PART).itertuples(index=False):
            yield Span(r.total, r.more, np.asarray(r.reach), np.asarray(r.starts), np.asarray(r.open))

    def survey(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "words"], kind="stable")
        return row(rows, Span.of(rows["words"].to_numpy(np.int64), rows["more"].to_numpy(np.int64), limit, cut))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        first, *others = spans_of(rows)
        for span in others:
            first = first.then(span, limit, cut)
        return row(rows, first).assign(**{PART: rows[PART].min() // FAN})

    def carry(rows: pd.DataFrame, open_: int, number: int) -> pd.DataFrame:
        found = []
        for span in spans_of(rows):
            found.append((open_, number))
            passed, started = span.passed(np.asarray(open_), limit, cut)
            open_, number = int(passed), number + int(started) + span.more
        return rows.sort_values(PART)[keys].assign(open=[f[0] for f in found], number=[f[1] for f in found])

    def before(surveyed: DataFrame, ranges: int) -> DataFrame:
        """(PART, book_id, open, number) where each span begins."""
        out = f"{PART} int, book_id {kind}, open long, number long"
        if ranges <= FAN:
            # nothing is open: the first item starts a group
            return surveyed.groupBy("book_id").applyInPandas(lambda rows: carry(rows, limit + 1, 0), out)
        surveyed = written(surveyed, "spans")
        block = [F.expr(f"{PART} div {FAN}").cast("int").alias("_block"), F.col("book_id")]
        above = before(surveyed.groupBy(*block).applyInPandas(joined, spans), -(-ranges // FAN))
        going_on = lambda rows, at: carry(rows, int(at["open"].iloc[0]), int(at["number"].iloc[0]))
        return surveyed.groupBy(*block).cogroup(above.groupBy(*keys)).applyInPandas(going_on, out)

    def number(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "words"], kind="stable")
        total = np.concatenate([[0], np.cumsum(rows["words"].to_numpy(np.int64))])
        more = rows["more"].to_numpy(np.int64)
        starts = np.zeros(len(rows), np.int64)
        i = max(0, int(cut.after(total, -int(at["open"].iloc[0]), limit)))
        while i < len(rows):
            starts[i] = 1
            i = max(i + 1, int(cut.after(total, total[i], limit)))
        return rows[["book_id", *order]].assign(**{name: int(at["number"].iloc[0]) + np.cumsum(starts) + np.cumsum(more) - more})

    ranges = (dealt.agg(F.max(PART)).first()[0] or 0) + 1
    carried = before(dealt.groupBy(*keys).applyInPandas(survey, spans), ranges)
    places = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in order)
    return dealt.groupBy(*keys).cogroup(carried.groupBy(*keys)).applyInPandas(number, f"book_id {kind}, {places}, {name} int")


def chunks(segments: DataFrame, limit: int = CHUNK_WORDS) -> DataFrame:
    """(book_id, file_pos, idx, chunk): the chunk, from 1, of every segment of a book."""
    own, file = ["book_id", "file_pos", "idx"], ["book_id", "file_pos"]
    sized = segments.select("book_id", F.col("file_pos").cast("long").alias("file_pos"), F.col("idx").cast("int").alias("idx"), "words")
    sized = written(sized.withColumn("_file", F.sum("words").over(Window.partitionBy(*file))), "sized")
    cut = written(parts(sized.where(F.col("_file") > limit), limit), "parts")
    whole = sized.where(F.col("_file") <= limit)
    files = whole.groupBy(*file).agg(F.sum("words").alias("words"), F.lit(0).alias("more"))
    # a longer file is alone, however long; its parts are numbers of their own
    files = files.unionByName(cut.groupBy(*file).agg(F.lit(limit + 1).alias("words"), (F.max("part") - 1).alias("more")))
    first = _numbered(files, ["file_pos"], limit, FITTING, "chunk").select(F.col("book_id").alias("_b"), F.col("file_pos").alias("_f"), "chunk")
    rows = whole.select(*own, F.lit(1).alias("part")).unionByName(cut)
    joined = rows.join(first, F.col("book_id").eqNullSafe(F.col("_b")) & F.col("file_pos").eqNullSafe(F.col("_f")))
    return joined.select(*own, (F.col("chunk") + F.col("part") - 1).alias("chunk"))


def slices(segments: DataFrame, limit: int = SLICE_WORDS) -> DataFrame:
    """(book_id, file_pos, idx, slice): the slice, from 1, of every segment, for gathering terms; slices cross files and chunks."""
    items = segments.select("book_id", F.col("file_pos").cast("long").alias("file_pos"), F.col("idx").cast("int").alias("idx"), "words", F.lit(0).alias("more"))
    return _numbered(written(items, "sized"), ["file_pos", "idx"], limit, REACHING, "slice")


def parts(segments: DataFrame, limit: int) -> DataFrame:
    """(book_id, file_pos, idx, part): each file in even parts, from 1. A task holds a batch and the numbers of one file, not its texts."""
    kind = segments.schema["book_id"].dataType.simpleString()
    names = ["book_id", "file_pos", "idx", "part"]

    def numbered(rows: pa.Table) -> pa.RecordBatch:
        """Whole files, side by side."""
        first, words = _first_rows(rows), rows.column("words").to_numpy()
        part = np.concatenate([even_parts(own, limit) + 1 for own in np.split(words, first[1:])])
        columns = [rows.column(c).combine_chunks() for c in names[:3]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.int32())], names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last file's rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            last = int(_first_rows(rows)[-1])
            if last:
                yield numbered(rows.slice(0, last))
            held = rows.slice(last).combine_chunks().to_batches()
        if held:
            yield numbered(pa.Table.from_batches(held))

    sized = segments.select("book_id", F.col("file_pos").cast("long").alias("file_pos"), F.col("idx").cast("int").alias("idx"), F.col("words").cast("long").alias("words"))
    dealt = sized.repartition("book_id", "file_pos").sortWithinPartitions("book_id", "file_pos", "idx", "words")
    return dealt.mapInArrow(fold, f"book_id {kind}, file_pos long, idx int, part int")


def _first_rows(rows: pa.Table) -> np.ndarray:
    """The first row of each file in rows sorted by file."""
    new = np.ones(len(rows), bool)
    new[1:] = False
    for name in ("book_id", "file_pos"):
        column = rows.column(name).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(rows) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
        new[1:] |= differ
    return np.flatnonzero(new)


def slice_texts(segments: DataFrame, limit: int = SLICE_WORDS) -> DataFrame:
    """(book_id, slice, text): each slice's segments with blank lines between. A slice is bounded by its words."""
    numbered = segments.join(slices(segments, limit), ["book_id", "file_pos", "idx"])
    row = F.struct("file_pos", "idx", "text")
    return numbered.groupBy("book_id", "slice").agg(F.array_sort(F.collect_list(row)).alias("s")).select("book_id", "slice", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"))


def chunk_id(number: str = "chunk"):
    """The number as text of four digits, or more where it needs them."""
    return F.when(F.col(number) < 10000, F.lpad(F.col(number).cast("string"), 4, "0")).otherwise(F.col(number).cast("string"))
