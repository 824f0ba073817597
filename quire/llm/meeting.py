"""Finding where equal hashes of different documents meet, in one shuffle.

Some documents at a time send a row for each distinct hash: the smallest
document that has it, and the others packed beside it. Rows are dealt by hash
and sorted; a stream over them sees each hash's documents side by side. Where
one of these packs has many documents of a hash, only the smallest is dealt by
the hash; what becomes of the others is known already, so they are dealt apart,
and a hash that a third of all documents share costs its task a row a pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.wordhash import mix

PACKED, PACKED_TWICE = "h long, kind int, doc long, more binary", "h long, kind int, doc long, more binary, g long"
_NAMES = ["h", "kind", "doc", "more", "g"]
#: Kinds of rows: the smallest document of a hash whose others are dealt apart; all documents of a hash; such others (more starts with their hash, and doc is the smallest, which isn't one of them).
HEAD, WHOLE, APART = 0, 1, 2
#: Values that are packed at once.
PACK_VALUES = 1 << 18
#: A hash of more documents in one pack has them dealt apart, so many together.
HOT, TOGETHER = 256, 4096
_U = np.uint64


def _rows(h: np.ndarray, kind: np.ndarray, doc: np.ndarray, sizes: np.ndarray, more: np.ndarray, g: np.ndarray | None) -> pa.RecordBatch:
    offsets = np.zeros(len(h) + 1, np.int32)
    np.cumsum(sizes * 8, out=offsets[1:])
    listed = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(more.astype("<i8").tobytes())])
    columns = [pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(doc), listed] + ([] if g is None else [pa.array(g.view(np.int64))])
    return pa.RecordBatch.from_arrays(columns, _NAMES[: len(columns)])


def pack(hashes: np.ndarray, docs: np.ndarray, second: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for the distinct pairs (hash, document) of a batch; with a second hash, both make the hash."""
    order = np.lexsort((docs, hashes)) if second is None else np.lexsort((docs, second, hashes))
    h, d = hashes[order], docs[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    if second is not None:
        g = second[order]
        head[1:] |= g[1:] != g[:-1]
    new = head.copy()
    new[1:] |= d[1:] != d[:-1]
    h, d, head = h[new], d[new], head[new]
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(h)))
    hot = size > HOT
    apart = np.repeat(hot, size)
    yield _rows(h[at], np.where(hot, HEAD, WHOLE), d[at], np.where(hot, 0, size - 1), d[~head & ~apart], None if second is None else g[new][at])
    for i in np.flatnonzero(hot).tolist():
        others = d[at[i] + 1 : at[i] + size[i]]
        name, least = h[at[i] : at[i] + 1], d[at[i] : at[i] + 1]
        for a in range(0, len(others), TOGETHER):
            own = others[a : a + TOGETHER]
            key, none = mix(name + own[:1].view(_U)), None if second is None else np.zeros(1, _U)
            yield _rows(key, np.array([APART]), least, np.array([len(own) + 1]), np.concatenate([name.view(np.int64), own]), none)


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes if there are, kinds, documents, rows' smallest documents) of packed rows, each row's together."""
    h, kind, first = (batch.column(i).to_numpy() for i in range(3))
    h = h.view(_U)
    g = batch.column(4).to_numpy().view(_U) if batch.num_columns > 4 else None
    column = batch.column(3).cast(pa.binary())
    if len(column) == 0:
        return h, g, kind, first, first
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    others = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<i8") if data and offsets[-1] > offsets[0] else np.empty(0, np.int64)
    apart = kind == APART
    size = np.diff(offsets) // 8 + 1
    if apart.any():
        names = (offsets[:-1][apart] - offsets[0]) // 8
        h = h.copy()
        h[apart] = others[names].view(_U)
        others = np.delete(others, names)
        size[apart] -= 2
    starts = (np.cumsum(size) - size)[~apart]
    docs = np.empty(int(size.sum()), np.int64)
    rest = np.ones(len(docs), bool)
    rest[starts] = False
    docs[starts], docs[rest] = first[~apart], others
    return np.repeat(h, size), None if g is None else np.repeat(g, size), np.repeat(kind, size), docs, np.repeat(first, size)


def by_hash(packed: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by hash, those of one hash in this order."""
    return packed.repartition("h").sortWithinPartitions("h", *order)


def repeated(packed: DataFrame) -> DataFrame:
    """(doc, h, later) of each hash that more than one document has; later: a smaller document has it. Where there are second hashes, they are part of the hash."""
    twice = "g" in packed.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = last_doc = None  # the last hash, and the smallest document that has it
        told = True  # whether that document is out already
        for batch in batches:
            h, g, kind, d, _ = unpack(batch)
            apart = kind == APART
            known = [(d[apart], h[apart], np.ones(int(apart.sum()), bool))]  # a smaller document of their pack has it
            h, kind, d = (x[~apart] for x in (h, kind, d))
            g = np.zeros(1, _U) if g is None else g[~apart]
            if len(h):
                head = np.ones(len(h), bool)
                head[1:] = h[1:] != h[:-1]
                if twice:
                    head[1:] |= g[1:] != g[:-1]
                goes_on = last is not None and (int(h[0]), int(g[0])) == last
                at = np.flatnonzero(head)
                size = np.diff(np.append(at, len(h)))
                least = d[at].copy()  # rows come by smallest document, and each starts with its own
                if goes_on:
                    least[0] = last_doc
                later = d > np.repeat(least, size)
                shared = np.logical_or.reduceat(later | (kind == HEAD), at)
                out = np.repeat(shared, size)
                if goes_on and told:
                    out[: size[0]] = later[: size[0]]
                known.append((d[out], h[out], later[out]))
                if goes_on and not told and shared[0]:
                    known.append((np.array([last_doc]), h[:1], np.zeros(1, bool)))
                told = bool(shared[-1]) or (told and goes_on and len(at) == 1)
                last, last_doc = (int(h[-1]), int(g[-1])), int(least[-1])
            docs, hashes, flags = (np.concatenate(x) for x in zip(*known, strict=True))
            if len(docs):
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(hashes.view(np.int64)), pa.array(flags)], ["doc", "h", "later"])

    return by_hash(packed, *["g"] * twice, "doc", "kind").mapInArrow(stream, "doc long, h long, later boolean")


def emit(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]], twice: bool = False) -> DataFrame:
    """Packed rows of what ``hashes_of`` finds: (hashes, documents) arrays, or with ``twice`` also second hashes, packed some at a time to bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        count = 0
        for arrays in (x for batch in batches for x in hashes_of(batch)):
            found.append(arrays)
            count += len(arrays[0])
            if count >= PACK_VALUES:
                yield from pack(*map(np.concatenate, zip(*found, strict=True)))
                found, count = [], 0
        if found:
            yield from pack(*map(np.concatenate, zip(*found, strict=True)))

    return docs.mapInArrow(run, PACKED_TWICE if twice else PACKED)
