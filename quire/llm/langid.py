"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams weighted by term frequency and inverse
document frequency. Document frequencies cover every document learned from; the
weights are learned from a bounded sample of labelled documents by
follow-the-regularised-leader with an elastic net, and probabilities calibrated
by a temperature on documents of the sample that the weights didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, unused
from quire.llm.wordhash import texts_of

SLOTS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Labelled documents that the weights and the temperature are fitted on, at most, for all languages together.
SAMPLE_ROWS = 4096
#: Bytes of their n-grams that go to the driver, at most; with very long texts that is fewer rows.
SAMPLE_BYTES = 1 << 28
#: Languages that the driver has memory to learn (1 MB each for what FTRL keeps); more end the job, none is left out.
LANGUAGES = 512
#: Languages that a task adds up at once.
CLASSES = 16
#: One in so many of them is for the temperature alone.
CALIBRATE = 4
#: n-grams are handled in runs of about so many bytes of text.
RUN_BYTES = 1 << 18
_SPACE = 32
_SCALE = np.float32(100)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and what it counts as: letters in lower case, all else as space."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    folded = np.full(0x110000, _SPACE, np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        folded[i] = ord(low) if len(low) == 1 else i
    return letter, folded


@dataclass
class Run:
    """The n-grams of some texts of a batch. slots[bounds[i]:bounds[i + 1]] are text i's."""

    row: int
    slots: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray  # of each text


def ngram_runs(column: pa.Array) -> Iterator[Run]:
    letter, folded = _characters()
    data, offsets = texts_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        points = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = np.zeros(len(own) + 1, np.int64)
        np.cumsum((own & 0xC0) != 0x80, out=starts[1:])
        bounds = starts[offsets[i : j + 1] - offsets[i]]
        # every text gets max(ORDERS) spaces after it; n-grams that begin there count as spaces alone, whatever text is next
        pad = max(ORDERS)
        text = np.repeat(np.arange(j - i), np.diff(bounds))
        size = len(points) + pad * (j - i)
        codes = np.full(size + pad, _SPACE, np.uint32)
        codes[np.arange(len(points)) + pad * text] = folded[points]
        ends = bounds + pad * np.arange(j - i + 1)
        letters = np.zeros(len(points) + 1, np.int64)
        np.cumsum(letter[points], out=letters[1:])
        slots = np.empty((size, len(ORDERS)), np.uint16)
        h = np.zeros(size, np.uint32)
        at = 0
        for order in range(1, max(ORDERS) + 1):
            h = h * np.uint32(0x01000193) + codes[order - 1 : order - 1 + size] * np.uint32(0x9E3779B1)
            if order in ORDERS:
                x = h ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
                x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
                slots[:, at] = (x ^ (x >> np.uint32(15))) & np.uint32(SLOTS - 1)
                at += 1
        for back in range(1, pad):
            slots[ends[1:] - back] = slots[size - 1]
        yield Run(i, slots.ravel(), ends * len(ORDERS), np.diff(letters[bounds]))
        i = j


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of this partition each slot occurs; slot -1 has the number of texts."""
    total, seen, n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool), 0
    for batch in batches:
        for run in ngram_runs(batch.column(0)):
            for a, b in zip(run.bounds, run.bounds[1:], strict=False):
                seen[:] = False
                seen[run.slots[a:b]] = True
                total += seen
                n += 1
    at = np.flatnonzero(total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["slot", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term frequencies of each text: slots and shares."""
    for batch in batches:
        slots, shares, letters = [], [], []
        for run in ngram_runs(batch.column(2)):
            letters += run.letters.tolist()
            for a, b in zip(run.bounds, run.bounds[1:], strict=False):
                s, c = np.unique(run.slots[a:b], return_counts=True)
                slots.append(s.astype("<u2").tobytes())
                shares.append((c / max(1, b - a)).astype("<f4").tobytes())
        keep = pa.array(np.array(letters, np.int64) > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary()), pa.array(shares, pa.binary())], ["label", "ord", "slots", "shares"]).filter(keep)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.002, l2: float = 1e-4) -> np.ndarray:
    """Per-coordinate FTRL-proximal for softmax regression; rows are (slots, values, class)."""
    z, n = np.zeros((SLOTS, classes), np.float64), np.zeros((SLOTS, classes), np.float64)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            slots, x, label = rows[i]
            zs, ns = z[slots], n[slots]
            w = weights(zs, ns)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            more = ns + g * g
            zs += g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            z[slots], n[slots] = zs, more
    for a in range(0, SLOTS, 4096):
        z[a : a + 4096] = weights(z[a : a + 4096], n[a : a + 4096])
    return z


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # slot x class: what one occurrence adds, before division by the text's n-grams
    temperature: float

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: probability of each class, and its letters."""
        out, letters = [np.empty((0, len(self.classes)))], [np.empty(0, np.int64)]
        for run in ngram_runs(column):
            count = np.maximum(np.diff(run.bounds), 1)
            score = np.empty((len(count), len(self.classes)))
            for a in range(0, len(self.classes), CLASSES):
                gained = self.table[:, a : a + CLASSES][run.slots]
                gained = np.vstack([gained, np.zeros((1, gained.shape[1]), np.float32)])
                score[:, a : a + CLASSES] = np.add.reduceat(gained, run.bounds[:-1], axis=0, dtype=np.float64) / count[:, None] / self.temperature
            p = np.exp(score - score.max(1, keepdims=True))
            out.append(p / p.sum(1, keepdims=True))
            letters.append(run.letters)
        return np.concatenate(out), np.concatenate(letters)


def learn(labelled: DataFrame, text: str = "text", label: str = "lang", order: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits a model on rows with a label and a text; None where there are none.

    Document frequencies are counted over all rows. The weights see a sample of
    at most ``sample_rows`` rows and SAMPLE_BYTES, shared evenly among labels and
    taken by a hash of ``order``. Every label is learned; more than LANGUAGES, or
    than the sample has rows for, end the job.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    most = min(LANGUAGES, sample_rows)
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"there are more than {most} languages to learn; map them to fewer, or raise sample_rows and LANGUAGES")
    if not sizes:
        return None
    classes = sorted(sizes)
    counts = rows.select(text).mapInArrow(_document_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(SLOTS, np.float64)
    total = 0
    for slot, n in counts:
        if slot < 0:
            total = n
        else:
            frequency[slot] = n
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)

    most = max(1, sample_rows // len(classes))
    place = F.pmod(F.xxhash64(F.col(order), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(min(1.0, most / sizes[c])))])[F.col(label)]
    sampled = rows.where(place < share).select(F.col(label).alias("label"), place.alias("ord"), F.col(text).alias("text"))
    found = materialize(sampled.mapInArrow(_sparse, "label string, ord double, slots binary, shares binary"), "sample")
    room = Window.partitionBy("label").orderBy("ord", "slots").rowsBetween(Window.unboundedPreceding, 0)
    taken = found.withColumns({"_n": F.row_number().over(Window.partitionBy("label").orderBy("ord", "slots")), "_b": F.sum(F.length("slots") * 3).over(room)})
    taken = taken.where((F.col("_n") <= most) & (F.col("_b") <= SAMPLE_BYTES // len(classes)))
    by: dict[str, list] = {c: [] for c in classes}
    for r in sorted(taken.select("label", "ord", "slots", "shares").collect(), key=lambda r: (r.ord, r.label, bytes(r.slots))):
        by[r.label].append(r)
    fit, calibrate = [], []
    for k, c in enumerate(classes):
        for i, r in enumerate(by[c]):
            slots = np.frombuffer(r.slots, "<u2").astype(np.int64)
            row = (slots, np.frombuffer(r.shares, "<f4") * idf[slots] * _SCALE, k)
            (calibrate if i % CALIBRATE == CALIBRATE - 1 else fit).append(row)
    weights = fit_ftrl(fit, len(classes))
    scores = np.array([x @ weights[s] for s, x, _ in calibrate]).reshape(-1, len(classes))
    temperature = fit_temperature(scores, np.array([k for *_, k in calibrate], np.int64))
    return Model(classes, (weights * idf[:, None] * _SCALE).astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds lang_pred and score, or two other names, to the columns ``keep`` of docs.

    A text that is null or has no letters, or any text where nothing was
    learned, gets ``und`` with score 0. Repeated rows get the same answer each;
    an empty table gives none.
    """
    keep = keep if keep is not None else docs.columns
    # by number, as Spark passes no column whose name has a dot
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", lang string, score double"
    read = keep if text in keep else [*keep, text]
    at = read.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and n:
                p, letters = model.probabilities(batch.column(at))
                known = letters > 0
                best = p.argmax(1)
                lang[known] = np.array(model.classes, object)[best[known]]
                score[known] = p[np.arange(n), best][known]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score)], [*(f"c{i}" for i in range(len(keep))), "lang", "score"])

    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(read)]).mapInArrow(run, schema).toDF(*keep, *names)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from learning: by the checksum of its key. A null key isn't held out (and isn't learned from)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts every row's language.

    Returns key, held_out, lang_pred, score. Only text is an input of a prediction.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"), F.col(label).alias("_label"), held_out(key).alias("held_out"))
    model = learn(slim.where(~F.col("held_out") & F.col("_key").isNotNull()), "_t", "_label", "_key", sample_rows)
    return predict(slim, model, "_t", ["_key", "held_out"]).withColumnRenamed("_key", key)


def keep_identified(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those whose text has no letters, or whose most likely language has a probability under ``least``.

    Learns like identify. All columns, whatever their names, and repeated rows stay.
    """
    labelled = docs.where(~held_out(key) & F.col(key).isNotNull()).select(F.col(text).alias("_t"), F.col(label).alias("_label"), F.col(key).alias("_key"))
    model = learn(labelled, "_t", "_label", "_key", sample_rows)
    lang, score = unused(docs, "_lang"), unused(docs, "_score")
    found = predict(docs, model, text, names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
