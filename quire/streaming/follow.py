"""Keeping up with a running translation: chunks are released in order, as state of a stream.

Chunks are announced in a folder of their own after the store has them, and the
stream reads that folder. Its state holds, for each book, the next chunk to be
released and the numbers that came before their turn; when a gap closes, they
are released together. A book that is prepared anew is another edition and
begins again at its first chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators.narration import first_gap
from quire.operators.store import Store
from quire.operators.translation import ARRIVALS, TRANSLATIONS, arrivals

RELEASED = "book_id string, edition string, chunk int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def released(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """The chunks of each book that are translated without a gap from its first on. chunks: book_id, chunk; done: with translation."""
    return first_gap(chunks.join(done.select("book_id", "chunk", "translation"), ["book_id", "chunk"], "left"))


class InOrder(StatefulProcessor):
    """Releases the chunks of a book's edition from 1 on, each once and after all before it, in whatever order they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "chunk int")
        self.waiting = handle.getMapState("waiting", "chunk int", "here boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.next.get()
        first = known[0] if known else 1
        came = {int(c) for frame in rows for c in frame["chunk"] if c >= first}
        after = first
        while True:
            if after in came:
                came.discard(after)
            elif self.waiting.containsKey((after,)):
                self.waiting.removeKey((after,))
            else:
                break
            after += 1
        for c in came:
            self.waiting.updateValue((c,), (True,))
        if after > first:
            self.next.update((after,))
            yield pd.DataFrame({"book_id": key[0], "edition": key[1], "chunk": pd.Series(range(first, after), dtype="int32")})

    def close(self) -> None:
        pass


def in_order(arrived: DataFrame) -> DataFrame:
    """RELEASED: what a stream of ARRIVALS releases. The session's state store must be one with column families; see follow."""
    return arrived.groupBy("book_id", "edition").transformWithStateInPandas(statefulProcessor=InOrder(), outputStructType=RELEASED, outputMode="Append", timeMode="None")


def follow(spark: SparkSession, store: Store, process: Callable[[DataFrame], None], checkpoint: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Calls ``process`` with the chunks (RELEASED) that can be worked on since the last time.

    A chunk is announced to the stream once and leaves it once. After a failure
    ``process`` may see the last ones again and must not do its work twice
    (pieces are stored by a key of their text).
    """
    store.ensure("arrivals")
    stream = spark.readStream.schema(ARRIVALS).parquet(f"{store.path}/arrivals")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps what the session had when it started
    try:
        writer = in_order(stream).writeStream.outputMode("append").foreachBatch(lambda new, _: process(new)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def wait_until_finished(query: StreamingQuery, chunks: DataFrame, store: Store, seconds: float = 60) -> None:
    """Lets a stream run until every chunk is translated and announced and what came has been processed, then ends it; a stream that fails raises."""
    while not query.awaitTermination(seconds):
        if finished(chunks, store):
            query.processAllAvailable()
            query.stop()
            return


def finished(chunks: DataFrame, store: Store) -> bool:
    """Whether every chunk is translated and announced."""
    done = store.read("translations", TRANSLATIONS).where(F.col("translation").isNotNull())
    return chunks.join(done, ["book_id", "chunk"], "left_anti").isEmpty() and chunks.join(arrivals(store), ["book_id", "chunk"], "left_anti").isEmpty()
