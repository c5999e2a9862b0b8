"""Changes that come in bursts, passed on once they have settled: state and timers for each path."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What leaves the operator; times are numbers, so no worker's time zone plays a part.
_OUT = "path string, text string, at long, seq long"
_COLUMNS = ["path", "text", "at", "seq"]


class Settle(StatefulProcessor):
    """Holds the last change of a path until none has come for `quiet` microseconds of event time.

    State a path is one change and the highest sequence number, so it doesn't grow with changes; a
    change with a number that isn't higher was delivered before, or late, and is dropped.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each access is a round trip to the state: what waits (without a time: nothing), and the highest number
        self.known = handle.getValueState("known", "text string, at long, seq long, highest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text, at, seq, highest = self.known.get() or (None, None, None, None)
        due = None if at is None else self._due(at)
        # sorted by time within a number, and as they came within both; a few tuples a path, for which a frame costs more than the work
        new = sorted((t for part in rows for t in zip(part["text"].tolist(), part["at"].tolist(), part["seq"].tolist())), key=lambda t: t[:0:-1])
        out = []
        for next_text, next_at, next_seq in new:
            if highest is not None and next_seq <= highest:
                continue
            highest = next_seq
            if at is not None and next_at - at > self.quiet:
                out.append((key[0], text, at, seq))
            text, at, seq = next_text, next_at, next_seq
        if at is not None:
            self.known.update((text, at, seq, highest))
            if due != self._due(at):
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(self._due(at))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        text, at, seq, highest = self.known.get() or (None, None, None, None)
        if at is not None:
            self.known.update((None, None, None, highest))
            yield pd.DataFrame([(key[0], text, at, seq)], columns=_COLUMNS)

    def _due(self, at: int) -> int:
        return (at + self.quiet) // 1000

    def close(self) -> None:
        pass


def settled(feed: DataFrame, quiet: str = "200 milliseconds", late: str = "0 seconds") -> DataFrame:
    """A feed (path, text, changed, seq) with of each burst the last change alone, when event time has passed it by `quiet`.

    A burst of a path ends where the next change comes more than `quiet` later, however many micro-batches it
    spans. late: how far changes may come out of order. Changes without a time or number are dropped. Start the query inside state_store().
    """
    keyed = feed.filter("changed IS NOT NULL AND seq IS NOT NULL").withColumn("at", F.unix_micros("changed")).withWatermark("changed", late).groupBy("path")
    out = keyed.transformWithStateInPandas(Settle(pd.Timedelta(quiet) // pd.Timedelta("1us")), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return out.select("path", "text", F.timestamp_micros("at").alias("changed"), "seq")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state where timers are supported."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
