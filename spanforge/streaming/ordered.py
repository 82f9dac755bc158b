"""Changes in the order of their making (T3, T6): keyed state across batches, event time, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge.operators.mutation import Store
from spanforge.streaming.apply import KEY, apply_batch

CHANGE = "repo_id string, path string, op string, seq long, ts timestamp"
LATEST = "repo_id string, path string, op string, seq long"


class Latest(StatefulProcessor):
    """Of each file the last change that was seen: (seq, op). A change is passed on if it is newer than that.

    A file's state goes once the watermark is past its last change, as rows before the watermark don't come here.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, until = self.last.get() if self.last.exists() else (None, 0)
        newest = None
        for part in rows:
            part = part[part["seq"].notna()]
            if len(part):
                row = part.sort_values(["seq", "op"]).iloc[-1]
                if seq is None or row["seq"] > seq:
                    seq, newest = int(row["seq"]), row["op"]
                until = max(until, int(part["ts"].max().timestamp() * 1000))
        if seq is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        self.last.update((seq, until))
        if newest is not None:
            yield pd.DataFrame({"repo_id": [key[0]], "path": [key[1]], "op": [newest], "seq": [seq]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change rows with the time of their making, from JSON files that arrive in a folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def newest(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(repo_id, path, op, seq) of changes that are newer than all before them of their file, in whatever order and
    batch they come. Rows more than `late` behind the newest time are dropped, and state is kept for that long."""
    keyed = stream.where("ts is not null").withWatermark("ts", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(statefulProcessor=Latest(), outputStructType=LATEST, outputMode="Update", timeMode="EventTime")


def run(stream: DataFrame, store: Store, table: str, load: Callable[[DataFrame], DataFrame], checkpoint: str, late: str = "1 hour") -> None:
    """Apply all that has arrived to a table of the store, as apply.run does, but also where a change comes after a
    newer one of its file that an earlier batch had. State and offsets are in the checkpoint, so a restart goes on."""
    spark = store.spark
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = newest(stream, late).writeStream.foreachBatch(apply_batch(store, table, load)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
