"""Incremental application of change sets as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.operators.mutation import Store, latest_operation

KEY = ["repo_id", "path"]

CHANGE = "repo_id string, path string, op string, seq long"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change rows from JSON files that arrive in a folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def apply_batch(store: Store, table: str, load: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What applies a batch of changes to a table: removals, then additions and modifications, as one commit with the
    batch's number, so one that is repeated after a failure is skipped. load gives the fresh rows of the keys it is
    handed. Only the buckets that a batch touches are written."""

    def apply(batch: DataFrame, number: int) -> None:
        done = store.metadata(f"batch:{table}")
        if done is not None and number <= int(done):
            return
        last = latest_operation(batch, KEY, ["seq"])
        come = last.where("op <> 'R'").select(*KEY)
        fresh = load(come).join(come, KEY, "left_semi")
        store.commit({table: store.replaced(table, last.select(*KEY), KEY, fresh)}, {f"batch:{table}": str(number)})

    return apply


def run(stream: DataFrame, store: Store, table: str, load: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """Apply all that has arrived to a table of the store; of a file's changes in a batch the last one counts. Changes
    that come in another order than they were made, over batches, need ordered.run."""
    query = stream.writeStream.foreachBatch(apply_batch(store, table, load)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
