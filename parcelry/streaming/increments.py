"""Incremental application of a stream of snapshots: each micro-batch goes through the same change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import risk
from ..operators.buckets import BucketedTable
from ..operators.snapshots import Table, apply_changes


def apply_stream(changes: DataFrame, keys: Sequence[str], columns: Sequence[str], nodes_path: str, state_path: str, checkpoint: str, n_buckets: int | None = None) -> StreamingQuery:
    """Applies every micro-batch with apply_changes. A repeated batch finds its own hashes in the state and is skipped.
    With n_buckets, both tables are bucketed, so a micro-batch writes only the buckets that it changes."""
    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        nodes, state = (Table(spark, p) if n_buckets is None else BucketedTable(spark, p, keys, n_buckets) for p in (nodes_path, state_path))
        apply_changes(batch, keys, columns, nodes, state)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_counts(applications: DataFrame, state_path: str, checkpoint: str, keys: Sequence[str] = risk.KEYS, n_buckets: int | None = None) -> StreamingQuery:
    """Adds every micro-batch of applications to the state of the scorecard. A batch has its number as its name, so one
    that is repeated after a failure is added once."""
    def one(batch: DataFrame, number: int) -> None:
        risk.add_applications(risk.card_state(batch.sparkSession, state_path, keys, n_buckets), batch, f"batch {number}", keys)

    return applications.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
