"""Reconciliation of a stream, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.config import ReconConfig
from tallyframe.operators.reconcile import ONLY_1, reconcile


def reconcile_stream(reference: DataFrame | Callable[[], DataFrame], stream: DataFrame, config: ReconConfig, path: str, checkpoint: str, profile: str = "typed", available_now: bool = False, **options) -> StreamingQuery:
    """Reconciles each micro-batch of stream, as the second table, with reference, and writes the classified rows to path.

    Rows that only the reference has are left out: they may be in a batch to come. Each batch is written to a folder of
    its own (batch=<id>), so a batch that is done again replaces itself. A callable gives a reference read anew each time.
    """

    def one(batch: DataFrame, number: int) -> None:
        source = reference() if callable(reference) else reference
        found = reconcile(source, batch, config, profile, **options).classified
        found.filter(F.col("_status") != ONLY_1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
