"""Query traffic as a stream: rollups merged batch by batch, and calls counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.traffic import merge, rollup


def ingest_stream(log: DataFrame, catalog, dataset: str, checkpoint: str, **trigger):
    """A running query that merges each micro-batch of log rows into a dataset's traffic table. A batch that is replayed
    after a failure is recognised by its number, which is published together with the table, and not added twice."""

    def add(batch: DataFrame, number: int) -> None:
        if int(catalog.mark(dataset, "traffic") or -1) >= number:
            return
        new = rollup(batch)
        old = catalog.table(dataset, "traffic")
        catalog.put_table(dataset, "traffic", merge(old, new) if old is not None else new, str(number))

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_calls(events: DataFrame, key: str, ts: str = "ts", window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Calls by key and event-time window; rows later than the watermark are left out and their state goes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide or window), key).agg(F.count(F.lit(1)).alias("calls")).select(F.col("window.start").alias("start"), key, "calls")
