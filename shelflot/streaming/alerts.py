"""Alerts as a stream: the periodic check run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelflot.operators.alerts import stock_and_expiry_alerts
from shelflot.schema import ALERTS
from shelflot.sources.sinks import append_alerts


def stored_alerts(spark, path: str, before: int | None = None) -> DataFrame:
    """All alerts in the store, or those made before a micro-batch."""
    schema = "id bigint, alert_type string, message string, medicine_id bigint, batch_id bigint, " \
        "priority string, severity string, is_read boolean, created_at timestamp_ntz, epoch bigint"
    rows = spark.read.schema(schema).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("epoch") < before)
    return rows.select(*ALERTS.fieldNames())


def start_store(alerts: DataFrame, path: str) -> None:
    """Lay down the alerts known before the stream starts, as micro-batch -1."""
    alerts.select(*ALERTS.fieldNames()).write.mode("overwrite").parquet(f"{path}/epoch=-1")


def stream_alerts(
    source: DataFrame,
    snapshot: Callable[[], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    as_of: Callable[[], object],
    every: str | None = "5 minutes",
) -> StreamingQuery:
    """Run the stock and expiry check whenever ``source`` has news, adding to the alert store.

    ``snapshot`` gives (medicines, batches) as they are when the micro-batch runs, ``as_of``
    the day. A micro-batch writes its alerts to its own partition and reads only earlier ones,
    so one that is replayed overwrites what it wrote. Without ``every`` the query handles what
    is there and stops.
    """
    def check(_: DataFrame, epoch: int) -> None:
        medicines, batches = snapshot()
        spark = medicines.sparkSession
        today = as_of()
        earlier = stored_alerts(spark, path, epoch)
        new = stock_and_expiry_alerts(medicines, batches, earlier, today)
        grown = append_alerts(earlier.limit(0), new, created_at=f"{today} 00:00:00")
        last = earlier.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
        grown.withColumn("id", F.col("id") + last).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = source.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
