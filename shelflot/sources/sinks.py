"""Report sinks and the alert append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.functions.money import money_text
from shelflot.functions.ranks import row_numbers


def display_rows(df: DataFrame, headers: dict[str, str], money: tuple[str, ...] = ()) -> DataFrame:
    """Report rows as they are shown: chosen columns under their headings, money with its sign."""
    return df.select(
        *[(money_text(c) if c in money else F.col(c)).alias(title) for c, title in headers.items()]
    )


def export_report(df: DataFrame, path: str, title: str, period: str, generated: str) -> None:
    """Write the rows as CSV with a header below ``path/rows``.

    Title, period and time of making go to ``path/about`` as one JSON row, so that the row
    files stay plain CSV, written in parallel.
    """
    base = path.rstrip("/")
    df.write.option("header", True).option("escape", '"').csv(f"{base}/rows")
    about = df.sparkSession.range(1).select(
        F.lit(title).alias("title"),
        F.lit(f"Period: {period}").alias("period"),
        F.lit(f"Generated: {generated}").alias("generated"),
    )
    about.write.json(f"{base}/about")


def report_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row; missing numbers become 0, missing texts stay null."""
    columns = [
        F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, T.NumericType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    packed = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(packed.alias(out))


def write_json(df: DataFrame, path: str) -> None:
    """Write ``report_json`` rows as JSON lines."""
    report_json(df, "value").write.text(path)


def append_alerts(alerts: DataFrame, new: DataFrame, created_at=None) -> DataFrame:
    """The alert table with new alerts added, numbered after the highest id so far.

    New alerts are unread. They take their ids in the order of all their columns, by a
    distributed count, so no task sees all of them.
    """
    from shelflot.functions.dates import moment

    if created_at is not None:
        new = new.withColumn("created_at", moment(created_at))
    extra = {
        "medicine_id": "bigint",
        "batch_id": "bigint",
        "priority": "string",
        "severity": "string",
        "created_at": "timestamp_ntz",
    }
    for name, kind in extra.items():
        if name not in new.columns:
            new = new.withColumn(name, F.lit(None).cast(kind))
    new = new.withColumn("is_read", F.lit(False)).drop("id")
    carried = ["alert_type", "message", *extra, "is_read"]
    last = alerts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    numbered = row_numbers(new.select(*carried), [], carried[:-1], "__n")
    numbered = numbered.withColumn("id", (F.col("__n") + last).cast("bigint")).drop("__n")
    return alerts.unionByName(numbered.select("id", *carried), allowMissingColumns=True)
