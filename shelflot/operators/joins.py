"""The shared joins.

Catalyst broadcasts a side whose size it knows to be under
``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution re-checks that with measured
sizes. Otherwise the join is by shuffle, where adaptive execution splits a hot key. The one
broadcast by hint is in ``lookup_join``, which measures the table first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.functions.dates import day
from shelflot.functions.money import amount

NULL_SPREAD = 256
SMALL_BYTES = 32 * 1024 * 1024
SALTS = 32


def left_join_nullable(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on a key that is often NULL.

    NULL keys match nothing, yet would all hash to one partition; a second key spreads them.
    """
    spread = F.when(
        F.col(left_key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(NULL_SPREAD)).cast("int")
    ).otherwise(F.lit(0))
    keyed = right.withColumnRenamed(right_key, "__right").withColumn("__zero", F.lit(0))
    return (
        left.withColumn("__spread", spread)
        .join(
            keyed,
            (F.col(left_key) == F.col("__right")) & (F.col("__spread") == F.col("__zero")),
            "left",
        )
        .drop("__right", "__spread", "__zero")
    )


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of a table hold, roughly: texts by their length, the rest at 16 each."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    fixed = 16 * len(df.columns)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(fixed))
    return df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0


def lookup_join(
    facts: DataFrame, table: DataFrame, key: str, spread: str, small_bytes: int = SMALL_BYTES
) -> DataFrame:
    """Join many rows with few distinct keys to a table that is usually small.

    The table is measured and broadcast if it is small. If not, each of its rows is repeated
    for ``SALTS`` salts and the facts of one key are spread over them by ``spread``, so a key
    held by a large part of the facts still meets the table in many tasks.
    """
    if measured_bytes(table) <= small_bytes:
        return facts.join(F.broadcast(table), key)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(table.withColumn("__salt", salts), [key, "__salt"]).drop("__salt")


def small(table: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """The table, marked for broadcast if it measures as small."""
    return F.broadcast(table) if measured_bytes(table) <= small_bytes else table


def sales_enriched(sales: DataFrame, batches: DataFrame, medicines: DataFrame) -> DataFrame:
    """Sale lines with their batch number, medicine and value; lines without either are dropped.

    Batches meet medicines first: both are far smaller than the sales, which are joined once.
    """
    lots = batches_enriched(batches, medicines).select(
        F.col("id").alias("batch_id"), "batch_no", "medicine_id", "medicine_name"
    )
    return sales.join(lots, "batch_id").withColumn("total_amount", amount())


def batches_enriched(batches: DataFrame, medicines: DataFrame) -> DataFrame:
    """Batches with the name and category of their medicine; orphans are dropped."""
    named = medicines.select(F.col("id").alias("medicine_id"), F.col("name").alias("medicine_name"), "category")
    return batches.join(named, "medicine_id")


def medicines_left_batches(medicines: DataFrame, batches: DataFrame, as_of=None) -> DataFrame:
    """Medicines with their batches, if any.

    With ``as_of``, expired batches are removed after the join: a medicine that has only
    expired batches disappears, one that never had a batch stays.
    """
    lots = batches.select(
        F.col("id").alias("batch_id"), "medicine_id", "batch_no", "quantity", "mrp", "cost_price", "expiry_date"
    )
    joined = (
        medicines.select(F.col("id").alias("medicine_id"), "name", "category")
        .join(lots, "medicine_id", "left")
    )
    if as_of is None:
        return joined
    return joined.filter((F.col("expiry_date") >= day(as_of)) | F.col("batch_id").isNull())


def alerts_enriched(alerts: DataFrame, medicines: DataFrame, batches: DataFrame) -> DataFrame:
    """Alerts with the medicine name and batch number they point to, where they point to one."""
    names = medicines.select("id", F.col("name").alias("medicine_name"))
    lots = batches.select("id", "batch_no")
    with_name = left_join_nullable(alerts, _renamed(names), "medicine_id", "__id")
    return left_join_nullable(with_name, _renamed(lots), "batch_id", "__id")


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "__id")


def total_stock(batches: DataFrame, as_of=None) -> DataFrame:
    """Units per medicine over all batches, or over those expiring after ``as_of``."""
    live = batches if as_of is None else batches.filter(F.col("expiry_date") > day(as_of))
    return live.groupBy("medicine_id").agg(F.sum("quantity").cast("bigint").alias("total_stock"))


def with_total_stock(
    df: DataFrame, batches: DataFrame, as_of=None, key: str = "id"
) -> DataFrame:
    """Add each medicine's stock; NULL when no batch counts. ``key`` holds the medicine id."""
    stock = total_stock(batches, as_of).withColumnRenamed("medicine_id", key)
    return df.join(stock, key, "left")


def not_alerted_today(
    batches: DataFrame,
    alerts: DataFrame,
    alert_type: str,
    severity: str | None,
    as_of,
    null_aware: bool = False,
) -> DataFrame:
    """Batches without an alert of this type (and severity) made on ``as_of``.

    With ``null_aware`` one such alert without a batch suppresses every batch, as NOT IN over
    a NULL does; it is read as one flag, so the join itself stays a hash anti join.
    """
    today = alerts.filter((F.col("alert_type") == alert_type) & (F.to_date("created_at") == day(as_of)))
    if severity is not None:
        today = today.filter(F.col("severity") == severity)
    alerted = today.filter(F.col("batch_id").isNotNull()).select(F.col("batch_id").alias("id")).distinct()
    kept = batches.join(alerted, "id", "left_anti")
    if not null_aware:
        return kept
    has_null = today.agg(
        F.coalesce(F.bool_or(F.col("batch_id").isNull()), F.lit(False)).alias("has_null")
    ).scalar()
    return kept.filter(~has_null)


def orphan_batches(batches: DataFrame, medicines: DataFrame) -> DataFrame:
    """Batches whose medicine no longer exists."""
    known = medicines.select(F.col("id").alias("medicine_id"))
    return batches.join(known, "medicine_id", "left_anti").select(*batches.columns)
