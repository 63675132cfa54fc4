"""Point lookups, filters and search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import day, days_left
from shelflot.functions.money import amount
from shelflot.functions.text import contains_pattern, or_na
from shelflot.operators.joins import with_total_stock


def by_id(df: DataFrame, ids: int | Iterable[int] | DataFrame, key: str = "id") -> DataFrame:
    """Rows with the given id, ids, or ids of another table (first column)."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        return df.join(wanted, key, "left_semi")
    if isinstance(ids, int):
        return df.filter(F.col(key) == ids)
    return df.filter(F.col(key).isin(list(ids)))


def sellable(batches: DataFrame, as_of) -> DataFrame:
    """Batches in stock that expire after ``as_of``."""
    return batches.filter((F.col("quantity") > 0) & (F.col("expiry_date") > day(as_of)))


def sellable_batches(batches: DataFrame, as_of, medicine_id: int | None = None) -> DataFrame:
    """What can be sold of a medicine, or of all of them, soonest to expire first."""
    found = sellable(batches, as_of)
    if medicine_id is not None:
        found = found.filter(F.col("medicine_id") == medicine_id)
    return found.select("id", "medicine_id", "batch_no", "quantity", "mrp", "expiry_date").orderBy(
        "expiry_date", "id"
    )


def available_stock(batches: DataFrame) -> DataFrame:
    """Batches in stock, whatever their expiry."""
    return batches.filter(F.col("quantity") > 0)


def search_medicines(
    medicines: DataFrame, batches: DataFrame, query: str | None, as_of, limit: int = 20
) -> DataFrame:
    """Medicines whose name, category or composition contains the query, with unexpired stock.

    The rows are limited before they meet the batches, so stock is summed for those only.
    """
    found = medicines
    wanted = (query or "").strip()
    if wanted:
        pattern = F.lit(wanted)
        found = found.filter(
            contains_pattern(F.col("name"), pattern)
            | contains_pattern(F.col("category"), pattern)
            | contains_pattern(F.col("composition"), pattern)
        )
    top = found.select("id", "name", "category", "composition").orderBy("name", "id").limit(limit)
    held = batches.join(top.select(F.col("id").alias("medicine_id")), "medicine_id", "left_semi")
    return (
        with_total_stock(top, held, as_of)
        .withColumn("total_stock", F.coalesce("total_stock", F.lit(0)).cast("bigint"))
        .orderBy("name", "id")
    )


def medicine_batches(
    medicines: DataFrame, batches: DataFrame, as_of, medicine_id: int | None = None, near_days: int = 15
) -> DataFrame:
    """Batches with a status text: Expired, the days left, Good, or Unknown without a date.

    One medicine's batches come soonest first; for all medicines the rows are not sorted.
    """
    if medicine_id is not None:
        medicines = medicines.filter(F.col("id") == medicine_id)
        batches = batches.filter(F.col("medicine_id") == medicine_id)
    left = days_left("expiry_date", as_of)
    status = (
        F.when(left.isNull(), "Unknown")
        .when(left < 0, "Expired")
        .when(left <= near_days, F.concat(left.cast("string"), F.lit(" days")))
        .otherwise("Good")
    )
    known = medicines.select(F.col("id").alias("medicine_id"), F.col("name").alias("medicine_name"))
    rows = batches.join(known, "medicine_id").select(
        "medicine_id", "medicine_name", "id", "batch_no", "quantity", "mrp", "expiry_date", status.alias("status")
    )
    return rows if medicine_id is None else rows.orderBy(F.asc_nulls_first("expiry_date"), "id")


def medicine_sales(sales: DataFrame, batches: DataFrame, medicine_id: int | None = None) -> DataFrame:
    """Sales by medicine: day, customer, batch number, quantity and value; N/A for empty texts."""
    lots = batches.select(F.col("id").alias("batch_id"), "medicine_id", "batch_no")
    if medicine_id is not None:
        lots = lots.filter(F.col("medicine_id") == medicine_id)
    rows = sales.join(lots, "batch_id").select(
        "medicine_id",
        F.coalesce(F.to_date("sold_on").cast("string"), F.lit("N/A")).alias("sale_date"),
        or_na("customer_name").alias("customer_name"),
        or_na("batch_no").alias("batch_no"),
        "quantity_sold",
        amount().alias("amount"),
    )
    return rows if medicine_id is None else rows.orderBy(F.desc("sale_date"), *rows.columns[2:])
