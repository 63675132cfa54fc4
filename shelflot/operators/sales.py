"""Sales figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import between_days, day
from shelflot.functions.money import amount, ratio, total, units
from shelflot.operators.joins import sales_enriched

# Calendar windows, in days before the day of the report.
WINDOWS = {"today": 0, "week": 7, "month": 30, "year": 365}


def in_days(sales: DataFrame, start=None, end=None) -> DataFrame:
    """Sales from ``start`` to ``end``, both days included; either may be left open."""
    if start is not None:
        sales = sales.filter(between_days("sold_on", start, end))
    elif end is not None:
        sales = sales.filter(F.to_date("sold_on") <= day(end))
    return sales


def _summary() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_sales"),
        units("quantity_sold").alias("total_units"),
        total(amount()).alias("total_revenue"),
    ]


def _average() -> Column:
    return ratio(F.col("total_revenue"), F.col("total_sales"))


def sales_window_stats(sales: DataFrame, start=None, end=None) -> DataFrame:
    """Lines, units, revenue and average line value of one window, 0 over no sales."""
    return in_days(sales, start, end).agg(*_summary()).withColumn("avg_transaction", _average())


def sales_by_window(sales: DataFrame, as_of, upper_bound: bool = False) -> DataFrame:
    """``sales_window_stats`` for today and the last 7, 30 and 365 days from one scan.

    Each window counts its first day too. Without ``upper_bound`` only today's window ends at
    ``as_of``. Lines are first summed per day, then each of the few hundred days is added to
    the windows that hold it.
    """
    longest = max(WINDOWS.values())
    recent = in_days(sales, F.date_sub(day(as_of), longest), as_of if upper_bound else None)
    return windows_from_days(daily_totals(recent), as_of)


def daily_totals(sales: DataFrame) -> DataFrame:
    """Lines, units and revenue per day."""
    return sales.groupBy(F.to_date("sold_on").alias("sale_date")).agg(*_summary())


def windows_from_days(days: DataFrame, as_of) -> DataFrame:
    """Window figures from daily totals, a row per window whether or not it had sales."""
    ago = F.datediff(day(as_of), F.col("sale_date"))
    windows = F.array(
        *[
            F.struct(F.lit(name).alias("window"), ((ago == 0) if n == 0 else (ago <= n)).alias("inside"))
            for name, n in WINDOWS.items()
        ]
    )
    measured = days.select(F.inline(windows), "total_sales", "total_units", "total_revenue").filter("inside")
    names = days.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in WINDOWS])).alias("window"),
        F.lit(0).cast("bigint").alias("total_sales"),
        F.lit(0).cast("bigint").alias("total_units"),
        F.lit(0).cast("decimal(38,2)").alias("total_revenue"),
    )
    return (
        measured.drop("inside")
        .unionByName(names)
        .groupBy("window")
        .agg(
            F.sum("total_sales").cast("bigint").alias("total_sales"),
            units("total_units").alias("total_units"),
            total("total_revenue").alias("total_revenue"),
        )
        .withColumn("avg_transaction", _average())
    )


def sales_stats_30d(sales: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Revenue, units, distinct customers and revenue per unit since ``days`` days ago."""
    start = F.date_sub(day(as_of), days)
    return (
        in_days(sales, start)
        .agg(
            total(amount()).alias("total_revenue"),
            units("quantity_sold").alias("total_units"),
            F.countDistinct("customer_name").alias("unique_customers"),
        )
        .withColumn("avg_unit_price", ratio(F.col("total_revenue"), F.col("total_units")))
    )


def custom_summary(sales: DataFrame, start, end) -> DataFrame:
    """``sales_window_stats`` between two days, with the number of distinct customers."""
    return (
        in_days(sales, start, end)
        .agg(*_summary(), F.countDistinct("customer_name").alias("unique_customers"))
        .withColumn("avg_transaction", _average())
    )


def daily_sales(sales: DataFrame, start=None, end=None, ordered: bool = True) -> DataFrame:
    """Units, revenue and number of lines per day."""
    rows = daily_totals(in_days(sales, start, end)).withColumnRenamed("total_sales", "transactions")
    return rows.orderBy("sale_date") if ordered else rows


def payment_breakdown(sales: DataFrame, start=None, end=None) -> DataFrame:
    """Number of lines and value per payment method."""
    return (
        in_days(sales, start, end)
        .groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("transactions"), total(amount()).alias("total_amount"))
    )


def recent_sales(sales: DataFrame, batches: DataFrame, medicines: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` sale lines with batch number, medicine and value."""
    rows = sales_enriched(sales, batches, medicines)
    rest = [c for c in rows.columns if c != "sold_on"]
    return rows.orderBy(F.desc("sold_on"), *rest).limit(n)


def top_medicines(
    sales: DataFrame, batches: DataFrame, medicines: DataFrame, start=None, end=None, n: int = 6
) -> DataFrame:
    """The ``n`` medicines with most units sold.

    Lines are summed per batch before any join, so what is joined is at most one row per batch
    however many lines a batch has; batches are then summed per medicine.
    """
    per_batch = (
        in_days(sales, start, end)
        .groupBy("batch_id")
        .agg(F.sum("quantity_sold").alias("units"), F.sum(amount()).alias("revenue"))
    )
    per_medicine = (
        per_batch.join(batches.select(F.col("id").alias("batch_id"), "medicine_id"), "batch_id")
        .groupBy("medicine_id")
        .agg(units("units").alias("total_sold"), total("revenue").alias("total_revenue"))
    )
    return (
        medicines.select("id", "name")
        .join(per_medicine.withColumnRenamed("medicine_id", "id"), "id")
        .orderBy(F.desc("total_sold"), "id")
        .limit(n)
    )
