"""Whole reports, composed of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import between_days, day, days_left
from shelflot.functions.money import TOTAL, amount
from shelflot.operators.inventory import expiry_buckets, inventory_stats, one_row
from shelflot.operators.joins import batches_enriched, sales_enriched
from shelflot.operators.sales import (
    WINDOWS,
    custom_summary,
    daily_sales,
    daily_totals,
    in_days,
    payment_breakdown,
    top_medicines,
    windows_from_days,
)
from shelflot.session import pinned

# Days back per period name, and the status texts of the expiry report.
PERIOD_DAYS = {"today": 0, "week": 7, "month": 30, "quarter": 90, "year": 365}
DEFAULT_DAYS = 30
STATUS_EXPIRED = "EXPIRED"
STATUS_URGENT = "URGENT (<15 days)"
STATUS_WARNING = "WARNING (15-90 days)"
STATUS_GOOD = "GOOD (>90 days)"


def period_bounds(period: str, as_of, start=None, end=None) -> tuple[Column, Column]:
    """First and last day of a named period, or of a custom one given both its days.

    An unknown name, or a custom period lacking a day, means the last 30 days.
    """
    if period == "custom" and start and end:
        return day(start), day(end)
    days = PERIOD_DAYS.get(period, DEFAULT_DAYS)
    return F.date_sub(day(as_of), days), day(as_of)


def in_period(df: DataFrame, ts: str, period: str, as_of, start=None, end=None) -> DataFrame:
    """Rows whose timestamp falls into the period, both its days included."""
    first, last = period_bounds(period, as_of, start, end)
    return df.filter(between_days(ts, first, last))


def _newest_first(df: DataFrame) -> list[Column]:
    return [F.desc("sold_on"), *[F.col(c) for c in df.columns if c != "sold_on"]]


def _sale_lines(sales, batches, medicines, period, as_of, start, end) -> DataFrame:
    lines = in_period(sales, "sold_on", period, as_of, start, end)
    return sales_enriched(lines, batches, medicines).select(
        F.to_date("sold_on").alias("sale_date"),
        "customer_name",
        "customer_phone",
        "medicine_name",
        "batch_no",
        "quantity_sold",
        "selling_price",
        F.col("total_amount").cast(TOTAL).alias("total_amount"),
        "payment_method",
        "sold_on",
    )


def sales_report(
    sales: DataFrame, batches: DataFrame, medicines: DataFrame, period: str, as_of, start=None, end=None
) -> DataFrame:
    """Sale lines of a period with customer, medicine and batch, newest first."""
    lines = _sale_lines(sales, batches, medicines, period, as_of, start, end)
    return lines.orderBy(*_newest_first(lines)).drop("sold_on")


def comprehensive_report(
    sales: DataFrame,
    batches: DataFrame,
    medicines: DataFrame,
    period: str,
    as_of,
    start=None,
    end=None,
    n: int = 100,
) -> DataFrame:
    """The newest ``n`` sale lines of a period, in six columns."""
    lines = _sale_lines(sales, batches, medicines, period, as_of, start, end).select(
        "sale_date", "customer_name", "medicine_name", "quantity_sold", "selling_price", "total_amount", "sold_on"
    )
    return lines.orderBy(*_newest_first(lines)).limit(n).drop("sold_on")


def inventory_report(medicines: DataFrame, batches: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Unexpired batches with their value at MRP, by medicine and expiry."""
    live = batches.filter(F.col("expiry_date") >= day(as_of))
    rows = batches_enriched(live, medicines).select(
        F.col("medicine_name").alias("name"),
        "category",
        "batch_no",
        "quantity",
        "mrp",
        "cost_price",
        "expiry_date",
        "supplier",
        amount("quantity", "mrp").cast(TOTAL).alias("stock_value"),
    )
    return rows.orderBy("name", "expiry_date", "batch_no") if ordered else rows


def expiry_report(medicines: DataFrame, batches: DataFrame, as_of, ordered: bool = True) -> DataFrame:
    """Unexpired batches with days left and a status, soonest first.

    A batch expiring on the day itself is listed and marked expired.
    """
    live = batches.filter(F.col("expiry_date") >= day(as_of))
    left = days_left("expiry_date", as_of)
    status = (
        F.when(left <= 0, STATUS_EXPIRED)
        .when(left <= 15, STATUS_URGENT)
        .when(left <= 90, STATUS_WARNING)
        .otherwise(STATUS_GOOD)
    )
    rows = batches_enriched(live, medicines).select(
        F.col("medicine_name").alias("name"),
        "batch_no",
        "quantity",
        "mrp",
        "expiry_date",
        left.alias("days_left"),
        status.alias("status"),
    )
    return rows.orderBy("expiry_date", "name", "batch_no") if ordered else rows


def summary_report(
    medicines: DataFrame, batches: DataFrame, sales: DataFrame, as_of, top: int = 6
) -> dict[str, DataFrame]:
    """The sections of the summary: windows, inventory, expiry, top_medicines, daily_sales.

    Windows and the daily chart come from the same totals per day, a few hundred rows that are
    stored, so that the sales of the year are read once for both.
    """
    today = day(as_of)
    recent = in_days(sales, F.date_sub(today, max(WINDOWS.values())))
    days = pinned(daily_totals(recent))
    week = days.filter(F.col("sale_date") >= F.date_sub(today, WINDOWS["week"]))
    return {
        "windows": windows_from_days(days, as_of),
        "inventory": inventory_stats(medicines, batches, as_of),
        "expiry": expiry_buckets(batches, as_of),
        "top_medicines": top_medicines(sales, batches, medicines, F.date_sub(today, WINDOWS["month"]), n=top),
        "daily_sales": week.select("sale_date", "total_units", "total_revenue"),
    }


def custom_report(
    medicines: DataFrame, batches: DataFrame, sales: DataFrame, start, end, top: int = 10
) -> dict[str, DataFrame]:
    """The sections of a report between two days, both required: summary, daily_breakdown,
    top_medicines, payment_breakdown."""
    if not start or not end:
        raise ValueError("start and end are required")
    return {
        "summary": custom_summary(sales, start, end),
        "daily_breakdown": daily_sales(sales, start, end, ordered=False),
        "top_medicines": top_medicines(sales, batches, medicines, start, end, n=top),
        "payment_breakdown": payment_breakdown(sales, start, end),
    }


# Section -> the column that names its items; sections without one hold a single row.
ITEM = {
    "windows": "window",
    "top_medicines": "name",
    "daily_sales": "sale_date",
    "daily_breakdown": "sale_date",
    "payment_breakdown": "payment_method",
}
ORDER = {
    "windows": ["window"],
    "top_medicines": ["-total_sold", "id"],
    "daily_sales": ["sale_date"],
    "daily_breakdown": ["sale_date"],
    "payment_breakdown": ["payment_method"],
}


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """A report as rows (section, item, metric, value), values as DOUBLE."""
    def long(section: str, df: DataFrame) -> DataFrame:
        item = F.col(ITEM[section]).cast("string") if section in ITEM else F.lit("all")
        if section == "top_medicines":
            item = F.concat(F.col("id").cast("string"), F.lit(" "), F.col("name"))
        metrics = [c for c in df.columns if c not in (ITEM.get(section), "id")]
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs))

    frames = [long(section, df) for section, df in sections.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def report_document(sections: dict[str, DataFrame]) -> DataFrame:
    """A report as one row: a struct per single-row section, a list of structs per other one.

    The lists are short by definition: the windows, the top medicines, one entry per day or
    payment method.
    """
    def packed(section: str, df: DataFrame) -> DataFrame:
        if section not in ITEM:
            return df.agg(F.max(F.struct(*df.columns)).alias(section))
        keys = [
            (-F.col(k[1:])).alias(f"__{i}") if k.startswith("-") else F.col(k).alias(f"__{i}")
            for i, k in enumerate(ORDER[section])
        ]
        ranked = F.struct(*keys, F.struct(*df.columns).alias("entry"))
        listed = F.sort_array(F.collect_list(ranked))
        return df.agg(F.transform(listed, lambda e: e["entry"]).alias(section))

    return one_row(*[packed(section, df) for section, df in sections.items()])
