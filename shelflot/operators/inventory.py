"""Stock and expiry figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import day, days_left
from shelflot.functions.money import TOTAL, amount, ratio, total, units
from shelflot.functions.ranks import GROUP_LIMIT, row_numbers
from shelflot.operators.lookup import sellable

# Thresholds that results depend on.
NEAR_DAYS = 15
SOON_DAYS = 90
LOW_STOCK = 20


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side: stack them, then take the only value of each column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _per_medicine(batches: DataFrame, *aggregates: Column) -> DataFrame:
    return batches.groupBy("medicine_id").agg(*aggregates)


def stock_by_medicine(medicines: DataFrame, batches: DataFrame, ordered: bool = True) -> DataFrame:
    """Every medicine with its units in stock and its number of batches."""
    held = _per_medicine(
        batches, F.sum("quantity").alias("total_stock"), F.count("id").alias("batch_count")
    ).withColumnRenamed("medicine_id", "id")
    rows = medicines.join(held, "id", "left").withColumns(
        {
            "total_stock": F.coalesce("total_stock", F.lit(0)).cast("bigint"),
            "batch_count": F.coalesce("batch_count", F.lit(0)).cast("bigint"),
        }
    )
    return rows.orderBy("name", "id") if ordered else rows


def low_stock_medicines(medicines: DataFrame, batches: DataFrame, max_total: int = LOW_STOCK) -> DataFrame:
    """Medicines with 1 to ``max_total`` units over all batches; none at all is not low."""
    low = (
        _per_medicine(batches, F.sum("quantity").cast("bigint").alias("total_stock"))
        .filter((F.col("total_stock") > 0) & (F.col("total_stock") <= max_total))
        .withColumnRenamed("medicine_id", "id")
    )
    return medicines.select("id", "name").join(low, "id")


def expiry_buckets(batches: DataFrame, as_of, near_days: int = NEAR_DAYS, soon_days: int = SOON_DAYS) -> DataFrame:
    """Batches expired, near expiry, expiring soon and good; a batch without a date is in none."""
    left = days_left("expiry_date", as_of)
    return batches.agg(
        F.count_if(left < 0).alias("expired_count"),
        F.count_if(left.between(0, near_days)).alias("near_expiry_count"),
        F.count_if(left.between(near_days + 1, soon_days)).alias("expiring_soon_count"),
        F.count_if(left > soon_days).alias("good_stock_count"),
    )


def dashboard_stats(medicines: DataFrame, batches: DataFrame, sales: DataFrame, as_of) -> DataFrame:
    """Headline counts in one row; each table is read once, batches twice."""
    left = days_left("expiry_date", as_of)
    stocked = F.col("quantity") > 0
    return one_row(
        medicines.agg(F.count(F.lit(1)).alias("medicines")),
        batches.agg(
            F.count(F.lit(1)).alias("batches"),
            F.count_if(stocked & left.between(0, NEAR_DAYS)).alias("near_expiry"),
            F.count_if(stocked & (left < 0)).alias("expired"),
        ),
        sales.agg(units("quantity_sold").alias("sales"), total(amount()).alias("revenue")),
        low_stock_medicines(medicines, batches).agg(F.count(F.lit(1)).alias("low_stock")),
    )


def inventory_stats(medicines: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """Medicines, batches, units and value of the unexpired stock, with the margin on its cost.

    Expired batches leave after the outer join: a medicine with expired batches only is not
    counted, one without any batch is. Batches are summed per medicine before the join.
    """
    live = F.col("expiry_date") >= day(as_of)

    def kept(value: Column) -> Column:
        return F.sum(F.when(live, value))

    held = _per_medicine(
        batches,
        F.count_if(live).alias("n"),
        kept(F.col("quantity")).alias("quantity"),
        kept(amount("quantity", "mrp")).alias("at_mrp"),
        kept(amount("quantity", "cost_price")).alias("at_cost"),
    ).withColumnRenamed("medicine_id", "id")
    sums = (
        medicines.select("id")
        .join(held, "id", "left")
        .filter((F.col("n") > 0) | F.col("n").isNull())
        .agg(
            F.count(F.lit(1)).alias("total_medicines"),
            units("n").alias("total_batches"),
            units("quantity").alias("total_quantity"),
            total("at_mrp").alias("stock_value"),
            total("at_cost").alias("cost_value"),
        )
    )
    gain = (F.col("stock_value") - F.col("cost_value")).cast(TOTAL)
    margin = F.when(F.col("cost_value") > 0, ratio(gain, F.col("cost_value")) * 100).otherwise(0.0)
    return sums.withColumn("profit_margin", margin)


def medicine_stats(medicines: DataFrame, batches: DataFrame, as_of, near_days: int = NEAR_DAYS) -> DataFrame:
    """Per medicine: units, value at MRP, batches, and batches needing attention."""
    left = days_left("expiry_date", as_of)
    held = _per_medicine(
        batches,
        units("quantity").alias("total_stock"),
        total(amount("quantity", "mrp")).alias("total_value"),
        F.count("id").alias("batch_count"),
        F.count_if(left < 0).alias("expired"),
        F.count_if(left.between(0, near_days)).alias("near_expiry"),
    ).withColumnRenamed("medicine_id", "id")
    none = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("total_stock", "batch_count", "expired", "near_expiry")}
    return (
        medicines.select("id", "name")
        .join(held, "id", "left")
        .withColumns({**none, "total_value": F.coalesce("total_value", F.lit(0)).cast(TOTAL)})
        .withColumn("need_attention", F.col("expired") + F.col("near_expiry"))
    )


def batches_by_medicine(
    medicines: DataFrame,
    batches: DataFrame,
    as_of,
    page_size: int = 1000,
    group_limit: int = GROUP_LIMIT,
    ordered: bool = True,
) -> DataFrame:
    """Medicines that can be sold, each with the list of its sellable batches, soonest first.

    The list comes in pages of ``page_size`` batches, numbered from 1, so that a medicine with
    very many batches is several rows and no row grows without bound.
    """
    lots = sellable(batches, as_of).filter(F.col("medicine_id").isNotNull())
    numbered = row_numbers(lots, ["medicine_id"], ["expiry_date", "id"], "__n", group_limit)
    paged = numbered.withColumn("page", F.ceil(F.col("__n") / page_size).cast("bigint"))
    entry = F.struct("expiry_date", "id", "batch_no", "quantity", "mrp")
    pages = paged.groupBy("medicine_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("batches"))
    rows = (
        medicines.select("id", "name", "category")
        .join(pages.withColumnRenamed("medicine_id", "id"), "id")
        .select("id", "name", "category", "page", "batches")
    )
    return rows.orderBy("name", "id", "page") if ordered else rows
