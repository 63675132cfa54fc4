"""The stock data model laid over a TPC-H-like star schema.

Parts are medicines, what was shipped of a part by a supplier is a batch, line items are
sales, events are alerts. Parts divisible by 5 have no batch, so their sales are orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.schema import MONEY

AS_OF = "2000-01-01"
SHELF_DAYS = 180


def batch_key():
    return F.col("l_partkey") * 1000000 + F.col("l_suppkey")


class Shelf:
    """Lazily built tables over the Parquet files of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @property
    def medicines(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("composition"),
            F.concat(F.lit("Use "), "p_name", F.lit(" "), "p_type").alias("uses"),
            F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("dosage"),
            F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("Type "), "p_type")).alias("side_effects"),
            F.col("p_type").alias("category"),
            F.lit(None).cast("timestamp_ntz").alias("created_at"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        )

    @property
    def batches(self) -> DataFrame:
        shipped = (
            self.read("lineitem")
            .filter(F.col("l_partkey") % 5 != 0)
            .groupBy("l_partkey", "l_suppkey")
            .agg(
                F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
                F.min("l_shipdate").alias("first"),
                F.max("l_shipdate").alias("last"),
            )
        )
        prices = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        stocked = (F.col("l_partkey") + F.col("l_suppkey")) % 23 == 0
        return shipped.join(prices, "l_partkey").select(
            batch_key().alias("id"),
            F.col("l_partkey").alias("medicine_id"),
            F.concat(F.lit("B"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias(
                "batch_no"
            ),
            F.when(stocked, F.col("units") % 40).otherwise(0).cast("bigint").alias("quantity"),
            F.col("p_retailprice").cast(MONEY).alias("mrp"),
            (F.col("p_retailprice") * 0.7).cast(MONEY).alias("cost_price"),
            F.to_date("first").alias("mfg_date"),
            F.date_add(F.to_date("last"), SHELF_DAYS).alias("expiry_date"),
            F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("supplier"),
            F.col("first").alias("created_at"),
        )

    @property
    def sales(self) -> DataFrame:
        """Sale lines; the unit price is the line's price in whole cents divided by its units."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        units = F.col("l_quantity").cast("bigint")
        each = F.call_function("div", cents, units)
        return self._ordered_lines().select(
            batch_key().alias("batch_id"),
            units.alias("quantity_sold"),
            (each.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY).alias("selling_price"),
            F.when(F.col("o_custkey") % 11 == 0, "")
            .otherwise(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")))
            .alias("customer_name"),
            F.concat(F.lit("555-"), F.col("o_custkey").cast("string")).alias("customer_phone"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("o_orderdate").alias("sold_on"),
        )

    def _ordered_lines(self) -> DataFrame:
        orders = self.read("orders")
        return self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @property
    def cart_items(self) -> DataFrame:
        """Line items as cart lines: an order is a cart."""
        return self._ordered_lines().select(
            F.col("l_orderkey").alias("cart_id"),
            F.col("o_orderdate").alias("cart_time"),
            F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("customer_name"),
            F.concat(F.lit("555-"), F.col("o_custkey").cast("string")).alias("customer_phone"),
            F.col("o_orderpriority").alias("payment_method"),
            F.col("l_linenumber").alias("line"),
            batch_key().alias("batch_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.col("l_extendedprice").cast(MONEY).alias("price"),
        )

    @property
    def opening_stock(self) -> DataFrame:
        """Batches holding half of what all carts together ask for."""
        asked = (
            self.read("lineitem")
            .groupBy(batch_key().alias("id"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("asked"))
        )
        return (
            self.batches.drop("quantity")
            .join(asked, "id")
            .withColumn("quantity", F.floor(F.col("asked") / 2).cast("bigint"))
            .drop("asked")
        )

    @property
    def cart_arrays(self) -> DataFrame:
        """One cart per order with three parallel lists, some of them faulty."""
        n = (F.col("o_orderkey") % 5).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("cart_id"),
            F.col("o_orderdate").alias("cart_time"),
            F.when(F.col("o_custkey") % 11 == 0, " ")
            .otherwise(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")))
            .alias("customer_name"),
            F.concat(F.lit("555-"), F.col("o_custkey").cast("string")).alias("customer_phone"),
            F.col("o_orderpriority").alias("payment_method"),
            F.transform(steps, lambda i: F.col("o_orderkey") * 10 + i).alias("batch_id"),
            F.transform(
                F.when(F.col("o_orderkey") % 13 == 0, F.array_append(steps, F.lit(9))).otherwise(steps),
                lambda i: (i + F.col("o_custkey") % 3).cast("bigint"),
            ).alias("quantity"),
            F.transform(steps, lambda i: (F.lit("1.25").cast(MONEY) * i).cast(MONEY)).alias("price"),
        )

    @property
    def alerts(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("alert_type"),
            F.concat("event_type", F.lit(" for user "), F.col("user_id").cast("string")).alias("message"),
            F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("medicine_id"),
            F.when(F.col("event_id") % 4 != 0, F.col("user_id") * 1000000 + F.col("event_id") % 100).alias("batch_id"),
            F.when(F.col("value") > 50, "high").otherwise("medium").alias("priority"),
            F.lit(None).cast("string").alias("severity"),
            (F.col("event_id") % 2 == 0).alias("is_read"),
            F.col("ts").alias("created_at"),
        )

    @property
    def interactions(self) -> DataFrame:
        """Every seventh part is said to interact with the part after it."""
        part = self.read("part")
        a = part.filter(F.col("p_partkey") % 7 == 0).select(
            F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("next"), F.col("p_name").alias("drug_a")
        )
        b = part.select(F.col("p_partkey").alias("next"), F.col("p_name").alias("drug_b"))
        long = F.length("drug_a") + F.length("drug_b")
        return a.join(b, "next").select(
            "id",
            "drug_a",
            "drug_b",
            F.concat(F.lit("effect "), (F.col("id") % 9).cast("string")).alias("interaction"),
            F.when(long % 2 == 0, "high").otherwise("medium").alias("severity"),
            F.concat(F.lit("advice "), (F.col("id") % 4).cast("string")).alias("recommendation"),
        )

    @property
    def basket_items(self) -> DataFrame:
        names = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("medicine_name"))
        lines = self.read("lineitem").select(F.col("l_orderkey").alias("cart_id"), "l_partkey")
        return lines.join(names, "l_partkey").select("cart_id", "medicine_name")

    @property
    def job_log(self) -> DataFrame:
        """Alerts the daily job made earlier on the day of the report."""
        kinds = F.array(
            *[
                F.struct(F.lit(n).alias("n"), F.lit(t).alias("alert_type"), F.lit(s).alias("severity"))
                for n, t, s in (
                    (5, "expiry", "danger"),
                    (7, "expiry", "warning"),
                    (11, "expiry", "info"),
                    (6, "low_stock", "warning"),
                )
            ]
        )
        return (
            self.batches.select("id", F.inline(kinds))
            .filter(F.col("id") % F.col("n") == 0)
            .select(
                "alert_type",
                "severity",
                F.col("id").alias("batch_id"),
                F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
            )
        )

    @property
    def job_log_with_null(self) -> DataFrame:
        """The same log with an info alert that names no batch, among many others."""
        return self.job_log.withColumn(
            "batch_id",
            F.when((F.col("severity") != "info") | (F.col("batch_id") % 3 != 0), F.col("batch_id")),
        )

    @property
    def standing_alerts(self) -> DataFrame:
        """Alerts left from earlier checks, some read, some with words around them."""
        low = self.medicines.filter(F.col("id") % 3 == 0).select(
            "id",
            F.lit("low_stock").alias("alert_type"),
            F.concat(
                F.lit("Note: "), F.upper("name"), F.lit(" is running low ("), (F.col("id") % 20).cast("string"),
                F.lit(" units left), order soon"),
            ).alias("message"),
            (F.col("id") % 2 == 0).alias("is_read"),
        )
        names = self.medicines.select(F.col("id").alias("medicine_id"), "name")
        dated = self.batches.filter(F.col("id") % 3 == 0).join(names, "medicine_id").select(
            "id",
            F.when(F.col("id") % 2 == 0, "expired").otherwise("expiry").alias("alert_type"),
            F.concat(F.lit("Batch "), "batch_no", F.lit(" of "), "name", F.lit(" has expired")).alias("message"),
            (F.col("id") % 4 == 1).alias("is_read"),
        )
        return low.unionByName(dated)

    @property
    def labelled_texts(self) -> DataFrame:
        """Documents as (id, text, label): the language is what is to be told."""
        return self.read("documents").select(
            F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")
        )

    @property
    def questions(self) -> DataFrame:
        """Conversation turns as (id, symptoms)."""
        return self.read("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("symptoms")
        )
