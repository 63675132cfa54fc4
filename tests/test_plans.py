"""What the plans look like: pushed filters, pruned columns, no pair-wise joins, skew handled."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shelflot.functions.ranks import row_numbers, running_total
from shelflot.operators import joins as J
from shelflot.operators import sales as S
from shelflot.plans import reports as R
from shelflot.plans.catalog import QUERIES
from shelflot.plans.shelf import AS_OF, Shelf
from shelflot.sources import tables
from tests.conftest import day

DIRECTORY = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no tables")

# Queries that only read and can be planned without running jobs first.
LAZY = [
    "sellable_batches", "search_medicines", "medicine_batches", "medicine_sales", "validate_medicines", "sales_enriched",
    "alerts_enriched", "with_total_stock", "not_alerted_today", "not_alerted_today_null_aware", "check_interactions",
    "basket_interactions", "dashboard_stats", "inventory_stats", "sales_window_stats", "top_medicines", "job_alerts",
    "summary_report", "custom_report", "sales_report", "ingest_batches", "upsert_medicines", "receipt_items",
]


def plan(df):
    return df._jdf.queryExecution().toString()


@with_tables
@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@with_tables
def test_date_filter_reaches_the_scan(spark):
    orders = Shelf(spark, DIRECTORY).read("orders")
    text = plan(R.in_period(orders, "o_orderdate", "quarter", AS_OF).select("o_orderkey"))
    assert re.search(r"PushedFilters: \[IsNotNull\(o_orderdate\), GreaterThanOrEqual\(o_orderdate,1999-10-03", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)


def test_stored_tables_are_pruned_and_filtered(spark, medicines, batches, sales, alerts, tmp_path):
    tables.save_tables({"batches": batches, "sales": sales}, str(tmp_path / "t"))
    t = tables.load_tables(spark, str(tmp_path / "t"), ["batches", "sales"])
    text = plan(S.sales_stats_30d(t["sales"], day(0)))
    assert "GreaterThanOrEqual(sold_on,2025-03-01" in text
    assert "struct<quantity_sold:bigint,selling_price:decimal(18,2),customer_name:string,sold_on:timestamp_ntz>" in text
    text = plan(J.total_stock(t["batches"], day(0)))
    assert "GreaterThan(expiry_date,2025-03-31)" in text


def test_top_k_is_not_a_full_sort(spark, sales, batches, medicines):
    assert "TakeOrderedAndProject" in plan(S.recent_sales(sales, batches, medicines))
    assert "TakeOrderedAndProject" in plan(S.top_medicines(sales, batches, medicines))


def test_top_medicines_sums_before_joining(spark, sales, batches, medicines):
    text = S.top_medicines(sales, batches, medicines)._jdf.queryExecution().optimizedPlan().toString()
    below = text.split("Join Inner")[-1]
    assert "Aggregate [batch_id" in below


@pytest.mark.parametrize("small_bytes, broadcast", [(1 << 20, True), (0, False)])
def test_lookup_join_measures_and_salts(spark, small_bytes, broadcast):
    table = spark.range(97).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    got = J.lookup_join(hot(spark), table, "k", "id", small_bytes)
    assert got.count() == 4000 and got.filter("name <> concat('n', k)").count() == 0
    assert ("__salt" in got._jdf.queryExecution().analyzed().toString()) is not broadcast


def hot(spark, n=4000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), (F.col("id") * 7 % 11).alias("v")
    )


@pytest.mark.parametrize("keys", [["k"], []])
def test_split_groups_count_the_same(spark, keys):
    df = hot(spark)
    split = {(r.id): r.n for r in row_numbers(df, keys, ["v", "id"], "n", group_limit=0).collect()}
    seen = {}
    for r in sorted(df.collect(), key=lambda r: (r.v, r.id)):
        group = r.k if keys else None
        seen[group] = seen.get(group, 0) + 1
        assert split[r.id] == seen[group]


def test_split_groups_sum_the_same(spark):
    df = hot(spark)
    columns = ["id", "total"]
    plain = running_total(df, ["k"], ["id"], "v", "total").select(columns).collect()
    split = running_total(df, ["k"], ["id"], "v", "total", group_limit=0).select(columns).collect()
    assert sorted(plain) == sorted(split)


def test_hot_join_key_is_split(spark):
    """Adaptive execution splits the partition of a key that holds a third of the sales."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sales = hot(spark, 200_000).repartition(8).select(
            F.col("k").alias("batch_id"), F.lit(1).cast("bigint").alias("quantity_sold"),
            F.lit("2.00").cast("decimal(18,2)").alias("selling_price"), F.md5(F.col("id").cast("string")).alias("customer_name"),
        )
        lots = spark.range(97).select("id", F.col("id").alias("medicine_id"), F.lit("b").alias("batch_no"))
        names = spark.range(97).select("id", F.lit("m").alias("name"), F.lit("c").alias("category"))
        joined = J.sales_enriched(sales, lots, names)
        assert len(joined.collect()) == 200_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
