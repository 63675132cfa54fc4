"""Streams give what the batch operators give, and a replayed micro-batch changes nothing."""

import datetime as dt

from pyspark.sql import functions as F

from shelflot.operators import sales as S
from shelflot.schema import ALERTS, CARTS, SALES
from shelflot.streaming import alerts as SA
from shelflot.streaming import carts as SC
from shelflot.streaming import daily as SD
from tests.conftest import AS_OF, frame, money
from tests.test_carts import cart, one_by_one, stock_of


def test_complete_days_equal_the_batch_report(spark, tmp_path):
    rows = [
        (i, 1, 1 + i % 3, money(2), dt.datetime(2025, 3, 1) + dt.timedelta(hours=5 * i)) for i in range(60)
    ]
    sales = frame(spark, SALES, rows, ["id", "batch_id", "quantity_sold", "selling_price", "sold_on"])
    sales.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SALES).parquet(str(tmp_path / "in"))
    query = SD.write_daily_sales(SD.stream_daily_sales(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    live = {r.sale_date: tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("sale_date", "transactions", "total_units", "total_revenue").collect()}
    batch = {r.sale_date: tuple(r) for r in S.daily_sales(sales).select("sale_date", "transactions", "total_units", "total_revenue").collect()}
    newest = max(r[4] for r in rows)
    complete = {d for d in batch if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=2) <= newest}
    assert live == {d: batch[d] for d in complete} and complete


def test_cart_stream_over_two_batches(spark, tmp_path):
    stock = {1: 10, 2: 4}
    first = [cart(1, [(1, 6)]), cart(2, [(1, 6)]), cart(3, [])]
    second = [cart(4, [(1, 4), (2, 4)]), cart(5, [(2, 1)])]
    ledger, source, progress = (str(tmp_path / n) for n in ("ledger", "in", "cp"))
    SC.open_ledger(stock_of(spark, stock), ledger)
    stream = lambda: spark.readStream.schema(CARTS).parquet(source)
    for rows in (first, second):
        spark.createDataFrame(rows, CARTS).write.mode("append").parquet(source)
        SC.stream_apply_sales(stream(), ledger, progress).awaitTermination()
    left, accepted = one_by_one(stock, [c for c in first + second if c[5]])
    assert {r.id: r.quantity for r in SC.current_stock(spark, ledger).collect()} == left
    decided = {r.cart_id: r.accepted for r in spark.read.parquet(f"{ledger}/decisions").collect()}
    assert decided == {**accepted, 3: False}
    # Running the same files again, as after a loss of the query's progress, posts the same.
    SC.stream_apply_sales(stream(), ledger, progress).awaitTermination()
    assert {r.id: r.quantity for r in SC.current_stock(spark, ledger).collect()} == left
    SC.fold(spark, ledger, str(tmp_path / "folded"))
    assert {r.id: r.quantity for r in SC.current_stock(spark, str(tmp_path / "folded")).collect()} == left


def test_replayed_micro_batch_overwrites_itself(spark, tmp_path):
    """A second query without the first one's progress handles the same carts as micro-batch 0."""
    ledger, source = str(tmp_path / "ledger"), str(tmp_path / "in")
    SC.open_ledger(stock_of(spark, {1: 10}), ledger)
    spark.createDataFrame([cart(1, [(1, 6)])], CARTS).write.parquet(source)
    for progress in ("cp1", "cp2"):
        stream = spark.readStream.schema(CARTS).parquet(source)
        SC.stream_apply_sales(stream, ledger, str(tmp_path / progress)).awaitTermination()
    assert SC.current_stock(spark, ledger).first().quantity == 4


def test_a_micro_batch_touches_the_buckets_of_its_carts_alone(spark, tmp_path):
    """Many micro-batches give what serving all carts one by one gives; other buckets keep their version."""
    stock = {i: 3 for i in range(40)}
    ledger, source, progress = (str(tmp_path / n) for n in ("ledger", "in", "cp"))
    SC.open_ledger(stock_of(spark, stock), ledger, buckets=8)
    carts = [cart(i + 1, [(i % 3, 1 + i % 2), (7, 1)]) for i in range(9)]
    for k in range(0, 9, 3):
        spark.createDataFrame(carts[k : k + 3], CARTS).coalesce(1).write.mode("append").parquet(source)
        SC.stream_apply_sales(spark.readStream.schema(CARTS).parquet(source), ledger, progress).awaitTermination()
    left, accepted = one_by_one(stock, carts)
    assert {r.id: r.quantity for r in SC.current_stock(spark, ledger).collect()} == left
    assert {r.cart_id: r.accepted for r in spark.read.parquet(f"{ledger}/decisions").collect()} == accepted
    versions = SC.manifest(spark, ledger, SC.last_epoch(spark, ledger))
    touched = {r[0] for r in spark.createDataFrame([(0,), (1,), (2,), (7,)], "id long").select(SC._bucket("id", 8)).collect()}
    assert {b for b, v in versions.items() if v == -1} == set(range(8)) - touched
    written = spark.read.parquet(f"{ledger}/stock/version=2").select("bucket").distinct().collect()
    assert {r.bucket for r in written} == {b for b, v in versions.items() if v == 2}
    assert SC.current_stock(spark, ledger, before=0).agg(F.sum("quantity")).first()[0] == 120


def test_a_stopped_micro_batch_changes_nothing(spark, tmp_path):
    """Without its manifest a micro-batch's stock does not count."""
    ledger = str(tmp_path / "ledger")
    SC.open_ledger(stock_of(spark, {1: 10, 2: 5}), ledger, buckets=2)
    SC._write_stock(stock_of(spark, {1: 0, 2: 0}), ledger, 0, 2)
    assert SC.current_stock(spark, ledger).agg(F.sum("quantity")).first()[0] == 15


def test_changes_add_up_to_the_batch_report(spark, tmp_path):
    """Out of order, late and repeated lines: totals equal the batch report over all different lines."""
    base = dt.datetime(2025, 3, 1)
    rows = [(i, 1, 1 + i % 3, money(2), base + dt.timedelta(hours=(7 * i) % 240)) for i in range(90)]
    rows.append((900, 1, -2, money(2), base + dt.timedelta(days=3)))  # taken back
    columns = ["id", "batch_id", "quantity_sold", "selling_price", "sold_on"]
    source, store, progress = (str(tmp_path / n) for n in ("in", "days", "cp"))
    SD.open_days(spark, store)
    for part in (rows[:40], rows[30:70] + [(901, 1, 1, money(1), None)], rows[60:] + rows[:5]):
        frame(spark, SALES, part, columns).coalesce(1).write.mode("append").parquet(source)
        SD.stream_daily_deltas(spark.readStream.schema(SALES).parquet(source), store, progress).awaitTermination()
    names = ["sale_date", "transactions", "total_units", "total_revenue"]
    batch = S.daily_sales(frame(spark, SALES, rows, columns)).select(*names).collect()
    live = SD.daily_totals(spark, store)
    assert sorted(map(tuple, live.select(*names).collect())) == sorted(map(tuple, batch))
    late = spark.read.parquet(f"{store}/late").collect()
    assert sum(r.late_lines for r in live.collect()) == sum(r.sale_date is not None for r in late) > 0
    assert [r.id for r in late if r.sold_on is None] == [901]


def test_alert_stream_says_things_once(spark, tmp_path, medicines, edges):
    source, store, progress = (str(tmp_path / n) for n in ("in", "alerts", "cp"))
    SA.start_store(spark.createDataFrame([], ALERTS), store)
    dated = edges.filter("expiry_date is not null")
    for _ in range(2):
        spark.range(1).write.mode("append").parquet(source)
        ticks = spark.readStream.schema("id bigint").parquet(source)
        SA.stream_alerts(ticks, lambda: (medicines, dated), store, progress, lambda: AS_OF, every=None).awaitTermination()
    said = SA.stored_alerts(spark, store)
    assert said.count() == 8 == said.select("id").distinct().count()
    assert said.filter(F.col("is_read")).count() == 0
