"""Carts against stock, compared with serving them one by one."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from shelflot.operators import carts as C
from shelflot.schema import BATCHES, CARTS
from tests.conftest import AS_OF, frame, money

T0 = dt.datetime(2025, 3, 31, 9)


def cart(id, items, minute=None, name="Ann", phone="1"):
    return (
        id, T0 + dt.timedelta(minutes=id if minute is None else minute), name, phone, "cash",
        [b for b, _ in items], [q for _, q in items], [money(2) for _ in items],
    )


def stock_of(spark, stock):
    rows = [(b, 1, f"B{b}", q, AS_OF - dt.timedelta(days=1)) for b, q in stock.items()]
    return frame(spark, BATCHES, rows, ["id", "medicine_id", "batch_no", "quantity", "expiry_date"])


def one_by_one(stock, carts):
    stock, accepted = dict(stock), {}
    for c in sorted(carts, key=lambda c: (c[1], c[0])):
        left = dict(stock)
        accepted[c[0]] = True
        for batch, quantity in zip(c[5], c[6]):
            if quantity <= 0 or batch not in left or left[batch] < quantity:
                accepted[c[0]] = False
                break
            left[batch] -= quantity
        if accepted[c[0]]:
            stock = left
    return stock, accepted


def compare(spark, stock, carts, **options):
    lines = C.cart_lines(spark.createDataFrame(carts, CARTS)).accepted
    got = C.apply_sales(stock_of(spark, stock), lines, **options)
    left, accepted = one_by_one(stock, carts)
    assert {r.cart_id: r.accepted for r in got.decisions.collect()} == accepted
    assert {r.id: r.quantity for r in got.batches.collect()} == left
    sold = got.sales.collect()
    assert sum(r.quantity_sold for r in sold) == sum(stock.values()) - sum(left.values())
    return got


def test_whole_cart_or_nothing(spark):
    carts = [cart(1, [(1, 3), (2, 5)]), cart(2, [(1, 3)]), cart(3, [(1, 1), (1, 1)]), cart(4, [(9, 1)]), cart(5, [(2, 0)])]
    got = compare(spark, {1: 4, 2: 4}, carts)
    reasons = {r.cart_id: r.reason for r in got.decisions.collect()}
    assert reasons == {1: "insufficient_stock", 2: None, 3: "insufficient_stock", 4: "batch_not_found", 5: "invalid_quantity"}


def test_expired_batches_can_be_refused(spark):
    lines = C.cart_lines(spark.createDataFrame([cart(1, [(1, 1)])], CARTS)).accepted
    assert C.apply_sales(stock_of(spark, {1: 4}), lines).decisions.first().accepted
    refused = C.apply_sales(stock_of(spark, {1: 4}), lines, as_of=AS_OF, allow_expired=False).decisions.first()
    assert refused.reason == "batch_expired"


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("group_limit", [1_000_000, 0])
def test_like_one_by_one(spark, seed, group_limit):
    draw = random.Random(seed)
    stock = {b: draw.randint(3, 30) for b in range(1, 7)}
    # A third of the lines wants the same batch.
    pick = lambda: 1 if draw.random() < 0.35 else draw.randint(2, 7)
    carts = [
        cart(i, [(pick(), draw.randint(1, 6)) for _ in range(draw.randint(1, 4))], minute=draw.randint(0, 20))
        for i in range(1, 60)
    ]
    compare(spark, stock, carts, group_limit=group_limit)


def test_cart_validation(spark):
    rows = [cart(1, [(1, 1)]), cart(2, [(1, 1)], name=" "), cart(3, []), cart(4, [(1, 1)])[:7] + ([],)]
    good, bad = C.cart_lines(spark.createDataFrame(rows, CARTS))
    assert [(r.cart_id, r.line) for r in good.collect()] == [(1, 1)]
    assert {r.cart_id: r.reason for r in bad.collect()} == {2: "customer_missing", 3: "cart_empty", 4: "cart_mismatch"}


def test_receipts(spark, medicines):
    stock = stock_of(spark, {1: 9, 2: 9})
    lines = C.cart_lines(spark.createDataFrame([cart(1, [(1, 1), (2, 2)]), cart(2, [(2, 1)])], CARTS)).accepted
    sales = C.apply_sales(stock, lines, first_id=41).sales
    totals, items = C.receipts(sales, stock, medicines.filter("id = 99"))
    got = {r.cart_id: r for r in totals.collect()}
    assert got[1].receipt_number == "SA-000042" and got[2].receipt_number == "SA-000043"
    assert (got[1].subtotal, got[1].tax_amount, got[1].grand_total) == (Decimal("6.00"), Decimal("0.30"), Decimal("6.30"))
    assert {r.medicine_name for r in items.collect()} == {"Unknown"}


def test_earlier_sale_probe(spark, batches):
    lines = C.cart_lines(spark.createDataFrame([cart(1, [(1, 2)])], CARTS)).accepted
    left = {r.id: r.quantity for r in C.apply_sales(batches, lines).batches.collect()}
    assert left == {1: 98, 2: 50, 3: 75, 4: 60}


def test_posting_is_spread_by_size_and_ships_little(spark, monkeypatch):
    """Jobs are planned for the number of lines; few units taken meet the stock without dealing it out anew."""
    lines = C.cart_lines(spark.createDataFrame([cart(i, [(i % 3, 1)]) for i in range(40)], CARTS)).accepted
    planned, key = [], "spark.sql.shuffle.partitions"
    before, demand = spark.conf.get(key), C._judged_demand

    def seen(*given):
        planned.append(int(spark.conf.get(key)))
        return demand(*given)

    monkeypatch.setattr(C, "_judged_demand", seen)
    monkeypatch.setattr(C.spread_over.__wrapped__, "__defaults__", (4,))
    done = C.apply_sales(stock_of(spark, {0: 5, 1: 50, 2: 0}), lines, first_id=None)
    assert planned == [10] and spark.conf.get(key) == before
    assert {r.id: r.quantity for r in done.batches.collect()} == {0: 0, 1: 37, 2: 0}
    assert done.sales.count() == 18 and "id" not in done.sales.columns
    assert "Exchange hashpartitioning" not in done.batches._jdf.queryExecution().executedPlan().toString()
