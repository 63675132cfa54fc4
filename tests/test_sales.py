"""Sales figures and reports on hand-computed rows."""

import datetime as dt
from decimal import Decimal

import pytest

from shelflot.operators import lookup as L
from shelflot.operators import sales as S
from shelflot.plans import reports as R
from tests.conftest import AS_OF, day


def test_windows(sales):
    got = {r.window: (r.total_sales, r.total_units, r.total_revenue) for r in S.sales_by_window(sales, AS_OF).collect()}
    assert got == {
        "today": (2, 3, Decimal("18.00")),
        "week": (4, 8, Decimal("43.00")),  # a week and its first day, and what lies after
        "month": (6, 12, Decimal("84.00")),
        "year": (7, 21, Decimal("93.00")),
    }


def test_windows_with_an_end(sales):
    got = {r.window: r.total_sales for r in S.sales_by_window(sales, AS_OF, upper_bound=True).collect()}
    assert got == {"today": 2, "week": 3, "month": 5, "year": 6}


def test_windows_without_sales(sales):
    got = S.sales_by_window(sales.limit(0), AS_OF).collect()
    assert len(got) == 4 and all(r.total_sales == 0 and r.avg_transaction == 0.0 for r in got)


def test_single_window_agrees(sales):
    one = S.sales_window_stats(sales, day(-7)).first()
    assert (one.total_sales, one.total_units, one.avg_transaction) == (4, 8, 10.75)


def test_stats_30d(sales):
    got = S.sales_stats_30d(sales, AS_OF).first()
    assert (got.total_units, got.unique_customers) == (12, 4) and got.avg_unit_price == 7.0


def test_daily_and_payment(sales):
    got = S.daily_sales(sales, day(-7), AS_OF).collect()
    assert [(r.sale_date, r.total_units, r.transactions) for r in got] == [(day(-7), 4, 1), (AS_OF, 3, 2)]
    paid = {r.payment_method: (r.transactions, r.total_amount) for r in S.payment_breakdown(sales, day(-30), AS_OF).collect()}
    assert paid == {"cash": (3, Decimal("35.00")), "card": (1, Decimal("8.00")), "upi": (1, Decimal("36.00"))}


def test_top_medicines(sales, batches, medicines):
    got = S.top_medicines(sales, batches, medicines, day(-30), n=2).collect()
    assert [(r.name, r.total_sold) for r in got] == [("Paracetamol", 8), ("Amoxicillin", 3)]


def test_recent_sales_drop_orphans(sales, batches, medicines):
    got = S.recent_sales(sales, batches, medicines, 3).collect()
    assert [r.id for r in got] == [7, 2, 1]


def test_medicine_sales(sales, batches):
    got = L.medicine_sales(sales, batches, 1).collect()
    assert [r.sale_date for r in got] == ["2025-04-02", "2025-03-31", "2025-03-24", "2025-03-23"]
    assert got[-1].customer_name == "N/A"


@pytest.mark.parametrize(
    "period, n", [("today", 2), ("week", 3), ("month", 5), ("quarter", 6), ("year", 6), ("other", 5), ("custom", 5)]
)
def test_periods(sales, period, n):
    assert R.in_period(sales, "sold_on", period, AS_OF).count() == n


def test_custom_period(sales):
    assert R.in_period(sales, "sold_on", "custom", AS_OF, day(-8), day(-7)).count() == 2


def test_sales_report(sales, batches, medicines):
    got = R.sales_report(sales, batches, medicines, "month", AS_OF)
    assert len(got.columns) == 9
    assert [r.quantity_sold for r in got.collect()] == [1, 2, 4, 1, 3]
    assert len(R.comprehensive_report(sales, batches, medicines, "month", AS_OF, n=2).collect()) == 2


def test_summary_document(sales, batches, medicines):
    sections = R.summary_report(medicines, batches, sales, AS_OF)
    got = R.report_document(sections).first()
    assert got.expiry.near_expiry_count == 1 and got.inventory.total_medicines == 5
    assert [e["name"] for e in got.top_medicines] == ["Paracetamol", "Amoxicillin", "Ibuprofen"]
    assert [e.sale_date for e in got.daily_sales] == [day(-7), AS_OF, day(2)]
    assert {e.window: e.total_sales for e in got.windows} == {"today": 2, "week": 4, "month": 6, "year": 7}


def test_custom_report(sales, batches, medicines):
    with pytest.raises(ValueError):
        R.custom_report(medicines, batches, sales, None, AS_OF)
    got = R.report_document(R.custom_report(medicines, batches, sales, day(-30), AS_OF)).first()
    assert got.summary.unique_customers == 4 and len(got.payment_breakdown) == 3
    assert dt.date(2025, 3, 31) in [e.sale_date for e in got.daily_breakdown]
