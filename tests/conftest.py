import datetime as dt
from decimal import Decimal

import pytest

from shelflot.schema import ALERTS, BATCHES, INTERACTIONS, MEDICINES, SALES
from shelflot.session import build_session

AS_OF = dt.date(2025, 3, 31)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "shelflot-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def money(value):
    return None if value is None else Decimal(str(value)).quantize(Decimal("0.01"))


def frame(spark, schema, rows, names):
    """Rows given for some columns only; the others are NULL."""
    position = {n: i for i, n in enumerate(names)}
    full = [tuple(r[position[f.name]] if f.name in position else None for f in schema.fields) for r in rows]
    return spark.createDataFrame(full, schema)


def day(offset):
    return AS_OF + dt.timedelta(days=offset)


@pytest.fixture(scope="session")
def medicines(spark):
    rows = [
        (1, "Paracetamol", "Acetaminophen 500mg", "Analgesic"),
        (2, "Ibuprofen", "Ibuprofen 400mg", "NSAID"),
        (3, "Amoxicillin", "Amoxicillin 250mg", "Antibiotic"),
        (4, "Cetirizine", "Cetirizine 10mg", "Antihistamine"),
        (5, "Omeprazole", "Omeprazole 20mg", "PPI"),
    ]
    return frame(spark, MEDICINES, rows, ["id", "name", "composition", "category"]).cache()


@pytest.fixture(scope="session")
def batches(spark):
    rows = [
        (1, 1, "BATCH001", 100, money(5), money(3.5), dt.date(2026, 12, 31), "Sun"),
        (2, 1, "BATCH002", 50, money(5), money(3.5), dt.date(2025, 6, 30), "North"),
        (3, 2, "BATCH003", 75, money(8), money(5), dt.date(2026, 8, 31), "South"),
        (4, 3, "BATCH004", 60, money(12), money(8), AS_OF, "East"),
    ]
    names = ["id", "medicine_id", "batch_no", "quantity", "mrp", "cost_price", "expiry_date", "supplier"]
    return frame(spark, BATCHES, rows, names).cache()


@pytest.fixture(scope="session")
def edges(spark):
    """One stocked batch of medicine 1 per distance from the day, one without a date, one empty."""
    offsets = [-1, 0, 1, 7, 8, 15, 16, 30, 31, 90, 91]
    rows = [(i + 1, 1, f"E{o}", 10, money(1), money(1), day(o)) for i, o in enumerate(offsets)]
    rows += [(50, 1, "NODATE", 10, money(1), money(1), None), (51, 1, "EMPTY", 0, money(1), money(1), day(5))]
    names = ["id", "medicine_id", "batch_no", "quantity", "mrp", "cost_price", "expiry_date"]
    return frame(spark, BATCHES, rows, names).cache()


@pytest.fixture(scope="session")
def sales(spark):
    at = lambda o, h=12, m=0, s=0: dt.datetime.combine(day(o), dt.time(h, m, s))
    rows = [
        (1, 1, 2, money(5), "Ann", "1", "cash", at(0, 0)),
        (2, 3, 1, money(8), "Bob", "2", "card", at(0, 23, 59, 59)),
        (3, 1, 4, money(5), "Ann", "1", "cash", at(-7)),
        (4, 2, 1, money(5), "", "3", "cash", at(-8)),
        (5, 4, 3, money(12), "Cid", "4", "upi", at(-30)),
        (6, 9, 9, money(1), "Dee", "5", "cash", at(-31)),
        (7, 1, 1, money(5), "Ann", "1", "cash", at(2)),
    ]
    names = ["id", "batch_id", "quantity_sold", "selling_price", "customer_name", "customer_phone", "payment_method", "sold_on"]
    return frame(spark, SALES, rows, names).cache()


@pytest.fixture(scope="session")
def alerts(spark):
    rows = [
        (1, "low_stock", "Paracetamol is running low (100 units left)", 1, None, "medium", False, dt.datetime(2025, 3, 29)),
        (2, "expiry", "Batch BATCH004 of Amoxicillin expires soon", 3, None, "high", False, dt.datetime(2025, 3, 30)),
        (3, "expiry", "old", None, 4, "high", True, dt.datetime(2025, 3, 31)),
    ]
    names = ["id", "alert_type", "message", "medicine_id", "batch_id", "priority", "is_read", "created_at"]
    return frame(spark, ALERTS, rows, names).cache()


@pytest.fixture(scope="session")
def interactions(spark):
    rows = [
        (1, "Warfarin", "Aspirin", "Bleeding", "high", "Watch"),
        (2, "Aspirin", "Warfarin", "Other", "medium", "None"),
        (3, "Aspirin", "Ibuprofen", "Less effect", "medium", "Avoid"),
    ]
    names = ["id", "drug_a", "drug_b", "interaction", "severity", "recommendation"]
    return frame(spark, INTERACTIONS, rows, names).cache()
