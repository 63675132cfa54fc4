"""Stock, expiry, lookups, reports on hand-computed rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelflot.operators import inventory as I
from shelflot.operators import joins as J
from shelflot.operators import lookup as L
from shelflot.operators import validate as V
from shelflot.operators import writes as W
from shelflot.plans import reports as R
from shelflot.schema import BATCHES
from shelflot.sources import sinks, tables
from tests.conftest import AS_OF, day, frame, money


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_expiry_buckets_on_the_day(batches):
    assert I.expiry_buckets(batches, AS_OF).first() == (0, 1, 0, 3)


def test_expiry_buckets_at_the_edges(edges):
    got = I.expiry_buckets(edges, AS_OF).first()
    assert got == (1, 6, 4, 1)  # the batch without a date is in none of them
    assert sum(got) == edges.filter("expiry_date is not null").count()


def test_batch_expiring_today(batches, medicines):
    assert 4 not in ids(L.sellable_batches(batches, AS_OF))
    assert "BATCH004" in ids(R.inventory_report(medicines, batches, AS_OF), "batch_no")
    status = {r.batch_no: r.status for r in R.expiry_report(medicines, batches, AS_OF).collect()}
    assert status["BATCH004"] == "EXPIRED" and status["BATCH002"] == "GOOD (>90 days)"


def test_expiry_report_edges(edges, medicines):
    rows = {r.days_left: r.status for r in R.expiry_report(medicines, edges.filter("quantity > 0"), AS_OF).collect()}
    assert rows == {
        0: "EXPIRED", 1: "URGENT (<15 days)", 7: "URGENT (<15 days)", 8: "URGENT (<15 days)", 15: "URGENT (<15 days)",
        16: "WARNING (15-90 days)", 30: "WARNING (15-90 days)", 31: "WARNING (15-90 days)", 90: "WARNING (15-90 days)",
        91: "GOOD (>90 days)",
    }


def test_medicine_batches_status(edges, medicines):
    rows = {r.batch_no: r.status for r in L.medicine_batches(medicines, edges, AS_OF, 1).collect()}
    assert rows["E-1"] == "Expired" and rows["E0"] == "0 days" and rows["E15"] == "15 days"
    assert rows["E16"] == "Good" and rows["NODATE"] == "Unknown"


def test_inventory_stats(medicines, batches):
    got = I.inventory_stats(medicines, batches, AS_OF).first()
    assert (got.total_medicines, got.total_batches, got.total_quantity) == (5, 4, 285)
    assert got.stock_value == Decimal("2070.00") and got.cost_value == Decimal("1380.00")
    assert abs(got.profit_margin - 50.0) < 1e-9


def test_inventory_stats_drops_medicine_with_only_expired_batches(medicines, batches):
    got = I.inventory_stats(medicines, batches, day(1)).first()
    assert (got.total_medicines, got.total_batches) == (4, 3)


def test_inventory_stats_of_nothing(medicines, batches):
    got = I.inventory_stats(medicines.limit(0), batches, AS_OF).first()
    assert got.total_medicines == 0 and got.stock_value == 0 and got.profit_margin == 0.0


def test_low_stock_bounds(spark, medicines):
    rows = [(i, i, f"B{i}", q) for i, q in enumerate([0, 1, 20, 21], 1)]
    df = frame(spark, BATCHES, rows, ["id", "medicine_id", "batch_no", "quantity"])
    assert sorted(ids(I.low_stock_medicines(medicines, df))) == [2, 3]


def test_stock_by_medicine_keeps_those_without(medicines, batches):
    rows = I.stock_by_medicine(medicines, batches).collect()
    assert [r.name for r in rows] == ["Amoxicillin", "Cetirizine", "Ibuprofen", "Omeprazole", "Paracetamol"]
    assert {r.name: (r.total_stock, r.batch_count) for r in rows}["Omeprazole"] == (0, 0)


def test_dashboard(medicines, batches, sales):
    got = I.dashboard_stats(medicines, batches, sales, AS_OF).first().asDict()
    assert got == {
        "medicines": 5, "batches": 4, "near_expiry": 1, "expired": 0, "sales": 21,
        "revenue": Decimal("93.00"), "low_stock": 0,
    }


def test_medicine_stats(medicines, edges):
    got = {r.id: r for r in I.medicine_stats(medicines, edges, AS_OF).collect()}
    assert (got[1].batch_count, got[1].expired, got[1].near_expiry, got[1].need_attention) == (13, 1, 6, 7)
    assert got[2].total_stock == 0 and got[2].total_value == 0


def test_search(medicines, batches):
    assert ids(L.search_medicines(medicines, batches, " anal", AS_OF)) == [1]
    got = L.search_medicines(medicines, batches, "", AS_OF).collect()
    assert [r.id for r in got] == [3, 4, 2, 5, 1]
    assert {r.id: r.total_stock for r in got} == {1: 150, 2: 75, 3: 0, 4: 0, 5: 0}


def test_search_wildcards_and_backslash(medicines, batches):
    assert ids(L.search_medicines(medicines, batches, "i_upro%n", AS_OF)) == [2]
    assert ids(L.search_medicines(medicines, batches, "a\\c", AS_OF)) == []


def test_pages_hold_every_batch_in_order(spark, medicines):
    rows = [(i, 1 + i % 2, f"B{i}", 1, money(1), day(5 + i % 7)) for i in range(1, 60)]
    df = frame(spark, BATCHES, rows, ["id", "medicine_id", "batch_no", "quantity", "mrp", "expiry_date"])
    plain = I.batches_by_medicine(medicines, df, AS_OF, page_size=8).collect()
    split = I.batches_by_medicine(medicines, df, AS_OF, page_size=8, group_limit=0).collect()
    assert plain == split and max(len(r.batches) for r in plain) == 8
    listed = [b.id for r in plain if r.id == 1 for b in r.batches]
    assert listed == [r[0] for r in sorted((r for r in rows if r[1] == 1), key=lambda r: (r[5], r[0]))]


def test_left_join_filter(medicines, batches):
    got = J.medicines_left_batches(medicines, batches, day(1))
    assert sorted(ids(got, "medicine_id")) == [1, 1, 2, 4, 5]


def test_null_keys_keep_their_rows(alerts, medicines, batches):
    got = {r.id: (r.medicine_name, r.batch_no) for r in J.alerts_enriched(alerts, medicines, batches).collect()}
    assert got == {1: ("Paracetamol", None), 2: ("Amoxicillin", None), 3: (None, "BATCH004")}


def test_not_alerted_today(batches, alerts):
    assert sorted(ids(J.not_alerted_today(batches, alerts, "expiry", None, AS_OF))) == [1, 2, 3]
    nothing = J.not_alerted_today(batches, alerts, "expiry", None, day(-1), null_aware=True)
    assert ids(nothing) == []  # that day's alert names no batch
    assert len(ids(J.not_alerted_today(batches, alerts, "expiry", None, day(-1)))) == 4


def test_delete_leaves_orphans_unless_cascading(spark, medicines, batches):
    gone = spark.createDataFrame([(1,)], "id bigint")
    left = W.delete_medicines(medicines, batches, gone)
    assert sorted(ids(J.orphan_batches(left.batches, left.medicines))) == [1, 2]
    swept = W.delete_medicines(medicines, batches, gone, cascade=True)
    assert ids(J.orphan_batches(swept.batches, swept.medicines)) == []


def test_validation(spark):
    rows = [
        (1, " Aspirin ", "Analgesic", "Acetylsalicylic", "Pain relief x", "Once a day."),
        (2, "A", "Analgesic", "Acetylsalicylic", "Pain relief x", "Once a day."),
        (3, " ", "", "short", "Pain relief x", None),
        (4, "x" * 101, "Candy", "Acetylsalicylic", "Pain relief x", "Once a day."),
    ]
    df = spark.createDataFrame(rows, "id bigint, name string, category string, composition string, uses string, dosage string")
    good, bad = V.validate_medicines(df)
    assert [(r.id, r.name) for r in good.collect()] == [(1, "Aspirin")]
    assert {r.id: r.reasons for r in bad.collect()} == {
        2: ["name_length"],
        3: ["name_missing", "category_missing", "composition_short", "dosage_short"],
        4: ["name_length", "category_unknown"],
    }


def test_text_budget_bands(spark):
    df = spark.createDataFrame([(1, "x" * 450, "x" * 226, "x" * 451)], "id bigint, uses string, dosage string, side_effects string")
    assert {r.field: r.band for r in V.text_budget(df).collect()} == {"uses": "warning", "dosage": "warning", "side_effects": "danger"}


def test_changed_rows(spark):
    names = "id bigint, name string, category string, composition string, uses string, dosage string, side_effects string"
    old = spark.createDataFrame([(1, "a", "c", None, "u", "d", "s"), (2, "a", "c", "x", "u", "d", "s")], names)
    new = spark.createDataFrame([(1, " a ", "c", "", "u", "d", "s"), (2, "b", "c ", "x", "u", "d", None)], names)
    assert [(r.id, r.changed) for r in V.changed_rows(old, new).collect()] == [(2, ["name", "category", "side_effects"])]


def test_upsert(spark, medicines):
    changes = spark.createDataFrame(
        [(1, " New ", "c", "x", "u", "d", "s"), (9, "Nine", "c", "x", "u", "d", None), (2, " ", "c", "x", "u", "d", "s")],
        "id bigint, name string, category string, composition string, uses string, dosage string, side_effects string",
    )
    got = {r.id: r for r in W.upsert_medicines(medicines, changes, "2025-03-31 10:00:00").collect()}
    stamp = dt.datetime(2025, 3, 31, 10)
    assert len(got) == 6
    assert got[1].name == "New" and got[1].updated_at == stamp and got[1].created_at is None
    assert got[9].created_at == stamp and got[9].updated_at is None and got[9].side_effects == ""
    assert got[2].name == "Ibuprofen"


def test_ingest(spark, batches):
    names = "row bigint, medicine_id string, batch_no string, quantity string, mrp string, cost_price string, mfg_date string, expiry_date string, supplier string"
    rows = [
        (1, "1", " N1 ", "5", "1.5", "1", None, "2026-01-01", "s"),
        (2, "1", "N1", "5", "1.5", "1", None, "2026-01-01", "s"),
        (3, "1", "BATCH001", "5", "1.5", "1", None, "x", "s"),
        (4, None, "N2", "5", "1.5", "1", None, "", "s"),
        (5, "1", "N3", "five", "1.5", "1", None, "", "s"),
        (6, "1", "N3", None, None, None, "", "31/12/2025", " t "),
        (7, "1", "", "1", "1", "1", None, "", "s"),
    ]
    good, bad = W.ingest_batches(batches, spark.createDataFrame(rows, names))
    kept = {r.row: r for r in good.collect()}
    assert set(kept) == {1, 6}
    assert kept[6].quantity == 0 and kept[6].mrp == 0 and kept[6].expiry_date is None and kept[6].supplier == "t"
    assert {r.row: r.reasons for r in bad.collect()} == {
        2: ["batch_exists"], 3: ["batch_exists"], 4: ["batch_or_medicine_missing"], 5: ["number_invalid"],
        7: ["batch_or_medicine_missing"],
    }


def test_csv_keeps_whole_texts(spark, tmp_path):
    rows = [('a "quoted", text\nwith a break', "M1"), (" spaced ", "M2")]
    tables.write_symptom_csv(spark.createDataFrame(rows, "symptoms string, medicine string"), str(tmp_path / "c"))
    back = tables.read_symptom_csv(spark, str(tmp_path / "c"), multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_tables_round_trip(spark, medicines, batches, tmp_path):
    tables.save_tables({"medicines": medicines, "batches": batches}, str(tmp_path / "t"))
    back = tables.load_tables(spark, str(tmp_path / "t"), ["medicines", "batches"])
    assert sorted(back["batches"].collect()) == sorted(batches.collect())


def test_export(spark, medicines, batches, tmp_path):
    rows = R.inventory_report(medicines, batches, AS_OF)
    shown = sinks.display_rows(rows, {"name": "Medicine", "mrp": "MRP"}, ("mrp",))
    sinks.export_report(shown, str(tmp_path / "e"), "T", "Today", "now")
    back = spark.read.option("header", True).csv(str(tmp_path / "e/rows"))
    assert back.columns == ["Medicine", "MRP"] and ("Ibuprofen", "₹8.00") in [tuple(r) for r in back.collect()]
    assert spark.read.json(str(tmp_path / "e/about")).first().period == "Period: Today"


def test_json_defaults(spark):
    df = spark.createDataFrame([(1, None, None)], "id bigint, name string, total decimal(18,2)")
    assert sinks.report_json(df).first()[0] == '{"id":1,"name":null,"total":0.00}'


def test_appended_ids_follow(spark, alerts):
    new = spark.createDataFrame([("expiry", f"m{i}") for i in range(5)], "alert_type string, message string")
    got = sinks.append_alerts(alerts, new, "2025-04-01 00:00:00")
    added = got.filter(F.col("id") > 3).collect()
    assert sorted(r.id for r in added) == [4, 5, 6, 7, 8] and not any(r.is_read for r in added)
