"""Every operator as a query over the tables of one directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.functions.ranks import row_numbers
from shelflot.operators import alerts as A
from shelflot.operators import carts as C
from shelflot.operators import interactions as X
from shelflot.operators import inventory as I
from shelflot.operators import joins as J
from shelflot.operators import lookup as L
from shelflot.operators import sales as S
from shelflot.operators import symptoms as M
from shelflot.operators import validate as V
from shelflot.operators import writes as W
from shelflot.plans import reports as R
from shelflot.plans.shelf import AS_OF, Shelf
from shelflot.schema import MONEY
from shelflot.session import run_dir
from shelflot.sources import sinks, tables
from shelflot.streaming import alerts as SA
from shelflot.streaming import carts as SC
from shelflot.streaming import daily as SD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = "1999-03-01", "1999-09-30"
NOW = "2000-01-01 12:00:00"


def query(build: Callable[[Shelf], DataFrame]) -> Callable[[Shelf], DataFrame]:
    """Register a builder under its own name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        return build(Shelf(spark, directory))

    QUERIES[build.__name__] = run
    return build


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Scans, sources, sinks


@query
def load_tables(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "tables")
    tables.save_tables({"medicines": s.medicines, "batches": s.batches, "sales": s.sales, "alerts": s.alerts}, path)
    stored = tables.load_tables(s.spark, path, ("medicines", "batches", "sales", "alerts"))
    measures = {"medicines": "id", "batches": "quantity", "sales": "quantity_sold", "alerts": "id"}
    parts = [
        stored[name].agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n"),
            F.sum(c).cast("bigint").alias("checksum"),
        )
        for name, c in measures.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def symptom_csv(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "csv")
    tables.write_symptom_csv(s.labelled_texts.select(F.col("text").alias("symptoms"), F.col("label").alias("medicine")), path)
    back = tables.read_symptom_csv(s.spark, path, multi_line=True)
    return back.groupBy("medicine").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("symptoms")).cast("bigint").alias("characters")
    )


INVENTORY_HEADINGS = {
    "name": "Medicine",
    "category": "Category",
    "batch_no": "Batch",
    "quantity": "Quantity",
    "mrp": "MRP",
    "cost_price": "Cost",
    "expiry_date": "Expiry",
    "supplier": "Supplier",
    "stock_value": "Stock Value",
}


@query
def export_report(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "export")
    rows = R.inventory_report(s.medicines, s.batches, AS_OF, ordered=False)
    shown = sinks.display_rows(rows, INVENTORY_HEADINGS, ("mrp", "cost_price", "stock_value"))
    sinks.export_report(shown, path, f"Inventory Report - {AS_OF}", "Today", NOW)
    text = ", ".join(f"`{h}` string" for h in INVENTORY_HEADINGS.values())
    return s.spark.read.schema(text).option("header", True).option("escape", '"').csv(f"{path}/rows")


@query
def report_json(s: Shelf) -> DataFrame:
    left = J.with_total_stock(s.medicines.select("id", "name", "category"), s.batches)
    return sinks.report_json(left.select("id", "name", "category", "total_stock"))


@query
def append_alerts(s: Shelf) -> DataFrame:
    new = J.batches_enriched(s.batches.filter(F.col("quantity") > 0), s.medicines).select(
        F.lit("expiry").alias("alert_type"),
        F.concat(F.lit("Check "), "batch_no").alias("message"),
        "medicine_id",
        F.col("id").alias("batch_id"),
        F.lit("medium").alias("priority"),
    )
    return sinks.append_alerts(s.alerts, new, NOW).select(
        "id", "alert_type", "message", "medicine_id", "batch_id", "priority", "is_read", "created_at"
    )


# Projections, filters, predicates


@query
def by_id(s: Shelf) -> DataFrame:
    wanted = s.read("supplier").select(F.col("s_suppkey") * 3)
    return L.by_id(s.medicines, wanted).select("id", "name", "category")


@query
def sellable_batches(s: Shelf) -> DataFrame:
    return L.sellable_batches(s.batches, AS_OF)


@query
def available_stock(s: Shelf) -> DataFrame:
    return L.available_stock(s.batches).select("id", "batch_no", "quantity", "expiry_date")


@query
def search_medicines(s: Shelf) -> DataFrame:
    return L.search_medicines(s.medicines, s.batches, " RING ", AS_OF)


@query
def search_all_medicines(s: Shelf) -> DataFrame:
    return L.search_medicines(s.medicines, s.batches, "", AS_OF)


@query
def medicine_batches(s: Shelf) -> DataFrame:
    return L.medicine_batches(s.medicines, s.batches, AS_OF)


@query
def medicine_sales(s: Shelf) -> DataFrame:
    return L.medicine_sales(s.sales, s.batches)


def _records(s: Shelf) -> DataFrame:
    """Parts as medicine records of mixed quality."""
    kinds = F.array(*[F.lit(c) for c in (*V.CATEGORIES, "Unlisted")])
    return s.read("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 17 == 0, "  ")
        .when(F.col("p_partkey") % 19 == 0, F.substring("p_name", 1, 1))
        .when(F.col("p_partkey") % 23 == 0, F.repeat("p_name", 12))
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
        .alias("name"),
        F.when(F.col("p_size") % 16 < 15, F.element_at(kinds, (F.col("p_size") % 16 + 1).cast("int")))
        .otherwise("")
        .alias("category"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
        .otherwise(F.concat("p_brand", F.lit(" "), "p_type"))
        .alias("composition"),
        F.repeat(F.concat("p_name", F.lit(" ")), F.col("p_size")).alias("uses"),
        F.when(F.col("p_partkey") % 29 != 0, F.repeat(F.concat("p_type", F.lit(" daily ")), F.col("p_size") % 25)).alias(
            "dosage"
        ),
        F.when(F.col("p_size") % 2 == 1, F.repeat("p_brand", F.col("p_size") + 5)).alias("side_effects"),
    )


@query
def validate_medicines(s: Shelf) -> DataFrame:
    good, bad = V.validate_medicines(_records(s))
    columns = ["id", "name", "category", F.length("uses").alias("uses_length")]
    return good.select(*columns, F.lit("").alias("reasons")).unionByName(
        bad.select(*columns, F.array_join("reasons", ",").alias("reasons"))
    )


@query
def text_budget(s: Shelf) -> DataFrame:
    return V.text_budget(_records(s))


@query
def changed_rows(s: Shelf) -> DataFrame:
    old = s.medicines
    new = old.withColumns(
        {
            "name": F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.col("name")),
            "category": F.when(F.col("id") % 6 == 0, F.concat("category", F.lit(" "))).otherwise(F.col("category")),
            "uses": F.when(F.col("id") % 10 == 0, F.lit("other")).otherwise(F.col("uses")),
            "side_effects": F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.col("side_effects")),
        }
    )
    return V.changed_rows(old, new).withColumn("changed", F.array_join("changed", ","))


# Joins


@query
def sales_enriched(s: Shelf) -> DataFrame:
    return J.sales_enriched(s.sales, s.batches, s.medicines).withColumn(
        "total_amount", F.col("total_amount").cast("decimal(38,2)")
    )


@query
def batches_enriched(s: Shelf) -> DataFrame:
    return J.batches_enriched(s.batches, s.medicines).select(
        "id", "medicine_id", "batch_no", "medicine_name", "category", "quantity"
    )


@query
def medicines_left_batches(s: Shelf) -> DataFrame:
    return J.medicines_left_batches(s.medicines, s.batches, AS_OF).select(
        "medicine_id", "name", "batch_id", "quantity", "expiry_date"
    )


@query
def alerts_enriched(s: Shelf) -> DataFrame:
    return J.alerts_enriched(s.alerts, s.medicines, s.batches).select(
        "id", "alert_type", "message", "medicine_id", "batch_id", "medicine_name", "batch_no"
    )


@query
def with_total_stock(s: Shelf) -> DataFrame:
    return J.with_total_stock(s.medicines.select("id", "name"), s.batches, AS_OF)


@query
def not_alerted_today(s: Shelf) -> DataFrame:
    return J.not_alerted_today(s.batches, s.job_log, "expiry", "danger", AS_OF).select("id", "batch_no")


@query
def not_alerted_today_null_aware(s: Shelf) -> DataFrame:
    log = s.job_log_with_null
    quiet = [
        J.not_alerted_today(s.batches, log, "expiry", severity, AS_OF, null_aware=True).select(
            F.lit(severity).alias("severity"), "id"
        )
        for severity in ("danger", "info")
    ]
    return quiet[0].unionByName(quiet[1])


@query
def check_interactions(s: Shelf) -> DataFrame:
    part = s.read("part")
    a = part.select((F.col("p_partkey") + 1).alias("k"), F.col("p_name").alias("drug1"))
    b = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("drug2"))
    return X.check_interactions(a.join(b, "k").drop("k"), s.interactions)


@query
def basket_interactions(s: Shelf) -> DataFrame:
    return X.basket_interactions(s.basket_items, s.interactions)


def _patterns(s: Shelf) -> DataFrame:
    """Pieces of part names as search patterns, with wildcards here and there."""
    piece = F.substr("p_name", (F.col("p_partkey") % 4 + 1).cast("int"), (F.col("p_size") % 9 + 1).cast("int"))
    return s.read("part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 100 == 0, "_" * 9)
        .when(F.col("p_partkey") % 101 == 0, "%")
        .when(F.col("p_partkey") % 5 == 0, F.replace(piece, F.lit(" "), F.lit("_")))
        .when(F.col("p_partkey") % 7 == 0, F.concat(F.substring("p_name", 1, 2), F.lit("%"), F.substring("p_name", -3, 2)))
        .when(F.col("p_partkey") % 11 == 0, F.concat(F.upper(piece), F.lit("q")))
        .otherwise(F.upper(piece))
        .alias("label"),
    )


@query
def resolve_medicine(s: Shelf) -> DataFrame:
    found = M.resolve_medicine(_patterns(s), s.medicines)
    return found.select("id", "label", F.col("medicine.id").alias("medicine_id"), F.col("medicine.name").alias("name"))


@query
def orphan_batches(s: Shelf) -> DataFrame:
    kept = W.delete_medicines(s.medicines, s.batches, s.medicines.filter("id % 9 = 0").select("id"))
    return J.orphan_batches(kept.batches, kept.medicines).select("id", "medicine_id", "batch_no")


# Aggregations


@query
def dashboard_stats(s: Shelf) -> DataFrame:
    return I.dashboard_stats(s.medicines, s.batches, s.sales, AS_OF)


@query
def stock_by_medicine(s: Shelf) -> DataFrame:
    return I.stock_by_medicine(s.medicines, s.batches).select("id", "name", "total_stock", "batch_count")


@query
def low_stock_medicines(s: Shelf) -> DataFrame:
    return I.low_stock_medicines(s.medicines, s.batches)


@query
def sales_window_stats(s: Shelf) -> DataFrame:
    return rounded(S.sales_by_window(s.sales, AS_OF), "avg_transaction")


@query
def sales_stats_30d(s: Shelf) -> DataFrame:
    return rounded(S.sales_stats_30d(s.sales, AS_OF), "avg_unit_price")


@query
def inventory_stats(s: Shelf) -> DataFrame:
    return rounded(I.inventory_stats(s.medicines, s.batches, AS_OF), "profit_margin")


@query
def expiry_buckets(s: Shelf) -> DataFrame:
    return I.expiry_buckets(s.batches, AS_OF)


@query
def medicine_stats(s: Shelf) -> DataFrame:
    return I.medicine_stats(s.medicines, s.batches, AS_OF)


@query
def daily_sales(s: Shelf) -> DataFrame:
    return S.daily_sales(s.sales)


@query
def payment_breakdown(s: Shelf) -> DataFrame:
    return S.payment_breakdown(s.sales, START, END)


@query
def custom_summary(s: Shelf) -> DataFrame:
    return rounded(S.custom_summary(s.sales, START, END), "avg_transaction")


@query
def unread_count(s: Shelf) -> DataFrame:
    return A.unread_count(s.alerts)


@query
def alert_summary(s: Shelf) -> DataFrame:
    return A.run_checks(s.batches, s.medicines, s.job_log, AS_OF).summary


@query
def class_distribution(s: Shelf) -> DataFrame:
    return M.class_distribution(s.labelled_texts, "label")


@query
def class_totals(s: Shelf) -> DataFrame:
    return M.class_totals(s.labelled_texts, "label")


@query
def batches_by_medicine(s: Shelf) -> DataFrame:
    listed = I.batches_by_medicine(s.medicines, s.batches, "1996-01-01", page_size=2)
    return listed.withColumn(
        "batches",
        F.array_join(
            F.transform(
                "batches",
                lambda b: F.concat_ws("|", b["batch_no"], b["quantity"].cast("string"), b["mrp"].cast("string"), b["expiry_date"].cast("string")),
            ),
            ";",
        ),
    )


# Sorts, limits, top-k


@query
def recent_sales(s: Shelf) -> DataFrame:
    return S.recent_sales(s.sales, s.batches, s.medicines).select(
        "batch_id", "quantity_sold", "selling_price", "customer_name", "payment_method", "sold_on",
        "batch_no", "medicine_name", F.col("total_amount").cast("decimal(38,2)").alias("total_amount"),
    )


@query
def top_medicines(s: Shelf) -> DataFrame:
    return S.top_medicines(s.sales, s.batches, s.medicines, F.date_sub(F.lit(AS_OF).cast("date"), 30))


@query
def alert_inbox(s: Shelf) -> DataFrame:
    return A.alert_inbox(s.alerts, s.medicines, s.batches).select(
        "id", "alert_type", "priority", "is_read", "created_at", "medicine_name", "batch_no"
    )


@query
def alert_inbox_unread(s: Shelf) -> DataFrame:
    return A.alert_inbox(s.alerts, s.medicines, s.batches, unread_only=True, n=10).select(
        "id", "alert_type", "priority", "created_at", "medicine_name", "batch_no"
    )


# Writes as snapshots


@query
def upsert_medicines(s: Shelf) -> DataFrame:
    known = s.medicines.filter(F.col("id") % 10 == 0)
    new = s.medicines.filter(F.col("id") % 10 == 1).withColumn("id", F.col("id") + 10_000_000)
    changes = known.unionByName(new).withColumn(
        "name", F.when(F.col("id") % 30 == 0, "  ").otherwise(F.concat(F.lit("  "), "name", F.lit(" plus ")))
    )
    return W.upsert_medicines(s.medicines, changes, NOW).select(
        "id", "name", "composition", "side_effects", "category", "created_at", "updated_at"
    )


def _incoming(s: Shelf) -> DataFrame:
    """Line items as raw batch records, some of them faulty or repeated."""
    ship = F.date_format("l_shipdate", "yyyy-MM-dd")
    return (
        s.read("lineitem")
        .select(
            (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("row"),
            F.when(F.col("l_orderkey") % 31 != 0, F.col("l_partkey").cast("string")).alias("medicine_id"),
            F.when(F.col("l_orderkey") % 37 == 0, " ")
            .otherwise(
                F.concat(F.lit(" B"), F.col("l_partkey").cast("string"), F.lit("-"), (F.col("l_suppkey") * 2).cast("string"))
            )
            .alias("batch_no"),
            F.when(F.col("l_orderkey") % 29 == 0, "many")
            .otherwise(F.col("l_quantity").cast("bigint").cast("string"))
            .alias("quantity"),
            F.when(F.col("l_orderkey") % 41 != 0, (F.col("l_partkey") % 100).cast("string")).alias("mrp"),
            F.lit("1.50").alias("cost_price"),
            ship.alias("mfg_date"),
            F.when(F.col("l_orderkey") % 3 == 0, "").when(F.col("l_orderkey") % 3 == 1, "soon").otherwise(ship).alias("expiry_date"),
            F.lit(" S ").alias("supplier"),
        )
        .distinct()
    )


@query
def ingest_batches(s: Shelf) -> DataFrame:
    taken, refused = W.ingest_batches(s.batches, _incoming(s))
    columns = ["row", "medicine_id", "batch_no", "quantity", "mrp", "expiry_date"]
    return taken.select(*columns, F.lit("").alias("reasons")).unionByName(
        refused.select(*columns, F.array_join("reasons", ",").alias("reasons"))
    )


@query
def apply_sales(s: Shelf) -> DataFrame:
    return C.apply_sales(s.opening_stock, s.cart_items).decisions


@query
def apply_sales_stock(s: Shelf) -> DataFrame:
    return C.apply_sales(s.opening_stock, s.cart_items).batches.select("id", "batch_no", "quantity")


@query
def cart_lines(s: Shelf) -> DataFrame:
    lines, refused = C.cart_lines(s.cart_arrays)
    return lines.select(
        "cart_id", "line", "batch_id", "quantity", "price", "customer_name", F.lit("").alias("reason")
    ).unionByName(refused, allowMissingColumns=True)


@query
def receipts(s: Shelf) -> DataFrame:
    sales = s.cart_items.select(
        "cart_id", "line", "batch_id", F.col("quantity").alias("quantity_sold"), F.col("price").alias("selling_price"), "cart_time"
    )
    # Any order that keeps a cart's lines together numbers its last line the same.
    numbered = row_numbers(
        sales, [], ["cart_time", "cart_id", "line", "batch_id", "quantity_sold", "selling_price"], "id"
    )
    return C.receipts(numbered, s.batches, s.medicines).totals


@query
def receipt_items(s: Shelf) -> DataFrame:
    sales = s.cart_items.select(
        "cart_id", "line", "batch_id", F.col("quantity").alias("quantity_sold"), F.col("price").alias("selling_price"),
        F.lit(0).cast("bigint").alias("id"),
    )
    items = C.receipts(sales, s.batches, s.medicines.filter(F.col("id") % 8 != 0)).items
    return items.withColumn("total", F.col("total").cast("decimal(38,2)"))


@query
def mark_read(s: Shelf) -> DataFrame:
    seen = s.read("documents").select("doc_id")
    return A.mark_read(s.alerts, seen).select("id", "is_read")


@query
def delete_medicines(s: Shelf) -> DataFrame:
    left = W.delete_medicines(s.medicines, s.batches, s.medicines.filter("id % 9 = 0").select("id"), cascade=True)
    return left.medicines.select(F.lit("medicines").alias("table_name"), "id").unionByName(
        left.batches.select(F.lit("batches").alias("table_name"), "id")
    )


# Alert generation


@query
def dedupe_alerts(s: Shelf) -> DataFrame:
    said = s.alerts.select(
        "alert_type",
        F.concat(F.substring("message", 1, 3), F.lit(" "), (F.col("id") % 700).cast("string"), F.lit(" at the till")).alias("message"),
        F.col("id").alias("source_id"),
    )
    standing = s.alerts.select(
        "id",
        "alert_type",
        F.concat(F.lit("seen: "), F.upper(F.substring("message", 1, 3)), F.lit(" "), (F.col("id") % 900).cast("string"), F.lit(" at the till today")).alias("message"),
        (F.col("id") % 5 != 0).alias("is_read"),
    )
    return A.dedupe_alerts(said, standing)


@query
def stock_and_expiry_alerts(s: Shelf) -> DataFrame:
    return A.stock_and_expiry_alerts(s.medicines, s.batches, s.standing_alerts, AS_OF)


@query
def new_batch_alerts(s: Shelf) -> DataFrame:
    return A.new_batch_alerts(s.batches, s.medicines, s.standing_alerts, AS_OF).drop("batch_id")


@query
def expired_batches(s: Shelf) -> DataFrame:
    return A.expired_batches(s.batches, s.medicines, s.job_log, AS_OF)


@query
def near_expiry_batches(s: Shelf) -> DataFrame:
    return A.near_expiry_batches(s.batches, s.medicines, s.job_log, AS_OF)


@query
def expiring_soon_batches(s: Shelf) -> DataFrame:
    return A.expiring_soon_batches(s.batches, s.medicines, s.job_log, AS_OF)


@query
def low_stock_batches(s: Shelf) -> DataFrame:
    return A.low_stock_batches(s.batches, s.medicines, s.job_log, AS_OF)


@query
def job_alerts(s: Shelf) -> DataFrame:
    return A.run_checks(s.batches, s.medicines, s.job_log, AS_OF).alerts


@query
def job_alerts_by_check(s: Shelf) -> DataFrame:
    frames = {
        "expired": A.expired_batches(s.batches, s.medicines, s.job_log, AS_OF),
        "near_expiry": A.near_expiry_batches(s.batches, s.medicines, s.job_log, AS_OF),
        "expiring_soon": A.expiring_soon_batches(s.batches, s.medicines, s.job_log, AS_OF),
        "low_stock": A.low_stock_batches(s.batches, s.medicines, s.job_log, AS_OF),
    }
    return A.job_alerts(frames).drop("batch_type")


# Text classification


@query
def tokenise(s: Shelf) -> DataFrame:
    terms = M.tokenise(s.labelled_texts, "text")
    return terms.select("id", F.size("terms").alias("terms"), F.md5(F.array_join("terms", "|")).alias("digest"))


@query
def fit_tfidf(s: Shelf) -> DataFrame:
    return rounded(M.fit_tfidf(s.labelled_texts).weights, "weight", digits=6)


@query
def tfidf_vocabulary(s: Shelf) -> DataFrame:
    return rounded(M.fit_tfidf(s.labelled_texts).vocabulary, "idf", digits=6)


@query
def fit_nb(s: Shelf) -> DataFrame:
    return rounded(M.train(s.labelled_texts).log_probs, "log_prob", digits=6)


@query
def recommend(s: Shelf) -> DataFrame:
    found = M.recommend(M.train(s.labelled_texts), s.questions, s.medicines)
    return found.select("id", "rank", "name", "confidence", "medicine_id", F.col("details.category").alias("category"))


@query
def holdout(s: Shelf) -> DataFrame:
    return M.holdout(s.labelled_texts).select("id", "label", "is_test")


@query
def accuracy(s: Shelf) -> DataFrame:
    split = M.holdout(s.labelled_texts)
    model = M.train(split.filter(~F.col("is_test")))
    return rounded(M.accuracy(model, split.filter("is_test")), "accuracy", digits=6)


@query
def top_terms(s: Shelf) -> DataFrame:
    return rounded(M.top_terms(M.train(s.labelled_texts)), "log_prob", digits=6)


@query
def saved_model(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "model")
    M.save_model(M.train(s.labelled_texts), path)
    return rounded(M.load_model(s.spark, path).priors, "log_prior", digits=6)


# Reports


@query
def in_period(s: Shelf) -> DataFrame:
    return R.in_period(s.read("orders"), "o_orderdate", "quarter", AS_OF).select("o_orderkey", "o_orderdate")


@query
def sales_report(s: Shelf) -> DataFrame:
    return R.sales_report(s.sales, s.batches, s.medicines, "month", AS_OF)


@query
def inventory_report(s: Shelf) -> DataFrame:
    return R.inventory_report(s.medicines, s.batches, AS_OF)


@query
def expiry_report(s: Shelf) -> DataFrame:
    return R.expiry_report(s.medicines, s.batches, AS_OF)


@query
def comprehensive_report(s: Shelf) -> DataFrame:
    return R.comprehensive_report(s.sales, s.batches, s.medicines, "custom", AS_OF, START, END)


@query
def summary_report(s: Shelf) -> DataFrame:
    return rounded(R.report_rows(R.summary_report(s.medicines, s.batches, s.sales, AS_OF)), "value")


@query
def custom_report(s: Shelf) -> DataFrame:
    return rounded(R.report_rows(R.custom_report(s.medicines, s.batches, s.sales, START, END)), "value")


# Streaming, each run over what is there and then stopped


@query
def stream_alerts(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "stream-alerts")
    store = f"{path}/alerts"
    standing = tables.conform(s.standing_alerts, "alerts")
    SA.start_store(standing, store)
    news = (
        s.spark.readStream.schema(s.read("part").schema)
        .option("pathGlobFilter", "part.parquet")
        .parquet(s.directory)
    )
    SA.stream_alerts(
        news, lambda: (s.medicines, s.batches), store, f"{path}/progress", lambda: AS_OF, every=None
    ).awaitTermination()
    made = s.spark.read.parquet(store).filter(F.col("epoch") >= 0)
    return made.select("alert_type", "message", "medicine_id", "batch_id", "priority", "created_at")


@query
def stream_daily_sales(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "stream-days")
    events = (
        s.spark.readStream.schema(s.read("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(s.directory)
    )
    sales = events.filter(F.col("event_type") == "purchase").select(
        F.lit(1).cast("bigint").alias("quantity_sold"),
        F.col("value").cast(MONEY).alias("selling_price"),
        F.col("ts").alias("sold_on"),
    )
    SD.write_daily_sales(SD.stream_daily_sales(sales), f"{path}/days", f"{path}/progress").awaitTermination()
    return s.spark.read.parquet(f"{path}/days")


@query
def stream_daily_deltas(s: Shelf) -> DataFrame:
    """All purchases, in files that are out of order, posted in four micro-batches."""
    path, events = run_dir(s.spark, "stream-deltas"), s.read("events")
    sales = events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").cast("bigint").alias("id"),
        F.lit(1).cast("bigint").alias("quantity_sold"),
        F.col("value").cast(MONEY).alias("selling_price"),
        F.col("ts").cast("timestamp_ntz").alias("sold_on"),
    )
    sales.repartition(4, "id").write.parquet(f"{path}/in")
    SD.open_days(s.spark, f"{path}/days")
    stream = s.spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    SD.stream_daily_deltas(stream, f"{path}/days", f"{path}/progress").awaitTermination()
    return SD.daily_totals(s.spark, f"{path}/days").drop("late_lines")


@query
def stream_apply_sales(s: Shelf) -> DataFrame:
    path = run_dir(s.spark, "stream-carts")
    one = s.cart_items.select(
        "cart_id", "cart_time", "customer_name", "customer_phone", "payment_method",
        F.array("batch_id").alias("batch_id"), F.array("quantity").alias("quantity"), F.array("price").alias("price"),
    )
    one.write.parquet(f"{path}/carts")
    SC.open_ledger(tables.conform(s.opening_stock, "batches"), f"{path}/ledger")
    carts = s.spark.readStream.schema(one.schema).parquet(f"{path}/carts")
    SC.stream_apply_sales(carts, f"{path}/ledger", f"{path}/progress").awaitTermination()
    return SC.current_stock(s.spark, f"{path}/ledger").select("id", "batch_no", "quantity")
