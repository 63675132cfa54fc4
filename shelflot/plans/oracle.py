"""SQL giving the same results as the catalog's queries, for a second engine to check them."""

from __future__ import annotations

from shelflot.operators import alerts as A
from shelflot.operators import symptoms as M
from shelflot.operators import validate as V
from shelflot.plans import reports as R
from shelflot.plans.shelf import AS_OF

DAY = f"DATE '{AS_OF}'"
START, END = "DATE '1999-03-01'", "DATE '1999-09-30'"
NOW = "TIMESTAMP '2000-01-01 12:00:00'"

# Table expressions, each with the ones it reads.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {}
ORACLES: dict[str, str] = {}


def table(name: str, sql: str, *reads: str) -> None:
    TABLES[name] = (sql, reads)


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(TABLES[name][1], seen)
            seen.append(name)
    return seen


def oracle(name: str, sql: str, *reads: str, recursive: str = "") -> None:
    """Register the SQL of a query, put behind the table expressions it reads."""
    parts = [f"{n} AS ({TABLES[n][0]})" for n in _needed(reads, [])]
    if recursive:
        parts.append(recursive)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    ORACLES[name] = head + sql


def days(column: str = "expiry_date", since: str = DAY) -> str:
    return f"CAST(date_diff('day', {since}, {column}) AS INTEGER)"


def big(sql: str) -> str:
    return f"CAST({sql} AS BIGINT)"


def money(sql: str) -> str:
    return f"CAST({sql} AS DECIMAL(38,2))"


def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# The data model

table(
    "medicines",
    """SELECT p_partkey AS id, p_name AS name, p_brand AS composition, 'Use ' || p_name || ' ' || p_type AS uses,
       p_size || ' mg' AS dosage, CASE WHEN p_size % 2 = 1 THEN 'Type ' || p_type END AS side_effects,
       p_type AS category FROM part""",
)
table(
    "batches",
    """SELECT g.l_partkey * 1000000 + g.l_suppkey AS id, g.l_partkey AS medicine_id,
       'B' || g.l_partkey || '-' || g.l_suppkey AS batch_no,
       CAST(CASE WHEN (g.l_partkey + g.l_suppkey) % 23 = 0 THEN g.units % 40 ELSE 0 END AS BIGINT) AS quantity,
       CAST(p.p_retailprice AS DECIMAL(18,2)) AS mrp, CAST(p.p_retailprice * 0.7 AS DECIMAL(18,2)) AS cost_price,
       CAST(g.first_day AS DATE) AS mfg_date, CAST(g.last_day + INTERVAL 180 DAY AS DATE) AS expiry_date,
       'Supplier#' || g.l_suppkey AS supplier, g.first_day AS created_at
       FROM (SELECT l_partkey, l_suppkey, SUM(CAST(l_quantity AS BIGINT)) AS units, MIN(l_shipdate) AS first_day,
                    MAX(l_shipdate) AS last_day FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL) g
       JOIN part p ON p.p_partkey = g.l_partkey""",
)
table(
    "sales",
    """SELECT l_partkey * 1000000 + l_suppkey AS batch_id, CAST(l_quantity AS BIGINT) AS quantity_sold,
       CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0)) * 0.01
            AS DECIMAL(18,2)) AS selling_price,
       CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'Customer#' || o_custkey END AS customer_name,
       '555-' || o_custkey AS customer_phone, o_orderpriority AS payment_method, o_orderdate AS sold_on,
       CAST(o_orderdate AS DATE) AS sold_day
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
table(
    "lines",
    "SELECT *, CAST(quantity_sold * selling_price AS DECIMAL(28,2)) AS amount FROM sales",
    "sales",
)
table(
    "sold",
    """SELECT s.*, b.batch_no, b.medicine_id, m.name AS medicine_name
       FROM lines s JOIN batches b ON b.id = s.batch_id JOIN medicines m ON m.id = b.medicine_id""",
    "lines", "batches", "medicines",
)
table(
    "lots",
    "SELECT b.*, m.name, m.category FROM batches b JOIN medicines m ON m.id = b.medicine_id",
    "batches", "medicines",
)
table("stock", "SELECT medicine_id, SUM(quantity) AS units FROM batches GROUP BY 1", "batches")
table(
    "alerts",
    """SELECT event_id AS id, event_type AS alert_type, event_type || ' for user ' || user_id AS message,
       CASE WHEN event_id % 3 <> 0 THEN user_id END AS medicine_id,
       CASE WHEN event_id % 4 <> 0 THEN user_id * 1000000 + event_id % 100 END AS batch_id,
       CASE WHEN value > 50 THEN 'high' ELSE 'medium' END AS priority, event_id % 2 = 0 AS is_read,
       ts AS created_at FROM events""",
)
table(
    "interactions",
    """SELECT a.p_partkey AS id, a.p_name AS drug_a, b.p_name AS drug_b, 'effect ' || (a.p_partkey % 9) AS interaction,
       CASE WHEN (length(a.p_name) + length(b.p_name)) % 2 = 0 THEN 'high' ELSE 'medium' END AS severity,
       'advice ' || (a.p_partkey % 4) AS recommendation
       FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 7 = 0""",
)
table(
    "cart_items",
    """SELECT l_orderkey AS cart_id, o_orderdate AS cart_time, l_linenumber AS line,
       l_partkey * 1000000 + l_suppkey AS batch_id, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
table(
    "opening",
    """SELECT b.id, b.batch_no, CAST(asked // 2 AS BIGINT) AS quantity FROM batches b
       JOIN (SELECT l_partkey * 1000000 + l_suppkey AS id, SUM(CAST(l_quantity AS BIGINT)) AS asked
             FROM lineitem GROUP BY 1) USING (id)""",
    "batches",
)
table(
    "job_log",
    f"""SELECT alert_type, severity, id AS batch_id, {DAY} AS made
        FROM batches, (VALUES (5, 'expiry', 'danger'), (7, 'expiry', 'warning'), (11, 'expiry', 'info'),
                              (6, 'low_stock', 'warning')) k(n, alert_type, severity) WHERE id % n = 0""",
    "batches",
)
table(
    "job_log_null",
    """SELECT alert_type, severity, CASE WHEN severity <> 'info' OR batch_id % 3 <> 0 THEN batch_id END AS batch_id, made
       FROM job_log""",
    "job_log",
)
table(
    "standing",
    """SELECT id, 'low_stock' AS alert_type, 'Note: ' || upper(name) || ' is running low (' || (id % 20)
              || ' units left), order soon' AS message, id % 2 = 0 AS is_read FROM medicines WHERE id % 3 = 0
       UNION ALL
       SELECT id, CASE WHEN id % 2 = 0 THEN 'expired' ELSE 'expiry' END, 'Batch ' || batch_no || ' of ' || name
              || ' has expired', id % 4 = 1 FROM lots WHERE id % 3 = 0""",
    "medicines", "lots",
)

# Scans, sources, sinks

oracle(
    "load_tables",
    f"""SELECT 'medicines' AS table_name, COUNT(*) AS n, {big('SUM(id)')} AS checksum FROM medicines
        UNION ALL SELECT 'batches', COUNT(*), {big('SUM(quantity)')} FROM batches
        UNION ALL SELECT 'sales', COUNT(*), {big('SUM(quantity_sold)')} FROM sales
        UNION ALL SELECT 'alerts', COUNT(*), {big('SUM(id)')} FROM alerts""",
    "medicines", "batches", "sales", "alerts",
)
oracle(
    "symptom_csv",
    f"SELECT lang AS medicine, COUNT(*) AS n, {big('SUM(length(text))')} AS characters FROM documents GROUP BY 1",
)
oracle(
    "export_report",
    f"""SELECT name AS "Medicine", category AS "Category", batch_no AS "Batch", CAST(quantity AS VARCHAR) AS "Quantity",
        '₹' || mrp AS "MRP", '₹' || cost_price AS "Cost", CAST(expiry_date AS VARCHAR) AS "Expiry",
        supplier AS "Supplier", '₹' || CAST(quantity * mrp AS DECIMAL(38,2)) AS "Stock Value"
        FROM lots WHERE expiry_date >= {DAY}""",
    "lots",
)
oracle(
    "report_json",
    """SELECT '{"id":' || m.id || ',"name":"' || name || '","category":"' || category || '","total_stock":'
              || COALESCE(units, 0) || '}' AS json FROM medicines m LEFT JOIN stock ON medicine_id = m.id""",
    "medicines", "stock",
)
oracle(
    "append_alerts",
    f"""SELECT id, alert_type, message, medicine_id, batch_id, priority, is_read, created_at FROM alerts
        UNION ALL
        SELECT {big("(SELECT MAX(id) FROM alerts) + row_number() OVER (ORDER BY 'Check ' || batch_no)")}, 'expiry',
               'Check ' || batch_no, medicine_id, id, 'medium', FALSE, {NOW} FROM lots WHERE quantity > 0""",
    "alerts", "lots",
)

# Projections, filters, predicates

oracle("by_id", "SELECT id, name, category FROM medicines WHERE id IN (SELECT s_suppkey * 3 FROM supplier)", "medicines")
oracle(
    "sellable_batches",
    f"SELECT id, medicine_id, batch_no, quantity, mrp, expiry_date FROM batches WHERE quantity > 0 AND expiry_date > {DAY}",
    "batches",
)
oracle("available_stock", "SELECT id, batch_no, quantity, expiry_date FROM batches WHERE quantity > 0", "batches")
for _name, _where in (
    (
        "search_medicines",
        "WHERE lower(name) LIKE '%ring%' OR lower(category) LIKE '%ring%' OR lower(composition) LIKE '%ring%'",
    ),
    ("search_all_medicines", ""),
):
    oracle(
        _name,
        f"""SELECT id, name, category, composition, {big(f'''COALESCE((SELECT SUM(quantity) FROM batches
            WHERE medicine_id = m.id AND expiry_date > {DAY}), 0)''')} AS total_stock
            FROM (SELECT * FROM medicines {_where} ORDER BY name, id LIMIT 20) m""",
        "medicines", "batches",
    )
oracle(
    "medicine_batches",
    f"""SELECT medicine_id, name AS medicine_name, id, batch_no, quantity, mrp, expiry_date,
        CASE WHEN expiry_date IS NULL THEN 'Unknown' WHEN {days()} < 0 THEN 'Expired'
             WHEN {days()} <= 15 THEN {days()} || ' days' ELSE 'Good' END AS status FROM lots""",
    "lots",
)
oracle(
    "medicine_sales",
    """SELECT b.medicine_id, CAST(sold_day AS VARCHAR) AS sale_date,
       CASE WHEN customer_name = '' THEN 'N/A' ELSE customer_name END AS customer_name, batch_no, quantity_sold, amount
       FROM lines JOIN batches b ON b.id = batch_id""",
    "lines", "batches",
)
_kinds = ", ".join(f"'{c}'" for c in (*V.CATEGORIES, "Unlisted"))
table(
    "records",
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 19 = 0 THEN p_name[1:1]
               WHEN p_partkey % 23 = 0 THEN repeat(p_name, 12) ELSE ' ' || p_name || ' ' END AS name,
        CASE WHEN p_size % 16 < 15 THEN [{_kinds}][p_size % 16 + 1] ELSE '' END AS category,
        CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || ' ' || p_type END AS composition,
        repeat(p_name || ' ', p_size) AS uses,
        CASE WHEN p_partkey % 29 <> 0 THEN repeat(p_type || ' daily ', p_size % 25) END AS dosage,
        CASE WHEN p_size % 2 = 1 THEN repeat(p_brand, p_size + 5) END AS side_effects FROM part""",
)
oracle(
    "validate_medicines",
    f"""SELECT id, name, category, CAST(length(uses) AS INTEGER) AS uses_length,
        concat_ws(',', CASE WHEN name = '' THEN 'name_missing' END,
                  CASE WHEN name <> '' AND length(name) NOT BETWEEN 2 AND 100 THEN 'name_length' END,
                  CASE WHEN category = '' THEN 'category_missing' END,
                  CASE WHEN category NOT IN ('', {names(V.CATEGORIES)}) THEN 'category_unknown' END,
                  CASE WHEN length(composition) < 10 THEN 'composition_short' END,
                  CASE WHEN length(uses) < 10 THEN 'uses_short' END,
                  CASE WHEN length(dosage) < 10 THEN 'dosage_short' END) AS reasons
        FROM (SELECT id, trim(name) AS name, category, composition, trim(uses) AS uses,
                     trim(COALESCE(dosage, '')) AS dosage FROM records)""",
    "records",
)
oracle(
    "text_budget",
    """SELECT id, field, n AS length, "limit", CASE WHEN n > 0.9 * "limit" THEN 'danger'
              WHEN n > 0.75 * "limit" THEN 'warning' ELSE 'ok' END AS band
       FROM (SELECT id, 'uses' AS field, CAST(length(uses) AS INTEGER) AS n, CAST(500 AS INTEGER) AS "limit" FROM records
             UNION ALL SELECT id, 'dosage', CAST(COALESCE(length(dosage), 0) AS INTEGER), 300 FROM records
             UNION ALL SELECT id, 'side_effects', CAST(COALESCE(length(side_effects), 0) AS INTEGER), 500 FROM records)""",
    "records",
)
oracle(
    "changed_rows",
    """SELECT * FROM (SELECT id, concat_ws(',', CASE WHEN id % 6 = 0 THEN 'category' END,
              CASE WHEN id % 10 = 0 THEN 'uses' END,
              CASE WHEN id % 9 = 0 AND side_effects IS NOT NULL THEN 'side_effects' END) AS changed FROM medicines)
       WHERE changed <> ''""",
    "medicines",
)

# Joins

oracle(
    "sales_enriched",
    f"""SELECT batch_id, quantity_sold, selling_price, customer_name, customer_phone, payment_method, sold_on, batch_no,
        medicine_id, medicine_name, {money('amount')} AS total_amount FROM sold""",
    "sold",
)
oracle(
    "batches_enriched",
    "SELECT id, medicine_id, batch_no, name AS medicine_name, category, quantity FROM lots",
    "lots",
)
oracle(
    "medicines_left_batches",
    f"""SELECT m.id AS medicine_id, name, b.id AS batch_id, quantity, expiry_date FROM medicines m
        LEFT JOIN batches b ON b.medicine_id = m.id WHERE expiry_date >= {DAY} OR b.id IS NULL""",
    "medicines", "batches",
)
oracle(
    "alerts_enriched",
    """SELECT a.id, alert_type, message, a.medicine_id, batch_id, m.name AS medicine_name, batch_no FROM alerts a
       LEFT JOIN medicines m ON m.id = a.medicine_id LEFT JOIN batches b ON b.id = a.batch_id""",
    "alerts", "medicines", "batches",
)
oracle(
    "with_total_stock",
    f"""SELECT id, name, {big(f'''(SELECT SUM(quantity) FROM batches b WHERE b.medicine_id = m.id
        AND expiry_date > {DAY})''')} AS total_stock FROM medicines m""",
    "medicines", "batches",
)


def _not_in(severity: str | None, log: str = "job_log") -> str:
    kind = "low_stock" if severity is None else "expiry"
    same = "" if severity is None else f" AND severity = '{severity}'"
    return f"id NOT IN (SELECT batch_id FROM {log} WHERE alert_type = '{kind}'{same} AND made = {DAY})"


oracle(
    "not_alerted_today",
    f"SELECT id, batch_no FROM batches WHERE {_not_in('danger')}",
    "batches", "job_log",
)
oracle(
    "not_alerted_today_null_aware",
    f"""SELECT 'danger' AS severity, id FROM batches WHERE {_not_in('danger', 'job_log_null')}
        UNION ALL SELECT 'info', id FROM batches WHERE {_not_in('info', 'job_log_null')}""",
    "batches", "job_log_null",
)
oracle(
    "check_interactions",
    """SELECT drug1, drug2, i.interaction, i.severity, i.recommendation
       FROM (SELECT a.p_name AS drug1, b.p_name AS drug2 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) p
       LEFT JOIN LATERAL (SELECT * FROM interactions WHERE (drug_a = drug1 AND drug_b = drug2)
                          OR (drug_a = drug2 AND drug_b = drug1) ORDER BY id LIMIT 1) i ON TRUE""",
    "interactions",
)
table("items", "SELECT DISTINCT l_orderkey AS cart_id, p_name AS name FROM lineitem JOIN part ON p_partkey = l_partkey")
table(
    "either_way",
    """SELECT least(drug_a, drug_b) AS low, greatest(drug_a, drug_b) AS high, arg_min(interaction, id) AS interaction,
       arg_min(severity, id) AS severity, arg_min(recommendation, id) AS recommendation FROM interactions GROUP BY 1, 2""",
    "interactions",
)
oracle(
    "basket_interactions",
    """SELECT a.cart_id, a.name AS drug_a, b.name AS drug_b, interaction, severity, recommendation
       FROM items a JOIN items b ON b.cart_id = a.cart_id AND a.name < b.name
       JOIN either_way ON low = a.name AND high = b.name""",
    "items", "either_way",
)
table(
    "pieces",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 100 = 0 THEN repeat('_', 9) WHEN p_partkey % 101 = 0 THEN '%'
              WHEN p_partkey % 5 = 0 THEN replace(piece, ' ', '_')
              WHEN p_partkey % 7 = 0 THEN left(p_name, 2) || '%' || substring(p_name, length(p_name) - 2, 2)
              WHEN p_partkey % 11 = 0 THEN upper(piece) || 'q' ELSE upper(piece) END AS label
       FROM (SELECT *, substring(p_name, p_partkey % 4 + 1, p_size % 9 + 1) AS piece FROM part)""",
)
oracle(
    "resolve_medicine",
    """SELECT id, label, medicine_id, p_name AS name FROM pieces
       LEFT JOIN (SELECT label, MIN(m.id) AS medicine_id FROM (SELECT DISTINCT label FROM pieces) JOIN medicines m
                  ON lower(m.name) LIKE '%' || lower(label) || '%' GROUP BY 1) USING (label)
       LEFT JOIN part ON p_partkey = medicine_id""",
    "pieces", "medicines",
)
oracle("orphan_batches", "SELECT id, medicine_id, batch_no FROM batches WHERE medicine_id % 9 = 0", "batches")

# Aggregations

oracle(
    "dashboard_stats",
    f"""SELECT (SELECT COUNT(*) FROM medicines) AS medicines, (SELECT COUNT(*) FROM batches) AS batches,
        (SELECT COUNT(*) FROM batches WHERE quantity > 0 AND {days()} BETWEEN 0 AND 15) AS near_expiry,
        (SELECT COUNT(*) FROM batches WHERE quantity > 0 AND {days()} < 0) AS expired,
        (SELECT {big('SUM(quantity_sold)')} FROM sales) AS sales, (SELECT {money('SUM(amount)')} FROM lines) AS revenue,
        (SELECT COUNT(*) FROM stock WHERE units BETWEEN 1 AND 20) AS low_stock""",
    "medicines", "batches", "lines", "stock",
)
oracle(
    "stock_by_medicine",
    f"""SELECT m.id, name, {big('COALESCE(SUM(quantity), 0)')} AS total_stock, COUNT(b.id) AS batch_count
        FROM medicines m LEFT JOIN batches b ON b.medicine_id = m.id GROUP BY 1, 2""",
    "medicines", "batches",
)
oracle(
    "low_stock_medicines",
    f"SELECT id, name, {big('units')} AS total_stock FROM medicines JOIN stock ON medicine_id = id WHERE units BETWEEN 1 AND 20",
    "medicines", "stock",
)
_figures = f"""COUNT(*) AS total_sales, {big('COALESCE(SUM(quantity_sold), 0)')} AS total_units,
    {money('COALESCE(SUM(amount), 0)')} AS total_revenue,
    round(COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 0), 4) AS avg_transaction"""
_windows = {
    "today": f"sold_day = {DAY}",
    "week": f"sold_day >= {DAY} - 7",
    "month": f"sold_day >= {DAY} - 30",
    "year": f"sold_day >= {DAY} - 365",
}
table(
    "windows",
    " UNION ALL ".join(f"""SELECT '{w}' AS "window", {_figures} FROM lines WHERE {test}""" for w, test in _windows.items()),
    "lines",
)
oracle("sales_window_stats", "SELECT * FROM windows", "windows")
oracle(
    "sales_stats_30d",
    f"""SELECT {money('COALESCE(SUM(amount), 0)')} AS total_revenue, {big('COALESCE(SUM(quantity_sold), 0)')} AS total_units,
        COUNT(DISTINCT customer_name) AS unique_customers,
        round(COALESCE(CAST(SUM(amount) AS DOUBLE) / NULLIF(SUM(quantity_sold), 0), 0), 4) AS avg_unit_price
        FROM lines WHERE sold_day >= {DAY} - 30""",
    "lines",
)
table(
    "valued",
    f"""SELECT COUNT(DISTINCT m.id) AS total_medicines, COUNT(b.id) AS total_batches,
        {big('COALESCE(SUM(quantity), 0)')} AS total_quantity, {money('COALESCE(SUM(quantity * mrp), 0)')} AS stock_value,
        {money('COALESCE(SUM(quantity * cost_price), 0)')} AS cost_value FROM medicines m
        LEFT JOIN batches b ON b.medicine_id = m.id WHERE expiry_date >= {DAY} OR b.id IS NULL""",
    "medicines", "batches",
)
table(
    "inventory",
    """SELECT *, round(CASE WHEN cost_value > 0 THEN CAST(stock_value - cost_value AS DOUBLE) / CAST(cost_value AS DOUBLE) * 100
              ELSE 0 END, 4) AS profit_margin FROM valued""",
    "valued",
)
oracle("inventory_stats", "SELECT * FROM inventory", "inventory")
table(
    "buckets",
    f"""SELECT COUNT(*) FILTER (expiry_date < {DAY}) AS expired_count,
        COUNT(*) FILTER (expiry_date BETWEEN {DAY} AND {DAY} + 15) AS near_expiry_count,
        COUNT(*) FILTER (expiry_date BETWEEN {DAY} + 16 AND {DAY} + 90) AS expiring_soon_count,
        COUNT(*) FILTER (expiry_date > {DAY} + 90) AS good_stock_count FROM batches""",
    "batches",
)
oracle("expiry_buckets", "SELECT * FROM buckets", "buckets")
oracle(
    "medicine_stats",
    f"""SELECT *, expired + near_expiry AS need_attention FROM (SELECT m.id, name,
        {big('COALESCE(SUM(quantity), 0)')} AS total_stock, {money('COALESCE(SUM(quantity * mrp), 0)')} AS total_value,
        COUNT(b.id) AS batch_count, COUNT(*) FILTER ({days()} < 0) AS expired,
        COUNT(*) FILTER ({days()} BETWEEN 0 AND 15) AS near_expiry
        FROM medicines m LEFT JOIN batches b ON b.medicine_id = m.id GROUP BY 1, 2)""",
    "medicines", "batches",
)
_daily = f"sold_day AS sale_date, COUNT(*) AS transactions, {big('SUM(quantity_sold)')} AS total_units, {money('SUM(amount)')} AS total_revenue"
oracle("daily_sales", f"SELECT {_daily} FROM lines GROUP BY 1", "lines")
table(
    "payments",
    f"""SELECT payment_method, COUNT(*) AS transactions, {money('SUM(amount)')} AS total_amount FROM lines
        WHERE sold_day BETWEEN {START} AND {END} GROUP BY 1""",
    "lines",
)
oracle("payment_breakdown", "SELECT * FROM payments", "payments")
table(
    "custom",
    f"SELECT {_figures}, COUNT(DISTINCT customer_name) AS unique_customers FROM lines WHERE sold_day BETWEEN {START} AND {END}",
    "lines",
)
oracle("custom_summary", "SELECT * FROM custom", "custom")
oracle("unread_count", "SELECT COUNT(*) AS unread FROM alerts WHERE NOT is_read", "alerts")

# The daily job

_checked = "SELECT id, batch_no, expiry_date, quantity, mrp, name AS medicine_name, category, {0} AS {1} FROM lots WHERE {2} AND {3}"
table("expired", _checked.format(days(), "days_expired", f"expiry_date < {DAY}", _not_in("danger")), "lots", "job_log")
table(
    "near",
    _checked.format(days(), "days_until_expiry", f"expiry_date BETWEEN {DAY} AND {DAY} + 15", _not_in("warning")),
    "lots", "job_log",
)
table(
    "soon",
    _checked.format(
        days(), "days_until_expiry", f"expiry_date > {DAY} + 15 AND expiry_date <= {DAY} + 90", _not_in("info")
    ),
    "lots", "job_log",
)
table(
    "low",
    f"""SELECT id, batch_no, quantity, mrp, name AS medicine_name, category, {big('units')} AS total_stock
        FROM lots JOIN stock USING (medicine_id) WHERE quantity < 20 AND {_not_in(None)}""",
    "lots", "stock", "job_log",
)
oracle("expired_batches", "SELECT * FROM expired", "expired")
oracle("near_expiry_batches", "SELECT * FROM near", "near")
oracle("expiring_soon_batches", "SELECT * FROM soon", "soon")
oracle("low_stock_batches", "SELECT * FROM low", "low")
_m = A.JOB_MESSAGES


def _said(kind: str, source: str, *detail: str) -> str:
    shape = _m[kind].replace("%s", "{}").replace("%d", "{}")
    return f"""SELECT id AS batch_id, '{A.JOB_TYPES[kind]}' AS alert_type,
        format('{shape}', medicine_name, batch_no, {', '.join(detail)}) AS message,
        '{A.JOB_SEVERITIES[kind]}' AS severity FROM {source}"""


for _name in ("job_alerts", "job_alerts_by_check"):
    oracle(
        _name,
        " UNION ALL ".join(
            [
                _said("expired", "expired", "abs(days_expired)"),
                _said("near_expiry", "near", "days_until_expiry"),
                _said("expiring_soon", "soon", "days_until_expiry"),
                _said("low_stock", "low", "quantity", "total_stock"),
            ]
        ),
        "expired", "near", "soon", "low",
    )
oracle(
    "alert_summary",
    """SELECT 'expired' AS batch_type, (SELECT COUNT(*) FROM expired) AS alerts
       UNION ALL SELECT 'near_expiry', (SELECT COUNT(*) FROM near)
       UNION ALL SELECT 'expiring_soon', (SELECT COUNT(*) FROM soon)
       UNION ALL SELECT 'low_stock', (SELECT COUNT(*) FROM low)
       UNION ALL SELECT 'total', (SELECT COUNT(*) FROM expired) + (SELECT COUNT(*) FROM near)
                                 + (SELECT COUNT(*) FROM soon) + (SELECT COUNT(*) FROM low)""",
    "expired", "near", "soon", "low",
)
oracle("class_distribution", "SELECT lang AS label, COUNT(*) AS samples FROM documents GROUP BY 1")
oracle("class_totals", "SELECT COUNT(*) AS samples, COUNT(DISTINCT lang) AS labels FROM documents")
oracle(
    "batches_by_medicine",
    """SELECT medicine_id AS id, name, category, page, string_agg(entry, ';' ORDER BY n) AS batches
       FROM (SELECT medicine_id, name, category, batch_no || '|' || quantity || '|' || mrp || '|' || expiry_date AS entry, n,
                    CAST(ceil(n / 2) AS BIGINT) AS page
             FROM (SELECT *, row_number() OVER (PARTITION BY medicine_id ORDER BY expiry_date, id) AS n FROM lots
                   WHERE quantity > 0 AND expiry_date > DATE '1996-01-01')) GROUP BY 1, 2, 3, 4""",
    "lots",
)

# Sorts, limits, top-k

oracle(
    "recent_sales",
    f"""SELECT batch_id, quantity_sold, selling_price, customer_name, payment_method, sold_on, batch_no, medicine_name,
        {money('amount')} AS total_amount FROM sold ORDER BY sold_on DESC, batch_id, quantity_sold, selling_price,
        customer_name, customer_phone, payment_method LIMIT 50""",
    "sold",
)


def _top(where: str, n: int) -> str:
    return f"""SELECT medicine_id AS id, medicine_name AS name, {big('SUM(quantity_sold)')} AS total_sold,
        {money('SUM(amount)')} AS total_revenue FROM sold WHERE {where} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT {n}"""


table("top6", _top(f"sold_day >= {DAY} - 30", 6), "sold")
table("top10", _top(f"sold_day BETWEEN {START} AND {END}", 10), "sold")
oracle("top_medicines", "SELECT * FROM top6", "top6")
_inbox = """FROM alerts a LEFT JOIN medicines m ON m.id = a.medicine_id LEFT JOIN batches b ON b.id = a.batch_id"""
oracle(
    "alert_inbox",
    f"SELECT a.id, alert_type, priority, is_read, a.created_at, name AS medicine_name, batch_no {_inbox}",
    "alerts", "medicines", "batches",
)
oracle(
    "alert_inbox_unread",
    f"""SELECT a.id, alert_type, priority, a.created_at, name AS medicine_name, batch_no {_inbox}
        WHERE NOT is_read ORDER BY a.created_at DESC, a.id LIMIT 10""",
    "alerts", "medicines", "batches",
)

# Writes as snapshots

_kept = "composition, COALESCE(side_effects, '') AS side_effects, category"
oracle(
    "upsert_medicines",
    f"""SELECT id, trim(name) || ' plus' AS name, {_kept}, CAST(NULL AS TIMESTAMP) AS created_at, {NOW} AS updated_at
        FROM medicines WHERE id % 10 = 0 AND id % 30 <> 0
        UNION ALL SELECT id, name, composition, side_effects, category, NULL, NULL FROM medicines
        WHERE id % 10 <> 0 OR id % 30 = 0
        UNION ALL SELECT id + 10000000, trim(name) || ' plus', {_kept}, {NOW}, NULL FROM medicines
        WHERE id % 10 = 1 AND (id + 10000000) % 30 <> 0""",
    "medicines",
)
table(
    "raw_batches",
    """SELECT DISTINCT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS row,
       CASE WHEN l_orderkey % 31 <> 0 THEN l_partkey END AS medicine_id,
       CASE WHEN l_orderkey % 37 = 0 THEN '' ELSE 'B' || l_partkey || '-' || (l_suppkey * 2) END AS batch_no,
       CASE WHEN l_orderkey % 29 <> 0 THEN CAST(l_quantity AS BIGINT) END AS quantity,
       CAST(CASE WHEN l_orderkey % 41 <> 0 THEN l_partkey % 100 ELSE 0 END AS DECIMAL(18,2)) AS mrp,
       CASE WHEN l_orderkey % 3 = 2 THEN CAST(l_shipdate AS DATE) END AS expiry_date, l_shipdate FROM lineitem""",
)
oracle(
    "ingest_batches",
    """SELECT row, medicine_id, batch_no, quantity, mrp, expiry_date,
              CASE WHEN reasons <> '' THEN reasons
                   WHEN batch_no IN (SELECT batch_no FROM batches) OR row > MIN(CASE WHEN reasons = '' THEN row END)
                        OVER (PARTITION BY batch_no) THEN 'batch_exists' ELSE '' END AS reasons
       FROM (SELECT *, concat_ws(',', CASE WHEN quantity IS NULL THEN 'number_invalid' END,
                    CASE WHEN batch_no = '' OR medicine_id IS NULL THEN 'batch_or_medicine_missing' END) AS reasons
             FROM raw_batches)""",
    "raw_batches", "batches",
)
table(
    "asked",
    f"SELECT cart_id, cart_time, batch_id, {big('SUM(quantity)')} AS qty FROM cart_items GROUP BY 1, 2, 3",
    "cart_items",
)
table(
    "hopeless",
    """SELECT cart_id, MIN(CASE WHEN o.id IS NULL THEN 'batch_not_found' ELSE 'insufficient_stock' END) AS reason
       FROM asked LEFT JOIN opening o ON o.id = batch_id WHERE o.id IS NULL OR qty > quantity GROUP BY 1""",
    "asked", "opening",
)
# Rounds over all carts: a cart is taken when it fits beside everything earlier that is not
# refused, and refused when it does not fit beside what was taken earlier.
_rounds = """rounds AS (
    SELECT 0 AS round, cart_id, cart_time, batch_id, qty, quantity AS stock, 'open' AS fate
    FROM asked JOIN opening ON id = batch_id WHERE cart_id NOT IN (SELECT cart_id FROM hopeless)
    UNION ALL
    SELECT round + 1, cart_id, cart_time, batch_id, qty, stock,
           CASE WHEN fate <> 'open' THEN fate WHEN bool_and(upper_sum <= stock) OVER (PARTITION BY cart_id) THEN 'taken'
                WHEN bool_or(lower_sum + qty > stock) OVER (PARTITION BY cart_id) THEN 'refused' ELSE 'open' END
    FROM (SELECT *, SUM(CASE WHEN fate = 'refused' THEN 0 ELSE qty END) OVER (
                        PARTITION BY batch_id ORDER BY cart_time, cart_id ROWS UNBOUNDED PRECEDING) AS upper_sum,
                 COALESCE(SUM(CASE WHEN fate = 'taken' THEN qty ELSE 0 END) OVER (
                        PARTITION BY batch_id ORDER BY cart_time, cart_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower_sum,
                 bool_or(fate = 'open') OVER () AS going FROM rounds) WHERE going)"""
_last = "(SELECT * FROM rounds WHERE round = (SELECT MAX(round) FROM rounds))"
oracle(
    "apply_sales",
    f"""SELECT cart_id, reason IS NULL AS accepted, reason FROM (
        SELECT DISTINCT a.cart_id, COALESCE(h.reason, CASE WHEN r.fate = 'refused' THEN 'insufficient_stock' END) AS reason
        FROM asked a LEFT JOIN hopeless h ON h.cart_id = a.cart_id
        LEFT JOIN (SELECT DISTINCT cart_id, fate FROM {_last}) r ON r.cart_id = a.cart_id)""",
    "asked", "opening", "hopeless",
    recursive=_rounds,
)
for _name in ("apply_sales_stock", "stream_apply_sales"):
    oracle(
        _name,
        f"""SELECT id, batch_no, {big('quantity - COALESCE(gone, 0)')} AS quantity FROM opening
            LEFT JOIN (SELECT batch_id, SUM(qty) AS gone FROM {_last} WHERE fate = 'taken' GROUP BY 1) ON batch_id = id""",
        "asked", "opening", "hopeless",
        recursive=_rounds,
    )
oracle(
    "cart_lines",
    """SELECT cart_id, CAST(i AS INTEGER) AS line, CAST(cart_id * 10 + i AS BIGINT) AS batch_id,
              CAST(i + o_custkey % 3 AS BIGINT) AS quantity, CAST(1.25 * i AS DECIMAL(18,2)) AS price,
              'Customer#' || o_custkey AS customer_name, '' AS reason
       FROM (SELECT o_orderkey AS cart_id, o_custkey, unnest(generate_series(1, o_orderkey % 5)) AS i FROM orders
             WHERE o_custkey % 11 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 13 <> 0)
       UNION ALL
       SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL,
              CASE WHEN o_custkey % 11 = 0 THEN 'customer_missing' WHEN o_orderkey % 5 = 0 THEN 'cart_empty'
                   ELSE 'cart_mismatch' END
       FROM orders WHERE o_custkey % 11 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 13 = 0""",
)
oracle(
    "receipts",
    f"""SELECT cart_id, sale_id, format('SA-{{:06d}}', sale_id) AS receipt_number, items, subtotal,
        {money('round(subtotal * 0.05, 2)')} AS tax_amount, {money('round(subtotal * 1.05, 2)')} AS grand_total
        FROM (SELECT cart_id, items, subtotal, {big('SUM(items) OVER (ORDER BY cart_time, cart_id)')} AS sale_id
              FROM (SELECT cart_id, cart_time, COUNT(*) AS items, {money('SUM(quantity * price)')} AS subtotal
                    FROM cart_items GROUP BY 1, 2))""",
    "cart_items",
)
oracle(
    "receipt_items",
    f"""SELECT cart_id, line, COALESCE(m.name, 'Unknown') AS medicine_name, batch_no, c.quantity, price,
        {money('c.quantity * price')} AS total FROM cart_items c JOIN batches b ON b.id = c.batch_id
        LEFT JOIN medicines m ON m.id = b.medicine_id AND m.id % 8 <> 0""",
    "cart_items", "batches", "medicines",
)
oracle("mark_read", "SELECT id, is_read OR id IN (SELECT doc_id FROM documents) AS is_read FROM alerts", "alerts")
oracle(
    "delete_medicines",
    """SELECT 'medicines' AS table_name, id FROM medicines WHERE id % 9 <> 0
       UNION ALL SELECT 'batches', id FROM batches WHERE medicine_id % 9 <> 0""",
    "medicines", "batches",
)

# Alert generation


def _fresh(source: str, known: str, columns: str) -> str:
    """Candidates no unread alert of their type contains and no earlier candidate left contains."""
    return f"""heads AS (SELECT alert_type, lower(left(message, 50)) AS head, MIN(source_id) AS source_id FROM {source}
               GROUP BY 1, 2),
        unread AS (SELECT DISTINCT alert_type, lower(message) AS message FROM {known} WHERE NOT is_read),
        unsaid AS (SELECT * FROM heads h WHERE NOT EXISTS (SELECT 1 FROM unread u WHERE u.alert_type = h.alert_type
                   AND u.message LIKE '%' || h.head || '%')),
        worded AS (SELECT c.*, u.head FROM unsaid u JOIN {source} c ON c.alert_type = u.alert_type
                   AND c.source_id = u.source_id)
        SELECT {columns} FROM worded w WHERE NOT EXISTS (SELECT 1 FROM worded e WHERE e.alert_type = w.alert_type
               AND e.source_id < w.source_id AND lower(e.message) LIKE '%' || w.head || '%')"""


def deduped(name: str, source: str, known: str, columns: str) -> None:
    parts = [f"{n} AS ({TABLES[n][0]})" for n in _needed((source, known), [])]
    ORACLES[name] = f"WITH {', '.join(parts)}, {_fresh(source, known, columns)}"


table(
    "said",
    "SELECT alert_type, left(message, 3) || ' ' || (id % 700) || ' at the till' AS message, id AS source_id FROM alerts",
    "alerts",
)
table(
    "seen",
    """SELECT alert_type, 'seen: ' || upper(left(message, 3)) || ' ' || (id % 900) || ' at the till today' AS message,
       id % 5 <> 0 AS is_read FROM alerts""",
    "alerts",
)
deduped("dedupe_alerts", "said", "seen", "alert_type, message, source_id")
table(
    "due",
    f"""SELECT 'low_stock' AS alert_type, name || ' is running low (' || units || ' units left)' AS message,
               id AS medicine_id, CAST(NULL AS BIGINT) AS batch_id,
               CASE WHEN units <= 5 THEN 'high' ELSE 'medium' END AS priority, id AS source_id
        FROM medicines JOIN stock ON medicine_id = id WHERE units BETWEEN 1 AND 20
        UNION ALL
        SELECT 'expiry', 'Batch ' || batch_no || ' of ' || name || ' expires in ' || {days()} || ' days', medicine_id, id,
               CASE WHEN {days()} <= 7 THEN 'high' ELSE 'medium' END, id
        FROM lots WHERE quantity > 0 AND {days()} BETWEEN 0 AND 30
        UNION ALL
        SELECT 'expired', 'Batch ' || batch_no || ' of ' || name || ' has expired', medicine_id, id, 'high', id
        FROM lots WHERE quantity > 0 AND {days()} < 0""",
    "medicines", "stock", "lots",
)
deduped("stock_and_expiry_alerts", "due", "standing", "alert_type, message, medicine_id, batch_id, priority")
deduped(
    "stream_alerts",
    "due",
    "standing",
    f"alert_type, message, medicine_id, batch_id, priority, CAST({DAY} AS TIMESTAMP) AS created_at",
)
table(
    "arrived",
    f"""SELECT 'expiry' AS alert_type, 'New batch ' || batch_no || ' of ' || name || ' expires in ' || {days()} || ' days'
        AS message, medicine_id, CASE WHEN {days()} <= 7 THEN 'high' ELSE 'medium' END AS priority, id AS source_id
        FROM lots WHERE {days()} <= 30""",
    "lots",
)

deduped("new_batch_alerts", "arrived", "standing", "alert_type, message, medicine_id, priority")

# Text classification: the whole chain over any table of (id, text, label)

_stop = names(M.STOP_WORDS)


def _words(source: str, text: str = "text") -> str:
    found = f"regexp_extract_all(lower(COALESCE({text}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"""SELECT id, list_concat(words, list_transform(generate_series(1, len(words) - 1),
        lambda i: words[i] || ' ' || words[i + 1])) AS terms FROM (SELECT id, list_filter({found},
        lambda w: w NOT IN ({_stop})) AS words FROM {source})"""


def model(prefix: str, source: str) -> None:
    """Table expressions of a model fitted on ``source``."""
    p = prefix
    table(f"{p}tokens", _words(source), source)
    table(f"{p}terms", f"SELECT id, unnest(terms) AS term FROM {p}tokens", f"{p}tokens")
    table(
        f"{p}chosen",
        f"SELECT term FROM {p}terms GROUP BY 1 ORDER BY COUNT(*) DESC, term LIMIT 100",
        f"{p}terms",
    )
    table(
        f"{p}tf",
        f"SELECT id, term, COUNT(*) AS tf FROM {p}terms WHERE term IN (SELECT term FROM {p}chosen) GROUP BY 1, 2",
        f"{p}terms", f"{p}chosen",
    )
    table(
        f"{p}vocabulary",
        f"""SELECT term, COUNT(*) AS df, ln(((SELECT COUNT(*) FROM {source}) + 1) / CAST(COUNT(*) + 1 AS DOUBLE)) + 1 AS idf
            FROM {p}tf GROUP BY 1""",
        f"{p}tf", source,
    )
    table(
        f"{p}weights",
        f"""SELECT id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS weight
            FROM (SELECT id, term, tf * idf AS w FROM {p}tf JOIN {p}vocabulary USING (term))""",
        f"{p}tf", f"{p}vocabulary",
    )
    table(
        f"{p}priors",
        f"SELECT label, ln(COUNT(*) / CAST((SELECT COUNT(*) FROM {source}) AS DOUBLE)) AS log_prior FROM {source} GROUP BY 1",
        source,
    )
    table(
        f"{p}log_probs",
        f"""SELECT label, term, ln(w) - ln(SUM(w) OVER (PARTITION BY label)) AS log_prob
            FROM (SELECT label, term, COALESCE(s, 0) + 0.1 AS w FROM {p}priors CROSS JOIN {p}vocabulary
                  LEFT JOIN (SELECT label, term, SUM(weight) AS s FROM {p}weights JOIN {source} USING (id) GROUP BY 1, 2)
                  USING (label, term))""",
        f"{p}priors", f"{p}vocabulary", f"{p}weights", source,
    )


def guesses(prefix: str, model_prefix: str, source: str, text: str = "text") -> None:
    """Table expression of ranked labels for the texts of ``source``."""
    p, m = prefix, model_prefix
    table(f"{p}asked_tokens", _words(source, text), source)
    table(
        f"{p}asked_tf",
        f"""SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM {p}asked_tokens)
            WHERE term IN (SELECT term FROM {m}vocabulary) GROUP BY 1, 2""",
        f"{p}asked_tokens", f"{m}vocabulary",
    )
    table(
        f"{p}scores",
        f"""SELECT id, label, COALESCE(s, 0) + log_prior AS score FROM (SELECT id FROM {source}) q CROSS JOIN {m}priors
            LEFT JOIN (SELECT id, label, SUM(weight * log_prob) AS s FROM (
                SELECT id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY id)) AS weight
                FROM (SELECT id, term, tf * idf AS w FROM {p}asked_tf JOIN {m}vocabulary USING (term)))
                JOIN {m}log_probs USING (term) GROUP BY 1, 2) USING (id, label)""",
        f"{p}asked_tf", f"{m}priors", f"{m}log_probs", f"{m}vocabulary", source,
    )
    table(
        f"{p}ranked",
        f"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, label DESC) AS INTEGER) AS rank, label,
            exp(score - MAX(score) OVER (PARTITION BY id)) AS e FROM {p}scores""",
        f"{p}scores",
    )
    table(
        f"{p}shares",
        f"SELECT id, rank, label, e / SUM(e) OVER (PARTITION BY id) AS probability FROM {p}ranked",
        f"{p}ranked",
    )


table("texts", "SELECT doc_id AS id, text, lang AS label FROM documents")
table(
    "drawn",
    """SELECT id, text, label, n > 1 AND rank <= floor(n * 0.2 + 0.5) AS is_test
       FROM (SELECT *, COUNT(*) OVER (PARTITION BY label) AS n,
                    row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42'), id) AS rank FROM texts)""",
    "texts",
)
table("training", "SELECT * FROM drawn WHERE NOT is_test", "drawn")
table("testing", "SELECT * FROM drawn WHERE is_test", "drawn")
table("questions", "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE trim(text) <> ''")
model("m_", "texts")
model("t_", "training")
guesses("q_", "m_", "questions")
guesses("a_", "t_", "testing")

oracle(
    "tokenise",
    "SELECT id, CAST(len(terms) AS INTEGER) AS terms, md5(array_to_string(terms, '|')) AS digest FROM m_tokens",
    "m_tokens",
)
oracle("fit_tfidf", "SELECT id, term, round(weight, 6) AS weight FROM m_weights", "m_weights")
oracle("tfidf_vocabulary", "SELECT term, df, round(idf, 6) AS idf FROM m_vocabulary", "m_vocabulary")
oracle("fit_nb", "SELECT label, term, round(log_prob, 6) AS log_prob FROM m_log_probs", "m_log_probs")
oracle("saved_model", "SELECT label, round(log_prior, 6) AS log_prior FROM m_priors", "m_priors")
oracle(
    "top_terms",
    """SELECT * FROM (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY log_prob DESC, term DESC) AS INTEGER)
       AS rank, term, round(log_prob, 6) AS log_prob FROM m_log_probs) WHERE rank <= 5""",
    "m_log_probs",
)
oracle(
    "recommend",
    """SELECT s.id, rank, COALESCE(m.name, label) AS name, round(probability * 100, 2) AS confidence, m.id AS medicine_id,
       m.category FROM q_shares s
       LEFT JOIN (SELECT label, MIN(id) AS first FROM m_priors JOIN medicines ON lower(name) LIKE '%' || lower(label) || '%'
                  GROUP BY 1) USING (label)
       LEFT JOIN medicines m ON m.id = first WHERE rank <= 3""",
    "q_shares", "m_priors", "medicines",
)
oracle("holdout", "SELECT id, label, is_test FROM drawn", "drawn")
oracle(
    "accuracy",
    """SELECT COUNT(*) AS samples, COUNT(*) FILTER (t.label = a.label) AS hits,
       round(CAST(COUNT(*) FILTER (t.label = a.label) AS DOUBLE) / COUNT(*), 6) AS accuracy
       FROM testing t JOIN a_shares a ON a.id = t.id WHERE rank = 1""",
    "testing", "a_shares",
)

# Reports

oracle(
    "in_period",
    f"""SELECT o_orderkey, o_orderdate FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN {DAY} - 90 AND {DAY}""",
)
oracle(
    "sales_report",
    f"""SELECT sold_day AS sale_date, customer_name, customer_phone, medicine_name, batch_no, quantity_sold, selling_price,
        {money('amount')} AS total_amount, payment_method FROM sold WHERE sold_day BETWEEN {DAY} - 30 AND {DAY}""",
    "sold",
)
oracle(
    "inventory_report",
    f"""SELECT name, category, batch_no, quantity, mrp, cost_price, expiry_date, supplier,
        {money('quantity * mrp')} AS stock_value FROM lots WHERE expiry_date >= {DAY}""",
    "lots",
)
oracle(
    "expiry_report",
    f"""SELECT name, batch_no, quantity, mrp, expiry_date, {days()} AS days_left,
        CASE WHEN {days()} <= 0 THEN '{R.STATUS_EXPIRED}' WHEN {days()} <= 15 THEN '{R.STATUS_URGENT}'
             WHEN {days()} <= 90 THEN '{R.STATUS_WARNING}' ELSE '{R.STATUS_GOOD}' END AS status
        FROM lots WHERE expiry_date >= {DAY}""",
    "lots",
)
oracle(
    "comprehensive_report",
    f"""SELECT sold_day AS sale_date, customer_name, medicine_name, quantity_sold, selling_price,
        {money('amount')} AS total_amount FROM sold WHERE sold_day BETWEEN {START} AND {END}
        ORDER BY sold_on DESC, customer_name, medicine_name, quantity_sold, selling_price LIMIT 100""",
    "sold",
)


def _long(section: str, item: str, source: str, *metrics: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, round(CAST({m} AS DOUBLE), 4) AS value
            FROM {source}"""
        for m in metrics
    )


table(
    "week",
    f"SELECT {_daily} FROM lines WHERE sold_day >= {DAY} - 7 GROUP BY 1",
    "lines",
)
table("between_days", f"SELECT {_daily} FROM lines WHERE sold_day BETWEEN {START} AND {END} GROUP BY 1", "lines")
_top_item = "id || ' ' || name"
_day_item = "CAST(sale_date AS VARCHAR)"
oracle(
    "summary_report",
    " UNION ALL ".join(
        [
            _long("windows", '"window"', "windows", "total_sales", "total_units", "total_revenue", "avg_transaction"),
            _long(
                "inventory", "'all'", "inventory",
                "total_medicines", "total_batches", "total_quantity", "stock_value", "cost_value", "profit_margin",
            ),
            _long(
                "expiry", "'all'", "buckets",
                "expired_count", "near_expiry_count", "expiring_soon_count", "good_stock_count",
            ),
            _long("top_medicines", _top_item, "top6", "total_sold", "total_revenue"),
            _long("daily_sales", _day_item, "week", "total_units", "total_revenue"),
        ]
    ),
    "windows", "inventory", "buckets", "top6", "week",
)
oracle(
    "custom_report",
    " UNION ALL ".join(
        [
            _long(
                "summary", "'all'", "custom",
                "total_sales", "total_units", "total_revenue", "avg_transaction", "unique_customers",
            ),
            _long("daily_breakdown", _day_item, "between_days", "transactions", "total_units", "total_revenue"),
            _long("top_medicines", _top_item, "top10", "total_sold", "total_revenue"),
            _long("payment_breakdown", "payment_method", "payments", "transactions", "total_amount"),
        ]
    ),
    "custom", "between_days", "top10", "payments",
)

# Streaming: days are complete a day after their end, by the newest event

oracle(
    "stream_daily_sales",
    f"""SELECT CAST(ts AS DATE) AS sale_date, COUNT(*) AS transactions, COUNT(*) AS total_units,
        {money('SUM(CAST(value AS DECIMAL(18,2)))')} AS total_revenue FROM events
        WHERE event_type = 'purchase' GROUP BY 1
        HAVING CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT MAX(ts) FROM events WHERE event_type = 'purchase')""",
)

oracle(
    "stream_daily_deltas",
    f"""SELECT CAST(ts AS DATE) AS sale_date, COUNT(*) AS transactions, COUNT(*) AS total_units,
        {money('SUM(CAST(value AS DECIMAL(18,2)))')} AS total_revenue FROM events
        WHERE event_type = 'purchase' GROUP BY 1""",
)
