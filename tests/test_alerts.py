"""Alerts: bounds, messages, de-duplication compared with inserting one by one."""

import datetime as dt
import random
import re

import pytest

from shelflot.functions import containment as K
from shelflot.functions.containment import first_containing
from shelflot.operators import alerts as A
from shelflot.operators import interactions as X
from shelflot.operators.symptoms import resolve_medicine
from shelflot.schema import ALERTS, BATCHES, INTERACTIONS
from tests.conftest import AS_OF, day, frame, money


def like(text, pattern):
    shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(f".*{shape}.*", text, re.I | re.S | re.A) is not None


def brute_first(patterns, texts):
    found = {}
    for p in patterns:
        hits = [i for i, t in texts if like(t, p)]
        if hits:
            found[p.lower()] = min(hits)
    return found


def test_containment_like_brute_force(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ab Ab cxyz") for _ in range(n))
    texts = [(i, text(draw.randint(0, 60))) for i in range(120)]
    patterns = set()
    for _ in range(150):
        base = draw.choice(texts)[1]
        start = draw.randint(0, max(0, len(base) - 1))
        piece = list(base[start : start + draw.randint(0, 30)])
        for _ in range(draw.randint(0, 2)):
            if piece:
                piece[draw.randrange(len(piece))] = draw.choice(["%", "_", "q"])
        patterns.add("".join(piece))
    patterns |= {"", "%", "__", "_" * 59, "%_%", "\\", "a\\b"}
    p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
    t = spark.createDataFrame(texts, "id bigint, text string")
    got = {r.pattern: r.first for r in first_containing(p, t, "pattern", "text", "id").collect()}
    assert got == brute_first(patterns, texts)


def test_resolve_takes_first_by_id(spark, medicines):
    names = spark.createDataFrame([("in",), ("CETIR",), ("Nothing",), ("i_upro",)], "label string")
    got = {r.label: r.medicine and r.medicine.name for r in resolve_medicine(names, medicines).collect()}
    assert got == {"in": "Amoxicillin", "CETIR": "Cetirizine", "Nothing": None, "i_upro": "Ibuprofen"}


def test_alert_bounds(spark, edges, medicines, alerts):
    got = A.stock_and_expiry_alerts(medicines, edges.filter("expiry_date is not null"), alerts, AS_OF).collect()
    rows = {r.message: (r.alert_type, r.priority) for r in got}
    assert rows == {
        "Batch E0 of Paracetamol expires in 0 days": ("expiry", "high"),
        "Batch E1 of Paracetamol expires in 1 days": ("expiry", "high"),
        "Batch E7 of Paracetamol expires in 7 days": ("expiry", "high"),
        "Batch E8 of Paracetamol expires in 8 days": ("expiry", "medium"),
        "Batch E15 of Paracetamol expires in 15 days": ("expiry", "medium"),
        "Batch E16 of Paracetamol expires in 16 days": ("expiry", "medium"),
        "Batch E30 of Paracetamol expires in 30 days": ("expiry", "medium"),
        "Batch E-1 of Paracetamol has expired": ("expired", "high"),
    }


def test_low_stock_alerts_and_second_run(spark, medicines):
    rows = [(i, i, f"B{i}", q, day(400)) for i, q in enumerate([0, 5, 6, 20, 21], 1)]
    df = frame(spark, BATCHES, rows, ["id", "medicine_id", "batch_no", "quantity", "expiry_date"])
    none = spark.createDataFrame([], ALERTS)
    first = A.stock_and_expiry_alerts(medicines, df, none, AS_OF)
    assert {r.medicine_id: r.priority for r in first.collect()} == {2: "high", 3: "medium", 4: "medium"}
    from shelflot.sources.sinks import append_alerts

    stored = append_alerts(none, first, "2025-03-31 00:00:00")
    assert A.stock_and_expiry_alerts(medicines, df, stored, AS_OF).count() == 0
    read = A.mark_read(stored)
    assert A.stock_and_expiry_alerts(medicines, df, read, AS_OF).count() == 3


def one_by_one(candidates, standing):
    said = [(t, m) for t, m, read in standing if not read]
    kept = []
    for id, kind, message in sorted(candidates):
        if not any(t == kind and like(m, message[:50]) for t, m in said):
            said.append((kind, message))
            kept.append(id)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_dedupe_like_one_by_one(spark, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["ring", "small ring", "a_b", "ox", "Ring", "cold rod", "x%y"])
    tail = lambda: draw.choice(["", " is low", " is low (5 units left)", " and a very long tail that runs past fifty characters " + word()])
    make = lambda: draw.choice(["", "note ", "the "]) + word() + tail()
    candidates = [(i, draw.choice(["low", "old"]), make()) for i in range(120)]
    standing = [(draw.choice(["low", "old"]), make(), draw.random() < 0.7) for _ in range(15)]
    c = spark.createDataFrame(candidates, "source_id bigint, alert_type string, message string")
    s = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(standing)], "id bigint, alert_type string, message string, is_read boolean"
    )
    assert sorted(r.source_id for r in A.dedupe_alerts(c, s).collect()) == one_by_one(candidates, standing)


def test_dedupe_chain(spark):
    """A silences B; C, which only B contains, is kept. Then C silences D."""
    b = "bravo " * 9 + "charlie says this and rather more than fifty characters in all of it"
    rows = [(1, "t", "alpha " + b[:50]), (2, "t", b), (3, "t", "charlie says this and rather more"), (4, "t", "rather more")]
    c = spark.createDataFrame(rows, "source_id bigint, alert_type string, message string")
    none = spark.createDataFrame([], "id bigint, alert_type string, message string, is_read boolean")
    assert sorted(r.source_id for r in A.dedupe_alerts(c, none).collect()) == one_by_one(rows, []) == [1, 3]


def test_new_batch_alerts(spark, medicines, alerts):
    rows = [(1, 1, "N1", 5, day(-3)), (2, 1, "N2", 5, day(30)), (3, 1, "N3", 5, day(31)), (4, 1, "N4", 5, None)]
    df = frame(spark, BATCHES, rows, ["id", "medicine_id", "batch_no", "quantity", "expiry_date"])
    got = {r.message: (r.priority, r.batch_id) for r in A.new_batch_alerts(df, medicines, alerts, AS_OF).collect()}
    assert got == {
        "New batch N1 of Paracetamol expires in -3 days": ("high", None),
        "New batch N2 of Paracetamol expires in 30 days": ("medium", None),
    }


def test_daily_job(spark, edges, medicines, alerts):
    run = A.run_checks(edges, medicines, alerts.limit(0), AS_OF)
    assert {r.batch_type: r.alerts for r in run.summary.collect()} == {
        "expired": 1, "near_expiry": 6, "expiring_soon": 4, "low_stock": 13, "total": 24,
    }
    messages = {r.message for r in run.alerts.collect()}
    assert "🚨 EXPIRED: Paracetamol (Batch: E-1) - Expired 1 days ago" in messages
    assert "📉 Low stock: Paracetamol (Batch: EMPTY) - Only 0 units left (Total: 120)" in messages


def test_daily_job_is_quiet_the_second_time(spark, edges, medicines, alerts):
    from shelflot.sources.sinks import append_alerts

    stored = append_alerts(alerts.limit(0), A.run_checks(edges, medicines, alerts.limit(0), AS_OF).alerts, f"{AS_OF} 08:00:00")
    summary = {r.batch_type: r.alerts for r in A.run_checks(edges, medicines, stored, AS_OF).summary.collect()}
    assert summary == {"expired": 0, "near_expiry": 0, "expiring_soon": 0, "low_stock": 0, "total": 0}


def test_inbox_order(alerts, medicines, batches):
    assert [r.id for r in A.alert_inbox(alerts, medicines, batches).collect()] == [2, 1, 3]
    assert [r.id for r in A.alert_inbox(alerts, medicines, batches, unread_only=True, n=1).collect()] == [2]
    assert A.unread_count(A.mark_read(alerts, [1])).first().unread == 1


def test_interactions(spark, interactions):
    pairs = spark.createDataFrame([("Aspirin", "Warfarin"), ("warfarin", "Aspirin"), ("Ibuprofen", "Aspirin")], "drug1 string, drug2 string")
    got = {(r.drug1, r.drug2): r.interaction for r in X.check_interactions(pairs, interactions).collect()}
    assert got == {("Aspirin", "Warfarin"): "Bleeding", ("warfarin", "Aspirin"): None, ("Ibuprofen", "Aspirin"): "Less effect"}


def test_baskets(spark, interactions):
    items = spark.createDataFrame(
        [(1, "Aspirin"), (1, "Warfarin"), (1, "Aspirin"), (1, "Ibuprofen"), (2, "Aspirin"), (2, "Cetirizine")],
        "cart_id bigint, medicine_name string",
    )
    got = sorted((r.cart_id, r.drug_a, r.drug_b, r.severity) for r in X.basket_interactions(items, interactions).collect())
    assert got == [(1, "Aspirin", "Ibuprofen", "medium"), (1, "Aspirin", "Warfarin", "high")]


def test_baskets_go_the_shorter_way(spark):
    """Everything interacts with everything: small baskets form their own pairs, not one per partner."""
    names = [f"m{i:02d}" for i in range(60)]
    known = [(i * 100 + j, a, b, f"{a}+{b}", "high", "") for i, a in enumerate(names) for j, b in enumerate(names) if a != b]
    interactions = spark.createDataFrame(known, INTERACTIONS)
    rows = [(cart, names[(7 * cart + 11 * k) % 60]) for cart in range(200) for k in range(4)] + [(900, n) for n in names]
    items = spark.createDataFrame(rows + [(None, "m00"), (901, "unknown"), (901, None)], "cart_id bigint, medicine_name string")
    found = X.basket_interactions(items, interactions)
    held = {}
    for cart, name in rows:
        held.setdefault(cart, set()).add(name)
    wanted = sorted((cart, a, b, f"{a}+{b}") for cart, own in held.items() for a in own for b in own if a < b)
    assert sorted((r.cart_id, r.drug_a, r.drug_b, r.interaction) for r in found.collect()) == wanted
    steps = plan_rows(found)
    assert max(steps) <= 3 * len(wanted), steps


def test_long_patterns_have_few_keys(spark):
    """Texts of one form differ in a number: a long pattern gives a few keys, and where all are shared finer ones."""
    texts = [(i, f"New batch B{1000 + 37 * i}-{i % 9} of red bolt expires in -{i % 50} days") for i in range(300)]
    texts += [(1000 + i, f"{'the same long beginning of every text, '}{i:04d}") for i in range(150)]
    t = spark.createDataFrame(texts, "id bigint, text string")
    spans = t.selectExpr("id", "lower(text) as __text", "id as __order")
    keys = K._text_keys(spans, [48], [], []).filter("__order < 300").count()
    assert 300 <= keys <= 4 * 300
    asked = [x[:50] for _, x in texts] + ["beginning of every text, 0003", "e same long beginning of every text, 014"]
    p = spark.createDataFrame([(x,) for x in asked], "pattern string")
    got = {r.pattern: r.first for r in K.first_containing(p, t, "pattern", "text", "id").collect()}
    lower = [(i, x.lower()) for i, x in texts]
    assert got == {a.lower(): min(i for i, x in lower if a.lower() in x) for a in asked}


def plan_rows(df):
    """Output rows of every join in the plan as it was run."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    seen, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else []
        todo += [node.plan()] if "QueryStage" in name else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if name.endswith("Join") and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
    return seen
