"""Alerts: generation, de-duplication, the daily job, and reading them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.containment import first_containing
from shelflot.functions.dates import day, days_left
from shelflot.functions.ranks import first_row
from shelflot.functions.text import ascii_lower
from shelflot.operators.inventory import LOW_STOCK, low_stock_medicines
from shelflot.operators.joins import alerts_enriched, batches_enriched, not_alerted_today, total_stock
from shelflot.session import pinned

# Alert types, thresholds and message formats that results depend on.
ALERT_DAYS = 30
HIGH_DAYS = 7
HIGH_STOCK = 5
PREFIX = 50
LOW_STOCK_MESSAGE = "%s is running low (%d units left)"
EXPIRY_MESSAGE = "Batch %s of %s expires in %d days"
EXPIRED_MESSAGE = "Batch %s of %s has expired"
NEW_BATCH_MESSAGE = "New batch %s of %s expires in %d days"
JOB_MESSAGES = {
    "expired": "🚨 EXPIRED: %s (Batch: %s) - Expired %d days ago",
    "near_expiry": "⚠️  Near expiry: %s (Batch: %s) expires in %d days",
    "expiring_soon": "ℹ️  Expiring soon: %s (Batch: %s) expires in %d days",
    "low_stock": "📉 Low stock: %s (Batch: %s) - Only %d units left (Total: %d)",
}
JOB_TYPES = {"expired": "expiry", "near_expiry": "expiry", "expiring_soon": "expiry", "low_stock": "low_stock"}
JOB_SEVERITIES = {"expired": "danger", "near_expiry": "warning", "expiring_soon": "info", "low_stock": "warning"}
SOON_AFTER_DAYS = 15

CANDIDATE = ("alert_type", "message", "medicine_id", "batch_id", "priority")


@dataclass(frozen=True)
class AlertConfig:
    """Thresholds of the daily job."""

    low_stock_threshold: int = 20
    near_expiry_days: int = 15
    expiring_soon_days: int = 90


class JobRun(NamedTuple):
    alerts: DataFrame
    summary: DataFrame


def unread_count(alerts: DataFrame) -> DataFrame:
    """Number of unread alerts, in one row."""
    return alerts.filter(~F.col("is_read")).agg(F.count(F.lit(1)).alias("unread"))


def alert_inbox(
    alerts: DataFrame,
    medicines: DataFrame,
    batches: DataFrame,
    unread_only: bool = False,
    n: int | None = None,
) -> DataFrame:
    """Alerts with medicine and batch, unread first, newest first; optionally only the first ``n``.

    With ``n`` the alerts are cut before they are joined.
    """
    order = [F.col("is_read").cast("int"), F.desc("created_at"), F.col("id")]
    wanted = alerts.filter(~F.col("is_read")) if unread_only else alerts
    if n is not None:
        wanted = wanted.orderBy(*order).limit(n)
    return alerts_enriched(wanted, medicines, batches).orderBy(*order)


def mark_read(alerts: DataFrame, ids: DataFrame | Iterable[int] | None = None) -> DataFrame:
    """Alerts with the given ones, or all, marked as read."""
    if ids is None:
        return alerts.withColumn("is_read", F.lit(True))
    if not isinstance(ids, DataFrame):
        return alerts.withColumn("is_read", F.col("is_read") | F.col("id").isin(list(ids)))
    seen = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("__seen", F.lit(True))
    return (
        alerts.join(seen, "id", "left")
        .withColumn("is_read", F.col("is_read") | F.coalesce("__seen", F.lit(False)))
        .select(*alerts.columns)
    )


def dedupe_alerts(candidates: DataFrame, alerts: DataFrame, order: str = "source_id") -> DataFrame:
    """Candidates that are not already said by an unread alert of their type.

    A candidate is dropped if such an alert, or a candidate kept before it, contains its first
    50 characters anywhere, without case, % and _ being wildcards. Candidates come in the order
    of ``order``, which is unique within a type. The outcome is that of inserting one by one.
    """
    head = F.substring("message", 1, PREFIX)
    keyed = candidates.filter(F.col("message").isNotNull()).withColumn("pattern", ascii_lower(head))
    # The first candidate with a given beginning stands for all: it silences the others if it
    # is kept, and whatever silences it silences them too.
    speakers = pinned(first_row(keyed, ["alert_type", "pattern"], [order]))
    unread = alerts.filter(~F.col("is_read"))
    said = first_containing(speakers, unread, "pattern", "message", "id", ["alert_type"])
    fresh = speakers.join(said, ["alert_type", "pattern"], "left_anti")
    undecided = pinned(fresh.withColumn("kept", F.lit(False)))
    settled = None
    while not undecided.isEmpty():
        live = undecided if settled is None else undecided.unionByName(settled)
        # The earliest live candidate containing the pattern; at the latest, the candidate itself.
        earliest = first_containing(undecided, live, "pattern", "message", order, ["alert_type"])
        judged = pinned(
            undecided.join(earliest, ["alert_type", "pattern"])
            .withColumn("kept", F.col("first") == F.col(order))
        )
        kept_now = judged.filter("kept").drop("first")
        settled = kept_now if settled is None else settled.unionByName(kept_now)
        silencers = settled.select("alert_type", F.col(order).alias("first"))
        undecided = pinned(
            judged.filter(~F.col("kept")).join(silencers, ["alert_type", "first"], "left_anti").drop("first")
        ).select(*kept_now.columns)
    result = undecided if settled is None else settled
    return result.select(*candidates.columns)


def _priority(value: Column, limit: int) -> Column:
    return F.when(value <= limit, "high").otherwise("medium")


def alert_candidates(medicines: DataFrame, batches: DataFrame, as_of) -> DataFrame:
    """What the periodic check would say before de-duplication.

    Low stock (1 to 20 units, high up to 5), stocked batches expiring within 30 days (high
    within 7) and stocked batches already expired (high). One pass over the batches serves
    both expiry kinds.
    """
    low = low_stock_medicines(medicines, batches, LOW_STOCK).select(
        F.lit("low_stock").alias("alert_type"),
        F.format_string(LOW_STOCK_MESSAGE, "name", "total_stock").alias("message"),
        F.col("id").alias("medicine_id"),
        F.lit(None).cast("bigint").alias("batch_id"),
        _priority(F.col("total_stock"), HIGH_STOCK).alias("priority"),
        F.col("id").alias("source_id"),
    )
    left = days_left("expiry_date", as_of)
    due = batches.filter((F.col("quantity") > 0) & (left <= ALERT_DAYS))
    expired = left < 0
    dated = batches_enriched(due, medicines).select(
        F.when(expired, "expired").otherwise("expiry").alias("alert_type"),
        F.when(expired, F.format_string(EXPIRED_MESSAGE, "batch_no", "medicine_name"))
        .otherwise(F.format_string(EXPIRY_MESSAGE, F.col("batch_no"), F.col("medicine_name"), left))
        .alias("message"),
        "medicine_id",
        F.col("id").alias("batch_id"),
        F.when(expired, "high").otherwise(_priority(left, HIGH_DAYS)).alias("priority"),
        F.col("id").alias("source_id"),
    )
    return low.unionByName(dated)


def stock_and_expiry_alerts(
    medicines: DataFrame, batches: DataFrame, alerts: DataFrame, as_of
) -> DataFrame:
    """New alerts of the periodic check, de-duplicated against unread ones and each other."""
    return dedupe_alerts(alert_candidates(medicines, batches, as_of), alerts).select(*CANDIDATE)


def new_batch_alerts(
    incoming: DataFrame, medicines: DataFrame, alerts: DataFrame, as_of, order: str = "id"
) -> DataFrame:
    """Alerts for batches just taken in that expire within 30 days or already have.

    ``order`` names the column telling in which order the batches came. The alert points to
    the medicine only.
    """
    left = days_left("expiry_date", as_of)
    due = batches_enriched(incoming.filter(left <= ALERT_DAYS), medicines)
    candidates = due.select(
        F.lit("expiry").alias("alert_type"),
        F.format_string(NEW_BATCH_MESSAGE, F.col("batch_no"), F.col("medicine_name"), left).alias("message"),
        "medicine_id",
        F.lit(None).cast("bigint").alias("batch_id"),
        _priority(left, HIGH_DAYS).alias("priority"),
        F.col(order).alias("source_id"),
    )
    return dedupe_alerts(candidates, alerts).select(*CANDIDATE)


def _checked(
    batches: DataFrame, medicines: DataFrame, alerts: DataFrame, kind: str, as_of, null_aware: bool
) -> DataFrame:
    severity = None if kind == "low_stock" else JOB_SEVERITIES[kind]
    quiet = not_alerted_today(batches, alerts, JOB_TYPES[kind], severity, as_of, null_aware)
    return batches_enriched(quiet, medicines)


def _dated(df: DataFrame, as_of, name: str) -> DataFrame:
    return df.select(
        "id",
        "batch_no",
        "expiry_date",
        "quantity",
        "mrp",
        "medicine_name",
        "category",
        days_left("expiry_date", as_of).alias(name),
    )


def expired_batches(
    batches: DataFrame, medicines: DataFrame, alerts: DataFrame, as_of, null_aware: bool = False
) -> DataFrame:
    """Batches past their date, in stock or not, without such an alert today."""
    due = batches.filter(days_left("expiry_date", as_of) < 0)
    return _dated(_checked(due, medicines, alerts, "expired", as_of, null_aware), as_of, "days_expired")


def near_expiry_batches(
    batches: DataFrame,
    medicines: DataFrame,
    alerts: DataFrame,
    as_of,
    config: AlertConfig = AlertConfig(),
    null_aware: bool = False,
) -> DataFrame:
    """Batches expiring from today to the near-expiry limit, without such an alert today."""
    due = batches.filter(days_left("expiry_date", as_of).between(0, config.near_expiry_days))
    return _dated(_checked(due, medicines, alerts, "near_expiry", as_of, null_aware), as_of, "days_until_expiry")


def expiring_soon_batches(
    batches: DataFrame,
    medicines: DataFrame,
    alerts: DataFrame,
    as_of,
    config: AlertConfig = AlertConfig(),
    null_aware: bool = False,
) -> DataFrame:
    """Batches expiring after 15 days and within the soon limit, without such an alert today."""
    left = days_left("expiry_date", as_of)
    due = batches.filter((left > SOON_AFTER_DAYS) & (left <= config.expiring_soon_days))
    return _dated(_checked(due, medicines, alerts, "expiring_soon", as_of, null_aware), as_of, "days_until_expiry")


def low_stock_batches(
    batches: DataFrame,
    medicines: DataFrame,
    alerts: DataFrame,
    as_of,
    config: AlertConfig = AlertConfig(),
    null_aware: bool = False,
) -> DataFrame:
    """Batches below the stock threshold, empty ones included, with their medicine's total."""
    due = batches.filter(F.col("quantity") < config.low_stock_threshold)
    return (
        _checked(due, medicines, alerts, "low_stock", as_of, null_aware)
        .join(total_stock(batches), "medicine_id", "left")
        .select("id", "batch_no", "quantity", "mrp", "medicine_name", "category", "total_stock")
    )


def job_alerts(frames: dict[str, DataFrame]) -> DataFrame:
    """Alert rows of the daily job from its checks, keyed expired, near_expiry, expiring_soon, low_stock."""
    def said(kind: str, df: DataFrame) -> DataFrame:
        detail = {
            "expired": lambda: [F.abs("days_expired")],
            "near_expiry": lambda: [F.col("days_until_expiry")],
            "expiring_soon": lambda: [F.col("days_until_expiry")],
            "low_stock": lambda: [F.col("quantity"), F.col("total_stock")],
        }[kind]()
        message = F.format_string(JOB_MESSAGES[kind], F.col("medicine_name"), F.col("batch_no"), *detail)
        return df.select(
            F.lit(kind).alias("batch_type"),
            F.col("id").alias("batch_id"),
            F.lit(JOB_TYPES[kind]).alias("alert_type"),
            message.alias("message"),
            F.lit(JOB_SEVERITIES[kind]).alias("severity"),
        )

    return reduce(DataFrame.unionByName, [said(kind, df) for kind, df in frames.items()])


def alert_summary(made: DataFrame) -> DataFrame:
    """Number of alerts per check and in total, 0 where a check found nothing."""
    names = made.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in (*JOB_TYPES, "total")])).alias("batch_type"),
        F.lit(0).cast("bigint").alias("n"),
    )
    counted = made.groupBy("batch_type").agg(F.count(F.lit(1)).alias("n"))
    both = counted.select(F.explode(F.array("batch_type", F.lit("total"))).alias("batch_type"), "n")
    return both.unionByName(names).groupBy("batch_type").agg(F.sum("n").cast("bigint").alias("alerts"))


def _due_kinds(as_of, config: AlertConfig) -> Column:
    """The checks a batch falls under, as a list."""
    left = days_left("expiry_date", as_of)
    tests = {
        "expired": left < 0,
        "near_expiry": left.between(0, config.near_expiry_days),
        "expiring_soon": (left > SOON_AFTER_DAYS) & (left <= config.expiring_soon_days),
        "low_stock": F.col("quantity") < config.low_stock_threshold,
    }
    return F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()])


def _kinds_said(alerts: DataFrame, as_of) -> DataFrame:
    """(kind, batch_id) of the alerts made on the day, for the checks they keep quiet."""
    kind = F.when(F.col("alert_type") == JOB_TYPES["low_stock"], "low_stock")
    for name in ("expired", "near_expiry", "expiring_soon"):
        same = (F.col("alert_type") == JOB_TYPES[name]) & (F.col("severity") == JOB_SEVERITIES[name])
        kind = kind.when(same, name)
    return (
        alerts.filter(F.to_date("created_at") == day(as_of))
        .select(kind.alias("kind"), "batch_id")
        .filter(F.col("kind").isNotNull())
        .distinct()
    )


def run_checks(
    batches: DataFrame,
    medicines: DataFrame,
    alerts: DataFrame,
    as_of,
    config: AlertConfig = AlertConfig(),
    null_aware: bool = False,
) -> JobRun:
    """The whole daily job: all checks see the alerts as they were, then alerts are made.

    The four checks share one pass: a batch yields a row per check it falls under, and one
    anti join on (check, batch) takes out what was said today.
    """
    due = batches.select(
        "id", "batch_no", "medicine_id", "quantity", "expiry_date", F.explode(_due_kinds(as_of, config)).alias("kind")
    ).filter(F.col("kind").isNotNull())
    said = _kinds_said(alerts, as_of)
    quiet = due.join(
        said.filter(F.col("batch_id").isNotNull()).withColumnRenamed("batch_id", "id"), ["kind", "id"], "left_anti"
    )
    if null_aware:
        quiet = quiet.join(said.filter(F.col("batch_id").isNull()).select("kind"), "kind", "left_anti")
    named = batches_enriched(quiet, medicines)
    with_total = named.join(total_stock(batches), "medicine_id", "left")
    left = days_left("expiry_date", as_of)
    details = {
        "expired": [F.abs(left)],
        "near_expiry": [left],
        "expiring_soon": [left],
        "low_stock": [F.col("quantity"), F.col("total_stock")],
    }
    message, kind_type, severity = F.lit(None), F.lit(None), F.lit(None)
    for kind, values in details.items():
        mine = F.col("kind") == kind
        said_as = F.format_string(JOB_MESSAGES[kind], F.col("medicine_name"), F.col("batch_no"), *values)
        message = F.when(mine, said_as).otherwise(message)
        kind_type = F.when(mine, JOB_TYPES[kind]).otherwise(kind_type)
        severity = F.when(mine, JOB_SEVERITIES[kind]).otherwise(severity)
    made = with_total.select(
        F.col("kind").alias("batch_type"),
        F.col("id").alias("batch_id"),
        kind_type.alias("alert_type"),
        message.alias("message"),
        severity.alias("severity"),
    )
    return JobRun(made.drop("batch_type"), alert_summary(made))
