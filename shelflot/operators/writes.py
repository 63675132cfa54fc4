"""Changes to the tables, as snapshots in and snapshots out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflot.functions.dates import moment
from shelflot.functions.text import clean
from shelflot.operators.validate import FIELDS, Checked, split_by_reasons, with_reasons
from shelflot.schema import MONEY


class Deleted(NamedTuple):
    medicines: DataFrame
    batches: DataFrame


def upsert_medicines(current: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Medicines after inserting new ids and updating known ones.

    Texts are trimmed and a change without a name is ignored. Ids are unique within
    ``changes``. New rows get ``created_at``, changed rows ``updated_at``.
    """
    stamp = moment(now)
    usable = changes.select("id", *[clean(c).alias(f"__{c}") for c in FIELDS]).filter(F.col("__name") != "")
    merged = current.withColumn("__old", F.lit(True)).join(
        usable.withColumn("__new", F.lit(True)), "id", "full"
    )
    changed = F.col("__new").isNotNull()
    known = F.col("__old").isNotNull()
    return merged.select(
        "id",
        *[F.when(changed, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS],
        F.when(known, F.col("created_at")).otherwise(stamp).alias("created_at"),
        F.when(known & changed, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*current.columns)


def ingest_batches(batches: DataFrame, incoming: DataFrame, order: str = "row") -> Checked:
    """Parse raw batch records (texts) and accept those with a new batch number.

    A record needs a medicine and a batch number and readable numbers; the batch number must
    be neither in ``batches`` nor on an acceptable record earlier in ``order``. An unreadable
    or empty date becomes NULL. Rejected records carry their reasons.
    """
    def number(column: str, kind: str):
        return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("x")).try_cast(kind)

    parsed = incoming.select(
        order,
        F.trim(F.col("medicine_id")).try_cast("bigint").alias("medicine_id"),
        clean("batch_no").alias("batch_no"),
        *[
            F.when(F.col(c).isNull(), F.lit(0).cast(kind)).otherwise(number(c, kind)).alias(c)
            for c, kind in (("quantity", "bigint"), ("mrp", MONEY), ("cost_price", MONEY))
        ],
        F.trim("mfg_date").try_cast("date").alias("mfg_date"),
        F.trim("expiry_date").try_cast("date").alias("expiry_date"),
        clean("supplier").alias("supplier"),
    )
    unreadable = F.col("quantity").isNull() | F.col("mrp").isNull() | F.col("cost_price").isNull()
    checked = with_reasons(
        parsed,
        {
            "number_invalid": unreadable,
            "batch_or_medicine_missing": (F.col("batch_no") == "") | F.col("medicine_id").isNull(),
        },
    )
    # First acceptable record per number, as an aggregate: a number that fills the load is
    # combined before it is shuffled.
    firsts = (
        checked.filter(F.size("reasons") == 0)
        .groupBy("batch_no")
        .agg(F.min(order).alias("__first"))
    )
    taken = batches.select("batch_no").distinct().withColumn("__taken", F.lit(True))
    known = (
        checked.join(firsts, "batch_no", "left")
        .join(taken, "batch_no", "left")
    )
    duplicate = (F.size("reasons") == 0) & (
        F.col("__taken").isNotNull() | (F.col(order) > F.col("__first"))
    )
    judged = known.withColumn(
        "reasons", F.when(duplicate, F.array(F.lit("batch_exists"))).otherwise(F.col("reasons"))
    ).drop("__first", "__taken")
    return split_by_reasons(judged.select(*parsed.columns, "reasons"))


def delete_medicines(
    medicines: DataFrame, batches: DataFrame, ids: DataFrame, cascade: bool = False
) -> Deleted:
    """Both tables without the given medicines; their batches stay unless ``cascade`` is set."""
    gone = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    kept = medicines.join(gone, "id", "left_anti").select(*medicines.columns)
    if not cascade:
        return Deleted(kept, batches)
    orphaned = gone.withColumnRenamed("id", "medicine_id")
    return Deleted(kept, batches.join(orphaned, "medicine_id", "left_anti").select(*batches.columns))
