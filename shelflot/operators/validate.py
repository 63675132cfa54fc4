"""Data-quality checks on medicine records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.text import clean

# The categories, length bounds and text limits that results depend on.
CATEGORIES = (
    "Analgesic",
    "Antibiotic",
    "Antihistamine",
    "Antacid",
    "NSAID",
    "Anti-diabetic",
    "Statin",
    "Thyroid hormone",
    "Bronchodilator",
    "Proton pump inhibitor",
    "ARB",
    "SSRI",
    "Vitamin",
    "Other",
)
NAME_LENGTH = (2, 100)
TEXT_MINIMUM = 10
TEXT_LIMITS = {"uses": 500, "dosage": 300, "side_effects": 500}
DANGER_PERCENT = 90
WARNING_PERCENT = 75

FIELDS = ("name", "category", "composition", "uses", "dosage", "side_effects")


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def with_reasons(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of the checks a row fails, in the order given."""
    failing = F.array(*[F.when(test, F.lit(reason)) for reason, test in checks.items()])
    return df.withColumn("reasons", F.filter(failing, lambda reason: reason.isNotNull()))


def split_by_reasons(df: DataFrame) -> Checked:
    return Checked(
        df.filter(F.size("reasons") == 0).drop("reasons"), df.filter(F.size("reasons") > 0)
    )


def medicine_reasons(df: DataFrame) -> DataFrame:
    """Medicine records, trimmed, with the list of rules each one breaks."""
    trimmed = df.withColumns({c: clean(c) for c in FIELDS if c in df.columns})
    low, high = NAME_LENGTH
    checks = {
        "name_missing": F.col("name") == "",
        "name_length": (F.col("name") != "") & ~F.length("name").between(low, high),
        "category_missing": F.col("category") == "",
        "category_unknown": (F.col("category") != "") & ~F.col("category").isin(*CATEGORIES),
    }
    for text in ("composition", "uses", "dosage"):
        checks[f"{text}_short"] = F.length(text) < TEXT_MINIMUM
    return with_reasons(trimmed, checks)


def validate_medicines(df: DataFrame) -> Checked:
    """Records that satisfy every rule, and the others with their reasons."""
    return split_by_reasons(medicine_reasons(df))


def text_budget(df: DataFrame) -> DataFrame:
    """Per record and text: its length, its limit, and the band it falls in."""
    def band(column: str, limit: int) -> Column:
        used = F.length(F.coalesce(F.col(column), F.lit("")))
        share = used * 100
        return F.struct(
            F.lit(column).alias("field"),
            used.alias("length"),
            F.lit(limit).alias("limit"),
            F.when(share > limit * DANGER_PERCENT, "danger")
            .when(share > limit * WARNING_PERCENT, "warning")
            .otherwise("ok")
            .alias("band"),
        )

    return df.select("id", F.inline(F.array(*[band(c, n) for c, n in TEXT_LIMITS.items()])))


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids present in both tables whose fields differ, with the names of those fields.

    New values are compared trimmed, but for the category, which is chosen from a list.
    """
    def after(field: str) -> Column:
        value = F.coalesce(F.col(f"n.{field}"), F.lit(""))
        return value if field == "category" else F.trim(value)

    differing = F.array(
        *[
            F.when(F.coalesce(F.col(f"o.{c}"), F.lit("")) != after(c), F.lit(c))
            for c in FIELDS
        ]
    )
    return (
        old.alias("o")
        .join(new.alias("n"), F.col("o.id") == F.col("n.id"))
        .select(F.col("o.id").alias("id"), F.filter(differing, lambda c: c.isNotNull()).alias("changed"))
        .filter(F.size("changed") > 0)
    )
