"""Interaction checks between medicines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflot.operators.joins import SMALL_BYTES, measured_bytes
from shelflot.session import pinned


def known_pairs(interactions: DataFrame) -> DataFrame:
    """One entry per unordered pair of names: the one with the least id."""
    pair = [F.least("drug_a", "drug_b").alias("low"), F.greatest("drug_a", "drug_b").alias("high")]
    entry = F.struct("id", "interaction", "severity", "recommendation")
    return (
        interactions.filter(F.col("drug_a").isNotNull() & F.col("drug_b").isNotNull())
        .groupBy(*pair)
        .agg(F.min(entry).alias("entry"))
        .select("low", "high", *[F.col(f"entry.{c}").alias(c) for c in ("id", "interaction", "severity", "recommendation")])
    )


def check_interactions(pairs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Each pair (drug1, drug2) with what is known of it, in either order; NULLs if nothing is.

    Names are compared exactly and with case.
    """
    low = F.least("drug1", "drug2")
    high = F.greatest("drug1", "drug2")
    both = F.col("drug1").isNotNull() & F.col("drug2").isNotNull()
    keyed = pairs.withColumn("low", F.when(both, low)).withColumn("high", F.when(both, high))
    return keyed.join(known_pairs(interactions).drop("id"), ["low", "high"], "left").drop("low", "high")


def basket_interactions(
    items: DataFrame, interactions: DataFrame, basket: str = "cart_id", name: str = "medicine_name"
) -> DataFrame:
    """Known interactions between any two medicines of one basket.

    Every basket goes the shorter of two ways. One with few medicines beside the partners they
    are known to have forms its pairs, which are then looked up. In the others the known pairs
    lead: an item looks up the partners of its name, and those are then looked up in its
    basket. So no more pairs are formed than either way alone would form.
    """
    pairs = pinned(known_pairs(interactions).filter(F.col("low") < F.col("high")))
    small = measured_bytes(pairs) <= SMALL_BYTES
    known = F.broadcast(pairs) if small else pairs
    names = pairs.select(F.col("low").alias("name"), F.lit(1).alias("n")).unionByName(
        pairs.select(F.col("high").alias("name"), F.lit(0).alias("n"))
    )
    relevant = names.groupBy("name").agg(F.sum("n").alias("partners"))
    held = (
        items.select(F.col(basket).alias("basket"), F.col(name).alias("name"))
        .filter(F.col("basket").isNotNull())
        .join(F.broadcast(relevant) if small else relevant, "name")
        .distinct()
    )
    n = F.count(F.lit(1))
    sizes = held.groupBy("basket").agg((n * (n - 1) <= 2 * F.sum("partners")).alias("few"))
    dealt = held.drop("partners").join(sizes, "basket")
    few, many = dealt.filter("few").drop("few"), dealt.filter(~F.col("few")).drop("few")
    formed = (
        few.withColumnRenamed("name", "low")
        .join(few.withColumnRenamed("name", "high"), "basket")
        .filter(F.col("low") < F.col("high"))
        .select("basket", "low", "high")
    )
    links = known.select("low", "high")
    partners = many.withColumnRenamed("name", "low").join(links, "low")
    led = partners.join(many.withColumnRenamed("name", "high"), ["basket", "high"]).select("basket", "low", "high")
    return formed.unionByName(led).join(known, ["low", "high"]).select(
        F.col("basket").alias(basket),
        F.col("low").alias("drug_a"),
        F.col("high").alias("drug_b"),
        "interaction",
        "severity",
        "recommendation",
    )
