"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order shuffled by hash, are cut into blocks of equal size. Block i of a source
with weight w is released at floor(i / w) and due at ceil((i + 1) / w), and in each slot the released block
that is due first is served. Every block then lies in its window, so at any slot each source has
been served within less than one block of its weight.

Weights are shares of a period of slots, after which the schedule repeats. So only one period, whose length
depends on the weights and not on the data, is scheduled; the place of any block follows from it by
arithmetic, and the documents are placed by joins.

The mix ends when every source has been served once in full. Sources above their share of the data
thus begin again, and their documents occur several times; no document is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflot.llm.common import table
from shelflot.session import partitions, pinned

#: Characters in a block.
BLOCK_CHARS = 1 << 16
#: Slots in a period, or as many for each source at least.
RESOLUTION, SLOTS_PER_SOURCE = 2_000, 20
#: Weights, one number for each source, pass through the driver; more sources than this are refused.
MAX_SOURCES = 50_000
#: Without target weights a source's weight is its size to this power.
TEMPER = 0.7
NO_SOURCE = "(none)"


def shares(weights: Mapping[str, float]) -> tuple[dict[str, int], int]:
    """Whole slots for each source in a period, by largest remainders, one at least; and the period."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"{len(weights)} sources; at most {MAX_SOURCES} are mixed")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    period, total = max(RESOLUTION, SLOTS_PER_SOURCE * len(weights)), sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in sorted(weights.items())}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(slots.values())]:
        slots[s] += 1
    return slots, period


def schedule(slots: Mapping[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period, the earliest deadline first among the released blocks."""
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append((s, i, slot))
        if i + 1 < slots[s]:
            heapq.heappush(waiting, ((i + 1) * period // slots[s], s, i + 1))
    return out


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, temper: float = TEMPER
) -> DataFrame:
    """Every occurrence of every document in the mix.

    ``docs`` has ``doc_id, source, text``; other columns are not read. A NULL source is the source
    ``(none)``, a NULL or empty text counts one character, a document longer than a block takes up the
    blocks that it reaches into, repeated rows are documents of their own. Sources without
    a weight are refused; weights of sources without documents are left out. An empty table gives no rows.

    Rows: doc_id, text_hash, copy (numbers rows of equal doc_id and text), source, epoch, block
    (from 0, of its source), release, deadline, slot, place (order inside the slot).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1)).cast("long").alias("size"),
    )
    alike = Window.partitionBy("doc_id", "text_hash").orderBy("source", "size")
    rows = rows.withColumn("copy", F.row_number().over(alike))
    order = F.xxhash64("doc_id", "text_hash", "copy")
    rows = pinned(rows.withColumn("order", order))
    placed = pinned(_with_upto(rows))
    placed = placed.withColumn("block", F.floor((F.col("upto") - F.col("size")) / block_chars).cast("long"))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("size"), F.ceil(F.max("upto") / block_chars).cast("long").alias("blocks"))
    found = {r["source"]: r for r in sizes.limit(MAX_SOURCES + 1).collect()}
    if weights is None:
        weights = {s: r["size"] ** temper for s, r in found.items()}
    elif missing := sorted(set(found) - set(weights))[:5]:
        raise ValueError(f"sources without a weight: {', '.join(missing)}")
    plan, sources = _plan(spark, {s: weights[s] for s in found}, {s: r["blocks"] for s, r in found.items()})
    served = F.expr("sequence(0L, (occurrences - block - 1) div blocks)")
    turns = (
        placed.join(F.broadcast(sources), "source")  # at most MAX_SOURCES rows
        .withColumn("epoch", F.explode(served))
        .withColumn("turn", F.col("epoch") * F.col("blocks") + F.col("block"))
        .withColumn("in_period", F.col("turn") % F.col("share"))
    )
    return turns.join(F.broadcast(plan), ["source", "in_period"]).select(  # one period
        "doc_id", "text_hash", "copy", "source", "epoch", "block",
        F.expr("turn * period div share").alias("release"),
        F.expr("((turn + 1) * period + share - 1) div share").alias("deadline"),
        F.expr("turn div share * period + slot").alias("slot"),
        F.col("upto").alias("place"),
    )


def _with_upto(rows: DataFrame) -> DataFrame:
    """Rows with ``upto``, the sizes of their source's rows up to them in the shuffled order.

    The order is a hash, so equal ranges of it cut a source, however hot, into parts of about equal
    size. Rows are summed in their part, and a window over one total for each part gives what lies before.
    """
    parts = partitions(rows.sparkSession)
    part = F.floor((F.shiftright("order", 40) + F.lit(1 << 23)) * parts / F.lit(1 << 24)).cast("int")
    cut = rows.withColumn("part", part)
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "text_hash", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("source", "part").agg(F.sum("size").alias("total"))
    before = totals.select("source", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    summed = cut.withColumn("upto", F.sum("size").over(inside)).join(before, ["source", "part"])
    return summed.withColumn("upto", F.col("upto") + F.col("before")).drop("part", "before")


def _plan(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """One period's slots, and for each source its share, blocks and occurrences until the mix ends."""
    slots, period = shares(weights) if weights else ({}, 1)
    served = schedule(slots, period) if weights else []
    place = {(s, i): slot for s, i, slot in served}
    end = 0
    for s, n in blocks.items():
        turn, inside = divmod(n - 1, slots[s])
        end = max(end, turn * period + place[s, inside] + 1)
    whole, rest = divmod(end, period)
    counts = {s: whole * slots[s] for s in slots}
    for s, _, slot in served:
        counts[s] += slot < rest
    plan = spark.createDataFrame(
        [(s, i, slot) for s, i, slot in served], "source string, in_period long, slot long"
    )
    sources = spark.createDataFrame(
        [(s, slots[s], period, blocks[s], counts[s]) for s in slots],
        "source string, share long, period long, blocks long, occurrences long",
    )
    return plan, sources


def mixed_rows(docs: DataFrame, weights: Mapping[str, float] | None = None, **settings) -> DataFrame:
    """The documents themselves in the order of the mix, with their columns as they are."""
    turns = mix(docs, weights, **settings).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th"), F.col("copy").alias("__k"),
        F.col("slot").alias("__slot"), F.col("place").alias("__place"),
    )
    alike = Window.partitionBy("doc_id", "__hash").orderBy(
        F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE))
    )
    numbered = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__copy", F.row_number().over(alike))
    same = numbered["doc_id"].eqNullSafe(turns["__id"]) & (numbered["__hash"] == turns["__th"]) & (numbered["__copy"] == turns["__k"])
    found = numbered.join(turns, same)
    ordered = found.repartitionByRange(partitions(docs.sparkSession), "__slot", "__place").sortWithinPartitions("__slot", "__place")
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_source_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The mix of all documents by tempered weights of their sources."""
    turns = mix(table(spark, directory, "documents", "doc_id", "source", "text"))
    return turns.select("doc_id", "source", "epoch", "block", "release", "deadline", "slot")
