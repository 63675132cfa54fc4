"""Which text contains a pattern, for many patterns and many texts, without comparing all pairs.

Every pattern is reduced to its longest part free of wildcards, the anchor. A text can only
match if it contains the anchor, so both sides get keys of which they must then share one:

* an anchor of at least ``SPANS[0]`` characters gives the least hash of each window of as many
  characters as the longest span it reaches; a window holds overlapping pieces of about two
  thirds of its length. The text has the same windows wherever it contains the anchor, so it
  has the same least hashes; of all windows of the pattern the one found in the fewest texts
  becomes its key. Long spans give a text few keys that are hardly shared. A pattern whose key
  many texts have all the same gets the finer keys of the least span, and so do those texts;
* a shorter anchor is its own key, and texts are cut into pieces of just the lengths that
  occur (all below ``SPANS[0]``);
* a pattern of wildcards alone matches by length, through a table with one row per length.

Pairs that share a key are then tested with LIKE itself, so the answer is exact, and only the
first text per pattern is kept, in an aggregate that is combined before its shuffle. A key
carried by very many texts becomes a skewed join partition, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflot.functions.text import ascii_lower, contains_pattern
from shelflot.session import partitions, pinned

#: Window lengths in characters, and how many texts may have the key of a long one.
SPANS = (11, 16, 24, 36, 48)
LONG = SPANS[0]
RARE = 64


def _span(length: Column) -> Column:
    """The longest span an anchor reaches; 0 for a short one."""
    return F.greatest(*[F.when(length >= n, n).otherwise(0) for n in SPANS])


def _width(span: Column) -> Column:
    """Pieces in a window: 4 of 8 characters in the least span, 17 of 32 in the longest."""
    return F.floor(span / 3).cast("int") + 1


def _with_pieces(df: DataFrame, text: str, span: Column, out: str) -> DataFrame:
    """Add the hashes of all pieces, in order; none for a text shorter than ``span`` or without one.

    They are a column of their own, which is used twice, so Spark keeps it and every piece is
    hashed once.
    """
    length = span - _width(span) + 1
    hashes = F.transform(
        F.sequence(F.lit(1), F.length(text) - length + 1),
        lambda i: F.xxhash64(F.substr(F.col(text), i, length)),
    )
    return df.withColumn(
        out, F.when((span > 0) & (F.length(text) >= span), hashes).otherwise(F.array().cast("array<bigint>"))
    )


def _window_keys(pieces: str, span: Column) -> Column:
    """Distinct least hashes over the windows of ``pieces``."""
    windows = F.size(pieces) - _width(span) + 1
    least = F.transform(
        F.sequence(F.lit(1), windows), lambda j: F.array_min(F.slice(pieces, j, _width(span)))
    )
    return F.when(windows > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _short_key(piece: Column) -> Column:
    return F.xxhash64(F.lit("short"), piece)


def _keys_of_length(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - F.lit(n - 1))
    return F.transform(starts, lambda i: _short_key(F.substr(text, i, F.lit(n))))


def _piece_keys(text: Column, lengths: Column) -> Column:
    """Keys of all pieces of ``text`` having one of ``lengths``."""
    per_length = [
        F.when(
            F.array_contains(lengths, n) & (F.length(text) >= n), _keys_of_length(text, n)
        ).otherwise(F.array().cast("array<bigint>"))
        for n in range(1, LONG)
    ]
    return F.array_distinct(F.concat(*per_length))


def _exploded(df: DataFrame, keys: Column, within: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """A row per key, which stands for ``within`` too.

    The outer form keeps Spark from testing the list first, which would build it twice.
    """
    rows = df.select(*dict.fromkeys([*within, *kept]), F.explode_outer(keys).alias("__k"))
    return rows.filter(F.col("__k").isNotNull()).select(*kept, F.xxhash64("__k", *within).alias("__key"))


def _pattern_keys(patterns: DataFrame, within: Sequence[str]) -> DataFrame:
    pieces = _with_pieces(patterns, "__anchor", F.col("__span"), "__pieces")
    keys = F.when(F.col("__span") == 0, F.array(_short_key(F.col("__anchor")))).otherwise(
        _window_keys("__pieces", F.col("__span"))
    )
    return _exploded(pieces, keys, within, [*within, "__pattern", "__span"])


def _text_keys(texts: DataFrame, spans: Sequence[int], lengths: Sequence[int], within: Sequence[str]) -> DataFrame:
    """Keys carry the order of their text, not the text, which is looked up again for the few pairs that share a key."""
    for n in spans:
        texts = _with_pieces(texts, "__text", F.lit(n), f"__pieces{n}")
    keys = [_window_keys(f"__pieces{n}", F.lit(n)) for n in spans]
    if lengths:
        keys.append(_piece_keys(F.col("__text"), F.array(*[F.lit(n) for n in lengths])))
    none = F.array().cast("array<bigint>")
    return _exploded(texts, F.array_distinct(F.concat(*keys)) if keys else none, within, ["__order"])


def _sharing(patterns: DataFrame, texts: DataFrame, within: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rarest key of each pattern with the number of texts that have it, and the keys of the texts.

    ``patterns`` holds (within, __pattern, __anchor, __span). A pattern is left out if no text has one of its keys.
    """
    seen = patterns.agg(
        F.collect_set(F.when(F.col("__span") > 0, F.col("__span"))).alias("spans"),
        F.collect_set(F.when(F.col("__span") == 0, F.length("__anchor"))).alias("lengths"),
    ).first()
    pattern_keys = pinned(_pattern_keys(patterns, within))
    text_keys = pinned(
        _text_keys(texts, sorted(seen["spans"]), sorted(seen["lengths"]), within).join(
            pattern_keys.select("__key").distinct(), "__key", "left_semi"
        )
    )
    counts = text_keys.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    rarest = (
        pattern_keys.join(counts, "__key", "left")
        .groupBy(*within, "__pattern", "__span")
        .agg(
            F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__key").alias("key"))).alias("__r")
        )
        .filter(F.col("__r.n") > 0)
        .select(*within, "__pattern", "__span", F.col("__r.n").alias("__n"), F.col("__r.key").alias("__key"))
    )
    return pinned(rarest), text_keys


def _anchor(pattern: Column) -> Column:
    parts = F.transform(F.split(pattern, "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    return F.array_max(parts)["p"]


def first_containing(
    patterns: DataFrame,
    texts: DataFrame,
    pattern: str,
    text: str,
    order: str,
    within: Sequence[str] = (),
) -> DataFrame:
    """For each distinct pattern, the least ``order`` among the texts that contain it.

    ``within`` names columns on which pattern and text must also agree. Returns
    (*within, pattern, first): patterns that no text contains are absent, as are NULLs.
    ``order`` may be a struct, which carries further columns of the text along.
    """
    within = list(within)
    p = (
        patterns.filter(F.col(pattern).isNotNull())
        .select(*within, ascii_lower(pattern).alias("__pattern"))
        .distinct()
        .withColumn("__anchor", _anchor(F.col("__pattern")))
    )
    t = (
        texts.filter(F.col(text).isNotNull())
        .groupBy(*within, ascii_lower(text).alias("__text"))
        .agg(F.min(order).alias("__order"))
    )
    # Both sides are distinct by now and about to grow many times over, so they are spread
    # over all tasks rather than over as many as their present size asks for.
    n = partitions(p.sparkSession)
    p, t = pinned(p.repartition(n, "__pattern")), pinned(t.repartition(n, "__text"))
    anchor_length = F.length("__anchor")
    keyed = p.filter(anchor_length > 0).withColumn("__span", _span(anchor_length))
    rarest, text_keys = _sharing(keyed, t, within)
    common = rarest.filter((F.col("__span") > LONG) & (F.col("__n") > RARE))
    pairs = rarest.filter((F.col("__span") <= LONG) | (F.col("__n") <= RARE)).join(text_keys, "__key")
    pairs = pairs.select(*within, "__pattern", "__order")
    if not common.isEmpty():
        # A text that contains such a pattern has its key, so only those texts get finer keys.
        again = keyed.join(common.select(*within, "__pattern"), [*within, "__pattern"], "left_semi")
        sharing = text_keys.join(common.select("__key").distinct(), "__key", "left_semi").select("__order").distinct()
        finer, finer_keys = _sharing(
            again.withColumn("__span", F.lit(LONG)), t.join(sharing, "__order", "left_semi"), within
        )
        pairs = pairs.unionByName(finer.join(finer_keys, "__key").select(*within, "__pattern", "__order"))
    by_key = (
        pairs.join(t, [*within, "__order"])
        .filter(contains_pattern(F.col("__text"), F.col("__pattern")))
        .select(*within, "__pattern", "__order")
    )
    underscores = F.length("__pattern") - F.length(F.replace(F.col("__pattern"), F.lit("_"), F.lit("")))
    by_length = (
        p.filter(anchor_length == 0)
        .withColumn("__k", underscores)
        .join(
            t.groupBy(*within, F.length("__text").alias("__len"))
            .agg(F.min("__order").alias("__order"))
            .withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__len")))),
            [*within, "__k"],
        )
        .select(*within, "__pattern", "__order")
    )
    return (
        by_key.unionByName(by_length)
        .groupBy(*within, "__pattern")
        .agg(F.min("__order").alias("first"))
        .withColumnRenamed("__pattern", "pattern")
    )
