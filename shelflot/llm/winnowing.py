"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ten consecutive words of a benchmark item; an item of fewer words is one window. Every window
of ten words has six groups of five; the least of their hashes is the window's fingerprint, so a text's
fingerprints are few, and a window that occurs in a document has the same one there and in its item.

1. Documents' fingerprints, each with the stretch of windows that chose it, meet the benchmark's, which are
   broadcast if they are counted to be few enough. Windows of shorter items are their own fingerprints: every
   group of as many words meets them.
2. Each meeting is extended: the windows of its stretch are compared whole, by hashes of all their words.
3. Windows found cover words and name items. Both are gathered once for each different text, and lists of
   items once for each different set of windows' item lists, so that copies cost nothing more.

Words and windows are compared by 64-bit hashes, texts by 128 bits of their SHA-256.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.llm.common import table
from shelflot.session import run_dir

#: Words of a window, and of the groups that are hashed for fingerprints.
WINDOW, GROUP = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to this many benchmark fingerprints or windows (16 bytes each) are sent to every worker.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for NULL."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(WORD), F.lit(0))


def _key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def _group(size: int, i: Column) -> Column:
    """The hash of the ``size`` words from place ``i`` of ``__hash``."""
    return F.xxhash64(F.lit(size), *[F.get(F.col("__hash"), i + j) for j in range(size)])


def _groups(size: int, count: Column) -> Column:
    """Hashes of all groups of ``size`` word hashes in ``__hash``."""
    starts = F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _group(size, i))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """``__hash``, the words' hashes, and ``__group``, those of their groups of five, instead of the text."""
    step = df.withColumn("__hash", F.transform(words(F.col(text)), lambda w: F.xxhash64(w))).drop(text)
    return step.withColumn("__group", _groups(GROUP, F.size("__hash")))


def _window(i: Column) -> Column:
    """The hash of the window of ten words that begins at ``i``."""
    return F.xxhash64(F.get(F.col("__group"), i), F.get(F.col("__group"), i + (WINDOW - GROUP)))


def fingerprints(hashed: DataFrame, short: list[int], windows: bool = False) -> DataFrame:
    """Explode ``fp``: struct(hash, words, first, upto), the windows from first to upto having this fingerprint.

    ``short`` are the numbers of words of windows of fewer than ten. With ``windows`` there is the array of their
    hashes too.
    """
    count = F.size("__group") - (WINDOW - GROUP)
    starts = F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    least = F.transform(starts, lambda i: F.least(*[F.get(F.col("__group"), i + j) for j in range(WINDOW - GROUP + 1)]))
    step = hashed.withColumn("__least", least)
    changed = F.filter(
        F.transform("__least", lambda x, i: F.when((i == 0) | (x != F.get(F.col("__least"), i - 1)), i)), lambda i: i.isNotNull()
    )
    step = step.withColumn("__changed", changed)
    upto = lambda k: F.coalesce(F.get(F.col("__changed"), k + 1), F.size("__least")) - 1
    chosen = F.transform(
        "__changed",
        lambda i, k: F.struct(
            F.get(F.col("__least"), i).alias("hash"),
            F.lit(WINDOW).alias("words"),
            i.alias("first"),
            upto(k).alias("upto"),
            *([F.transform(F.sequence(i, upto(k)), _window).alias("windows")] if windows else []),
        ),
    )
    def each(m: int) -> Column:
        return F.transform(
            _groups(m, F.size("__hash")),
            lambda x, i: F.struct(
                x.alias("hash"), F.lit(m).alias("words"), i.alias("first"), i.alias("upto"), *([F.array(x).alias("windows")] if windows else [])
            ),
        )

    whole = [each(m) for m in short]
    step = step.withColumn("__all", F.concat(chosen, *whole) if whole else chosen)
    # Outer: else Spark would filter by the size of the array before, and work it out again for that.
    return step.drop("__least", "__changed").withColumn("fp", F.explode_outer("__all")).drop("__all").where("fp IS NOT NULL")


def _small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast when it was counted to be within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """Add n_words, n_hit, n_items, ``items`` (sorted ids as strings) and ``contaminated`` to each document.

    NULL and empty texts have no words and hit nothing; items without words have no windows; a NULL item id
    counts as the empty string and rows of one item id as one item. Every row stays, repeated rows get equal
    results, columns of the result names are replaced. Either table may be empty. A document's word hashes
    are one array.
    """
    spark, path = docs.sparkSession, run_dir(docs.sparkSession, "winnow")
    added = ("n_words", "n_hit", "n_items", "items", "contaminated", "__key")
    kept = [c for c in docs.columns if c.lower() not in added]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], _key(F.col(f"`{text}`")).alias("__key"), F.col(f"`{text}`").alias("__whole"))

    # The benchmark's windows, each with the list of its items, and the lists once for each different one.
    items = _hashed(benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text}`").alias("__text")), "__text")
    n = F.size("__hash")
    lengths = [r["n"] for r in items.select(F.least(n, F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()]  # ten rows at most
    short = sorted(m for m in lengths if m < WINDOW)
    places = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    short_hash = F.coalesce(*[F.when(n == m, _group(m, F.lit(0))) for m in short], F.lit(0))
    whole = F.transform(places, lambda i: F.when(n >= WINDOW, _window(i)).otherwise(short_hash))
    windows = items.select("item", F.least(n, F.lit(WINDOW)).alias("words"), F.explode_outer(whole).alias("window")).where("window IS NOT NULL")
    lists = windows.groupBy("window", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    lists = lists.withColumn("list", F.unhex(F.sha2(F.to_json("items"), 256)))
    lists.write.parquet(f"{path}/windows")
    lists = spark.read.parquet(f"{path}/windows")
    own = fingerprints(items.where(n >= WINDOW), []).select(F.col("fp.hash").alias("hash"), F.col("fp.words").alias("words"))
    own.union(lists.where(F.col("words") < WINDOW).select("window", "words")).distinct().write.parquet(f"{path}/prints")
    prints = spark.read.parquet(f"{path}/prints")

    # Documents' fingerprints meet them; each meeting is extended to the windows of its stretch, compared whole.
    narrow = source.select("__key", "__whole")
    if prints.count() <= BROADCAST_ROWS:
        # No text or fingerprint is shuffled: windows are hashed beside the fingerprints.
        met = fingerprints(_hashed(narrow, "__whole"), short, windows=True).select("__key", "fp.*")
        met = met.join(F.broadcast(prints), ["hash", "words"], "left_semi")
        hit = met.select("__key", "words", "first", F.posexplode("windows").alias("k", "window"))
        hit = hit.select("__key", "words", (F.col("first") + F.col("k")).alias("at"), "window")
    else:
        # Fingerprints alone are shuffled, and only texts that met the benchmark are read again.
        met = fingerprints(_hashed(narrow, "__whole"), short).select("__key", "fp.*")
        met = met.join(prints, ["hash", "words"], "left_semi")
        met = met.groupBy("__key").agg(F.collect_set(F.struct("words", "first", "upto")).alias("met"))
        again = _hashed(narrow.join(met, "__key"), "__whole")
        stretch = F.transform(
            "met", lambda m: F.transform(F.sequence(m["first"], m["upto"]), lambda i: F.struct(m["words"].alias("words"), i.alias("at")))
        )
        opened = F.transform(
            F.flatten(stretch),
            lambda w: F.struct(
                w["words"].alias("words"),
                w["at"].alias("at"),
                F.coalesce(*[F.when(w["words"] == m, _group(m, w["at"])) for m in short], _window(w["at"])).alias("window"),
            ),
        )
        hit = again.select("__key", F.explode_outer(opened).alias("w")).select("__key", "w.words", "w.at", "w.window")
    sure = hit.join(_small(lists.select("window", "words", "list")), ["window", "words"])
    sure = sure.groupBy("__key").agg(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("words")).alias("end")))).alias("hits"),
        F.sort_array(F.collect_set("list")).alias("lists"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "hits",
        zero,
        lambda s, h: F.struct(
            F.greatest(s["end"], h["end"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(s["end"], h["at"]))).alias("n"),
        ),
    )["n"]
    together = F.unhex(F.sha2(F.array_join(F.transform("lists", lambda x: F.hex(x)), "").cast("binary"), 256))
    sure.select("__key", covered.cast("long").alias("n_hit"), together.alias("set"), "lists").write.parquet(f"{path}/sure")
    sure = spark.read.parquet(f"{path}/sure")

    # Lists of items, made once for each different set.
    sets = sure.groupBy("set").agg(F.first("lists").alias("lists")).select("set", F.explode("lists").alias("list"))
    named = lists.groupBy("list").agg(F.first("items").alias("items"))
    named = sets.join(named, "list").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    result = sure.select("__key", "n_hit", "set").join(named, "set").drop("set")
    every = source.withColumn("n_words", F.size(words(F.col("__whole"))).cast("long")).drop("__whole")
    return every.join(result, "__key", "left").select(
        *[F.col(f"`{c}`") for c in kept],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_decontaminate(spark: SparkSession, directory: str) -> DataFrame:
    """What every document shares with the benchmark, the items as a digest of their ids."""
    found = contaminated(
        table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "benchmark", "item_id", "text")
    )
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
OP13_SQL = rf"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS n, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(words) - {WINDOW - 2}, 2))) AS i) WHERE len(words) > 0),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, {_SQL_WORDS} AS words FROM documents),
places AS (
  SELECT row_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM docs, (SELECT DISTINCT n FROM windows), LATERAL (SELECT unnest(range(1, greatest(len(words) - n + 2, 1))) AS i)),
found AS (SELECT DISTINCT row_id, n, i, w FROM places SEMI JOIN windows USING (n, w)),
hits AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT row_id, item FROM found JOIN windows USING (n, w)) GROUP BY row_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (row_id) LEFT JOIN named USING (row_id)
"""
