"""Quality rules at the level of hosts, in DataFrame functions only.

Every document is measured by simple rules. Failures are counted for each host, the host's rate is
shrunk towards the rate of all hosts by a beta prior that is fitted to them by moments, and a host
whose shrunk rate passes a limit takes its documents with it. A host with few documents is thus
judged mostly by what is usual, a large one by its own record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.llm.common import table
from shelflot.operators.joins import SMALL_BYTES, lookup_join
from shelflot.session import pinned, run_dir

SYMBOLS = "#*$%&|<>"
BLANK_CLASS, WORD_CLASS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
#: Most per cent of words in repeated windows, of symbols to words, of repeated lines.
MAX_REPEATED, MAX_SYMBOLS, MAX_LINES = 20, 10, 30
#: A host is rejected when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (2.0, 10_000.0)

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text; those of NULL are those of the empty text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``,
    ``n_repeat_words``. Rows are kept as they are, columns of these names are replaced. Windows are
    compared by 64-bit hashes inside one text.
    """
    keep = [c for c in df.columns if c.lower() not in _MEASURES]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = df.select(*[F.col(f"`{c}`") for c in keep], whole.alias("__text"))
    words = F.filter(F.split("__text", BLANK_CLASS), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD_CLASS))
    step = step.withColumns(
        {
            "__hash": F.transform(words, lambda w: F.xxhash64(w)),
            "__chars": F.char_length(F.array_join(words, "")),
            "__symbols": F.char_length("__text") - F.char_length(F.regexp_replace("__text", f"[{SYMBOLS}]+", "")),
            "__n_lines": F.size(lines),
            "__n_own_lines": F.size(F.array_distinct(lines)),
        }
    ).drop("__text")
    at = lambda i, j: F.get(F.col("__hash"), i + j)
    places = F.when(
        F.size("__hash") >= WINDOW, F.sequence(F.lit(0), F.size("__hash") - WINDOW)
    ).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("__windows", F.transform(places, lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)])))
    found_twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__order", F.when(found_twice, ordered))

    def repeated(x: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get(F.col("__order"), j)["h"] == x["h"], F.lit(False))
        return F.when(same(k - 1) | same(k + 1), x["i"])

    starts = F.sort_array(F.filter(F.transform("__order", repeated), lambda i: i.isNotNull()))
    step = step.withColumn("__starts", F.when(F.col("__order").isNotNull(), starts).otherwise(F.array().cast("array<int>")))
    gap = lambda i, k: F.least(i - F.coalesce(F.get(F.col("__starts"), k - 1), i - WINDOW), F.lit(WINDOW))
    covered = F.aggregate(F.transform("__starts", gap), F.lit(0), lambda a, x: a + x)
    return step.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__hash").cast("long").alias("n_words"),
        F.col("__chars").cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        F.col("__n_lines").cast("long").alias("n_lines"),
        (F.col("__n_lines") - F.col("__n_own_lines")).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """Whether a document's own measures fail it, whatever its host."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def any_failed() -> Column:
    """Whether any rule fails; this is what hosts are judged by."""
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_LINES * F.col("n_lines"))
    )


def host_verdicts(measured: DataFrame, host: str = "host") -> DataFrame:
    """For each host that is not NULL: n_docs, n_failed, its shrunk ``host_rate`` and ``host_ok``.

    The prior has the mean of all documents, and the weight at which a beta distribution has the
    hosts' variance beyond that of chance. Without documents there is no host.
    """
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("n_docs"), F.sum(any_failed().cast("long")).alias("n_failed")
    )
    n, f = F.col("n_docs"), F.col("n_failed")
    total = hosts.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_failed").alias("all_failed"), F.count("*").alias("n_hosts"))
    mean = F.col("all_failed") / F.col("all_docs")
    spread = hosts.crossJoin(F.broadcast(total)).agg(  # one row
        F.first("all_docs").alias("all_docs"), F.first("all_failed").alias("all_failed"), F.first("n_hosts").alias("n_hosts"),
        F.sum(n * (f / n - mean) * (f / n - mean)).alias("squares"), F.sum(n * n).alias("n_squares"),
    )
    chance = mean * (1 - mean)
    beyond = F.col("squares") - (F.col("n_hosts") - 1) * chance
    between = F.try_divide(beyond, F.col("all_docs") - F.col("n_squares") / F.col("all_docs"))  # NULL with one host
    weight = F.when(between > 0, F.least(F.greatest(chance / between - 1, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])))
    prior = spread.select(mean.alias("prior_mean"), F.coalesce(weight, F.lit(PRIOR_WEIGHT[1])).alias("prior_weight"))
    rate = (f + F.col("prior_mean") * F.col("prior_weight")) / (n + F.col("prior_weight"))
    judged = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", rate)  # one row
    return judged.select(host, "n_docs", "n_failed", "host_rate", (F.col("host_rate") <= MAX_HOST_RATE).alias("host_ok"))


def judge(df: DataFrame, text: str = "text", host: str = "source", small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept``; every row stays and repeated rows are judged alike.

    Documents without a host are judged by their own measures. The measures are kept as a table in the
    shared folder, so that texts are read once. Verdicts are measured: few are sent to the rows, which stay
    where they are, and many meet the rows of a host in salted parts, so no task gets a hot host whole.
    """
    spark, path = df.sparkSession, run_dir(df.sparkSession, "measures")
    added = {*_MEASURES, "base_failed", "kept", "__host", "__spread", "__ok"}
    rest = [c for c in df.columns if c.lower() not in added | {text.lower()}]
    narrow = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{host}`").cast("string").alias("__host"), F.col(f"`{text}`").alias("__whole"))
    measure(narrow, "__whole").drop("__whole").write.parquet(path)
    measured = spark.read.parquet(path)
    verdicts = pinned(host_verdicts(measured, "__host").select("__host", F.col("host_ok").alias("__ok")))
    named = measured.where("__host is not null").withColumn("__spread", F.monotonically_increasing_id())
    judged = lookup_join(named, verdicts, "__host", "__spread", small_bytes).drop("__spread")
    joined = judged.unionByName(measured.where("__host is null").withColumn("__ok", F.lit(True)))
    return joined.select(
        *[F.col(f"`{c}`") for c in rest],
        *_MEASURES,
        base_failed().alias("base_failed"),
        (~base_failed() & F.col("__ok")).alias("kept"),
    )


def op8_host_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Measures and verdicts of every document, its source being its host."""
    judged = judge(table(spark, directory, "documents", "doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_BLANKS = r"\x20\x09-\x0D"
OP8_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT row_id, regexp_extract_all(text, '[^{_BLANKS}]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS}]')) AS lines
  FROM docs),
windows AS (
  SELECT row_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM split, LATERAL (SELECT unnest(range(1, len(words) - {WINDOW - 2})) AS i)),
twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT row_id, sum(least({WINDOW}, i - coalesce(before, i - {WINDOW}))) AS n
  FROM (SELECT row_id, i, lag(i) OVER (PARTITION BY row_id ORDER BY i) AS before FROM twice) GROUP BY row_id),
measured AS (
  SELECT d.row_id, doc_id, source, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN split s USING (row_id) LEFT JOIN covered c USING (row_id)),
failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words OR 100 * n_symbols > {MAX_SYMBOLS} * word_chars
      OR 100 * n_dup_lines > {MAX_LINES} * n_lines AS any_failed
  FROM measured),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(any_failed::INT)::DOUBLE AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
total AS (SELECT sum(f) / sum(n) AS mean, sum(n) AS n, count(*) AS hosts, sum(n * n) AS squares FROM hosts),
spread AS (
  SELECT any_value(mean) AS mean, (sum(h.n * (h.f / h.n - mean) * (h.f / h.n - mean)) - (any_value(hosts) - 1) * any_value(mean * (1 - mean)))
    / nullif(any_value(t.n) - any_value(squares) / any_value(t.n), 0) AS between_hosts
  FROM hosts h, total t),
prior AS (
  SELECT mean, CASE WHEN between_hosts > 0
    THEN least(greatest(mean * (1 - mean) / between_hosts - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) ELSE {PRIOR_WEIGHT[1]} END AS weight FROM spread),
verdicts AS (SELECT source, (f + mean * weight) / (n + weight) <= {MAX_HOST_RATE} AS host_ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_ok, true) AS kept
FROM failed LEFT JOIN verdicts USING (source)
"""
