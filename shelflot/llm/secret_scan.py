"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A text's SHA-256 is its blob. A ledger says which blob was scanned by which version of which rule
and what was found. A scan reads each blob once, however many paths or versions hold it, and only by
rules that have not seen it; findings are then joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelflot.llm.common import table
from shelflot.session import run_dir

LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start int, `end` int"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of ``pattern`` that do not overlap; of them those whose
    ``group`` has ``least`` characters or more count. A new pattern needs a new version."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1


_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
BASE = (
    Rule("assign", rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # A run is matched whole from its start, so that shorter ones need not be matched to be dropped.
    Rule("access", "AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 40),
)
RULES = BASE + ADDED


def blob_of(text: str = "text") -> Column:
    """The content address of a text; NULL counts as the empty text."""
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)


def stored(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A part of a ledger, empty where none was written yet."""
    folder = f"{path}/{part}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(folder)
    return spark.createDataFrame([], schema)


def _matches(rule: Rule, text: str = "text") -> Column:
    """What a due rule matches in a text, with the lengths of what lies before each match.

    Where lists of unequal length meet, what is missing is NULL: the part behind the last match.
    """
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("own"),
    )

    def one(z: Column, k: Column) -> Column:
        known = [F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least")]
        return F.struct(*known, k.alias("k"), z["gap"].alias("gap"), z["size"].alias("size"), z["own"].alias("own"))

    return F.when(F.array_contains("due", rule.name) & F.col(text).rlike(rule.pattern), F.transform(zipped, one))


def _hits(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Matches of the rules that a blob still needs: rows in the form of FINDINGS.

    The lengths of matches and of what lies between them, summed over one text, are the places.
    """
    found = [_matches(rule) for rule in rules]
    empty = F.array().cast("array<struct<rule:string,version:int,least:int,k:int,gap:int,size:int,own:int>>")
    all_found = F.concat(*[F.coalesce(f, empty) for f in found])
    rows = blobs.select("blob", F.explode(all_found).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)
    return (
        rows.withColumn("end", end)
        .where("own >= least")  # the part behind the last match has no size
        .select("blob", "rule", "version", (F.col("end") - F.col("size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    )


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Bring a ledger up to date with the texts of all given versions.

    Findings are written before the scanned pairs, so a scan that dies is repeated and
    nothing is lost; what it had found already is not counted twice, since readers take distinct rows.
    """
    spark = versions.sparkSession
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    # Copies meet in the task that reads them first, then once for each task.
    blobs = versions.select(blob_of(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = stored(spark, ledger, "scanned", LEDGER).groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
    due = F.array_except(pairs, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>")))
    todo = blobs.join(seen, "blob", "left").withColumn("due", F.transform(due, lambda d: d["rule"])).where(F.size("due") > 0)
    _hits(todo.select("blob", "text", "due"), rules).write.mode("append").parquet(f"{ledger}/findings")
    ids = versions.select(blob_of(text).alias("blob")).distinct().select("blob", F.explode(pairs).alias("p")).select("blob", "p.*")
    before = stored(spark, ledger, "scanned", LEDGER)
    ids.join(before, ["blob", "rule", "version"], "left_anti").write.mode("append").parquet(f"{ledger}/scanned")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with a finding by the rules' present versions: ``spans``, an array of
    (start, place of the rule, rule, end) in that order; places in code points, the end exclusive."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(i))])
    place = F.try_element_at(order, F.concat_ws(":", "rule", "version"))
    rows = stored(spark, ledger, "findings", FINDINGS).distinct().withColumn("place", place).where("place is not null")
    return rows.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "place", "rule", "end"))).alias("spans"))


def find_secrets(
    df: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "spans"
) -> DataFrame:
    """Add ``out``, the secrets in each row's text as in ``findings``, an empty array where there is none.

    All rows and columns are kept, repeated rows too; NULL and empty texts hold nothing; a column named
    as ``out`` is replaced. A given ledger is brought up to date, else one in the shared folder is begun.
    The join back to the rows is by blob; rows of a hot blob are split by the adaptive join.
    """
    ledger = ledger or run_dir(df.sparkSession, "ledger")
    scan(df, ledger, rules, text)
    found = findings(df.sparkSession, ledger, rules).select(F.col("blob").alias("__own"), F.col("spans").alias("__found"))
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    joined = df.withColumn("__blob", blob_of(text)).join(found, F.col("__blob") == F.col("__own"), "left")
    empty = F.array().cast("array<struct<start:int,place:int,rule:string,end:int>>")
    return joined.select(*rest, F.coalesce("__found", empty).alias(out))


def redacted(text: str = "text", spans: str = "spans", mark: str = "[secret]") -> Column:
    """The text with its secrets replaced by a mark; spans that touch or overlap share one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    state = "struct<at:int,out:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)

    def step(a: Column, s: Column) -> Column:
        gap = F.concat(a["out"], F.substring(whole, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        out = F.when((s["start"] > a["at"]) | (a["at"] == 0) & (a["out"] == ""), gap).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out")).cast(state)

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.char_length(whole))))
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of scanned documents."""
    base = [r.name for r in BASE]
    joined = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    own = lambda *names: F.filter("spans", lambda s: s["rule"].isin(*names))
    return found.select(
        "doc_id",
        *[F.size(own(name)).cast("long").alias(f"n_{name}") for name in base],
        F.sha2(joined(own(*base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    """The secrets of every document."""
    return digests(find_secrets(table(spark, directory, "documents", "doc_id", "text")))


def _sql_spans(rule: Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT row_id, {place} AS place, '{rule.name}' AS rule, own,
    sum(length(gap) + length(m)) OVER (PARTITION BY row_id ORDER BY k) AS e, length(m) AS size
  FROM (SELECT row_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(gs) AS own, unnest(gaps[1:len(ms)]) AS gap
    FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs,
      string_split_regex(text, '{pattern}') AS gaps FROM docs))
  QUALIFY length(own) >= {rule.least}"""


OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
joined AS (
  SELECT row_id, string_agg(rule || ':' || (e - size)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - size, place) AS spans,
    string_agg(rule || ':' || (e - size)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - size, place) FILTER (place < {len(BASE)}) AS base,
    {", ".join(f"count(*) FILTER (rule = '{r.name}') AS n_{r.name}" for r in BASE)}
  FROM found GROUP BY row_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.name}, 0)::BIGINT AS n_{r.name}" for r in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (row_id)
"""
