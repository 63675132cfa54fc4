"""A corpus made ready for training: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.llm import byte_bpe, jaccard_join, mixing, secret_scan, toxicity
from shelflot.llm.common import ship, table
from shelflot.session import run_dir

#: Documents that score this high are rejected.
TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents that the class-conditional models, fitted on the labelled ones, don't find toxic.

    Empty and NULL texts have no evidence and stay.
    """
    model = toxicity.train(docs, table(spark, directory, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model, out="__score")
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    return scored.where((F.col("__score") < TOXIC) | blank).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document, that of the least id, of each class linked by five-word shingles at 0.8 or more."""
    return jaccard_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and ``n_chars`` brought in line."""
    found = secret_scan.find_secrets(docs, out="__spans")
    clean = found.withColumn("text", secret_scan.redacted(spans="__spans"))
    if "n_chars" in docs.columns:
        changed = F.size("__spans") > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The documents in the order of the mix; those of sources above their share of the data recur."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its very bytes."""
    found = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), add=("ids", "round_trip"), drop=("text",))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    ship(spark)
    path, docs = run_dir(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
