"""Parquet tables of the data model and the labelled-symptom CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.schema import SYMPTOMS, TABLES


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] = tuple(TABLES)
) -> dict[str, DataFrame]:
    """The stored tables by name, read with their declared schema (no inference pass)."""
    base = directory.rstrip("/")
    return {name: spark.read.schema(TABLES[name]).parquet(f"{base}/{name}") for name in names}


def save_tables(tables: dict[str, DataFrame], directory: str) -> None:
    """Write each table as Parquet in its declared column order, missing columns as NULL."""
    base = directory.rstrip("/")
    for name, df in tables.items():
        conform(df, name).write.parquet(f"{base}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The declared columns and types of a table; columns it lacks become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def read_symptom_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Labelled symptom rows from CSV with a header.

    Leave ``multi_line`` off unless texts hold line breaks: with it on, a file is one task.
    """
    return (
        spark.read.schema(SYMPTOMS)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path)
    )


def write_symptom_csv(df: DataFrame, path: str) -> None:
    """Write labelled symptom rows as CSV with a header and no index column."""
    (
        df.select("symptoms", "medicine")
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
