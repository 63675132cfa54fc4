"""Daily sales as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelflot.functions.money import amount, total, units
from shelflot.schema import MONEY
from shelflot.session import pinned


def stream_daily_sales(sales: DataFrame, late: str = "1 day") -> DataFrame:
    """Units, revenue and lines per day of a sales stream, each day once it is complete.

    A day is complete when the newest sale seen is ``late`` past its end; lines arriving later
    are dropped, which the batch report would count: :func:`stream_daily_deltas` keeps them. The watermark needs a zoned timestamp, so
    the session time zone decides what a day is; it is meant to be UTC.
    """
    timed = sales.withColumn("sold_at", F.col("sold_on").cast("timestamp"))
    return (
        timed.withWatermark("sold_at", late)
        .groupBy(F.window("sold_at", "1 day"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            units("quantity_sold").alias("total_units"),
            total(amount()).alias("total_revenue"),
        )
        .select(
            F.to_date("window.start").alias("sale_date"), "transactions", "total_units", "total_revenue"
        )
    )


def write_daily_sales(
    days: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Append complete days to Parquet; without ``every`` handle what is there and stop."""
    writer = days.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


_DAY = [
    T.StructField("sale_date", T.DateType()),
    T.StructField("transactions", T.LongType()),
    T.StructField("total_units", T.LongType()),
    T.StructField("total_revenue", MONEY),
    T.StructField("late", T.BooleanType()),
]


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """What earlier micro-batches wrote."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)


def open_days(spark: SparkSession, path: str, key_type: str = "bigint") -> None:
    """Start a store of daily totals; sale lines are told apart by a key of the given type."""
    for name, schema in {"deltas": T.StructType(_DAY), "newest": "newest timestamp_ntz"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}/epoch=-1")
    none = spark.createDataFrame([], f"sale_date date, key {key_type}")
    none.write.partitionBy("sale_date").parquet(f"{path}/seen/epoch=-1")


def stream_daily_deltas(
    sales: DataFrame, path: str, checkpoint: str, key: str = "id", late_days: int = 1, every: str | None = None
) -> StreamingQuery:
    """Post a sales stream into daily totals as signed changes: every line counts once, however late it is.

    Each micro-batch appends to ``deltas`` what it adds to each day (a line of negative quantity takes away), apart
    for lines that are late: those of a day that was complete, ``late_days`` past its end, when the micro-batch
    before had ended. Late lines go to ``late`` as well, and lines without a time go there alone. A line whose key was posted
    before is a replay and left out; only the keys of the days that a micro-batch touches are read for that, so its
    cost follows its own lines. A micro-batch overwrites its own parts when it is run again.
    """

    def post(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        key_type = df.schema[key].dataType
        lines = pinned(df.withColumn("sale_date", F.to_date("sold_on")).dropDuplicates([key]))
        days = [r[0] for r in lines.where("sale_date IS NOT NULL").select("sale_date").distinct().collect()]  # one a day
        keys = T.StructType([T.StructField("key", key_type), T.StructField("epoch", T.LongType()), T.StructField("sale_date", T.DateType())])
        posted = spark.read.schema(keys).parquet(f"{path}/seen").where(F.col("sale_date").isin(days) & (F.col("epoch") < epoch))
        new = pinned(lines.join(posted.select(F.col("key").alias(key)), key, "left_anti"))
        before = spark.read.schema("newest timestamp_ntz").parquet(f"{path}/newest/epoch={epoch - 1}").agg(F.max("newest")).first()[0]
        closed = F.lit(False) if before is None else F.date_add("sale_date", late_days + 1) <= F.lit(before)
        told = new.withColumn("late", F.coalesce(closed, F.lit(False)))
        dated = told.where("sale_date IS NOT NULL")
        deltas = dated.groupBy("sale_date", "late").agg(
            F.count(F.lit(1)).alias("transactions"), units("quantity_sold").alias("total_units"), total(amount()).alias("total_revenue")
        )
        deltas.select(*[F.col(f.name).cast(f.dataType) for f in _DAY]).write.mode("overwrite").parquet(f"{path}/deltas/epoch={epoch}")
        told.where("late OR sale_date IS NULL").drop("late").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        own = dated.select(F.col(key).alias("key"), "sale_date").repartition("sale_date")
        own.write.mode("overwrite").partitionBy("sale_date").parquet(f"{path}/seen/epoch={epoch}")
        newest = new.agg(F.greatest(F.max("sold_on").cast("timestamp_ntz"), F.lit(before).cast("timestamp_ntz")).alias("newest"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/epoch={epoch}")

    writer = sales.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """The days of a store with their totals now, and how many lines came late."""
    return (
        _read(spark, T.StructType(_DAY), f"{path}/deltas")
        .groupBy("sale_date")
        .agg(
            F.sum("transactions").cast("bigint").alias("transactions"),
            F.sum("total_units").cast("bigint").alias("total_units"),
            F.sum("total_revenue").cast(MONEY).alias("total_revenue"),
            F.coalesce(F.sum(F.when(F.col("late"), F.col("transactions"))), F.lit(0)).cast("bigint").alias("late_lines"),
        )
    )
