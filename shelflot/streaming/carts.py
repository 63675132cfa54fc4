"""Cart posting as a stream over a keyed stock ledger.

The stock lies in buckets by the hash of the batch id, each in versions, and a manifest per micro-batch names
the version of every bucket. A micro-batch reads the manifest of the one before it, reads and judges only the
buckets that its carts touch, writes those anew under its own number, then its manifest. Its cost thus
follows its carts and their buckets, whatever was posted before. A replayed micro-batch starts from the same
manifest and overwrites its own version, so nothing is sold twice, and one that fails before its manifest is
written has changed nothing. Decisions and sales are appended and never read again. ``fold`` writes a new
ledger without the old versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelflot.operators.carts import apply_sales, cart_lines
from shelflot.operators.joins import SMALL_BYTES, measured_bytes
from shelflot.schema import BATCHES

#: Buckets of a new ledger, and the most that there may be: a manifest passes through the driver.
BUCKETS, MAX_BUCKETS = 64, 100_000
_MANIFEST = "bucket int, version bigint"


def _bucket(batch_id: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(batch_id), F.lit(buckets)).cast("int")


def _write_stock(stock: DataFrame, path: str, version: int, buckets: int, placed: bool = False) -> None:
    """The rows of some buckets as one version of them; ``placed`` if they lie as the files of buckets were read."""
    rows = stock.withColumn("bucket", _bucket("id", buckets))
    rows = rows if placed else rows.repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/stock/version={version}")


def _write_manifest(spark: SparkSession, path: str, epoch: int, versions: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(versions.items()), _MANIFEST).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")


def manifest(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """The version of every bucket after a micro-batch, as many entries as there are buckets; -1 is the opening."""
    return dict(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/epoch={epoch}").collect())


def open_ledger(batches: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Start a ledger with the given stock."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"between 1 and {MAX_BUCKETS} buckets")
    _write_stock(batches, path, -1, buckets)
    _write_manifest(batches.sparkSession, path, -1, dict.fromkeys(range(buckets), -1))


def _stock(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    """The given versions of buckets: whole versions are read by partition, so that files are listed once for each."""
    by_version: dict[int, list[int]] = {}
    for bucket, version in versions.items():
        by_version.setdefault(version, []).append(bucket)
    schema = T.StructType([*BATCHES.fields, T.StructField("bucket", T.IntegerType())])
    parts = [
        spark.read.schema(schema).parquet(f"{path}/stock/version={version}").where(F.col("bucket").isin(own))
        for version, own in sorted(by_version.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("bucket")


def last_epoch(spark: SparkSession, path: str) -> int:
    """The last micro-batch that is in the ledger; -1 before the first."""
    return spark.read.schema(f"{_MANIFEST}, epoch bigint").parquet(f"{path}/manifest").agg(F.max("epoch")).first()[0]


def current_stock(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Stock now, or as it was before a micro-batch."""
    return _stock(spark, path, manifest(spark, path, last_epoch(spark, path) if before is None else before - 1))


def fold(spark: SparkSession, path: str, into: str) -> None:
    """Write a new ledger at ``into`` that opens with the present stock, without the versions before."""
    versions = manifest(spark, path, last_epoch(spark, path))
    open_ledger(_stock(spark, path, versions), into, len(versions))


def stream_apply_sales(
    carts: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Apply a stream of carts to the ledger at ``path``; every micro-batch in order of cart time.

    A micro-batch reads the touched buckets as they were before it and writes its own versions and partitions,
    so one that is replayed after a failure writes the same again instead of selling twice.
    """
    def post(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        versions = manifest(spark, path, epoch - 1)
        checked = cart_lines(df)
        lines = checked.accepted
        known = lines.where("batch_id IS NOT NULL").select(_bucket("batch_id", len(versions)).alias("bucket"))
        touched = [r.bucket for r in known.distinct().collect()]  # no more than there are buckets
        own = {bucket: versions[bucket] for bucket in touched}
        # Carts on no batch at all are judged against any one bucket.
        done = apply_sales(_stock(spark, path, own or {0: versions[0]}), lines, first_id=None)
        refused = checked.rejected.select("cart_id", F.lit(False).alias("accepted"), "reason")
        done.sales.write.mode("overwrite").parquet(f"{path}/sales/epoch={epoch}")
        done.decisions.unionByName(refused).write.mode("overwrite").parquet(f"{path}/decisions/epoch={epoch}")
        if own:
            # Few units taken are broadcast, so the stock still lies by the files of its buckets.
            _write_stock(done.batches, path, epoch, len(versions), measured_bytes(done.taken) <= SMALL_BYTES)
        _write_manifest(spark, path, epoch, versions | dict.fromkeys(own, epoch))

    writer = carts.writeStream.foreachBatch(post).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
