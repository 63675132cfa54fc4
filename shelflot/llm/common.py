"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import io
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.session import partitions, pinned

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's source to the workers, once for each context, as ``--py-files`` would."""
    context, home = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_sent_packages", None) == home:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(home.rglob("*.py")):
            archive.write(file, f"{home.name}/{file.relative_to(home)}")
    path = Path(tempfile.mkdtemp(prefix=f"{home.name}-")) / f"{home.name}-source.zip"
    path.write_bytes(data.getvalue())
    context.addPyFile(str(path))  # the driver serves it
    context._sent_packages = home


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Columns of one Parquet table of a directory (all without names)."""
    ship(spark)
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def least_hashes(wanted: float, of: int) -> int:
    """The highest of the 64-bit hashes that ``wanted`` of so many evenly spread ones are expected not to exceed."""
    return (1 << 63) - 1 if of <= wanted else int(wanted / of * 2.0**64) - (1 << 63)


def slices(batches: Iterable[pa.RecordBatch], column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of one text column, a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def extend(
    df: DataFrame,
    inputs: list[str],
    outputs: list[T.StructField],
    compute: Callable[[Iterator[pa.RecordBatch]], Iterator[list]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns that Python computes; columns of the same names are replaced.

    ``compute`` gets record batches of the input columns, the first of which sets the size of
    the slices, and yields for each the list of the output columns. Each column is sent once; those
    in ``drop`` don't come back.
    """
    ship(df.sparkSession)
    names = {f.name.lower() for f in outputs} | {c.lower() for c in drop}
    keep = [c for c in df.columns if c.lower() not in names]
    sent = {c.lower(): i for i, c in enumerate(keep)}
    extra = [c for c in dict.fromkeys(inputs) if c.lower() not in sent]
    sent |= {c.lower(): len(keep) + i for i, c in enumerate(extra)}
    at = [sent[c.lower()] for c in inputs]
    source = df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(extra)])
    schema = T.StructType([df.schema[c] for c in keep] + outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at[0]):
                held.append(batch)
                yield batch.select(at)

        for columns in compute(feed()):
            batch = held.pop()
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(kept + list(columns), names=schema.names)

    return source.mapInArrow(run, schema)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """Connected components of an edge table: rows (node, component), the smallest node of each.

    Alternating star contractions: each round links every node's larger neighbours to its smallest
    neighbour, then its smaller ones, so that the number of rounds grows with the logarithm of
    the size, whatever the shape. A node's neighbours are only aggregated and joined, never
    collected, and each round is kept with ``checkpoint()``. Self links are allowed; nodes are
    of any ordered type and not NULL. With ``rounds`` the work ends after as many: nodes of one component
    may then still have different ones, but nodes of different components never the same.
    """
    given = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    # Edges are few beside the rows they come from, so they are kept in fewer parts.
    parts = max(1, partitions(edges.sparkSession) // 8)
    start = pinned(given.distinct().coalesce(parts))
    pairs, before, done = start.where("lo < hi"), None, 0
    while done != rounds:
        done += 1
        both = pairs.union(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.least(F.min("hi"), F.first("lo")).alias("root"))
        large = both.join(least, "lo").where("hi > lo").select(F.col("root").alias("lo"), "hi")
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        linked = large.join(root, "hi").select("root", "lo", "hi")
        inner = linked.where("lo > root").select(F.col("root").alias("lo"), F.col("lo").alias("hi"))
        small = linked.select(F.col("root").alias("lo"), "hi").union(inner)
        pairs = pinned(small.distinct().coalesce(parts))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    release(edges.sparkSession)
    linked = pairs if rounds is None else pairs.groupBy("hi").agg(F.min("lo").alias("lo"))
    # At rest every node that is not the least of its component is linked with that node alone.
    roots = start.select(F.col("lo").alias("hi")).union(start.select("hi")).distinct().join(linked, "hi", "left_anti")
    return linked.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select(F.col("hi").alias("node"), F.col("hi").alias("component"))
    )
