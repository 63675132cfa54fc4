"""Near-duplicate vectors through an inverted multi-index.

The two halves of a vector have codebooks of their own, whose product is a grid of cells. A vector lies in
the cell of its nearest centroids. As a query it visits cells in the order of their summed distances (the
multi-sequence order), as many as a sample needed to reach the target recall, and is compared
there exactly.

Codebooks and the number of visits are fitted on bounded samples, for each length of vectors by itself; every
vector is indexed and is a query. Vectors of one component are compared by their sign.
Equal vectors are one entry with a weight. A cell's members and its queries are cut into blocks, and a task
compares two blocks: no group is larger, however hot its cell. A task sends for each vector the
number of its links and one link of a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.common import components, ship, table
from shelflot.session import pinned, run_dir

COSINE = 0.98
TARGET_RECALL = 0.999
#: Vectors that train the codebooks and vectors whose links set the visits, in the order of a hash.
TRAIN_ROWS, PROBE_ROWS = 20_000, 512
#: Vectors to a cell at which the grid grows, and the most centroids for a half.
PER_CELL, MAX_CENTROIDS = 50, 512
#: Cells that are visited at least, whatever the sample needed.
MIN_VISITS = 8
BLOCK = 2_048
ROUNDS = 10


def units(column, dim: int) -> np.ndarray:
    """Rows of ``dim`` floats or doubles as bytes as vectors of length one in double precision."""
    rows = np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8") for x in column]).astype(float)
    top = np.abs(rows).max(1, keepdims=True)
    far = ((top < 1e-100) | (top > 1e100))[:, 0]  # their squares would leave the range
    rows[far] /= top[far]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(1)


def codebook(rows: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows chosen at random; fewer when there are fewer rows."""
    random = np.random.default_rng(seed)
    centroids = rows[np.sort(random.choice(len(rows), min(size, len(rows)), replace=False))].copy()
    for _ in range(ROUNDS):
        near = _distances(rows, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(counts > 0, sums / np.maximum(counts, 1), centroids)
    return centroids


class Grid:
    """Two codebooks and the cells of their product."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.half = (first, second), first.shape[1]
        self.cells = len(first) * len(second)

    def order(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """For each row its nearest ``visits`` cells, nearest first; the first is its own.

        A cell among the nearest m pairs centroids whose ranks multiply to m at most, so only
        those of the first m ranks of either half are looked at.
        """
        visits = min(visits, self.cells)
        d = [_distances(x, b) for x, b in zip((rows[:, : self.half], rows[:, self.half :]), self.books, strict=True)]
        ranked = [np.argsort(x, axis=1, kind="stable")[:, :visits] for x in d]
        costs = [np.take_along_axis(x, r, 1) for x, r in zip(d, ranked, strict=True)]
        i, j = np.meshgrid(np.arange(costs[0].shape[1]), np.arange(costs[1].shape[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= visits
        i, j = i[near], j[near]
        sums = costs[0][:, i] + costs[1][:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        cells = ranked[0][:, i] * len(self.books[1]) + ranked[1][:, j]
        return np.take_along_axis(cells, best, 1).astype(np.int32)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``label, dim, node, weight, vector`` (its bytes) of each distinct vector that can link."""
    return rows.where("usable").groupBy("label", "dim", "node").agg(F.count("*").alias("weight"), F.first("vector").alias("vector"))


def usable_rows(df: DataFrame) -> DataFrame:
    """``vec_id, label, dim, node, usable, vector`` of every row.

    Usable are vectors with a label, of finite components that are not all zero. Floats stay floats, other
    numbers are doubles; of a single component only the sign is kept.
    """
    single = isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    given = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    v = F.when(F.size(given) == 1, F.transform(given, lambda x: F.signum(x).cast("float" if single else "double"))).otherwise(given)
    finite = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(given, lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite & some, F.lit(False))
    rows = df.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"), usable.alias("usable"))
    node = F.md5(F.concat_ws(",", F.size("v").cast("string"), F.col("label"), F.col("v").cast("array<string>")))
    dtype = "<f4" if single else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            out = [x.values.to_numpy(zero_copy_only=False).astype(dtype).tobytes() if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "node", "usable", "vector"])

    vector = F.when(F.col("usable"), F.col("v"))
    shaped = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size("v").alias("dim"), node.alias("node"), "usable", vector.alias("vector"))
    return shaped.mapInArrow(pack, "vec_id bigint, label string, dim int, node string, usable boolean, vector binary")


def fit(vectors: DataFrame, n: int, dim: int) -> Grid:
    """The grid of a bounded sample of ``n`` distinct vectors of one length; its cells grow with their number."""
    half = dim // 2
    size = int(np.clip(round((n / PER_CELL) ** 0.5), 1, MAX_CENTROIDS))
    if dim == 1:
        return Grid(np.zeros((1, 0)), np.array([[-1.0], [1.0]]))
    if size == 1:
        return Grid(np.zeros((1, half)), np.zeros((1, dim - half)))
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(TRAIN_ROWS).select("vector").toArrow()["vector"].to_pylist()
    rows = units(sample, dim)
    return Grid(codebook(rows[:, :half], size), codebook(rows[:, half:], size, 13))


def grids(vectors: DataFrame, target: float, cosine: float) -> dict[int, tuple[Grid, int]]:
    """The grid and the number of visits for each length; lengths of few vectors have one cell and need no sample."""
    out = {}
    for dim, n in vectors.groupBy("dim").count().collect():
        own = vectors.where(F.col("dim") == dim)
        grid = fit(own, n, dim)
        out[dim] = grid, visits_for(own, grid, target, cosine, dim) if grid.cells > 1 and dim > 1 else 1
    return out


def visits_for(vectors: DataFrame, grid: Grid, target: float, cosine: float, dim: int) -> int:
    """How many cells a query must visit until the sample's links are found at the target rate.

    The vectors are of one length. A bounded sample of queries is compared with every vector; each query's links count as one.
    """
    probes = vectors.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(PROBE_ROWS).select("label", "node", "vector").toArrow()
    labels, nodes = np.array(probes["label"].to_pylist()), np.array(probes["node"].to_pylist())
    queries = units(probes["vector"].to_pylist(), dim)
    shared = vectors.sparkSession.sparkContext.broadcast((labels, nodes, queries, grid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, nodes, queries, grid = shared.value
        order = grid.order(queries, grid.cells)
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(grid.cells, dtype=np.int32)[None], 1)
        for batch in batches:
            for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
                own, names = np.array(part.column(0).to_pylist()), np.array(part.column(1).to_pylist())
                rows = units(part.column(2).to_pylist(), dim)
                linked = (queries @ rows.T >= cosine) & (labels[:, None] == own[None]) & (nodes[:, None] != names[None])
                q, y = np.nonzero(linked)
                rank = ranks[q, grid.order(rows, 1)[y, 0]] if len(q) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(rank, pa.int32())], names=["q", "rank"])

    found = vectors.select("label", "node", "vector").mapInArrow(run, "q int, rank int")
    counts = found.groupBy("q", "rank").agg(F.count("*").alias("n")).toArrow()  # PROBE_ROWS times the cells at most
    if not counts.num_rows:
        return min(MIN_VISITS, grid.cells)
    q, rank, n = (counts[c].to_numpy() for c in ("q", "rank", "n"))
    share = n / np.bincount(q, weights=n)[q]
    curve = np.cumsum(np.bincount(rank, weights=share)) / share.sum()
    return int(min(max(np.searchsorted(curve, target - 1e-12) + 1, MIN_VISITS), grid.cells))


def placed(vectors: DataFrame, found: dict[int, tuple[Grid, int]]) -> DataFrame:
    """Vectors with the cells they visit in the grid of their length, their own first."""
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
                dims, data = part.column(1).to_numpy(), part.column(4)
                counts, own = np.zeros(len(dims), np.int64), {}
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    grid, visits = shared.value[dim]
                    own[dim] = at, grid.order(units(data.take(pa.array(at)).to_pylist(), dim), visits)
                    counts[at] = own[dim][1].shape[1]
                offsets = np.concatenate([[0], np.cumsum(counts)])
                flat = np.empty(offsets[-1], np.int32)
                for at, cells in own.values():
                    flat[offsets[at][:, None] + np.arange(cells.shape[1])] = cells
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["label", "dim", "node", "weight", "vector", "cells"])

    return vectors.select("label", "dim", "node", "weight", "vector").mapInArrow(
        run, "label string, dim int, node string, weight bigint, vector binary, cells array<int>"
    )


def _compare(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, queries = pdf[~pdf["query"]], pdf[pdf["query"]]
        if members.empty or queries.empty:
            return pd.DataFrame({"node": [], "links": [], "root": []})
        dim = int(pdf["dim"].iloc[0])
        names, place = np.unique(np.concatenate([members["node"], queries["node"]]).astype(str), return_inverse=True)
        at_m, at_q = place[: len(members)], place[len(members) :]
        wm, wq = members["weight"].to_numpy(), queries["weight"].to_numpy()
        cells = np.stack(members["cells"].to_list())
        home = np.array([c[0] for c in queries["cells"]])
        ym, counts, root = units(members["vector"], dim), np.zeros(len(names), np.int64), np.arange(len(names))
        ends = []
        for k in range(0, len(queries), 512):
            close = units(queries["vector"].iloc[k : k + 512], dim) @ ym.T >= cosine
            q, m = np.nonzero(close & (at_q[k : k + 512, None] != at_m[None]))
            q = q + k
            np.add.at(counts, at_q[q], wm[m])
            # A member that does not visit the query's own cell will not count this link as a query.
            unseen = (cells[m] != home[q][:, None]).all(1)
            np.add.at(counts, at_m[m[unseen]], wq[q[unseen]])
            ends.append(np.column_stack([at_q[q], at_m[m]]))
        ends = np.concatenate(ends)
        while True:  # the least vector that each is linked with inside this task
            low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
            new = root.copy()
            np.minimum.at(new, ends[:, 0], low)
            np.minimum.at(new, ends[:, 1], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = (counts > 0) | (root != np.arange(len(names)))
        return pd.DataFrame({"node": names[some], "links": counts[some], "root": names[root[some]]})

    return run


def links(cells: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``node, links, root``: parts of each vector's number of links, and a vector that it is linked with."""
    members = cells.withColumn("cell", F.get("cells", 0)).withColumn("query", F.lit(False))
    queries = cells.withColumn("cell", F.explode("cells")).withColumn("query", F.lit(True))
    sizes = queries.groupBy("label", "dim", "cell").agg(
        F.count("*").alias("queries"), F.sum((F.col("cell") == F.get("cells", 0)).cast("long")).alias("members")
    )
    sizes = sizes.where("members > 0 and queries > 1").select(
        "label", "dim", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("queries") / BLOCK).cast("int").alias("qb")
    )
    own = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    m = members.join(sizes, ["label", "dim", "cell"]).withColumn("m", F.pmod(own, "mb").cast("int")).withColumn("q", F.explode(every("qb")))
    q = queries.join(sizes, ["label", "dim", "cell"]).withColumn("q", F.pmod(own, "qb").cast("int")).withColumn("m", F.explode(every("mb")))
    keys = ["label", "dim", "cell", "m", "q"]
    columns = [*keys, "query", "node", "weight", "vector", "cells"]
    both = m.select(*columns).union(q.select(*columns))
    return both.groupBy(*keys).applyInPandas(_compare(cosine), "node string, links bigint, root string")


def near_duplicates(df: DataFrame, cosine: float = COSINE, target: float = TARGET_RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``; others are not read.

    Vectors are linked when their labels and lengths are equal and their cosine in double precision is at least
    ``cosine``. Rows with a NULL label, or a vector that is NULL, zero or has
    components that are NULL or not finite, link with nothing. Repeated vectors link with each other.
    A NULL vec_id counts as no least one and is not kept. An empty table gives no rows.
    """
    spark, path = df.sparkSession, run_dir(df.sparkSession, "vectors")
    ship(spark)
    usable_rows(df).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    vectors = pinned(distinct_vectors(rows))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    if vectors.isEmpty():
        return alone.select("*", kept)
    cells = placed(vectors, grids(vectors, target, cosine))
    found = pinned(links(pinned(cells), cosine))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    places = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = vectors.select("node", "weight").join(counts, "node", "left").join(places, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    linked = rows.where("usable").select("vec_id", "node").join(info, "node")
    least = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = linked.join(least, "component").select("vec_id", "n_links", "component_id")
    return joined.union(alone).select("*", kept)


def op2_near_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """The links and components of all vectors."""
    return near_duplicates(table(spark, directory, "embeddings", "vec_id", "embedding", "label"))
