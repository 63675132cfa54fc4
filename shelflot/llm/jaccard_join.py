"""Jaccard join of documents by their word n-grams with a grouped prefix join.

Shingles are put in one order for all documents, the rarest first. Two sets as alike as the threshold
asks share a shingle among the first n - ceil(t n) + 1 of each, their prefixes. Shingles that one
document alone has lead to no pair, so most documents are done when their prefixes are known.

1. Texts are dealt into chunks and become sets of 64-bit shingle hashes there. How many documents have
   each shingle is counted over all chunks: every chunk sends each shingle once, as the distances
   of sorted 40-bit hashes, so a frequent shingle is no hot key. Back to a chunk goes what more
   than one document has. Hashes that fall together are counted together, in every document alike, which
   leaves the order one order.
2. Documents with the same prefix and size form a group; equal sets are one variant in it. Groups meet by
   the shingles of their prefixes, once for a whole group. A document that shares any of its prefix keeps
   its set beside it.
3. Pairs of groups are filtered: by their sizes; by their shingles that no other document has, as these
   come first in a prefix and none of them can be shared; and by 512 bits, each the parity of
   a part of the other shingles. Bits that differ and lone shingles both count differences, of which linked sets have few.
   A pair of groups comes from one shingle alone if the least shingles of their prefixes overlap.
4. The group pairs left are expanded to pairs of variants and these compared exactly by their full sets.

Only components are asked for. So first only one variant of each group is compared, in small random parts of
each shingle's groups, and the components of what is linked are found to the end. Then only those group pairs
are made that may still connect different components. A large group of near copies thus costs some
comparisons for each member, not one for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelflot.llm.chars import mixed
from shelflot.llm.common import components, release, ship, table
from shelflot.session import partitions, pinned, run_dir

WORDS, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Words whose hashes a worker remembers, and the longest of them; it forgets all beyond, which changes no result.
REMEMBERED, LONGEST = 300_000, 64
#: Documents, and bytes of text, in a chunk, about; bytes of text whose shingles a bucket counts.
CHUNK_ROWS, CHUNK_BYTES, BUCKET_BYTES = 2_000, 16 << 20, 32 << 20
#: Size of a random part of a shingle's groups, about, and least shingles of a prefix that a pair is looked for in.
PART, HEAD = 5, 12
#: Bits of parity of a set, as 64-bit numbers.
PARITY = 8

_PACKET = "chunk bigint, hashes binary, counts binary"
_DOCS = "doc_id bigint, text_hash bigint, n int, alone int, fp binary, prefix binary, parity array<bigint>, shared array<bigint>, whole binary"
_VARIANTS = "fp binary, n int, alone int, prefix binary, parity array<bigint>, doc_id bigint, text_hash bigint, shared array<bigint>"
_GROUPS = "prefix binary, n int, alone int, shared array<bigint>, first binary, members bigint, parity array<bigint>"


def needed(n, numerator: int, denominator: int):
    """Shingles that a set of n must share at least with any set it is linked with."""
    return -(-n * numerator // denominator)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers below 2**40 as the bytes of their distances, all lowest bytes first, then the next."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :5] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Shingler:
    """Sets of n-gram hashes, remembering the hashes of words."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.factors = [np.uint64(pow(0xC2B2AE3D27D4EB4F, 2 * j + 1, 1 << 64)) for j in range(words)]

    def _hash(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            if len(word) <= LONGEST:
                self.known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles; of all words as one if they are too few."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        own = np.array([known[w] if w in known else self._hash(w) for w in words], np.uint64)
        size = min(self.words, len(own))
        with np.errstate(over="ignore"):
            total = np.zeros(len(own) - size + 1, np.uint64)
            for j in range(size):
                total = mixed(total + own[j : len(own) - size + 1 + j] * self.factors[j])
        return np.unique(total)


def parity(hashes: np.ndarray) -> np.ndarray:
    """64 * PARITY bits: for each value of the hash's highest bits whether it occurs an odd number of times."""
    odd = np.bincount((hashes >> np.uint64(64 - (64 * PARITY - 1).bit_length())).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _print(hashes: np.ndarray, n: int = 0) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest()


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """``text, doc_id, text_hash, chunk``: documents dealt by hash into chunks of about CHUNK_ROWS, or of
    CHUNK_BYTES where texts are long; and the number of buckets to count their shingles in.

    Copies of one row lie in one chunk only if their ids are equal too; rows repeated as a whole are
    first counted as one, since they are in one class whatever else.
    """
    rows = docs.select("text", F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"))
    many, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = partitions(docs.sparkSession)
    n = max(1, many // CHUNK_ROWS, size // CHUNK_BYTES)
    chunk = F.pmod(F.xxhash64("doc_id", "text_hash", F.monotonically_increasing_id() % 64), F.lit(n))
    return rows.withColumn("chunk", chunk).repartition(parts, "chunk"), max(parts, size // BUCKET_BYTES)


def shared_shingles(chunked: DataFrame, words: int, buckets: int) -> DataFrame:
    """For each chunk, which of its shingles several documents have, and how many: ``_PACKET``.

    Every chunk sends each distinct hash once, in as many packets as there are buckets of the hash; a
    bucket's task counts its part of the hashes, so none is larger than another.
    """
    width = -(-(1 << 40) // buckets)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        make = Shingler(words)
        own, counts = np.unique(np.concatenate([make(t) >> np.uint64(24) for t in pdf["text"]]), return_counts=True)
        edges = np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width))
        parts = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b]
        return pd.DataFrame(
            {
                "bucket": [i for i, *_ in parts],
                "chunk": int(pdf["chunk"].iloc[0]),
                "hashes": [pack(own[a:b]) for _, a, b in parts],
                "counts": [_planes(counts[a:b]) for _, a, b in parts],
            }
        )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack(x) for x in pdf["hashes"]]
        counts = np.concatenate([_counts(x) for x in pdf["counts"]])
        own, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(own)).astype(np.uint32)[inverse]
        out, at = [], 0
        for chunk, x in zip(pdf["chunk"], hashes, strict=True):
            mine = total[at : at + len(x)]
            at += len(x)
            several = mine > 1
            if several.any():
                out.append((chunk, pack(x[several]), _planes(mine[several])))
        return pd.DataFrame(out, columns=["chunk", "hashes", "counts"])

    # All columns, as ``prefixes`` takes them, so that both read one exchange of the texts.
    sent = chunked.groupBy("chunk").applyInPandas(send, f"bucket int, {_PACKET}")
    return sent.groupBy("bucket").applyInPandas(count, _PACKET)


def prefixes(chunked: DataFrame, shared: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """Each document's size, lone shingles, fingerprint, a hash of its prefix and size, parities, and what others share of its prefix."""

    def assign(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        make, out = Shingler(words), []
        hashes = np.concatenate([unpack(x) for x in back["hashes"]] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([_counts(x) for x in back["counts"]] or [np.zeros(0, np.uint32)])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        for text, doc_id, text_hash in zip(own["text"], own["doc_id"], own["text_hash"], strict=True):
            full = make(text)
            n = len(full)
            if not n:
                continue
            times = np.ones(n, np.int64)
            if len(hashes):
                short = full >> np.uint64(24)
                where = np.minimum(np.searchsorted(hashes, short), len(hashes) - 1)
                known = hashes[where] == short
                times[known] = counts[where[known]]
            first = np.lexsort((full, times))[: n - int(needed(n, numerator, denominator)) + 1]
            several = full[first][times[first] > 1]
            whole = full.tobytes() if len(several) else None
            others = full[times > 1]
            known_by = _print(full), _print(full[first], n), parity(others)
            out.append((doc_id, text_hash, n, n - len(others), *known_by, several.view(np.int64), whole))
        found = pd.DataFrame(out, columns=["doc_id", "text_hash", "n", "alone", "fp", "prefix", "parity", "shared", "whole"])
        return found.astype({"doc_id": "Int64"})

    return chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(assign, _DOCS)


def verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Those of the pairs ``a, b`` of variants whose sets are alike enough, by exact intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(denominator * same >= numerator * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("fp").alias("a"), F.col("whole").alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col("whole").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _sizes_fit(small: Column, large: Column, numerator: int, denominator: int) -> Column:
    return F.least(small, large) * denominator >= F.greatest(small, large) * numerator


def _differences_fit(x: str, y: str, numerator: int, denominator: int) -> Column:
    """Whether sets may be linked by what is known to differ: lone shingles of both, and bits of parity.

    Linked sets differ in (1 - t) / (1 + t) of their sizes at most. A group of several variants has no parity: unknown.
    """
    n, alone = F.col(f"{x}.n") + F.col(f"{y}.n"), F.col(f"{x}.alone") + F.col(f"{y}.alone")
    px, py = F.col(f"{x}.parity"), F.col(f"{y}.parity")
    bits = sum((F.bit_count(F.get(px, i).bitwiseXOR(F.get(py, i))) for i in range(1, PARITY)), F.bit_count(F.get(px, 0).bitwiseXOR(F.get(py, 0))))
    return (alone + F.coalesce(bits, F.lit(0))) * (denominator + numerator) <= n * (denominator - numerator)


def _lone_fit(x: str, y: str, numerator: int, denominator: int) -> Column:
    """Whether enough shingles are left for the overlap that links, without those that no other document has."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.alone"), F.col(f"{y}.n") - F.col(f"{y}.alone"))
    return left * (denominator + numerator) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * numerator


def _fit(x: str, y: str, numerator: int, denominator: int) -> Column:
    return _sizes_fit(F.col(f"{x}.n"), F.col(f"{y}.n"), numerator, denominator) & _lone_fit(x, y, numerator, denominator)


def _in_parts(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows that share the keys with others, with a random ``part`` of about PART of them."""
    parts = df.groupBy(*keys).agg(F.ceil(F.count("*") / PART).alias("parts"), F.count("*").alias("m")).where("m > 1").drop("m")
    return df.join(parts, keys).withColumn("part", F.pmod(F.xxhash64(name), "parts"))


def _some_pairs(entries: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs ``a < b`` of groups that meet in a random part of a shingle's groups of about one size."""
    step = float(np.log(denominator / numerator)) if numerator < denominator else 1e-9
    kind = F.floor(F.log(F.col("n").cast("double")) / step).cast("long")
    parted = _in_parts(entries.withColumn("kind", kind), ["token", "kind"], "prefix")
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "kind", "part")]
    both = parted.alias("x").join(parted.alias("y"), [*meet, F.col("x.prefix") < F.col("y.prefix"), _fit("x", "y", numerator, denominator)])
    return both.select(F.col("x.prefix").alias("a"), F.col("y.prefix").alias("b")).distinct()


def _some_inside(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs ``a < b`` of variants of one group that meet in a random part of it."""
    parted = _in_parts(members, ["prefix"], "fp")
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("prefix", "part")]
    both = parted.alias("x").join(parted.alias("y"), [*meet, F.col("x.fp") < F.col("y.fp"), _differences_fit("x", "y", numerator, denominator)])
    return both.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def _open_pairs(entries: DataFrame, groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs ``a <= b`` of groups that may hold linked variants of different components.

    ``groups`` has, for each group that meets another or holds several variants, ``prefix``, its least and greatest component ``lo, hi``,
    ``n, alone, parity, head``. Two groups whose heads overlap make a pair only at the least shingle of both heads.
    """
    placed = entries.select("token", "prefix").join(groups, "prefix")
    still = placed.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("token")
    placed = pinned(placed.join(still, "token", "left_semi"))
    same = F.least("x.lo", "y.lo") == F.greatest("x.hi", "y.hi")
    first = F.array_min(F.array_intersect("x.head", "y.head"))
    once = F.coalesce(first == F.col("x.token"), F.lit(True))
    conditions = [
        F.col("x.token") == F.col("y.token"), F.col("x.prefix") < F.col("y.prefix"), ~same,
        _fit("x", "y", numerator, denominator), _differences_fit("x", "y", numerator, denominator), once,
    ]
    both = placed.alias("x").join(placed.alias("y"), conditions).select(F.col("x.prefix").alias("a"), F.col("y.prefix").alias("b")).distinct()
    inside = groups.where("lo <> hi")
    return both.union(inside.select(F.col("prefix").alias("a"), F.col("prefix").alias("b")))


def _expanded(pairs: DataFrame, members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs of variants of different components that the pairs of groups stand for."""
    one = pairs.join(members.alias("x"), F.col("a") == F.col("x.prefix"))
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("a") < F.col("b")) | (F.col("x.fp") < F.col("y.fp")))
    both = one.join(members.alias("y"), [F.col("b") == F.col("y.prefix"), apart, _differences_fit("x", "y", numerator, denominator)])
    return both.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def classes(
    docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR
) -> DataFrame:
    """Every document that has words, with its class of documents linked directly or through others.

    ``docs`` has ``doc_id, text``; other columns are not read. Rows: doc_id, text_hash (xxhash64 of the
    text), n_shingles, component (a name of the class), component_id (its least doc_id). Documents
    without words (NULL, empty or blank texts) have no row: they are linked with nothing. Repeated
    rows are in one class; a NULL doc_id takes part and counts as no least one.
    """
    spark, path = docs.sparkSession, run_dir(docs.sparkSession, "jaccard")
    ship(spark)
    docs = docs.select("doc_id", "text")
    chunked, buckets = dealt(docs)
    shared = shared_shingles(chunked, words, buckets)
    prefixes(chunked, shared, words, numerator, denominator).write.parquet(f"{path}/documents")
    del chunked, shared
    release(spark)
    found = spark.read.schema(_DOCS).parquet(f"{path}/documents")

    # Variants are distinct sets; a group is the variants with one prefix and size.
    variants = found.groupBy("fp").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("d"), F.first("shared").alias("shared"),
    ).where(F.size("shared") > 0).select("fp", "n", "alone", "prefix", "parity", "d.doc_id", "d.text_hash", "shared")
    variants.write.parquet(f"{path}/variants")
    variants = spark.read.schema(_VARIANTS).parquet(f"{path}/variants")
    groups = variants.groupBy("prefix").agg(
        F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("shared").alias("shared"), F.min("fp").alias("first"),
        F.count("*").alias("members"), F.first("parity").alias("parity"),
    ).withColumn("parity", F.when(F.col("members") == 1, F.col("parity")))
    groups.write.parquet(f"{path}/groups")
    groups = spark.read.schema(_GROUPS).parquet(f"{path}/groups")
    tokens = groups.select("prefix", "n", "alone", F.explode("shared").alias("token"))
    met = tokens.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1")
    entries = pinned(tokens.join(met.select("token"), "token", "left_semi"))
    meeting = entries.select("prefix").union(groups.where("members > 1").select("prefix")).distinct()
    members = variants.join(meeting, "prefix", "left_semi").select("fp", "prefix", "n", "alone", "parity", "doc_id", "text_hash")
    release(spark)
    # The set of each variant that may meet another, from the row that stands for the variant.
    wanted = members.select("fp", "text_hash", F.coalesce("doc_id", F.lit(-1)).alias("id"))
    rows = found.where("whole is not null").select("fp", "text_hash", F.coalesce("doc_id", F.lit(-1)).alias("id"), "whole")
    sets = pinned(rows.join(wanted, ["fp", "text_hash", "id"], "left_semi").groupBy("fp").agg(F.first("whole").alias("whole")))

    # One variant of each group first; then whatever may still connect components.
    some = _some_pairs(entries, numerator, denominator)
    for side in "ab":
        some = some.join(groups.select(F.col("prefix").alias(side), F.col("first").alias(f"{side}1")), side)
    crowded = groups.where("members > 1").select("prefix")
    some = some.select(F.col("a1").alias("a"), F.col("b1").alias("b")).union(
        _some_inside(members.join(crowded, "prefix", "left_semi"), numerator, denominator)
    )
    links = pinned(verified(some, sets, numerator, denominator))
    joined = components(links).withColumnRenamed("node", "fp")
    placed = members.drop("doc_id", "text_hash").join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = pinned(placed)
    spans = placed.groupBy("prefix").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    head = F.slice(F.array_sort("shared"), 1, HEAD)
    spread = groups.select("prefix", "n", "alone", "parity", head.alias("head")).join(spans, "prefix")
    rest = _expanded(_open_pairs(entries, spread, numerator, denominator), placed, numerator, denominator)
    final = components(links.union(verified(rest, sets, numerator, denominator))).withColumnRenamed("node", "fp")
    classed = found.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), "fp").join(final, "fp", "left")
    classed = classed.withColumn("component", F.coalesce("component", "fp"))
    least = classed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return classed.join(least, "component").select("doc_id", "text_hash", "n_shingles", "component", "component_id")


def without_words(text: str = "text") -> Column:
    return F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))


def one_of_each(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """The rows of documents with one of each class: that with the least doc_id.

    All columns stay as they are. Documents without words are linked with nothing and all stay.
    """
    found = classes(docs, words, numerator, denominator)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("d"))
    # Plain keys on both sides: the join's exchange of the texts serves the removal of repeated rows too.
    keys = {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__hash": F.col("text_hash")}
    first = first.select("d.doc_id", "d.text_hash").select(*[v.alias(k) for k, v in keys.items()])
    worded = docs.where(~without_words()).withColumns(keys | {"__id": keys["__id"].cast("long"), "__hash": F.xxhash64("text")})
    kept = worded.join(first, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
    return kept.unionByName(docs.where(without_words()))


def op7_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    """The class of every document."""
    docs = table(spark, directory, "documents", "doc_id", "text")
    found = classes(docs).select("doc_id", "n_shingles", "component_id")
    empty = docs.where(without_words()).select(
        F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").cast("long").alias("component_id")
    )
    return found.union(empty)
