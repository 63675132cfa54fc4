"""Periodic runs of words, found by block convolution.

A run is a stretch of words that repeats with a smallest period at least twice over and cannot be
made longer. With period p the words p apart are equal on p places or more, so at the dyadic scale
b with 2b - 1 <= p <= 4b - 2 one of the text's aligned blocks of b words lies inside the equal places
and occurs again p words later. For each scale, number-theoretic transforms give the sum of squared
differences between a block and every place of the window that follows it; where it is zero, the
distance is a candidate and seeds an extension in both directions, which compares the words themselves.

Blocks that can't match are left out before: those with a word that has no equal in its window, and
those deep inside a run found at a smaller scale, which occur again only at multiples of its period.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.common import extend, table

#: A run holds this many words at least, and this many periods.
MIN_WORDS, MIN_PERIODS = 12, 2
#: Prime of the transforms, with roots of unity of order 2**30; products stay below 2**64.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
#: Numbers that one batch of transforms holds at a time.
BATCH = 1 << 19
#: Up to this block length candidates are first extended side by side.
SHORT = 4

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


@cache
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        step = np.uint64(pow(root, len(out), PRIME))
        out = np.concatenate([out, out * step % np.uint64(PRIME)])
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row; the result is in bit-reversed order."""
    rows, n, p = len(x), x.shape[1], np.uint64(PRIME)
    half = n // 2
    while half:
        pair = x.reshape(rows, -1, 2, half)
        out = np.empty_like(pair)
        out[:, :, 0] = (pair[:, :, 0] + pair[:, :, 1]) % p
        out[:, :, 1] = (pair[:, :, 0] + (p - pair[:, :, 1])) % p * _powers(half, False) % p
        x, half = out, half // 2
    return x.reshape(rows, n)


def inverse(x: np.ndarray) -> np.ndarray:
    """The rows back from bit-reversed transforms."""
    rows, n, p = len(x), x.shape[1], np.uint64(PRIME)
    half = 1
    while half < n:
        pair = x.reshape(rows, -1, 2, half)
        out = np.empty_like(pair)
        turned = pair[:, :, 1] * _powers(half, True) % p
        out[:, :, 0] = (pair[:, :, 0] + turned) % p
        out[:, :, 1] = (pair[:, :, 0] + (p - turned)) % p
        x, half = out, 2 * half
    return x.reshape(rows, n) * np.uint64(pow(n, -1, PRIME)) % p


def zero_mismatches(codes: np.ndarray, blocks: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks and the distances from 2b - 1 to 4b - 2 at which each occurs again.

    ``codes`` must reach 5b places beyond every start. The sums of squared differences are exact
    modulo the prime, so no occurrence is missed.
    """
    p, found = np.uint64(PRIME), []
    for i in range(0, len(blocks), max(1, BATCH // (4 * b))):
        part = blocks[i : i + max(1, BATCH // (4 * b))]
        left = np.zeros((len(part), 4 * b), np.uint64)
        right = np.zeros_like(left)
        left[:, :b] = codes[part[:, None] + np.arange(b)[::-1]]
        right[:, : 3 * b - 1] = codes[part[:, None] + np.arange(2 * b - 1, 5 * b - 2)]
        products = inverse(transform(left) * transform(right) % p)[:, b - 1 : 3 * b - 1]
        own = (left * left % p).sum(1) % p
        sums = np.zeros((len(part), 3 * b), np.uint64)
        np.cumsum(right[:, : 3 * b - 1] ** 2 % p, axis=1, out=sums[:, 1:])
        window = (sums[:, b:] - sums[:, : 2 * b]) % p
        row, shift = np.nonzero((own[:, None] + window) % p == 2 * products % p)
        found.append((part[row], shift + 2 * b - 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])


def _forward(x: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from ``i`` on equal those from ``j`` on, ``j`` staying below ``end``."""
    begin, step = j, 64
    while j < end:
        n = min(step, end - j)
        same = x[i : i + n] == x[j : j + n]
        if not same.all():
            return j - begin + int(same.argmin())
        i, j, step = i + n, j + n, 2 * step
    return j - begin


def _backward(x: np.ndarray, i: int, j: int, first: int) -> int:
    """How many words before ``i`` equal those before ``j``, not going below ``first``."""
    begin, step = i, 64
    while i > first:
        n = min(step, i - first)
        same = (x[i - n : i] == x[j - n : j])[::-1]
        if not same.all():
            return begin - i + int(same.argmin())
        i, j, step = i - n, j - n, 2 * step
    return begin - i


def _long_enough(x: np.ndarray, a: np.ndarray, d: np.ndarray, b: int) -> np.ndarray:
    """Which short candidates reach the least length of a run, all extended side by side.

    ``x`` may be read across the end of a text here: that can only let more candidates pass.
    """
    need = np.maximum(d, MIN_WORDS - d) - b
    have, last = np.zeros(len(a), np.int64), len(x) - 1
    for step in (1, -1):
        live = np.flatnonzero(have < need)
        at = a[live] + (b if step > 0 else -1)
        for _ in range(int(need.max(initial=0))):
            other = at + d[live]
            same = (at >= 0) & (other <= last) & (x[np.maximum(at, 0)] == x[np.minimum(other, last)])
            live, at = live[same], at[same] + step
            have[live] += 1
            if not len(live):
                break
    return have >= need


def find_runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of all runs of several texts.

    ``codes`` holds the numbers of all words, text after text, equal within a text where the words
    are; ``sizes`` the number of words of each text.
    """
    ends = np.cumsum(sizes)
    firsts, total = ends - sizes, int(sizes.sum())
    text = np.repeat(np.arange(len(sizes)), sizes)
    # Equal words of a text get numbers that follow each other by place: one sorted array finds distances.
    reach = 2 * total + 16
    order = np.lexsort((codes, text))
    new = np.ones(total, bool)
    new[1:] = (codes[order[1:]] != codes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    placed = np.cumsum(new) * reach + order
    half, b = sizes // MIN_PERIODS, 1
    half[sizes < MIN_WORDS] = 0
    padded = np.concatenate([codes.astype(np.uint64) + np.uint64(1), np.zeros(5 * int(half.max(initial=0)) + 8, np.uint64)])
    inside_end, inside_period = np.zeros(total, np.int64), np.ones(total, np.int64)
    best: dict[tuple[int, int], int] = {}
    while 2 * b - 1 <= half.max(initial=0):
        long = half >= 2 * b - 1
        if not long.all():
            keep = long[text[order]]
            order, placed = order[keep], placed[keep]
        after = np.searchsorted(placed, placed + (2 * b - 1))
        seen = np.append(placed, np.iinfo(np.int64).max)[after] <= placed + (4 * b - 2)
        again = np.zeros(total, bool)
        again[order[seen]] = True
        blocks = np.flatnonzero(again[: total - total % b].reshape(-1, b).all(1)) * b
        # Deep inside a run whose period fits the block, nothing but multiples of the period can match.
        deep = (inside_end[blocks] >= np.minimum(blocks + 5 * b - 2, ends[text[blocks]])) & (inside_period[blocks] <= b)
        blocks = blocks[(text[blocks] == text[blocks + b - 1]) & ~deep]
        a, d = zero_mismatches(padded, blocks, b)
        known = (inside_end[a] >= a + d + b) & (d % inside_period[a] == 0)
        fits = (a + d + b <= ends[text[a]]) & (d <= half[text[a]]) & ~known
        a, d = a[fits], d[fits]
        if b <= SHORT and len(a):
            enough = _long_enough(codes, a, d, b)
            a, d = a[enough], d[enough]
        by = np.lexsort((a, d))
        a, d = a[by], d[by]
        i = 0
        while i < len(a):
            at, p = int(a[i]), int(d[i])
            end = int(ends[text[at]])
            upto = at + b + _forward(codes, at + b, at + b + p, end)
            start = at - _backward(codes, at, at + p, int(firsts[text[at]]))
            if upto - start >= p and upto - start + p >= MIN_WORDS:
                key = (start, upto + p)
                best[key] = min(best.get(key, p), p)
                if upto + p > inside_end[at]:
                    inside_end[start : upto + p], inside_period[start : upto + p] = upto + p, best[key]
            # The blocks up to the first unequal place lead to the same stretch.
            i += int(np.searchsorted(a[i : np.searchsorted(d, p, "right")], upto))
        b *= 2
    rows = np.array([(text[s], s - firsts[text[s]], e - s, p) for (s, e), p in best.items()], np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the number of each text's words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words = lists.flatten()
    filled = pc.not_equal(words, "")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    sizes = np.bincount(owner[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(filled), sizes.astype(np.int64)


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add each text's ``runs`` (start, length, period in words, by start, then period) and ``collapsed``.

    ``collapsed`` joins by one space the words that no run holds after its first period. Words are what
    stands between white space of ASCII. NULL and empty texts have no runs and the empty string. Every row
    and column stays but for those named in ``drop``, repeated rows are treated alike, columns of the result
    names are replaced, an empty table stays empty. A text is held whole by one worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in batches:
            words, sizes = _split(batch.column(0))
            codes = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            found = find_runs(codes, sizes)
            begins = (np.cumsum(sizes) - sizes)[found[:, 0]] + found[:, 1]
            marks = np.zeros(len(codes) + 1, np.int64)
            np.add.at(marks, begins + found[:, 3], 1)
            np.add.at(marks, begins + found[:, 2], -1)
            kept = np.cumsum(marks[:-1]) == 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            left = np.bincount(owner[kept], minlength=len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, words.filter(pa.array(kept))), " ")
            counts = np.bincount(found[:, 0], minlength=len(sizes))
            places = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            structs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], names=RUN.names)
            yield [pa.ListArray.from_arrays(places, structs), joined.cast(pa.string())]

    fields = [T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    return extend(df, [text], fields, run, drop)


def planted(text: Column, key: Column) -> Column:
    """Texts with a planted run where crc32 of the key is divisible by ten, the others as they are.

    From word a on, word i becomes word a + (i - a) % p; a and p follow from the same number.
    """
    number = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(number / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # Values that the lambda reads for each word are computed once, as an array bound to a name.
        return F.transform(
            F.array(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p"))),
            lambda x: F.array_join(
                F.transform(w, lambda own, i: F.when(i < x["a"], own).otherwise(F.get(w, x["a"] + F.pmod(i - x["a"], x["p"])))), " "
            ),
        )[0]

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    whole = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))[0]
    return F.when(text.isNotNull() & (number % 10 == 0), whole).otherwise(text)


def op11_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text.

    Every tenth document gets a run planted by :func:`planted` first. An empty table gives no rows.
    """
    docs = table(spark, directory, "documents", "doc_id", "text")
    found = with_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")), drop=("text",))
    first = F.sort_array(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p")))
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    out = found.withColumn("longest", F.get(first, F.lit(0)))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.s").alias("start"),
        (-F.col("longest.n")).alias("length"),
        F.col("longest.p").alias("period"),
        F.floor(-1000 * F.col("longest.n") / F.col("longest.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
