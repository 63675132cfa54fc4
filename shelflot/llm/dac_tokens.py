"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level k the
chunk k of those ids that have one. A bitmap beside each level says which of its ids go on in the
next level, and a directory holds the number of set bits before each block of 512, so the place
of an id in the next level is one directory entry and one popcount away. Any token is read
without decoding those before it.

Files are Parquet, so that any store Spark writes to can hold them. A row is a segment: the
documents of a stretch in ascending doc_id order, their lengths, and one code as bytes:

    u32 magic 0x31434144, u32 levels, u64 ids,
    then for each level: u64 entries, chunk bytes, and unless it is the last level
    bitmap bytes (eight entries a byte, lowest bit first) and u32 directory entries.

Parts of fixed length are padded with zeros to a multiple of eight bytes.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.common import ship, slices, table
from shelflot.session import partitions, run_dir

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAGIC = 0x31434144
BLOCK_BITS = 512
#: Words, and pieces of words, whose ids a worker remembers (about 100 MB in all); it forgets all of them
#: Bytes of text whose ids make one segment.
SEGMENT_BYTES = 8 << 20
#: Words and pieces that an encoder remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)

SEGMENT = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("code", T.BinaryType()),
    ]
)


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode_ids(ids: np.ndarray) -> bytes:
    """The code of a sequence of ids below 2**32."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest > 255
        last = not more.any()
        body = [np.uint64(len(rest)).tobytes(), _padded((rest & 255).astype(np.uint8).tobytes())]
        if not last:
            bits = np.packbits(more, bitorder="little")
            padded = np.frombuffer(bits.tobytes() + bytes(-len(bits) % (BLOCK_BITS // 8)), np.uint8)
            blocks = _ONES[padded].reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.int64)
            directory = (np.cumsum(blocks) - blocks).astype(np.uint32)
            body += [_padded(bits.tobytes()), _padded(directory.tobytes())]
        levels.append(b"".join(body))
        if last:
            break
        rest = rest[more] >> 8
    head = np.array([MAGIC, len(levels)], np.uint32).tobytes() + np.uint64(len(ids)).tobytes()
    return head + b"".join(levels)


class Codes:
    """Reads a code in place."""

    def __init__(self, data: bytes):
        magic, n_levels = np.frombuffer(data, np.uint32, 2)
        if magic != MAGIC:
            raise ValueError("not a code of token ids")
        self.n, at = int(np.frombuffer(data, np.uint64, 1, 8)[0]), 16
        self.levels = []
        for k in range(n_levels):
            n, at = int(np.frombuffer(data, np.uint64, 1, at)[0]), at + 8
            chunks, at = np.frombuffer(data, np.uint8, n, at), at + n + (-n % 8)
            bits = directory = None
            if k + 1 < n_levels:
                size = -(-n // 8)
                bits, at = np.frombuffer(data, np.uint8, size, at), at + size + (-size % 8)
                size = -(-n // BLOCK_BITS)
                directory, at = np.frombuffer(data, np.uint32, size, at), at + 4 * size + (-4 * size % 8)
            self.levels.append((chunks, bits, directory))

    def __len__(self) -> int:
        return self.n

    def rank(self, level: int, i: int) -> int:
        """Set bits before entry ``i`` of a level's bitmap."""
        _, bits, directory = self.levels[level]
        block = i // BLOCK_BITS
        if block == len(directory):  # just past the end of full blocks
            return int(_ONES[bits].sum())
        begin = block * (BLOCK_BITS // 8)
        full = int(_ONES[bits[begin : i // 8]].sum())
        part = int(_ONES[bits[i // 8] & ((1 << (i % 8)) - 1)]) if i % 8 else 0
        return int(directory[block]) + full + part

    def __getitem__(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(k, i), shift + 8
        return value

    def read(self, begin: int, end: int) -> np.ndarray:
        """The ids of a range, without touching those before it."""
        lo, hi = max(0, begin), min(end, self.n)
        values = np.zeros(max(0, hi - lo), np.uint32)
        where, shift = np.arange(len(values)), 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            values[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(shift)
            if bits is None or lo >= hi:
                break
            on = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo].astype(bool)
            where, lo = where[on], self.rank(k, lo)
            hi, shift = lo + len(where), shift + 8
        return values


#: Printable characters below U+0250, whose classes no version of Unicode has changed.
_LATIN = re.compile("[\x21-\x7e\xa1-\xac\xae-ɏ]+")


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


_BYTE_CHARS = _byte_characters()


def _split_pattern(file: dict) -> regex.Pattern | None:
    """The pattern whose matches are the pieces, if the file splits by one and then writes bytes as characters."""
    steps = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if not file.get("normalizer") or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    split, byte_level = steps
    if "Regex" not in split["pattern"] or not split["invert"] or split["behavior"] != "Removed":
        return None
    if byte_level["add_prefix_space"] or byte_level["use_regex"]:
        return None
    found = regex.compile(split["pattern"]["Regex"])
    return None if found.groups else found


class WordEncoder:
    """Ids of texts by a vocabulary file that splits at white space in any case.

    Words between spaces, tabs and line ends are encoded apart; since the file's pattern drops white
    space and no match spans it, their ids put together are the ids of the text. Names of special tokens
    get their own ids, as in the library; a file whose names are not matched plainly inside words
    sends its texts through the library whole.

    Words of printable Latin characters fall into fewer pieces by the file's own pattern, so for them
    the library's normalizer and model are called for each new piece instead of for each word; other words,
    and files with another pre-tokenizer, go through the library. Only short pieces and words are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        pattern = _split_pattern(file)
        self.splitter = regex.compile(f"{pattern.pattern}| ") if pattern else None
        steps = [s["type"] for s in (file.get("normalizer") or {}).get("normalizers") or []]
        # What a normalizer of these steps makes of ASCII words, which have no white space inside.
        self.lowers = steps == ["NFC", "Replace", "Lowercase"]
        added = file.get("added_tokens") or []
        self.names = [t["content"] for t in added]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        self.whole = any(any(t.get(f) for f in flags) or re.search(r"\s", t["content"]) for t in added)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _remember(self, cache: dict[str, tuple[int, ...]], wanted: list[str], learn) -> list[tuple[int, ...]]:
        """The ids of each wanted text, from the cache or learned; short ones are kept for later."""
        if len(cache) > REMEMBERED:
            cache.clear()
        new = [w for w in wanted if w not in cache]
        own = dict(zip(new, learn(new), strict=True))
        cache.update((w, ids) for w, ids in own.items() if len(w) <= REMEMBERED_CHARS)
        return [own[w] if w in own else cache[w] for w in wanted]

    def _by_model(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        for piece in pieces:
            shown = piece if piece.isascii() else "".join([_BYTE_CHARS[b] for b in piece.encode()])
            yield () if piece == " " else tuple([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _by_library(self, texts: list[str]) -> Iterator[tuple[int, ...]]:
        for found in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            yield tuple(found.ids)

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Flat ids of plain words and the number of each; None where normalizing changes their number."""
        # Normalized and split together: no character of theirs combines with a space, and a space is its own part.
        joined = " ".join(words)
        normal = joined.lower() if self.lowers and joined.isascii() else self.tokenizer.normalizer.normalize_str(joined)
        parts = pa.array(self.splitter.findall(normal), pa.string()).dictionary_encode()
        at = parts.indices.to_numpy(zero_copy_only=False)
        pieces = parts.dictionary.to_pylist()
        space = np.array([p == " " for p in pieces], bool)[at] if len(at) else np.zeros(0, bool)
        if space.sum() + 1 != len(words):
            return None
        table, starts, sizes = _table(self._remember(self.pieces, pieces, self._by_model))
        flat, n = _gather(table, starts, sizes, at)
        return flat, np.bincount(np.cumsum(space), weights=n, minlength=len(words)).astype(np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words: flat ids, where each word's begin, and their number."""
        plain = np.zeros(len(words), bool)
        if self.splitter and len(words):
            plain = pc.match_substring_regex(words, f"^(?:{_LATIN.pattern})$").to_numpy(zero_copy_only=False)
            for name in self.names:
                plain &= ~pc.match_substring(words, name).to_numpy(zero_copy_only=False)
        ascii_only = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        n, starts, tables, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        for mask, encode in ((plain & ascii_only, self._latin), (plain & ~ascii_only, self._latin), (~plain, self._rest)):
            own = words.filter(pa.array(mask)).to_pylist()
            if own:
                table, sizes = encode(own) or self._rest(own)
                n[mask], starts[mask] = sizes, size + np.cumsum(sizes) - sizes
                tables.append(table)
                size += len(table)
        return np.concatenate([np.zeros(0, np.uint32), *tables]), starts, n

    def _rest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words by the library, and the number of each."""
        table, _, sizes = _table(self._remember(self.known, words, self._by_library))
        return table, sizes

    def __call__(self, texts: list[str | None] | pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with the end id behind it, and the length of each."""
        clean = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        end = np.array([] if end_id is None else [end_id], np.uint32)
        if self.whole:
            ids = [np.concatenate([np.array(x, np.uint32), end]) for x in self._by_library(clean.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        for space in "\n\t\r":
            clean = pc.replace_substring(clean, space, " ")
        split = pc.split_pattern(clean, " ")
        coded = split.flatten().dictionary_encode()
        table, starts, sizes = self._words(coded.dictionary)
        table, starts, sizes = np.concatenate([table, end]), np.append(starts, len(table)), np.append(sizes, len(end))
        places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        places = np.insert(places, ends, len(sizes) - 1)  # the end id is one more word of each text
        flat, n = _gather(table, starts, sizes, places)
        return flat, np.diff(np.cumsum(n)[ends + np.arange(len(ends))], prepend=0)


def _table(ids: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids behind each other, where each tuple begins, and its length."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes


def _gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries at ``places``, behind each other, and the number of each."""
    n = sizes[places]
    return table[np.repeat(starts[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary in a worker process, which keeps its words from task to task."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode ``doc_id, text`` and write the ids in ascending doc_id order.

    NULL ids come first, rows of one id in the order of their texts' hashes; a NULL or empty text gives
    the end id alone. Other columns are not read. An empty table gives no segment.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    ordered = (
        docs.select("text", F.col("doc_id").cast("long"))
        .repartitionByRange(partitions(docs.sparkSession), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for k, batch in enumerate(slices(batches, limit=SEGMENT_BYTES)):
            ids, lengths = coder(batch.column(0), end_id)
            row = [part, k, start, len(ids), batch.column(1).to_pylist(), lengths.tolist(), encode_ids(ids)]
            start += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.binary() if f.name == "code" else pa.list_(pa.int64()) if f.name in ("doc_ids", "lengths") else pa.int32() if f.name in ("part", "segment") else pa.int64()) for v, f in zip(row, SEGMENT, strict=True)],
                names=SEGMENT.names,
            )

    ordered.mapInArrow(run, SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments of token files with ``start``, the number of ids before each.

    Only one row for each part meets in the window: as many as tasks wrote.
    """
    ship(spark)
    stored = spark.read.schema(SEGMENT).parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return stored.join(offsets, "part").withColumn("start", F.col("start_in_part") + F.col("offset"))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Documents of segments, 512 at a time: their doc_id, start and n_tokens, their ids, and where each begins in these."""
    for batch in batches:
        for row in range(batch.num_rows):
            code, start, doc_ids, lengths = (batch.column(c)[row].as_py() for c in range(4))
            codes, at = Codes(code), 0
            for k in range(0, len(doc_ids), 512):
                own = lengths[k : k + 512]
                offsets = np.cumsum([0, *own])
                columns = [pa.array(doc_ids[k : k + 512], pa.int64()), pa.array(start + at + offsets[:-1], pa.int64()), pa.array(own, pa.int64())]
                yield columns, codes.read(at, at + int(offsets[-1])), offsets
                at += int(offsets[-1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of token files: doc_id, start, n_tokens, ids."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, offsets in _stored(batches):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=["doc_id", "start", "n_tokens", "ids"])

    return segments(spark, path).select("code", "start", "doc_ids", "lengths").mapInArrow(run, schema)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The ids at given positions of the whole sequence: position, token (NULL beyond its ends).

    Positions meet their segment by a join on the number of 2**16 ids they lie in, so that a list
    of positions is bounded, and are read there without decoding the others.
    """
    width = 1 << 16
    cell = F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + n_ids - 1) div {width}"))
    cells = segments(spark, path).where("n_ids > 0").select(F.explode(cell).alias("cell"), "start", "code")
    asked = positions.select(F.col("position").cast("long")).distinct()
    wanted = asked.where("position >= 0").groupBy(F.expr(f"position div {width}").alias("cell"))
    schema = "position bigint, token bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, start, code in zip(*(batch.column(c) for c in range(3)), strict=True):
                codes, begin = Codes(code.as_py()), start.as_py()
                own = [p for p in places.as_py() if begin <= p < begin + len(codes)]
                values = [codes[p - begin] for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(values, pa.int64())], names=["position", "token"])

    lists = wanted.agg(F.collect_list("position").alias("positions"))
    read = lists.join(cells, "cell").select("positions", "start", "code").mapInArrow(run, schema)
    return asked.join(read, "position", "left")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in token files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, offsets in _stored(batches):
            data = ids.astype("<u4", copy=False)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments(spark, path).select("code", "start", "doc_ids", "lengths").mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, directory: str) -> DataFrame:
    """Write every document's ids to files in the shared folder and report on what they hold."""
    path = run_dir(spark, "tokens")
    write_tokens(table(spark, directory, "documents", "doc_id", "text"), path)
    return digests(spark, path)
