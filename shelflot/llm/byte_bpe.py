"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library merges; texts of any length are first cut where every match of the
splitting pattern must begin anew, so that a worker's memory follows the piece, not the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelflot.llm.common import extend, list_array, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: The rank file is sent to every worker; a vocabulary is far below this.
MAX_RANK_BYTES = 64 << 20
#: No match of the pattern goes from a character that is no white space to one that is.
_SAFE = re.compile(r"(?<=\S)[ \n]")


def rank_bytes(path: str) -> bytes:
    """The rank file, read once; it is refused above the stated bound."""
    data = Path(path).read_bytes()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"rank file of {len(data)} bytes; at most {MAX_RANK_BYTES} are sent to the workers")
    return data


def encoding(data: bytes, pattern: str = public_tokenizers.PATTERN):
    """The tiktoken encoding of a rank file's bytes, without special tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text into pieces of ``limit`` characters or a little more, at safe boundaries.

    A boundary is a space or line feed after a character that is no white space. A match never
    holds such a pair, and no look-around of the pattern sees across it, so the pieces' ids put
    together are the text's ids. A text without boundaries stays whole.
    """
    begin = 0
    while len(text) - begin > limit:
        found = _SAFE.search(text, begin + limit)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


def encode_text(coder, text: str | None, limit: int = PIECE_CHARS) -> np.ndarray:
    """The ids of one text; none for NULL and for the empty text."""
    if not text:
        return np.zeros(0, np.uint32)
    return np.concatenate([coder.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, limit)])


class RawBytes:
    """Ids back to bytes by copying from one flat table of the vocabulary's bytes."""

    def __init__(self, data: bytes):
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, data.splitlines())}
        words = [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        out, step = [], 1 << 18
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            sizes = self.sizes[part]
            shift = np.repeat(self.starts[part] - (np.cumsum(sizes) - sizes), sizes)
            out.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


FIELDS = {
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
    "round_trip": T.BooleanType(),
}


def encode(
    df: DataFrame,
    text: str = "text",
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    add: tuple[str, ...] = ("ids", "decoded"),
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``ids``, the token ids of each text, and ``decoded``, the bytes that they give back.

    ``add`` names the columns to add: also ``decoded_sha256``, the digest of these bytes, and ``round_trip``, whether
    they are those of the text, for which the bytes don't leave the worker. Columns in ``drop`` don't come back.
    A NULL or empty text has no ids and no bytes. Repeated rows stay as they are, every other column
    is kept, columns of the added names are replaced, an empty table stays empty.
    """
    data = df.sparkSession.sparkContext.broadcast(rank_bytes(ranks or public_tokenizers.path(RANKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        coder, raw = encoding(data.value, pattern), RawBytes(data.value)
        for batch in batches:
            found = {name: [] for name in ("ids", *add)}
            for value in batch.column(0):
                whole = value.as_py() or ""
                ids = encode_text(coder, whole)
                found["ids"].append(ids.astype(np.int32))
                if len(add) > 1 or add[0] != "ids":
                    own = raw.decode(ids)
                    made = {"decoded": lambda: own, "decoded_sha256": lambda: hashlib.sha256(own).hexdigest(), "round_trip": lambda: own == whole.encode()}
                    for name in add:
                        if name != "ids":
                            found[name].append(made[name]())
            lengths = np.array([len(x) for x in found["ids"]], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *found["ids"]])
            types = {"decoded": pa.binary(), "decoded_sha256": pa.string(), "round_trip": pa.bool_()}
            yield [list_array(flat, lengths) if name == "ids" else pa.array(found[name], types[name]) for name in add]

    return extend(df, [text], [T.StructField(name, FIELDS[name]) for name in add], run, drop)


def op9_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    docs = table(spark, directory, "documents", "doc_id", "text")
    return digests(encode(docs, add=("ids", "decoded_sha256"), drop=("text",)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    own = F.col("decoded_sha256") if "decoded_sha256" in encoded.columns else F.sha2("decoded", 256)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        own.alias("decoded_sha256"),
    )
