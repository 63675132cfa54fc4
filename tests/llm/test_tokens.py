import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelflot.llm import byte_bpe, dac_tokens

TEXTS = ["", None, "Hello  world\n\n it's\tfine ", "é中\U0001f600 x", "a" * 70_000, "ab cd\n" * 20_000, " " * 3_000, "<|endoftext|> x\x1cy"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.encoding(byte_bpe.rank_bytes(public_tokenizers.path(byte_bpe.RANKS)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 '\n\t\x1c és!", max_size=60), st.integers(1, 9))
def test_pieces_give_the_ids_of_the_whole(text, limit):
    data = byte_bpe.rank_bytes(public_tokenizers.path(byte_bpe.RANKS))
    own = test_pieces_give_the_ids_of_the_whole.__dict__.setdefault("coder", byte_bpe.encoding(data))
    assert "".join(byte_bpe.pieces(text, limit)) == text
    assert byte_bpe.encode_text(own, text, limit).tolist() == own.encode_ordinary(text)


def test_byte_bpe_query(spark, documents, coder):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "x")]
    got = byte_bpe.digests(byte_bpe.encode(documents(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = coder.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.encode(documents([]))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_round_trip_and_random_access(ids, data):
    codes = dac_tokens.Codes(dac_tokens.encode_ids(np.array(ids, np.uint32)))
    assert codes.read(0, len(ids)).tolist() == ids
    if ids:
        i, j = data.draw(st.integers(0, len(ids) - 1)), data.draw(st.integers(0, len(ids)))
        assert codes[i] == ids[i]
        assert codes.read(i, j).tolist() == ids[i:j]


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(dac_tokens.VOCABULARY)
    whole = Tokenizer.from_file(path)
    texts = [*TEXTS, "é Ä B's don't", "İx ΣΣ 1234"]
    texts += ["\u0130'Sx 'RE's \xbdx\xb2\xaa!? \xe9a a\xadb a\xa0b a\x85b \x0bq\x0c \xc0\xc9*** \u0149 \u01c5 x_9\xbd"]
    texts += ["<|endoftext|> x", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|><|endoftext|>", "<|endo ftext|>", "w" * 100_000 + " x"]
    texts += [joint.join(map(chr, range(0x21, 0x2B0))) for joint in ("", " ")]
    flat, lengths = dac_tokens.WordEncoder(path)(texts)
    expected = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert lengths.tolist() == [len(x) for x in expected]
    assert flat.tolist() == [i for x in expected for i in x]


def test_digests_and_round_trip_are_made_in_the_worker(spark, documents):
    rows = [(1, "Hé llo 12"), (2, None), (3, "")]
    got = byte_bpe.encode(documents(rows), add=("ids", "decoded_sha256", "round_trip"), drop=("text",))
    assert "text" not in got.columns and "decoded" not in got.columns
    for r, (_, text) in zip(sorted(got.collect(), key=lambda r: r.doc_id), rows, strict=True):
        assert r.round_trip and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_token_files(spark, documents, tmp_path):
    rows = [(7, "b c"), (3, None), (None, "first"), (5, "a " * 3_000), (5, "a " * 3_000), (9, "")]
    path = str(tmp_path / "tokens")
    dac_tokens.write_tokens(documents(rows), path)
    docs = sorted(dac_tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in docs] == [None, 3, 5, 5, 7, 9]
    sequence = [i for r in docs for i in r.ids]
    assert [r.start for r in docs] == np.cumsum([0] + [r.n_tokens for r in docs[:-1]]).tolist()
    assert all(r.ids[-1] == 1 for r in docs)
    asked = spark.createDataFrame([(p,) for p in (0, 1, 500, len(sequence) - 1, len(sequence), -1)], "position long")
    found = {r.position: r.token for r in dac_tokens.tokens_at(spark, path, asked).collect()}
    assert found == {p: sequence[p] if 0 <= p < len(sequence) else None for p in found}
    empty = str(tmp_path / "none")
    dac_tokens.write_tokens(documents([]), empty)
    assert dac_tokens.digests(spark, empty).count() == 0


def test_query_against_the_library(spark, tmp_path, monkeypatch):
    import zlib

    from tokenizers import Tokenizer

    monkeypatch.setattr(dac_tokens, "SEGMENT_BYTES", 500)  # a document above it is a slice of its own
    rows = [(7, "b c <|endoftext|> d"), (3, None), (5, "long text, again " * 300), (5, "long text, again " * 300), (9, ""), (1, "Ça va? 42")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole, start, want = Tokenizer.from_file(public_tokenizers.path(dac_tokens.VOCABULARY)), 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in dac_tokens.op6_token_files(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == want
