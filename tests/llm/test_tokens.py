import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import byte_bpe, piece_counts

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", " ", "\n\n", "  x\n\n  y ", "日本語🙂🙂 ▁x ▁▁ y", "<s> </s> <0x0A> <|endoftext|>", " " * 90 + "z" + "a" * 400, "\t\tfoo\r\nbar", "é" * 9 + "👨‍👩‍👧", "x" * 3000, "$$$ 'll 1234567"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(byte_bpe.read_vocabulary(RANKS)), special_tokens={})


@pytest.fixture(scope="module")
def model():
    return piece_counts.PieceModel(piece_counts.read_vocabulary(PIECES))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_library(codec, library, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert "".join(codec.decode(ids)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abct he\n▁é<>", max_size=80))
def test_piece_counts_equal_library(model, pieces, text):
    assert piece_counts.count_batch(model, piece_counts.Known(), [text]) == [len(pieces.encode(text))]


def test_odd_texts(codec, library, model, pieces):
    for t in ODD:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    assert piece_counts.count_batch(model, piece_counts.Known(), ODD) == [len(pieces.encode(t)) for t in ODD]


def test_states_may_be_dropped(library):
    codec = byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS), public_tokenizers.PATTERN, kept=2)
    text = "several different words that do not fit the store of states"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_utf8_stream_holds_back_incomplete_characters():
    data = "aé日🙂".encode()
    for cut in range(len(data) + 1):
        s = byte_bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == "aé日🙂"
    s = byte_bpe.Utf8Stream()
    assert s.feed(b"ab\xe6\x97") == "ab" and s.finish() == "�"
    r = random.Random(6)
    for _ in range(3000):  # any bytes, cut anywhere, as the library decodes them whole
        data = bytes(r.choice([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xE6, 0xED, 0xF0, 0xF3, 0xF4, 0xF5, 0xFF]) for _ in range(r.randint(0, 9)))
        cut = r.randint(0, len(data))
        s = byte_bpe.Utf8Stream()
        assert s.feed(data[:cut]) + s.feed(data[cut:]) + s.finish() == data.decode("utf-8", "replace")


def test_columns_and_nulls(spark, docs):
    df = docs([(1, None), (2, "one two"), (2, "one two"), (3, "")], extra=["ids", "decoded", "a.b", "c0", "n_tokens"])
    made = byte_bpe.decode_ids(byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in made) == [(1, 0, ""), (2, 2, "one two"), (2, 2, "one two"), (3, 0, "")]
    back = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert back[2].decoded_sha256 == hashlib.sha256(b"one two").hexdigest()
    counts = piece_counts.count_tokens(df, PIECES).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in counts) == [(1, 0), (2, 2), (2, 2), (3, 0)]
    assert byte_bpe.encode_texts(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0
    assert piece_counts.count_tokens(docs([]), PIECES).count() == 0


def test_long_pieces_take_time_in_proportion(model, pieces, codec, library):
    r = random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "a", "中文字é🙂"):
        for n in (3000, 100_000):
            text = "".join(r.choice(alphabet) for _ in range(n))
            began = time.time()
            assert piece_counts.count_batch(model, piece_counts.Known(), [text]) == [len(pieces.encode(text))]
            assert time.time() - began < 20
    small = byte_bpe.Codec(byte_bpe.read_vocabulary(RANKS), public_tokenizers.PATTERN, kept=500)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(small.machine.steps) <= 500 + 1024


def test_kept_counts_are_bounded(model, pieces):
    known = piece_counts.Known(2000)
    texts = [f"some {i} more words{i} and{i * 7}" for i in range(50)]
    assert [piece_counts.count_batch(model, known, [t])[0] for t in texts] == [len(pieces.encode(t)) for t in texts]
    assert known.size <= 2000
    piece_counts.count_batch(model, known, ["y" * 100])
    assert all(len(p) <= piece_counts.KNOWN_CHARS for p in known.counts)


def test_queries_equal_libraries(spark, docs, library, pieces, tmp_path):
    texts = [None, "", "one two", "é🙂 x" * 3000, "one two", *ODD]
    docs(list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    for r in byte_bpe.op9(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for r in piece_counts.op10(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        n = len(pieces.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
