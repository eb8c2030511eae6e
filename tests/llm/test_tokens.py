"""Encoding, decoding and counts against the public libraries."""

import hashlib
import random
from pathlib import Path

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from turnlake.llm import bpe, token_count

RANKS = Path(P.path("byte_bpe_50k.tiktoken")).read_bytes()
MODEL = Path(P.path("piece_bpe_32k.model")).read_bytes()
TEXTS = ["", " ", "  a  b ", "a\n\nb\tc", "<|endoftext|> <s> x</s> <0x0A>", "　a ﬁ é ▁▁a\x00", "日本語 カナ 😀😀x", "🏳️‍🌈 " * 30, "a" * 3000, " " * 200, "ab" * 2000 + "\n" * 50, "it's we'LL 123 ½ Ⅷ ñ ́e", "\x1c\x1d a b c"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_count.PieceCounter(MODEL)


PIECES = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_texts(codec, library, counter):
    r = random.Random(3)
    for t in [*TEXTS, *("".join(r.choice("abcdeé日 \n'🙂") for _ in range(200)) for _ in range(200))]:
        ids = codec.encode(t)
        assert ids == library.encode_ordinary(t)
        assert codec.decode(ids) == t
        assert counter(t) == len(PIECES.encode(t))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(codec, library, counter, t):
    assert codec.encode(t) == library.encode_ordinary(t)
    assert counter(t) == len(PIECES.encode(t))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_decoder_streams(codec, data, size):
    ids = [codec.machine.ranks[bytes([b])] for b in data]
    d = bpe.Decoder(codec.machine.bytes_of)
    assert "".join(d.feed(ids[i : i + size]) for i in range(0, len(ids), size)) + d.close() == data.decode("utf-8", "replace")


def test_bounded_states(codec, library):
    c = bpe.Codec(bpe.read_ranks(RANKS), P.PATTERN, (3, 50, 20))
    t = "many different wordings undergo retokenisation continuously " * 5
    assert c.encode(t) == library.encode_ordinary(t)


def test_piece_cache(counter, monkeypatch):
    monkeypatch.setattr(token_count, "CACHED", 2)
    for t in TEXTS:
        assert counter(t) == len(PIECES.encode(t))


SCHEMA = "doc_id long, text string, ids string, n_tokens int, kept boolean"


def rows(spark, texts):
    return spark.createDataFrame([(None if i == 1 else i, t, "x", -1, None) for i, t in enumerate(texts)], SCHEMA)


def test_frames(spark, library):
    texts = [*TEXTS, None, TEXTS[3], "w " * 300_000]
    got = {r.doc_id: r for r in bpe.digests(rows(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        r = got[None if i == 1 else i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for r in token_count.count_tokens(rows(spark, texts), MODEL).collect():
        t = texts[1 if r.doc_id is None else r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(PIECES.encode(t)), len(PIECES.encode(t)) > 4096)
    encoded = bpe.encode(rows(spark, texts), RANKS, P.PATTERN, decoded_col="again")
    assert encoded.columns == ["doc_id", "text", "n_tokens", "kept", "ids", "again"]
    assert all((r.text or "") == r.again for r in encoded.collect())
    assert all((r.text or "") == r.back for r in bpe.decode(encoded, RANKS, out_col="back").select("text", "back").collect())
    none = rows(spark, []).limit(0)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0 and token_count.count_tokens(none, MODEL).count() == 0


def test_model_kinds():
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})
