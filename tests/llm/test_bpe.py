import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from bulwark.llm.bpe import ByteBPE, Transducer, Utf8Decoder, decode_bytes, encode_documents, load_ranks
from bulwark.llm.op1_bpe import vocabulary

DATA = vocabulary()
RANKS = load_ranks(DATA)
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return ByteBPE(RANKS, P.PATTERN)


def texts():
    rng = random.Random(3)
    tokens = [t for t in RANKS if len(t) < 12]
    out = ["", " ", "\n\n a", "<|endoftext|>", "a" * 3000, " " * 500 + "x", "\r\n\t", "é" * 50, "\U0001f600\U0001f468‍\U0001f469", "\x00\x01", "don't we'll I'D"]
    for _ in range(400):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        out.append(piece.decode("utf-8", "ignore"))
    out += ["".join(rng.choice("abcdefg hijé中\n0123.,!?") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    return out


def test_matches_the_known_encoder(codec):
    for t in texts():
        ids = codec.encode(t)
        assert ids == KNOWN.encode_ordinary(t), t
        assert decode_bytes(codec.token, ids) == t.encode()


def test_small_tables_change_nothing():
    small = ByteBPE(RANKS, P.PATTERN, max_words=3)
    small.fst = Transducer(RANKS, max_states=10)
    for t in texts()[:200]:
        assert small.encode(t) == KNOWN.encode_ordinary(t)


def test_streaming_decoder_splits_anywhere(codec):
    for t in texts()[:300]:
        ids = codec.encode(t)
        d = Utf8Decoder(codec.token)
        got = "".join(d.feed([i]) for i in ids) + d.finish()
        assert got == t


def test_decoder_replaces_ill_formed_bytes():
    tokens = [bytes([b]) for b in range(256)]
    for data in (b"\xff", b"a\xe4\xb8", b"\xc0\x80", b"\xed\xa0\x80", b"\xf0\x9f\x98x", b"\xe4\xb8\xad\x80"):
        d = Utf8Decoder(tokens)
        assert "".join(d.feed([b]) for b in data) + d.finish() == data.decode("utf-8", "replace")
        whole = Utf8Decoder([data])
        assert whole.feed([0]) + whole.finish() == data.decode("utf-8", "replace")


def test_decoder_matches_on_random_bytes():
    rng = random.Random(4)
    some = [0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC1, 0xC2, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(2000):
        parts = [bytes(rng.choice(some) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5))]
        d = Utf8Decoder(parts)
        assert d.feed(range(len(parts))) + d.finish() == b"".join(parts).decode("utf-8", "replace")


def test_query_columns(spark, documents):
    docs = documents([None, "", "hello world", "naïve \U0001f600", "hello world", "x" * 50_000])
    rows = {r["doc_id"]: r for r in encode_documents(docs.withColumnRenamed("lang", "n_tokens"), DATA, P.PATTERN).collect()}
    assert len(rows) == 6
    for i, t in ((0, ""), (1, ""), (2, "hello world"), (3, "naïve \U0001f600"), (5, "x" * 50_000)):
        ids = KNOWN.encode_ordinary(t)
        assert rows[i]["n_tokens"] == len(ids) and list(rows[i]["token_ids"]) == ids
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and rows[i]["valid_utf8"]
    assert encode_documents(docs.limit(0), DATA, P.PATTERN).count() == 0
