"""Encoding against the library that the ranks are made for, decoding against Python's own, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillon.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aeiourstln", ["the", "in", " er", "an "], "ab", "äöüßéàñ日本語中文字", "😀🎉é", "\n\t 　", "-_*#/.", "'stmdrevl ", "0123456789ab "]


@pytest.fixture(scope="module")
def rank_file():
    return open(RANKS).read()


@pytest.fixture(scope="module")
def library(rank_file):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(rank_file), special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in (rng.choice(ALPHABETS) for _ in range(n))]


def test_random_texts(rank_file, library):
    encoder, decoder = byte_bpe.Encoder(rank_file, public_tokenizers.PATTERN), byte_bpe.Decoder(rank_file)
    for k, text in enumerate(random_texts(4000, 1)):
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode_ordinary(text), text
        assert "".join(byte_bpe.pieces(decoder, ids, 1 + k % 5)) == text


def test_moves_and_words_may_be_forgotten_at_any_time(rank_file, library):
    encoder = byte_bpe.Encoder(rank_file, public_tokenizers.PATTERN)
    encoder.words = byte_bpe.Words(byte_bpe.Transducer(byte_bpe.read_ranks(rank_file), kept_moves=3), kept_words=2)
    for text in [*random_texts(300, 2), "strawberrypiesandsoforth" * 20]:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
    assert encoder.words.transducer.made <= 3 * 2 and len(encoder.words) <= 2


def test_tokens_leave_after_bounded_lookahead(rank_file):
    """No move holds back more bytes than the longest token has."""
    t = byte_bpe.Transducer(byte_bpe.read_ranks(rank_file))
    longest = max(map(len, t.spelling.values()))
    t.encode(b"abcdefgh" * 2000)
    assert max(sum(len(t.spelling[x]) for x in pending) for _, branches in t.states for _, pending in branches) <= 2 * longest


def test_small_vocabulary_by_merges_alone():
    """A vocabulary whose merges overlap: every word of up to 8 letters against joining lowest ranks first."""
    tokens = [b"a", b"b", b"c", b"ab", b"bc", b"aa", b"abc", b"aab", b"bcab", b"cc"]
    ranks = {t: k for k, t in enumerate(tokens)}
    t = byte_bpe.Transducer(ranks)

    def joined(word):
        parts = [bytes([x]) for x in word]
        while True:
            best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)  # noqa: B905
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for n in range(9):
        for code in range(3**n):
            word = bytes(b"abc"[code // 3**k % 3] for k in range(n))
            assert t.encode(word) == joined(word), word


def test_decoding_any_ids(rank_file, library):
    decoder, rng = byte_bpe.Decoder(rank_file), random.Random(3)
    for _ in range(3000):
        ids = np.array([rng.randrange(rng.choice([256, 50256])) for _ in range(rng.randint(0, 12))], dtype=np.int32)
        want = library.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        assert "".join(byte_bpe.pieces(decoder, ids, rng.randint(1, 4))) == want


def test_odd_rows_and_clashing_columns(spark):
    long = "word " * 120_000 + "x" * 300_000 + " " * 50_000
    rows = [(1, "a b", None, "p"), (2, None, [1], "q"), (3, "", [2], None), (None, long, None, None), (1, "a b", None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids array<int>, decoded string")
    out = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded", "token_ids_"]
    back = byte_bpe.decode(out, RANKS, ids_col="token_ids_")
    assert back.columns == [*out.columns, "decoded_"]
    got = sorted(((r["doc_id"], r["decoded"], r["decoded_"]) for r in back.collect()), key=str)
    assert got == sorted(((d, p, t or "") for d, t, _, p in rows), key=str)
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    holes = spark.createDataFrame([([64, None, 65],), (None,)], "token_ids array<int>")
    assert [len(r["decoded"]) for r in byte_bpe.decode(holes, RANKS).orderBy(F.size("token_ids").desc()).collect()] == [2, 0]


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = byte_bpe.op13_byte_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
