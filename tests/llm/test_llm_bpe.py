import hashlib
import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from terravet.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def ids(vocab, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(vocab, texts)]


def test_random_texts_match(vocab, reference):
    rng = random.Random(5)
    parts = list("aabz'''stmdrevl  \n\t  \u0085\x1c9٣½é中😀.,!$%-_\x00\r") + ["'s", "'re", "'ll", " '", "   ", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert ids(vocab, texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_slices_match(vocab, reference):
    texts = ["a" * 5000, " " * 3000, "é" * 700 + "x", "abc" * 2000, "1234567" * 6, "", "x" * 47, "x" * 48, "x" * 49]
    assert ids(vocab, texts) == [reference.encode_ordinary(t) for t in texts]


def test_scan_equals_steps():
    rng = np.random.default_rng(1)
    of_class, _, from_free, _ = bpe.monoid()
    for size in (1, 63, 64, 65, 5000):
        kinds = rng.integers(0, 9, size)
        state, want = bpe.FREE, []
        for k in kinds:
            state = bpe._step(state, int(k))[0]
            want.append(state)
        assert from_free[bpe.scan(of_class[kinds])].tolist() == want


def test_round_trip_of_odd_rows(spark, vocab):
    rows = [(1, "Hello world, it's", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello world, it's", "x"), (None, "é\n\n 中", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.round_trip(df, bpe.default_vocabulary(), keep=["doc_id"]).collect()
    assert len(out) == 5 and all(r.lossless for r in out)
    assert [r.n_tokens for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert {r.decoded_sha256 for r in out if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    full = bpe.decode(bpe.encode(df, bpe.default_vocabulary(), keep=["doc_id"]), bpe.default_vocabulary()).collect()
    assert {bytes(r.decoded) for r in full if r.doc_id is None} == {"é\n\n 中".encode()}
    assert [r.offsets[-1] for r in full if r.doc_id == 1] == [17, 17]
    clash = bpe.round_trip(df.withColumn("n_tokens", df.doc_id), bpe.default_vocabulary()).collect()
    assert sorted(r.n_tokens for r in clash) == sorted(r.n_tokens for r in out) and "ids" in clash[0].asDict()
    long = bpe.round_trip(df.selectExpr("doc_id", "repeat('wörter and 中 ', 200000) AS text").limit(1), bpe.default_vocabulary()).collect()
    assert long[0].lossless and long[0].n_tokens > 600_000
    assert bpe.round_trip(df.limit(0), bpe.default_vocabulary(), keep=["doc_id"]).count() == 0


def test_offsets_cut_the_decoded_bytes_into_the_tokens(vocab):
    for packed in bpe.encode_texts(vocab, ["Plain words, 12345 and\n\n  more é😀.", ""]):
        decoded, ends = vocab.decode(packed), bpe.token_offsets(vocab, packed)
        cut = [decoded[a:b] for a, b in zip([0, *ends], ends)]
        ids = np.frombuffer(packed, "<u4")
        assert cut == [vocab.tokens[i] for i in ids.tolist()]
        assert vocab.decode(packed, ends) == decoded == b"".join(vocab.tokens[i] for i in ids.tolist())
