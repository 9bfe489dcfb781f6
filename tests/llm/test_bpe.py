from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from simstrata.llm import bpe

RANKS = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module", params=[(4, 1), (9, 2), (64, 8), (10**9, 5)])
def small(request):
    return bpe.Encoder(RANKS, P.PATTERN, *request.param)


def by_merging(word: bytes) -> list[bytes]:
    parts = [bytes([x]) for x in word]
    while len(parts) > 1:
        rank, i = min((RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def test_every_token_encodes_to_itself():
    assert all(by_merging(t) == [t] for t in RANKS)


def test_merges_by_heap_equal_plain_ones():
    encoder, r = bpe.Encoder(RANKS, P.PATTERN), np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300):
        for letters in (b"a", b"ab", b"the in", bytes(range(256))):
            data = bytes(r.choice(list(letters), n).tolist())
            assert [encoder.bytes_of[i] for i in encoder._merge_large(data)] == by_merging(data) == [encoder.bytes_of[i] for i in encoder.merge(data)]


@pytest.mark.parametrize("text", [
    "", "a", "'", "it's they're we'll'll'llama I'd've", "a" * 5000, "ab" * 3000, " " * 3000, "1234567" * 400, "!?'" * 900,
    "x  y\n\n\t z  w" * 90, "äöüß" * 700, "日本語テキスト" * 300, "𝒳😀" * 400, "don't" * 500, "re're" * 300, "\r\n" * 700,
])
def test_same_as_whole_text(small, text):
    ids = small.encode(text)
    assert ids == TRUE.encode_ordinary(text)
    assert small.decode(ids) == text.encode()


ODD = st.text(alphabet=st.sampled_from(list("abertlsv 's\n\t1 2!?.é日😀’  ")), max_size=400)


@given(ODD)
@settings(max_examples=400, deadline=None)
def test_odd_texts(text):
    for leaf in (4, 7, 32):
        encoder = _cached(leaf)
        assert encoder.encode(text) == TRUE.encode_ordinary(text)


@given(st.text(max_size=300), st.lists(st.sampled_from(["the", " tion", "  ", "lichkeit", "'ll", "ing"]), max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_texts(a, b):
    text = a + "".join(b)
    assert _cached(7).encode(text) == TRUE.encode_ordinary(text)
    assert _cached(7).decode(_cached(7).encode(text)) == text.encode()


_ENCODERS: dict[int, bpe.Encoder] = {}


def _cached(leaf):
    if leaf not in _ENCODERS:
        _ENCODERS[leaf] = bpe.Encoder(RANKS, P.PATTERN, leaf, leaf % 7)
    return _ENCODERS[leaf]


def test_query(spark, sf_dir):
    rows = bpe.op9_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = TRUE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "it's", None)], "doc_id int, text string, token_ids string")
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in out) == [b"", b"", b"", b"it's"]
    assert bpe.encode(df.limit(0), path, P.PATTERN).count() == 0
