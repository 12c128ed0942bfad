"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tapestream.llm import bytebpe

from .data import SF, documents, empty


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=bytebpe.load_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.Encoder(bytebpe.load_ranks(), bytebpe.PATTERN, bytebpe.newer())


def test_documents(spark, library):
    for docs in (documents(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        expected = sorted((d.doc_id if d.doc_id is not None else -1, library.encode_ordinary(d.text or "")) for d in docs.select("doc_id", "text").collect())
        encoded = bytebpe.encode(docs)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in encoded.collect()) == expected
        assert all(r.n_tokens == len(r.ids) for r in encoded.collect())
        texts = sorted((d.doc_id if d.doc_id is not None else -1, (d.text or "").encode()) for d in docs.select("doc_id", "text").collect())
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.raw)) for r in bytebpe.decode(encoded).collect()) == texts


def test_query(spark, library):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    out = bytebpe.op11_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_ids_of_any_type_and_empty_tables(spark):
    out = bytebpe.encode(spark.createDataFrame([("x", "one two")], "doc_id string, text string")).collect()
    assert out[0].doc_id == "x" and out[0].n_tokens == len(out[0].ids) > 0
    assert bytebpe.encode(empty(spark)).collect() == [] and bytebpe.digests(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab ", min_size=60, max_size=400), st.text(alphabet="the 're\n", max_size=300), st.text(alphabet="漢字かな", min_size=20, max_size=120)))
def test_texts(encoder, library, text):
    found = encoder.encode([text])[0].tolist()
    assert found == library.encode_ordinary(text) and encoder.decode(found) == text.encode()


def test_code_points_newer_than_the_library(encoder, library):
    some = bytebpe.newer()[:: max(1, len(bytebpe.newer()) // 400)]
    for c in some:
        text = f"a{c}a{c} {c}{c}1{c}.{c} \n{c}"
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_long_pieces_take_rounds_not_their_square(encoder, library):
    rng = np.random.default_rng(1)
    for text in ("a" * 200_000, "long" * 30_000, "".join(rng.choice(list("etaoinshr"), 30_000)), "+-" * 20_000, " " * 50_000, "".join(map(chr, 0x4E00 + rng.integers(0, 500, 8_000)))):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_vocabularies_whose_merges_come_out_of_order():
    """Ranks in any order: a merge may at once make a better one, within matrices and in long pieces."""
    rng = np.random.default_rng(7)
    for _ in range(12):
        tokens = {bytes([b]) for b in b"abc"}
        while len(tokens) < 40:
            a, b = (sorted(tokens)[i] for i in rng.integers(0, len(tokens), 2))
            tokens.add((a + b)[:6])
        extra = [t for t in sorted(tokens) if len(t) > 1]
        rng.shuffle(extra)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(extra)}
        own, theirs = bytebpe.Encoder(ranks, bytebpe.PATTERN, ""), tiktoken.Encoding("own", pat_str=bytebpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for size in (5, 30, 63, 70, 300, 900):
            text = "".join(rng.choice(list("abc"), size))
            assert own.encode([text])[0].tolist() == theirs.encode_ordinary(text)
