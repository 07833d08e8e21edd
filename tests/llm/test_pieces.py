"""Encoding by backtracking, against the library over whole texts."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from gridloom.llm import pieces_bpe, queries
from tests.llm.fixtures import documents, empty, texts

FOLDER = "/root/testdata/sf0.001"
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pieces_bpe.Encoder(MODEL)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_random_texts(encoder, library):
    rng = random.Random(3)
    known = list(encoder.ids)
    odd = [" ", "  ", "▁", "a", "aa", "é", "e\u0301", "日本", "\n", "\t", "\x00", "😀", ".", "_.", "².", "<s>", "<0x41>", "</s>"]
    for _ in range(3000):
        text = "".join(rng.choice(odd + [rng.choice(known), rng.choice(known).replace("▁", " ")]) for _ in range(rng.randint(0, 12)))
        assert ids(encoder, text) == library.encode(text)


@pytest.mark.parametrize("text", ["a" * 5001, " " * 3001, "ab" * 3000, "x" * 100_000, "日本語" * 2000, "of the" * 5000, "\n" * 400, "wor d." * 999])
def test_long_texts_without_cuts(encoder, library, text):
    assert ids(encoder, text) == library.encode(text)


def test_pieces_that_agree_are_what_the_merges_make(encoder):
    """The taken sequence needs backing off: the longest matches alone would differ."""
    rng = random.Random(4)
    differs = 0
    for _ in range(400):
        text = "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 30)))
        merged, taken, at, greedy = encoder.merge(text), encoder.run(text), 0, []
        assert taken == merged
        while at < len(text):
            longest = next(text[at:k] for k in range(len(text), at, -1) if text[at:k] in encoder.ids)
            greedy.append(longest)
            at += len(longest)
        differs += greedy != merged
    assert differs > 50


def test_memory_of_chunks_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces_bpe, "MOST", 50)
    monkeypatch.setattr(pieces_bpe, "MOST_PAIRS", 50)
    small = pieces_bpe.Encoder(MODEL)
    for text in filter(None, texts()):
        assert ids(small, text) == library.encode(text)
        assert max(map(len, (small.met, small.met.old, small.words, small.words.old, small.agree))) <= 50


def test_other_models_are_refused():
    model = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces_bpe.Encoder(model.SerializeToString())
    model = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces_bpe.Encoder(model.SerializeToString())


def test_tables(spark, library):
    """Nulls, empty texts, repeated rows, a clashing column and extra columns."""
    docs = documents(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = pieces_bpe.decode(pieces_bpe.encode(docs, MODEL), MODEL)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(r.text or "")
        assert r.ids == want and r.decoded == library.decode(want)
    assert pieces_bpe.encode(empty(spark), MODEL, keep=["doc_id"]).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([None, 65],)], "ids array<int>")
    assert [r.decoded for r in pieces_bpe.decode(odd, MODEL).collect()] == ["", "", library.decode([65])]


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op12_sentencepiece"](spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        want = library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()
