"""Piece encoding against the library it follows."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from trialspark.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", " Hello  world\n x\t éﬁ ", "a\x00b <s> </s> <unk> <0x41>", "▁▁x", "\n\nq", "日本語 text ขขข 😀😀", " " * 900, " " * 77 + "abc" + " " * 500,
       "a" * 3000, "ab" * 700, "\U0010ffff x", "▁ ▁"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def run(texts, begin=True, end=True):
    raw = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(r) for r in raw]))
    flat, at = pieces.vocabulary(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), off, begin, end)
    return [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnop   \n\t.,éèñ日本ขabc▁😀̀", "aeionrst ", "aab ", "  \n", "0123456789abcdefABCDEF"])
def test_encoding_equals_the_library(library, alphabet):
    rng = random.Random(len(alphabet))
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(1500)]
    assert run(texts) == library.encode(texts, add_bos=True, add_eos=True)
    assert run(texts[:50], False, False) == library.encode(texts[:50])


def test_decoding_any_ids_equals_the_library(library):
    rng = random.Random(2)
    v = pieces.vocabulary(PATH)
    for _ in range(2000):
        ids = [rng.choice([1, 2, 0, 13, 200, 230, 201, 195, 29871, 300, 259, rng.randrange(32000)]) for _ in range(rng.randrange(9))]
        flat, at = v.decode(np.array(ids, "<u4"), np.array([0, len(ids)]))
        assert flat.tobytes().decode() == library.decode(ids) and at.tolist() == [0, len(flat)]
    with pytest.raises(ValueError):
        v.decode(np.array([32000], "<u4"), np.array([0, 1]))


def test_long_words_end(library):
    rng = random.Random(3)
    texts = [" " * 200_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(300_000))]
    start = time.perf_counter()
    got = run(texts)
    assert time.perf_counter() - start < 60
    assert got == library.encode(texts, add_bos=True, add_eos=True)


def test_tables(spark, library):
    rows = [(t, i, "x") for i, t in enumerate([*ODD, None])] + [("same", None, "y")] * 2
    docs = spark.createDataFrame(rows, "text string, doc_id long, decoded_ string").repartition(3)
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).collect()[0].decoded == ""
    with pytest.raises(ValueError):
        pieces.encode(docs.withColumnRenamed("decoded_", "IDS"), PATH)


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.QUERIES["op13_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
