"""Encoding and decoding by merge rounds against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from splicelake.llm import pieces, queries

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, ids string, `odd name` int"
ODD = [None, "", " ", "  ", "a", "▁", "▁▁ ▁a", "\n\n  x\t\r\n ", " " * 5000, "a" * 5000, "the" * 3000, "ACGT" * 2000, "中文字" * 100, "\x00a\x00", "😀x😀", "a  b   c    d", "<s></s><0x41><unk>", "ab c　d", "ab c　d"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.PieceEncoder(MODEL, generation=50)


def agree(own, library, texts):
    ids, stops = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:])] == [library.encode(t or "") for t in texts]
    ids, stops = own.with_end(ids, stops)
    assert own.decode(ids, stops).to_pylist() == [library.decode(ids[a:b].tolist()) for a, b in zip(stops, stops[1:])]


def test_odd_texts(own, library):
    agree(own, library, ODD)
    agree(own, library, [])
    agree(own, library, [None, ""])


def test_random_texts(own, library):
    rng = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz  ", "ab ", "the n", "éèàüß ", "ACGT", "中文日本語 ", "0123456789. ", "{}();= \n\t", "▁ a", "👍🏽 é‍"]
    for k in range(100):
        texts = ["".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.3 else alphabets[k % 10]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
        agree(own, library, texts)


def test_every_piece_of_the_vocabulary(own, library):
    agree(own, library, [library.id_to_piece(i) for i in range(library.get_piece_size())])


def test_ids_that_spell_no_text(own, library):
    rng = random.Random(2)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    got = own.decode(np.array([i for r in rows for i in r], np.int32), np.cumsum([0, *map(len, rows)])).to_pylist()
    assert got == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        own.decode(np.array([32000]), np.array([0, 1]))


def test_slices_of_long_texts(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 64)
    agree(own, library, ["ab cd, " * 200, "x" * 300, None, "", "a" * 30 + "  b", "é" * 90, " " * 200, ""])
    agree(own, library, ODD)


def test_ties_go_through_the_agenda(own, library, monkeypatch):
    monkeypatch.setattr(pieces, "TIES", 4)
    agree(own, library, [" " * n + "x" * (n % 3) for n in range(60)] + ["a" + " " * 40 + "b" + " " * 41])


def test_encode_and_decode_tables(spark, library):
    rows = [(None if i == 3 else i // 2, t, "x", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pieces.encode(docs, MODEL, decoded=True)
    want = sorted((d if d is not None else -1, library.encode(t or "", add_eos=True)) for d, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got.collect()) == want
    assert all(library.decode(r.ids) == r.text for r in got.collect())
    stored = spark.createDataFrame([(1, [450, 29871, 2]), (2, None), (3, []), (None, [None, 450])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in pieces.decode(stored, MODEL).collect()} == {(1, library.decode([450, 29871, 2])), (2, None), (3, ""), (None, library.decode([450]))}
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_query(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op13_merge_rounds(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
