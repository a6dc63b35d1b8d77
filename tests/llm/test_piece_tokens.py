"""Ids and texts of the merge-type model against its own library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from mnemoscope.llm import piece_tokens, queries

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces():
    return piece_tokens.load(tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def odd_texts(pieces):
    r = random.Random(3)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [pick(" ▁aabe  the-in\n0é中文ﬁ\U0001d538_=", r.randrange(80)) for _ in range(500)]
    texts += [pick([chr(x) for x in (*range(1, 0x250), *range(0x3000, 0x3100), *range(0x4E00, 0x5200))], 60) for _ in range(300)]
    texts += [pick(pieces.pieces[259:], 12) for _ in range(1000)]
    texts += [x for k in range(50) for x in (" " * k, "a" + " " * k + "b", "a" * k, "=" * k + "-" * k, "\n" * k)]
    return [*texts, "", "<s>a</s><unk><0x41>", "\x00a​﻿", "no" * 5000, "x" * 20000]


def rows_of(lengths, ids):
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_ids_and_texts_are_the_librarys(pieces, library, odd_texts):
    expected = library.encode(odd_texts, add_eos=True)
    lengths, ids = pieces.encode_all([t.encode() for t in odd_texts])
    assert rows_of(lengths, ids) == expected
    bounds = np.append(0, np.cumsum(lengths))
    assert pieces.decode_all(pa.array(ids), bounds) == library.decode(expected)


def test_any_ids_decode_as_in_the_library(pieces, library):
    r = random.Random(4)
    rows = [[r.randrange(32000 if r.random() < 0.6 else 300) for _ in range(r.randrange(9))] for _ in range(3000)]
    bounds = np.append(0, np.cumsum([len(x) for x in rows]))
    assert pieces.decode_all(pa.array([i for x in rows for i in x], pa.int32()), bounds) == library.decode(rows)


def test_pairs_stay_as_when_joined(pieces):
    """The test by scores gives what joining the two texts gives."""
    r, names = random.Random(5), list(pieces.borders)
    short = [p for p in names if len(p) < 5 and set(p) <= set("▁aetion-=*sx")]
    for k in range(20000):
        a, b = (r.choice(names if k % 2 else short) for _ in range(2))
        border, stays = len(a), True
        for _, symbols in piece_tokens.joined(list(a + b), pieces.scores):
            stays = stays and border in np.cumsum([len(s) for s in symbols])
        assert pieces.compatible(pieces.ids[a], pieces.ids[b]) == stays


def test_forgetting_changes_nothing(pieces, library, odd_texts, monkeypatch):
    monkeypatch.setattr(piece_tokens, "REMEMBERED", 10)
    assert rows_of(*pieces.encode_all([t.encode() for t in odd_texts[:400]])) == library.encode(odd_texts[:400], add_eos=True)


def test_hard_rows(spark, pieces, library, hard, hard_rows, nothing):
    got = sorted((tuple(r) for r in piece_tokens.decode(piece_tokens.encode(hard, pieces), pieces).collect()), key=repr)
    texts = [t or "" for _, t, *_ in hard_rows]
    expected = sorted(((i, library.encode(t, add_eos=True), t) for (i, *_), t in zip(hard_rows, texts)), key=repr)
    assert got == expected
    assert piece_tokens.decode(piece_tokens.encode(nothing, pieces), pieces).count() == 0
    odd = piece_tokens.encode(spark.createDataFrame([(None, None), (None, "a")], "doc_id string, text string"), pieces)
    assert [tuple(r) for r in odd.orderBy("ids").collect()] == [(None, [2]), (None, [264, 2])]


def test_query(spark, library):
    got = {tuple(r) for r in queries.op13_piece_tokens(spark, SF).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = library.encode([d.text or "" for d in docs], add_eos=True)
    assert got == {(d.doc_id, len(x), digest(" ".join(map(str, x))), digest(library.decode(x))) for d, x in zip(docs, ids)}
