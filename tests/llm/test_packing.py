"""Packing: ids equal the tokenizer's, pieces tile documents and sequences."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as pk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def checked(rows, pieces, tokenizer, size):
    """rows: (id, text); every id lies in one piece, sequences are gapless and full but the last."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert [p.start for p in mine] == list(np.cumsum([0] + [p.length for p in mine[:-1]]))
        assert sum(p.length for p in mine) == len(ids) and all(p.doc_tokens == len(ids) for p in mine)
        for p in mine:
            cut = ids[p.start:p.start + p.length]
            assert p.ids == cut and p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert fill.get(p.sequence_id, 0) == p.offset
        fill[p.sequence_id] = p.offset + p.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == size for s in range(len(fill) - 1))
    assert fill[len(fill) - 1] <= size


def test_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    checked([(r.doc_id, r.text) for r in docs.collect()], pk.pack_documents(docs).collect(), tokenizer, 1024)


def test_texts_of_all_kinds_and_sizes(spark, tokenizer):
    texts = [None, "", " ", "  ", "a", "a b", "a  b", " a", "a ", "a\nb c", "a \n b", "don't we'll", "12 345", "é ü ß", "日本 語", "x<|endoftext|>y z",
             "a\u00a0b c\u2003 d", "\t\ttabs\there", "one two\nthree four\n\nfive", "a\nb\nc", "\na", "a\n", "it's\n's a b", "!!! ??", "word " * 3000, "x" * 30_000, "a\u3000 b", "end.\r\n\r\nnext"]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, part int")
    for size in (1024, 16):
        checked(list(enumerate(texts)), pk.pack_documents(frame.repartition(4), size=size).collect(), tokenizer, size)
    assert pk.pack_documents(frame.limit(0)).collect() == []


def test_remembered_units_are_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(pk, "CACHE_UNITS", 3)
    encode, _ = pk.make_encoder("byte_bpe_50k")
    text = "one two three four five six one two three seven"
    assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_and_null_identifiers(spark):
    frame = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id long, text string")
    got = pk.pack_documents(frame).collect()
    assert [p.doc_id for p in got].count(1) == 2 and sum(p.length for p in got) == 4 + 4 + 2


def test_padding_width():
    assert [pk.pad_to(n) for n in (1, 3, 512, 700, 1024)] == [1, 1024, 512, 1024, 1024]
