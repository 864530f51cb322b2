"""What a task's Python holds, and what crosses the network, does not follow the table."""
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import unicode as U
from tessera.operators import lmprep as L
from tessera.operators import vocab as V


def test_word_pieces_with_few_words_kept_and_few_rows_at_once(spark, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)] + ["a" * 101, "zz"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, "")]
    texts = spark.createDataFrame(rows, "i long, t string")
    tokens = ["[UNK]", "a", "b", "ab", "##a", "##b", "##c", "##bc"]
    vocab = spark.createDataFrame(list(zip(tokens, range(len(tokens)))), "token string, id int")

    def encoded(**options):
        return sorted(map(tuple, L.wordpiece_encode(texts, ["i"], "t", vocab, unk_id=0, **options).collect()))

    want, cut = encoded(), encoded(max_length=7)
    assert [(i, t[:7], n[:7]) for i, t, n in want] == cut
    known = set(tokens)
    for (i, text), (j, got, _) in zip(rows, want):
        assert i == j and got == [p for w in (text or "").split() for p in plain(w, known)]
    monkeypatch.setattr(L, "KNOWN_WORDS", 2)
    monkeypatch.setattr(L, "ENCODE_ROWS", 3)
    assert encoded() == want and encoded(max_length=7) == cut


def plain(word, known):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in known:
                break
        else:
            return ["[UNK]"]
        out.append(piece)
        at = end
    return out if len(word) <= 100 else ["[UNK]"]


def packed_and_not(spark):
    rows = [(1, "abc" * 5), (2, ""), (3, None), (4, "\u00e9\U0001f600x\u0301" * 3), (5, "q"), (5, "rs"), (None, "t" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.select("doc_id", L.code_points("text").alias("text"))


@pytest.mark.parametrize("most", [None, 4])
def test_padding_of_packed_ids(spark, most):
    text, ids = packed_and_not(spark)
    unique = F.col("doc_id") < 5                             # repeated keys have no defined order
    pads = [L.pad_batches(d.where(unique), ["doc_id"], 2, "text", 0, "left", most, packed=p) for d, p in ((text, True), (ids, False))]
    got, want = [sorted((tuple(map(str, r)) for r in p.select("doc_id", "batch_id", "text", "attention_mask").collect())) for p in pads]
    assert got == want and len(got) == 4


def test_collation_of_packed_ids_shuffles_text(spark):
    out = []
    for d, p in zip(packed_and_not(spark), (True, False)):
        ch = L.chunk_sequences(d.where("doc_id < 5"), ["doc_id"], "text", 4, packed=p).select("doc_id", "chunk_no", "input_ids")
        out.append(L.collate_batches(ch, ["doc_id", "chunk_no"], 3, "input_ids", 0, packed=p))
    got, want = [sorted(tuple(map(str, r)) for r in c.select("doc_id", "chunk_no", "batch_id", "input_ids", "labels").collect()) for c in out]
    assert got == want and len(got) == 7


def test_collate_query_joins_text(spark):
    from tessera.plans.q_prep import q_i4, q_i5
    for query in (q_i4, q_i5):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Join"):]
        assert "split(" in plan[:plan.index("Join")] and "split(" not in below


def test_nfkc_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(U, "ROWS", 3)
    texts = ["\uff11", None, "a", "", "\ufb01n", "e\u0301", "x"] * 5
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", V.nfkc("t").alias("t")).collect()
    assert [r.t for r in sorted(got)] == ["1", None, "a", "", "fin", "\u00e9", "x"] * 5


def test_training_in_small_chunks_and_lots(spark, monkeypatch):
    rng = random.Random(3)
    rows = list({"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 50) for _ in range(400)}.items())
    words = spark.createDataFrame(rows, "word string, freq long")
    want = V.train_bpe(words, 2 + 256 + 60)[1].orderBy("rank").collect()
    monkeypatch.setattr(V, "TRIAL_ROWS", 5)
    assert V.train_bpe(words, 2 + 256 + 60, chunk_words=20)[1].orderBy("rank").collect() == want and len(want) == 60
    assert V.CHUNK_WORDS <= 50_000
