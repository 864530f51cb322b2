"""Word pieces put together as arrays, byte-level words, and the texts that need no NFKC."""
import random
import re
import unicodedata

import pyarrow as pa
import pytest

from tessera.operators import lmprep as L
from tessera.operators import vocab as V


@pytest.mark.parametrize("cut", [None, 1, 5])
def test_each_distinct_word_is_asked_once(cut):
    rng = random.Random(7)
    rows = [[rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(50)] + [None, [], ["zz"], None]
    asked = []

    def pieces(word):
        asked.append(word)
        return tuple(range(len(word), 2 * len(word)))

    words = pa.array(rows, pa.list_(pa.string()))
    offsets, out = L._pieces_of_rows(words.slice(3), pieces, cut)
    got = pa.ListArray.from_arrays(offsets, out).to_pylist()
    assert got == [[k for w in row or () for k in range(len(w), 2 * len(w))][:cut] for row in rows[3:]]
    assert sorted(asked) == sorted({w for row in rows[3:] for w in row or ()})
    for nothing in (words.slice(0, 0), pa.array([None, []], pa.list_(pa.string()))):
        offsets, out = L._pieces_of_rows(nothing, pieces, cut)
        assert pa.ListArray.from_arrays(offsets, out).to_pylist() == [[]] * len(nothing)


def test_text_that_stays_in_the_jvm_is_nfkc_already():
    plain = re.compile(f"[{V.NFKC_PLAIN}]")
    kept = [chr(c) for c in range(0x250) if plain.fullmatch(chr(c))]
    assert set("aéßñ\x00\x7f") <= set(kept) and not set(" ªµ½Ā") & set(kept)
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in kept for b in kept)


def test_words_of_plain_and_other_texts(spark):
    texts = ["café naïve", "é café", "ａé", "½ ªµ x", None, "", "a\nbé\n", "é "]
    got = {r.word: r.freq for r in V.word_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()}
    want = {}
    for text in texts:
        for w in re.findall(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+", unicodedata.normalize("NFKC", text or "")):
            word = "".join(V._byte_char(b) for b in w.encode())
            want[word] = want.get(word, 0) + 1
    assert got == want


def test_byte_level_of_every_byte(spark):
    words = [chr(c) for c in range(1, 0x180)] + ["\x00", "€ \U0001f600", "", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", V.byte_level("w").alias("b")).collect()
    assert [r.b for r in sorted(got)] == [None if w is None else "".join(V._byte_char(b) for b in w.encode()) for w in words]
