"""BPE training: merges applied to all words at once, and the number of passes."""

import random
from collections import Counter

import numpy as np
import pytest

from test_bruteforce import bpe_counted
from tessera.operators import vocab as V


def packed(words, freqs):
    return (np.frombuffer("".join(words).encode("utf-32-le"), "<i4"), np.asarray([len(w) for w in words], np.int64),
            np.asarray(freqs, np.int64))


def words_of(symbols, lengths, freqs):
    ends = np.cumsum(lengths)
    return sorted((symbols[e - n:e].tolist(), f) for e, n, f in zip(ends, lengths, freqs.tolist()) if n > 1)


@pytest.mark.parametrize("seed, long_word", [(seed, long) for seed in range(8) for long in (1000, 6, 0)])
def test_merges_at_once_equal_one_after_another(monkeypatch, seed, long_word):
    """Runs of one letter, pairs that come twice in the list, tokens made again, and words of every length."""
    monkeypatch.setattr(V, "LONG_WORD", long_word)
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aaabc") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    freqs = [rnd.randint(1, 9) for _ in words]
    symbols, merges = [ord(c) for c in "abc"], []
    for k in range(25):
        token = rnd.choice(symbols[3:]) if len(symbols) > 3 and rnd.random() < 0.2 else V.FIRST_MERGED + k
        merges.append((rnd.choice(symbols[-6:]), rnd.choice(symbols), token))
        symbols.append(token)
    one, want = V._Chunk(*packed(words, freqs)), Counter()
    for step, merge in enumerate(merges):
        changed = one.change(*merge)
        for code, n in zip(*changed) if changed else ():
            want[step, int(code)] += int(n)
    block = V._Block(*packed(words, freqs))
    got = block.apply(merges, report=True)
    got = {(int(s), int(c)): int(n) for s, c, n in zip(*got)} if got else {}
    assert got == {k: n for k, n in want.items() if n}
    kept = one.packed()
    left = words_of(*(np.frombuffer(kept[c], t) for c, t in (("symbols", "<i4"), ("lengths", "<i4"), ("freqs", "<i8"))))
    assert words_of(*block.words()) == left
    if block.long is not None:
        block.long.index()
    one.index()
    assert [x.tolist() for x in block.totals()] == [x.tolist() for x in one.totals()]


def test_few_passes_with_words_beyond_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = V.word_frequencies(docs, "text").cache()
    stats = {}
    _, m = V.train_bpe(words, 2 + 256 + 4000, guess_words=10_000, stats=stats)
    got = [(r.left, r.right, r.cnt) for r in m.orderBy("rank").collect()]
    assert got == bpe_counted({r.word: r.freq for r in words.collect()}, len(got))
    assert len(got) >= 4000 and stats["passes"] <= 20, stats


def test_leading_pairs_stay_bounded():
    pairs = V._Leading([(k << 32 | 1, 100 + k) for k in range(2, 40)], chr, None, 2, 10)
    pairs.apply([5 << 32 | 1], [1], 900)
    assert len(pairs.count) == 10 and pairs.best() == (39 << 32 | 1, 139) and pairs.cut == pairs.key(30 << 32 | 1, 130)[:3]
    pairs.apply([39 << 32 | 1, 7 << 32 | 900], [-139, 129], 900)          # behind the cut: not taken in
    assert len(pairs.count) == 9 and pairs.best() == (38 << 32 | 1, 138)
