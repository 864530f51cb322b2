"""Operators without a SQL oracle (or with long inputs) against plain Python."""

import random
from collections import Counter

import pytest

from tessera.functions import overlap as O
from tessera.operators import lmprep as L
from tessera.operators import vocab as V


def bpe_sequential(freqs, n_merges, min_freq=2):
    words = {tuple(w): f for w, f in freqs.items()}
    merges = []
    for _ in range(n_merges):
        counts = Counter()
        for sym, f in words.items():
            for a, b in zip(sym, sym[1:]):
                counts[(a, b)] += f
        cands = [(c, p) for p, c in counts.items() if c >= min_freq]
        if not cands:
            break
        c, (a, b) = min(cands, key=lambda x: (-x[0], x[1]))
        merges.append((a, b, c))
        new = Counter()
        for sym, f in words.items():
            out, i = [], 0
            while i < len(sym):
                if i < len(sym) - 1 and sym[i] == a and sym[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(sym[i])
                    i += 1
            new[tuple(out)] += f
        words = new
    return merges


@pytest.mark.parametrize("seed,top", [(1, 3), (2, 256), (3, 5)])
def test_bpe_equals_sequential(spark, seed, top):
    rnd = random.Random(seed)
    freqs = Counter()
    for _ in range(300):
        w = "".join(rnd.choice("aabbcdl") for _ in range(rnd.randint(1, 7)))
        freqs[w] += rnd.randint(1, 5)
    df = spark.createDataFrame(list(freqs.items()), "word string, freq long")
    alphabet = sorted(set("".join(freqs)))
    _, m = V.train_bpe(df, vocab_size=2 + len(alphabet) + 25, alphabet=alphabet, top_pairs=top)
    got = [(r.left, r.right, r.cnt) for r in m.orderBy("rank").collect()]
    want = bpe_sequential(freqs, len(got))
    assert got == want


def test_merge_overlapping_same_pair():
    import numpy as np

    def merged(words, *merges):
        text = "".join(words)
        chunk = V._Chunk(np.asarray(list(map(ord, text))), np.asarray(list(map(len, words))), np.ones(len(words), np.int64))
        for a, b, token in merges:
            chunk.merge(a, b, token)
        out = chunk.packed()
        return np.frombuffer(out["symbols"], "<i4").tolist(), np.frombuffer(out["lengths"], "<i4").tolist()
    l, a, b = map(ord, "lab")
    assert merged(["lllo", "ll", "l"], (l, l, 900)) == ([900, l, ord("o"), 900, l], [3, 1, 1])
    assert merged(["abab", "ba"], (a, b, 900), (900, 900, 901)) == ([901, b, a], [1, 2])
    assert merged(["lllllll"], (l, l, 900), (900, 900, 901), (900, l, 902)) == ([901, 902], [2])


def test_bpe_on_documents_takes_few_passes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = V.word_frequencies(docs, "text")
    stats = {}
    _, m = V.train_bpe(words, 2 + 256 + 300, stats=stats)
    got = [(r.left, r.right, r.cnt) for r in m.orderBy("rank").collect()]
    assert got == bpe_counted({r.word: r.freq for r in words.collect()}, 300)
    assert stats["passes"] <= 15 and stats["recounts"] == 1


def bpe_counted(freqs, n_merges, min_freq=2):
    """Sequential training with counts kept up to date word by word, the best pair from a heap."""
    import heapq
    words = [(list(w), f) for w, f in freqs.items()]
    counts, where = Counter(), {}
    for k, (sym, f) in enumerate(words):
        for pair in zip(sym, sym[1:]):
            counts[pair] += f
            where.setdefault(pair, set()).add(k)
    heap = [(-c, p) for p, c in counts.items()]
    heapq.heapify(heap)
    merges = []
    while len(merges) < n_merges and heap:
        top, (a, b) = heapq.heappop(heap)
        if counts[a, b] != -top:
            continue
        if -top < min_freq:
            break
        merges.append((a, b, -top))
        changed = set()
        for k in where.pop((a, b)):
            sym, f = words[k]
            new, i = [], 0
            while i < len(sym):
                hit = sym[i:i + 2] == [a, b]
                new.append(a + b if hit else sym[i])
                i += 1 + hit
            for pair in zip(sym, sym[1:]):
                counts[pair] -= f
                changed.add(pair)
            for pair in zip(new, new[1:]):
                counts[pair] += f
                changed.add(pair)
                where.setdefault(pair, set()).add(k)
            words[k] = new, f
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(heap, (-counts[pair], pair))
    return merges


@pytest.mark.parametrize("sf, part, merges, options, passes", [
    ("0.001", 4, 1500, {"chunk_words": 3000, "top_pairs": 4000, "guesses": 300, "guess_words": 4000}, 60),
    ("0.01", 1, 10_000, {}, 12)])
def test_bpe_of_documents_equals_sequential(spark, sf, part, merges, options, passes):
    """Small chunks, few leading pairs and few words to guess from; and ten thousand merges as they come."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    words = V.word_frequencies(docs.where(f"doc_id % {part} = 0"), "text").cache()
    want = bpe_counted({r.word: r.freq for r in words.collect()}, merges)
    stats = {}
    _, m = V.train_bpe(words, 2 + 256 + len(want), stats=stats, **options)
    got = [(r.left, r.right, r.cnt) for r in m.orderBy("rank").collect()]
    assert got[:len(want)] == want and len(want) == merges and stats["passes"] <= passes



def test_pretokenize_matches_python_regex(spark):
    import regex
    pat = V.GPT2_PATTERN.replace("(?U)", "")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.w for r in docs.select("doc_id", V.pretokenize("text").alias("w")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == regex.findall(pat, r.text), r.doc_id


def test_byte_level_map(spark):
    # the byte rule: visible Latin-1 bytes stand for themselves, the others for U+0100, U+0101, ... in byte order
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255) or b == 173]
    table = {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}
    words = [" hello", "Ünïcødé", "\t\n", "日本語", "a­b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(V.byte_level("w")).collect()]
    assert got == ["".join(table[b] for b in w.encode("utf-8")) for w in words]


def test_nfkc(spark):
    import unicodedata
    texts = ["ﬁne", "Ｆｕｌｌ", "x²", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(V.nfkc("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def wordpiece(word, vocab, unk="[UNK]"):
    if len(word) > 100:
        return [unk]
    out, start = [], 0
    while start < len(word):
        end, cur = len(word), None
        while start < end:
            sub = ("##" if start > 0 else "") + word[start:end]
            if sub in vocab:
                cur = sub
                break
            end -= 1
        if cur is None:
            return [unk]
        out.append(cur)
        start = end
    return out


def test_wordpiece_equals_greedy(spark):
    rnd = random.Random(7)
    vocab = {"a", "ab", "abc", "b", "##b", "##c", "##bc", "c", "##a", "d"}
    words = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(200)} | {"a" * 101})
    wdf = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(-1, None), (-2, "")], "i int, word string")
    vdf = spark.createDataFrame([(t, i) for i, t in enumerate(sorted(vocab))], "token string, id int")
    got = {r.i: r for r in L.wordpiece_encode(wdf, ["i"], "word", vdf, unk_id=99).collect()}
    ids = {t: i for i, t in enumerate(sorted(vocab))}
    for i, w in enumerate(words):
        assert got[i].tokens == wordpiece(w, vocab) and got[i].ids == [ids.get(t, 99) for t in got[i].tokens]
    assert got[-1].tokens == [] and got[-2].ids == []
    with pytest.raises(ValueError):
        L.wordpiece_encode(wdf, ["i"], "word", vdf, max_vocab=3)


@pytest.mark.parametrize("seed", range(30))
def test_piece_trie_equals_greedy(seed):
    rnd = random.Random(seed)
    part = lambda n: "".join(rnd.choice("ab#") for _ in range(rnd.randint(1, n)))
    vocab = {rnd.choice(["", "##"]) + part(5) for _ in range(rnd.randint(1, 25))}
    trie = L.piece_trie(vocab)
    for word in [part(12) for _ in range(300)]:
        assert L.longest_pieces(word, trie, 100, "?") == wordpiece(word, vocab, "?")


def test_pieces_of_a_trained_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trained, _ = V.train_bpe(V.word_frequencies(docs, "text"), 2 + 256 + 500)
    vocab = {r.token: r.id for r in L.piece_vocabulary(trained).collect()}
    assert sorted(vocab.values()) == list(range(len(vocab))) and vocab["[UNK]"] == 0
    assert {"a", "##a", "Z", "##Z", "0", "##9", ".", "##,"} <= set(vocab) and sum(len(t) > 3 for t in vocab) > 200
    frame = spark.createDataFrame(list(vocab.items()), "token string, id int")
    got = L.wordpiece_encode(docs, ["doc_id", "text"], "text", frame, unk_id=0, max_length=1015, tasks=4).collect()
    import regex
    split = regex.compile(r"[^\s\p{P}!-/:-@\[-`{-~]+|[\p{P}!-/:-@\[-`{-~]")
    plain = {w: wordpiece(w, vocab) for r in got for w in set(split.findall(r.text))}
    for r in got:
        want = [p for w in split.findall(r.text) for p in plain[w]]
        assert r.tokens == want[:1015] and r.ids == [vocab[t] for t in r.tokens]


def lcs(a, b):
    dp = [0] * (len(b) + 1)
    for x in a:
        prev = dp[:]
        for j in range(1, len(b) + 1):
            dp[j] = prev[j - 1] + 1 if b[j - 1] == x else max(prev[j], dp[j - 1])
    return dp[-1]


def test_lcs_and_char_overlap_random(spark):
    from tessera.functions.lcs_udf import lcs_length
    rnd = random.Random(3)
    rows = []
    for _ in range(200):
        a = [rnd.choice("xyzw") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("xyzw") for _ in range(rnd.randint(0, 12))]
        rows.append((a, b, "".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, sa string, sb string")
    got = df.select(lcs_length("a", "b").alias("l"), O.char_multiset_overlap("sa", "sb").alias("o")).collect()
    for (a, b, sa, sb), r in zip(rows, got):
        assert r.l == lcs(a, b)
        ca, cb = Counter(sa), Counter(sb)
        assert r.o == sum(min(ca[c], cb[c]) for c in ca)


def test_lcs_bits():
    from tessera.functions.lcs_udf import lcs_words
    rnd = random.Random(11)
    for _ in range(300):
        a = [rnd.choice("pqrs") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("pqrs") for _ in range(rnd.randint(0, 30))]
        assert lcs_words(a, b) == lcs(a, b)
