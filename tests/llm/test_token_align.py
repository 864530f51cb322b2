"""Token alignment: fragments as a monoid, documents and counts against brute force."""
import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import pytest

from tessera.llm import token_align as ta

SMALL = "/root/testdata/sf0.001"


def whole_tokens(text):
    """Ids and byte ends of a whole text by the published tokenizers themselves."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    global _A, _B
    if "_A" not in globals():
        _A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        _A.encode_special_tokens = True
        _B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        base = [*range(33, 127), *range(161, 173), *range(174, 256)]
        globals()["_bytes"] = {chr(b): b for b in base} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in base)}
    full = " " + text
    a, b = _A.encode(full, add_special_tokens=False), _B.encode(text)
    bytes_a = [bytes(_bytes[c] for c in t) for t in a.tokens]
    bytes_b = [bytes.fromhex(p[3:5]) if len(p := _B.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("\u2581", " ").encode() for i in b]
    if not text or b"".join(bytes_a) != full.encode() or b"".join(bytes_b) != full.encode():
        return None
    ends = [list(np.cumsum([len(x) for x in y])) for y in (bytes_a, bytes_b)]
    return list(a.ids), ends[0], list(b), ends[1]


def brute(texts):
    links, rows = [], []
    for text in texts:
        found = whole_tokens(text or "") if text else None
        if not found:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        a, ea, b, eb = found
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        own = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            ga = [x for x, y in zip(a[i:], ea[i:]) if y <= e]
            gb = [x for x, y in zip(b[j:], eb[j:]) if y <= e]
            i, j = i + len(ga), j + len(gb)
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        rows.append((len(a), len(b), len(groups), ";".join(groups)))
        links.append(own)
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(n_a, n_b, n_g, len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), groups)
            for (n_a, n_b, n_g, groups), own in zip(rows, links)]


ODD = ["", None, "a", "a b", "word " * 7 + "end", " leading", "trailing ", "two  spaces here", "tab\tand\nline\n\nbreaks\r\n x", "\n", "\nfoo bar",
       " \nfoo", "foo\n bar", "foo \nbar", "x\u2581y", "<s> <|endoftext|> <0x41> </s> <unk> don't we'll", "\u00a0nbsp\u3000wide \u00a0 x",
       "na\u00efve caf\u00e9 \ufb01 \u00bd e\u0301", "\U0001f600 emoji\U0001f468\u200d\U0001f469 \u4e2d\u6587\u5b57\u7b26", "\x00\x1c a\x1c b \x85 c",
       "1234567890123 4.5e-7", "....!!!! ??? ,,,", "a" * 300, "\u0633\u0644\u0627\u0645 \u05e9\u05dc\u05d5\u05dd", "   ", "\t\t", "a   b    c     d"]


def result(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in ta.align_tokens(docs, **options).orderBy("doc_id").collect()]


def test_odd_texts_against_brute_force(spark):
    assert result(spark, ODD) == brute(ODD)


def test_long_documents_are_composed_in_a_tree(spark):
    """Pieces of 64 bytes: open prefixes and suffixes, several levels."""
    draw = random.Random(5)
    parts = [t for t in ODD if t]
    texts = [" ".join(draw.choice(parts) for _ in range(n)).replace("\u2581", "") for n in (3, 40, 200)] + ["x" * 3000, "\u2581" + "ab cd " * 90]
    want = brute(texts)
    assert result(spark, texts, chunk_bytes=64, block_bytes=100) == want
    assert result(spark, texts) == want


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    short = [t[:400] for t in texts]                          # the plain version compares all pairs of a text
    frame = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string").repartition(5)
    got = [tuple(r)[1:] for r in ta.align_tokens(frame, block_bytes=5000).orderBy("doc_id").collect()]
    assert got == brute(short)
    digests = ta.align_tokens(docs, write_groups=lambda g: hashlib.sha256(g.encode()).hexdigest())
    for r in digests.collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups and r.count_sum >= r.n_links >= r.n_best
        assert (r.n_a > 0) == (len(r.groups) == 64)


def random_run(draw, size):
    def ends():
        cuts = sorted(draw.sample(range(1, size), draw.randint(0, size - 1))) + [size]
        return np.asarray(cuts, np.int64)
    ea, eb = ends(), ends()
    ids = lambda e: np.asarray([draw.randint(0, 9) for _ in e], np.int64)
    return ta.Tokens(ids(ea), ea, ids(eb), eb)


def same(x, y):
    if isinstance(x, tuple):
        return len(x) == len(y) and all(map(same, x, y))
    return np.array_equal(x, y)


@pytest.mark.parametrize("seed", range(40))
def test_fragments_compose_associatively(seed):
    draw = random.Random(seed)
    size = draw.randint(2, 40)
    run = random_run(draw, size)
    # A and B may also be cut at different places: the parts' ends then cross
    cuts_a = [0, *sorted(draw.choices(range(size + 1), k=4)), size]
    cuts_b = [0, *sorted(draw.choices(range(size + 1), k=4)), size]
    parts = []
    for (i, j), (k, m) in zip(zip(cuts_a, cuts_a[1:]), zip(cuts_b, cuts_b[1:])):
        a, b = run.cut(i or None, j), run.cut(k or None, m)
        parts.append(ta.fragment(ta.Tokens(a.a, a.a_ends, b.b, b.b_ends)))
    left = reduce(ta.combine, parts)
    right = reduce(lambda g, f: ta.combine(f, g), reversed(parts))
    at = draw.randint(1, len(parts) - 1)
    mixed = ta.combine(reduce(ta.combine, parts[:at]), reduce(ta.combine, parts[at:]))
    assert same(left, right) and same(left, mixed) and same(left, ta.fragment(run))
    assert same(ta.document(left), ta.close(run))


def test_edges(spark):
    assert result(spark, []) == []
    assert result(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
    rows = [(None, "same text"), (1, "same text"), (1, "same text")]
    docs = spark.createDataFrame([(*r, "x", 1, [2]) for r in rows], "doc_id long, text string, block string, pair int, units array<int>")
    got = ta.align_tokens(docs).collect()
    assert len(got) == 3 and len({tuple(r)[1:] for r in got}) == 1 and sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]


def test_hot_text_sends_a_row_a_pair_and_block(spark):
    docs = spark.range(0, 2000, 1, 4).selectExpr("id AS doc_id", "'the same words again' AS text")
    got = ta.align_tokens(docs).collect()
    assert len(got) == 2000 and all(r.n_best > 0 and r.count_sum == 2000 * r.n_links for r in got)
