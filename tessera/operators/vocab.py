"""Vocabulary operators: G4 (extend), D13 (best adjacent pair), I6 (byte-level
BPE training), A12 helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def extend_vocabulary(vocab: DataFrame, tokens: list[str]) -> DataFrame:
    """G4 ``add_tokens``: tokens already present keep their id; new ones get
    ids after the highest, in list order. The added list is a parameter (its
    size is known), the vocabulary is bounded by its size parameter."""
    spark = vocab.sparkSession
    seen, add = set(), []
    for t in tokens:
        if t not in seen:
            seen.add(t)
            add.append((t, len(add)))
    new = spark.createDataFrame(add, "token string, ord int").join(vocab.select("token"), "token", "left_anti")
    top = vocab.agg(F.max("id")).first()[0]
    top = -1 if top is None else int(top)
    new = new.select("token", (F.lit(top) + F.row_number().over(Window.orderBy("ord"))).cast("int").alias("id"))
    return vocab.select("token", F.col("id").cast("int").alias("id")).unionByName(new)


# ---------------------------------------------------------------- pre-tokenisation
# The published GPT-2 pre-tokenisation pattern (fixed value; Java regex takes
# its look-ahead). (?U) makes \s Unicode-aware like the original engine.
GPT2_PATTERN = r"""(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The special tokens of the published vocabulary.
SPECIAL_TOKENS = ["<|endoftext|>", "<|padding|>"]


def nfkc(text):
    """H5 (see ``tessera.functions.unicode``)."""
    from tessera.functions.unicode import nfkc as _nfkc
    return _nfkc(text)


# ASCII, and what NFKC leaves as it is of Latin-1: none of it joins with a neighbour that is in here too.
NFKC_PLAIN = r"\x00-\x7F" + "".join(rf"\x{b:02X}" for b in range(128, 256) if unicodedata.is_normalized("NFKC", chr(b)))


def byte_level(word):
    """H6 second half: UTF-8 bytes of a word as printable characters."""
    w = F.col(word) if isinstance(word, str) else word
    other = [b for b in range(256) if _byte_char(b) != chr(b)]
    return F.translate(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), "".join(map(chr, other)), "".join(map(_byte_char, other)))


def pretokenize(text):
    """H6 first half: GPT-2 pattern matches, in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(GPT2_PATTERN), 0)


def word_frequencies(texts: DataFrame, text: str, normalize: bool = True, tasks: int | None = None) -> DataFrame:
    """(word, freq) of byte-level words: NFKC, pre-tokenise, count (partial
    aggregation: the table is the distinct words, not the corpus), then map
    the distinct words to byte-level characters. ``tasks`` deals the texts to
    that many tasks first, for inputs of few large splits."""
    t = texts.select(F.col(text).alias("t"))
    if tasks:
        t = t.repartition(tasks)
    if normalize:
        # text of these characters is already NFKC: only other texts go to Python, in the same scan
        plain = F.col("t").rlike(f"^[{NFKC_PLAIN}]*$")
        t = t.select(F.coalesce(nfkc(F.when(~plain, F.col("t"))), F.col("t")).alias("t"))
    w = t.select(F.explode(pretokenize("t")).alias("w")).where(F.length("w") > 0)
    freq = w.groupBy("w").agg(F.count(F.lit(1)).alias("freq"))
    return freq.select(byte_level("w").alias("word"), "freq").groupBy("word").agg(F.sum("freq").alias("freq"))


# ---------------------------------------------------------------- pairs and merges
def symbols_of(word) -> Column:
    """A word as space-separated symbols (byte-level characters never contain
    a space: byte 32 maps to U+0120)."""
    w = F.col(word) if isinstance(word, str) else word
    return F.array_join(F.split(w, ""), " ")


def pair_counts(words: DataFrame, syms: str = "syms", freq: str = "freq") -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency."""
    s = F.split(F.col(syms), " ")
    z = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("l"),
                     F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("r"))
    return (words.where(F.size(s) > 1).select(F.explode(z).alias("p"), freq)
            .groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right"))
            .agg(F.sum(freq).alias("cnt")))


# ---------------------------------------------------------------- training
#: Symbols are numbers: a character is its code point, a merged token follows.
FIRST_MERGED = 0x110000
CHUNK_WORDS = 50_000                                         # some 75 MB in a task, whatever the table
TRIAL_ROWS = 200_000                                         # changes a task holds before it hands them on


class _Chunk:
    """Symbols of a chunk of words as linked arrays, with an index from a pair
    to its places, so a merge touches the words that hold its pair only."""

    def __init__(self, symbols, lengths, freqs):
        import numpy as np
        n = len(symbols)
        ends = np.cumsum(lengths)
        self.end = n                                         # stands for "nothing" on either side of a word
        self.symbol = np.append(symbols, -1).astype(np.int64)
        self.freq = np.append(np.repeat(freqs, lengths), 0)
        self.next = np.append(np.arange(1, n + 1), n)
        self.before = np.append(np.arange(-1, n - 1), n)
        self.next[ends - 1] = n
        self.before[ends - lengths] = n
        self.lengths, self.freqs, self.first = lengths, freqs, ends - lengths
        self.index()

    def index(self) -> None:
        import numpy as np
        places = np.flatnonzero((self.symbol[:-1] >= 0) & (self.next[:-1] < self.end))
        codes = self.codes(places)
        order = np.argsort(codes, kind="stable")
        self.sorted_codes, self.sorted_places = codes[order], places[order]
        self.made: dict[int, list] = {}                      # token -> (codes, places) of the pairs it came into

    def codes(self, places):
        return self.symbol[places] << 32 | self.symbol[self.next[places]]

    def totals(self):
        """Codes and weighted counts of all pairs."""
        import numpy as np
        codes, starts = np.unique(self.sorted_codes, return_index=True)
        return codes, np.add.reduceat(self.freq[self.sorted_places], starts) if len(codes) else starts

    def places(self, a: int, b: int):
        import numpy as np
        code = a << 32 | b
        found = []
        for codes, places in [(self.sorted_codes, self.sorted_places), *self.made.get(a, ()), *(self.made.get(b, ()) if a != b else ())]:
            lo, hi = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            if lo < hi:
                found.append(places[lo:hi])
        if not found:
            return None
        p = np.sort(found[0]) if len(found) == 1 else np.unique(np.concatenate(found))
        p = p[(self.symbol[p] == a) & (self.symbol[self.next[p]] == b)]
        if a == b and len(p) > 1:                            # left to right: every other one of a run
            at = np.arange(len(p))
            start = np.append(True, self.next[p[:-1]] != p[1:])
            p = p[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]
        return p if len(p) else None

    def merge(self, a: int, b: int, token: int):
        """Make ``token`` of every ``a b``; codes and changes of the pairs that
        went and came, or None."""
        import numpy as np
        p = self.places(a, b)
        if p is None:
            return None
        q = self.next[p]
        left, right = self.before[p], self.next[q]
        gone = np.unique(np.concatenate([left[left < self.end], p, q[right < self.end]]))
        gone_codes = self.codes(gone)
        self.symbol[p], self.symbol[q] = token, -2
        self.next[p] = right
        self.before[right] = p
        self.before[self.end] = self.end
        came = np.unique(np.concatenate([left[(left < self.end) & (self.symbol[left] >= 0)], p[right < self.end]]))
        codes = self.codes(came)
        order = np.argsort(codes, kind="stable")
        self.made.setdefault(token, []).append((codes[order], came[order]))
        return np.concatenate([gone_codes, codes]), np.concatenate([-self.freq[gone], self.freq[came]])

    def change(self, a: int, b: int, token: int):
        """``merge``, with the distinct codes of the changed pairs and their sums."""
        import numpy as np
        out = self.merge(a, b, token)
        if out is None:
            return None
        codes, where = np.unique(out[0], return_inverse=True)
        sums = np.zeros(len(codes), np.int64)
        np.add.at(sums, where, out[1])
        return codes, sums

    def copy(self) -> _Chunk:
        import copy
        other = copy.copy(self)
        other.symbol, other.next, other.before = self.symbol.copy(), self.next.copy(), self.before.copy()
        other.made = {token: list(found) for token, found in self.made.items()}
        return other

    def open_words(self) -> int:
        """Words that still have a pair."""
        import numpy as np
        return int((np.add.reduceat(self.symbol[:-1] >= 0, self.first, dtype=np.int64) > 1).sum()) if len(self.first) else 0

    def packed(self) -> dict:
        """The words as they are now."""
        import numpy as np
        alive = self.symbol[:-1] >= 0
        lengths = np.add.reduceat(alive, self.first) if len(self.first) else self.lengths
        return {"symbols": self.symbol[:-1][alive].astype("<i4").tobytes(), "lengths": lengths.astype("<i4").tobytes(),
                "freqs": self.freqs.astype("<i8").tobytes()}


_CHUNKS = "symbols binary, lengths binary, freqs binary"


def _word_chunks(words: DataFrame, chunk_words: int) -> DataFrame:
    """(word, freq) -> rows of up to ``chunk_words`` words as packed arrays."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        held, size = [], 0

        def emit():
            texts = [w for b in held for w in b.column(0).to_pylist()]
            freqs = np.concatenate([b.column(1).to_numpy() for b in held])
            lengths = np.asarray([len(w) for w in texts], "<i4")
            return pa.RecordBatch.from_pydict({"symbols": ["".join(texts).encode("utf-32-le")], "lengths": [lengths.tobytes()],
                                               "freqs": [freqs.astype("<i8").tobytes()]})
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk_words:
                yield emit()
                held, size = [], 0
        if size:
            yield emit()
    return words.mapInArrow(run, _CHUNKS)


#: A step no merge has, and the length from which a word is merged with an index from pairs to places.
NEVER = 0x7FFFFFFF
LONG_WORD = 1_000


class _Steps:
    """Merges in order, each pair once, to look up at many places at once."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        import numpy as np
        a, b, self.tokens = np.asarray(merges, np.int64).reshape(-1, 3).T
        codes = a << 32 | b
        self.order = np.argsort(codes).astype(np.int32)
        self.codes = codes[self.order]
        self.size = int(max(a.max(), b.max())) + 1
        self.left, self.right = np.zeros(self.size + 1, bool), np.zeros(self.size + 1, bool)
        self.left[a], self.right[b] = True, True

    def of(self, left, right):
        """The step that merges each pair, or ``NEVER``."""
        import numpy as np
        found = np.full(len(left), NEVER, np.int32)
        at = np.flatnonzero(self.left[np.minimum(left, self.size)] & self.right[np.minimum(right, self.size)])
        codes = left[at].astype(np.int64) << 32 | right[at]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        hit = self.codes[place] == codes
        found[at[hit]] = self.order[place[hit]]
        return found


def _runs(merges):
    """(first step, merges) such that no pair comes twice in one of them."""
    lo, seen = 0, set()
    for k, (a, b, _) in enumerate(merges):
        if (a, b) in seen:
            yield lo, merges[lo:k]
            lo, seen = k, set()
        seen.add((a, b))
    if lo < len(merges):
        yield lo, merges[lo:]


def _summed(step, code, change):
    """Changes summed by step and code, in that order."""
    import numpy as np
    order = np.lexsort((code, step))
    step, code = step[order], code[order]
    starts = np.flatnonzero(np.append(True, (step[1:] != step[:-1]) | (code[1:] != code[:-1])))
    sums = np.add.reduceat(change[order], starts)
    kept = sums != 0
    return step[starts][kept], code[starts][kept], sums[kept]


class _Block:
    """The words of a chunk, to which merges are applied in order: in a round
    each word takes the earliest step that it holds, and only words that hold
    one are looked at, so a pass costs the symbols once and not the merges.
    Words of more than ``LONG_WORD`` symbols are merged step by step."""

    def __init__(self, symbols, lengths, freqs):
        import numpy as np
        long = lengths > LONG_WORD
        self.long = None
        if long.any():
            far = np.repeat(long, lengths)
            self.long = _Chunk(symbols[far], lengths[long], freqs[long])
            symbols, lengths, freqs = symbols[~far], lengths[~long], freqs[~long]
        self.symbols, self.freqs = symbols.astype(np.int32), freqs
        self.word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)

    def apply(self, merges, report: bool = False):
        """``merges`` one after another; with ``report`` (step, code, change) of the pairs' counts."""
        import numpy as np
        out = []
        for first, run in _runs(merges):
            out += [(step + first, code, change) for step, code, change in self._rounds(_Steps(run), report)]
        if self.long is not None:
            for step, (a, b, token) in enumerate(merges):
                changed = self.long.change(a, b, token) if report else self.long.merge(a, b, token)
                if report and changed is not None:
                    out.append((np.full(len(changed[0]), step, np.int32), *changed))
            if merges and not report:
                self.long.index()
        return _summed(*(np.concatenate(x) for x in zip(*out))) if out else None

    def _rounds(self, steps: _Steps, report: bool) -> list:
        import numpy as np
        symbols, word, freqs, changes = self.symbols, self.word, self.freqs, []
        if not len(symbols):
            return changes

        def inside():                                        # places that have a next one in their word
            return np.append(word[:-1] == word[1:], False)

        def change(at, sign: int) -> None:
            changes.append((now[at], symbols[at].astype(np.int64) << 32 | symbols[at + 1], sign * freqs[word[at]]))

        step = np.append(steps.of(symbols[:-1], symbols[1:]), NEVER).astype(np.int32)
        step[~inside()] = NEVER
        holds = np.zeros(len(freqs), bool)
        holds[word[step < NEVER]] = True
        busy = holds[word]
        rest = [(symbols[~busy], word[~busy])]
        symbols, word, step = symbols[busy], word[busy], step[busy]
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            now = np.repeat(np.minimum.reduceat(step, first), np.diff(np.append(first, len(word))))
            busy = now < NEVER
            if not busy.all():
                rest.append((symbols[~busy], word[~busy]))
                symbols, word, step, now = symbols[busy], word[busy], step[busy], now[busy]
                if not len(symbols):
                    break
            hit = step == now
            if (hit[1:] & hit[:-1]).any():                   # left to right: every other one of a run
                at = np.arange(len(hit))
                start = hit & ~np.append(False, hit[:-1])
                hit &= (at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0
            places = np.flatnonzero(hit)
            if report:
                gone = hit.copy()
                gone[places[places > 0] - 1] = True
                gone[places + 1] = True
                change(np.flatnonzero(gone & inside()), -1)
            symbols[places] = steps.tokens[now[places]]
            keep = np.ones(len(hit), bool)
            keep[places + 1] = False
            symbols, word, step, now, hit = symbols[keep], word[keep], step[keep], now[keep], hit[keep]
            places = np.flatnonzero(hit)
            hit[places[places > 0] - 1] = True
            step[hit] = NEVER
            came = np.flatnonzero(hit & inside())
            if report:
                change(came, 1)
            found = steps.of(symbols[came], symbols[came + 1])
            step[came] = np.where(found > now[came], found, NEVER)       # a step that is over does not come again
        self.symbols, self.word = (np.concatenate(x) for x in zip(*rest))
        return changes

    def totals(self):
        """Codes and weighted counts of all pairs."""
        import numpy as np
        at = np.flatnonzero(self.word[:-1] == self.word[1:])
        codes, counts = self.symbols[at].astype(np.int64) << 32 | self.symbols[at + 1], self.freqs[self.word[at]]
        if self.long is not None:
            codes, counts = (np.concatenate(x) for x in zip((codes, counts), self.long.totals()))
        return _summed(np.zeros(len(codes), np.int32), codes, counts)[1:] if len(codes) else (codes, counts)

    def words(self):
        """Symbols, lengths and counts of the words that still have a pair."""
        import numpy as np
        first = np.flatnonzero(np.append(True, self.word[1:] != self.word[:-1])) if len(self.word) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(first, len(self.word)))
        parts = [(self.symbols, lengths, self.freqs[self.word[first]])]
        if self.long is not None:
            packed = self.long.packed()
            parts.append(tuple(np.frombuffer(packed[c], t) for c, t in (("symbols", "<i4"), ("lengths", "<i4"), ("freqs", "<i8"))))
        symbols, lengths, freqs = (np.concatenate(x) for x in zip(*parts))
        kept = lengths > 1
        return symbols[np.repeat(kept, lengths)], lengths[kept], freqs[kept]


def _over_chunks(chunks: DataFrame, merges: list[tuple[int, int, int]], work, schema: str) -> DataFrame:
    """``work(block)`` (record batches) on every chunk after ``merges``."""
    def run(batches):
        import numpy as np
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = _Block(np.frombuffer(row["symbols"], "<i4"), np.frombuffer(row["lengths"], "<i4").astype(np.int64),
                               np.frombuffer(row["freqs"], "<i8"))
                block.apply(merges)
                yield from work(block)
    return chunks.mapInArrow(run, schema)


def _merged_chunks(chunks: DataFrame, merges) -> DataFrame:
    """The chunks after ``merges``; words that have become one symbol are done and left out."""
    def work(block):
        import pyarrow as pa
        symbols, lengths, freqs = block.words()
        if len(lengths):
            yield pa.RecordBatch.from_pylist([{"symbols": symbols.astype("<i4").tobytes(), "lengths": lengths.astype("<i4").tobytes(),
                                               "freqs": freqs.astype("<i8").tobytes()}])
    return _over_chunks(chunks, merges, work, _CHUNKS)


def _chunk_pairs(chunks: DataFrame, merges) -> DataFrame:
    """(code, cnt) of every pair."""
    def work(block):
        import pyarrow as pa
        codes, counts = block.totals()
        for lo in range(0, len(codes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[lo:lo + 50_000]), pa.array(counts[lo:lo + 50_000])], names=["code", "n"])
    return _over_chunks(chunks, merges, work, "code long, n long").groupBy("code").agg(F.sum("n").alias("cnt"))


def _trial(chunks: DataFrame, merges, tried: list[tuple[int, int, int]]) -> DataFrame:
    """How each of ``tried``, one after another, changes the pairs' counts: (step, code, change)."""
    def work(block):
        import pyarrow as pa
        changes = block.apply(tried, report=True)
        for lo in range(0, len(changes[0]) if changes else 0, TRIAL_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + TRIAL_ROWS]) for x in changes], names=["step", "code", "change"])
    return (_over_chunks(chunks, merges, work, "step int, code long, change long")
            .groupBy("step", "code").agg(F.sum("change").alias("change")).where("change <> 0"))


def _sample(chunks: DataFrame, words: int) -> _Chunk:
    """The most frequent ``words`` words that still have a pair."""
    def work(block):
        import numpy as np
        import pyarrow as pa
        symbols, lengths, freqs = block.words()
        ends = np.append(0, np.cumsum(lengths)).astype("<i4") * 4
        yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(lengths), [
            None, pa.py_buffer(ends), pa.py_buffer(symbols.astype("<i4").tobytes())]), pa.array(freqs)], names=["symbols", "freq"])
    import numpy as np
    found = _over_chunks(chunks, [], work, "symbols binary, freq long").orderBy(F.desc("freq"), "symbols").limit(words).toArrow()
    rows = found.column("symbols").to_pylist()
    return _Chunk(np.frombuffer(b"".join(rows), "<i4"), np.asarray([len(r) // 4 for r in rows], np.int64),
                  found.column("freq").to_numpy())


class _Leading:
    """Exact counts of the leading pairs on the driver, down to the order key
    ``cut`` (count, then the pair's strings). Pairs behind it are left out: a
    pair's count rises only when a merge makes one of its symbols, and pairs
    that come before the cut then are taken in."""

    def __init__(self, rows, text, cut, least: int = 1, most: int = 200_000):
        import heapq
        self.text, self.cut, self.least, self.most = text, cut, least, most
        self.count: dict[int, int] = {}
        self.heap: list[tuple] = []
        for code, n in rows:
            self._put(code, n)
        heapq.heapify(self.heap)

    def key(self, code: int, n: int) -> tuple:
        return -n, self.text(code >> 32), self.text(code & 0xFFFFFFFF), code

    def _put(self, code: int, n: int) -> tuple:
        self.count[code] = n
        self.heap.append(self.key(code, n))
        return self.heap[-1]

    def best(self):
        """(code, count) of the next merge; None if that is not certain."""
        import heapq
        while self.heap:
            top = self.heap[0]
            if self.count.get(top[3]) == -top[0]:
                return (top[3], -top[0]) if self.cut is None or top[:3] <= self.cut else None
            heapq.heappop(self.heap)
        return None

    def apply(self, codes, changes, token: int) -> None:
        import heapq
        for code, change in zip(codes, changes):
            a, b = code >> 32, code & 0xFFFFFFFF
            if code in self.count or a == token or b == token:
                now = self.count.get(code, 0) + change
                if now >= self.least and (self.cut is None or self.key(code, now)[:3] <= self.cut):
                    self._put(code, now)
                    heapq.heappush(self.heap, self.heap.pop())
                else:
                    self.count.pop(code, None)
        if len(self.count) > 2 * self.most:
            self._shorten()

    def _shorten(self) -> None:
        """Keep the ``most`` first pairs, the last of them as the new cut."""
        import heapq
        rows = heapq.nsmallest(self.most, (self.key(code, n) for code, n in self.count.items()))
        self.heap, self.cut = rows, rows[-1][:3]             # sorted, so a heap
        self.count = {code: -n for n, _, _, code in rows}

    def guess(self, steps: int, least: int, name, sample: _Chunk, told: dict, against: dict) -> list[tuple[int, int, int]]:
        """Likely next merges (a, b, token): the greedy rule on these counts,
        carried on by what each merge changed when it was last tried (``told``:
        codes and changes by pair) or, for others, changes in ``sample`` (which
        it uses up), scaled to the pair's count. Two merges that overlap take
        the same places from each other in either order, so one picked before
        a merge that it was tried after lowers that one by what it lost to it
        (``against``: by pair, the pairs tried before it and what they took).
        ``name(a, b)`` numbers a merge's token."""
        import heapq
        import numpy as np
        if len(self.heap) > 2 * len(self.count):
            self.heap = [self.key(code, n) for code, n in self.count.items()]
            heapq.heapify(self.heap)
        heap = self.heap.copy()
        counts = np.fromiter(self.count.values(), np.int64, len(self.count))
        floor = max(least, int(np.partition(counts, -2 * steps)[-2 * steps]) // 2) if len(counts) > 2 * steps else least
        moved: dict[int, int] = {}                           # counts that the guesses have changed
        out, taken = [], set()
        while heap and len(out) < steps:
            n, _, _, code = heapq.heappop(heap)
            if code in taken or moved.get(code, self.count.get(code, 0)) != -n or -n < least:
                continue
            taken.add(code)
            a, b = code >> 32, code & 0xFFFFFFFF
            token = name(a, b)
            out.append((a, b, token))
            for c, change in against.get(code, ()):
                if c not in taken:
                    moved[c] = now = moved.get(c, self.count.get(c, 0)) + change
                    if now >= floor:
                        heapq.heappush(heap, self.key(c, now))
            if code in told:
                sample.merge(a, b, token)
                codes, changes = told[code]
            else:
                changed = sample.change(a, b, token)
                if changed is None:
                    moved[code] = 0
                    continue
                codes, changes = changed
                held = -changes[codes == code][0]
                changes = (changes * (-n / held)).round().astype("int64")
            for c, change in zip(codes.tolist(), changes.tolist()):
                moved[c] = now = moved.get(c, self.count.get(c, 0)) + change
                if now >= floor and c not in taken:
                    heapq.heappush(heap, self.key(c, now))
            moved[code] = 0
        return out


def train_bpe(words: DataFrame, vocab_size: int, min_frequency: int = 2,
              special_tokens: list[str] = SPECIAL_TOKENS, top_pairs: int = 200_000,
              guesses: int = 8192, checkpoint_every: int = 4, alphabet: list[str] | None = None,
              chunk_words: int = CHUNK_WORDS, guess_words: int = 500_000, stats: dict | None = None):
    """Byte-level BPE over a (word, freq) table.

    Vocabulary: special tokens, then the alphabet (all 256 byte characters
    unless given) in code-point order, then merged tokens in merge order,
    until ``vocab_size`` or until no pair counts ``min_frequency``. Ties go to
    the smaller (left, right).

    The distinct words are kept as packed integer arrays in written chunks. A
    pass tries up to ``guesses`` likely merges one after another on every chunk
    and returns, per step, how every pair's count changes (summed in the tasks,
    then by Spark). The merges tried are the greedy rule's on the exact counts,
    carried on over the ``guess_words`` most frequent words, which the driver
    holds for that alone: a wrong guess costs time and never a merge. With these the driver follows the exact counts of the
    leading ``top_pairs`` pairs and takes what the greedy rule picks, as long
    as that is among the guesses. A pick may pass guesses tried before it that
    are not picked yet if the two do not touch: the change of neither names the
    other's pair or token, so each changes the same counts in either order.
    Pairs are counted anew only when the leading ones run out, and the words
    are written every ``checkpoint_every`` passes. The driver holds the leading
    pairs, the guessing words, a pass's changes and the merge list. ``stats`` receives the number
    of passes. Returns (vocab DataFrame, merges DataFrame).
    """
    import numpy as np
    spark = words.sparkSession
    if alphabet is None:
        alphabet = sorted({_byte_char(b) for b in range(256)})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))      # the passes are CPU work: keep them spread
    # written before the filter: Spark would push it below the aggregation that makes the words
    words = materialize(words.select("word", F.col("freq").cast("long").alias("freq")).repartition(tasks, "word"),
                        "bpe-frequencies").where(F.length("word") > 1)
    chunks = materialize(_word_chunks(words, chunk_words), "bpe-words")
    tokens = list(dict.fromkeys(list(special_tokens) + list(alphabet)))
    known = set(tokens)
    merged: list[str] = []                                   # strings of the merged numbers
    number: dict[str, int] = {}

    def text(symbol: int) -> str:
        return chr(symbol) if symbol < FIRST_MERGED else merged[symbol - FIRST_MERGED]

    def name(a: int, b: int) -> int:
        made = text(a) + text(b)
        if made not in number:
            number[made] = FIRST_MERGED + len(merged)
            merged.append(made)
        return number[made]

    def leading():
        names = spark.createDataFrame([(FIRST_MERGED + i, t) for i, t in enumerate(merged)], "id long, t string")
        counts = _chunk_pairs(chunks, pending).where(F.col("cnt") >= min_frequency)
        for side, symbol in (("l", F.shiftright("code", 32)), ("r", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)))):
            counts = counts.withColumn("id", symbol).join(F.broadcast(names), "id", "left").withColumn(       # at most the vocabulary
                side, F.coalesce("t", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))).drop("id", "t")
        rows = [(r["code"], r["cnt"]) for r in counts.orderBy(F.desc("cnt"), "l", "r").limit(top_pairs).select("code", "cnt").collect()]
        found = _Leading(rows, text, None, min_frequency, top_pairs)
        if len(rows) == top_pairs:
            found.cut = found.key(*rows[-1])[:3]
        return found

    sample = _sample(chunks, guess_words)
    pending: list[tuple[int, int, int]] = []                 # merges the written words do not have yet
    merges: list[tuple[str, str, int]] = []
    steps = min(guesses, 256)
    pairs, passes, recounts, finished = None, 0, 0, False
    told: dict[int, tuple] = {}                              # what guesses not picked yet changed when last tried,
    against: dict[int, list] = {}                            # and what each of them took from another's pair
    while len(tokens) < vocab_size and not finished:
        if pairs is None or pairs.best() is None:
            pairs, recounts = leading(), recounts + 1
            if pairs.best() is None:
                break
        tried = pairs.guess(min(steps, vocab_size - len(tokens) + 16), min_frequency, name, sample.copy(), told, against)
        trial = _trial(chunks, pending, tried).toArrow()
        step, code, change = (trial.column(c).to_numpy() for c in ("step", "code", "change"))
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(len(tried) + 1))
        deltas = [(code[order[i:j]], change[order[i:j]]) for i, j in zip(cuts, cuts[1:])]
        place = {a << 32 | b: k for k, (a, b, _) in enumerate(tried)}
        makers: dict[int, list[int]] = {}                    # by token, and by pair, the guesses that make or change it
        for j, (_, _, token) in enumerate(tried):
            makers.setdefault(token, []).append(j)
        changers: dict[int, list[tuple]] = {}
        hits = np.flatnonzero(np.isin(code, np.asarray(list(place), np.int64)))
        for c, j, n in zip(code[hits].tolist(), step[hits].tolist(), change[hits].tolist()):
            if j != place[c]:
                changers.setdefault(c, []).append((j, n))
        done, passes = {}, passes + 1                        # picked, in that order
        while True:
            best = pairs.best()
            if best is None:
                break
            if best[1] < min_frequency or len(tokens) >= vocab_size:
                finished = True
                break
            k = place.get(best[0])
            if k is None or k in done:
                break
            codes = deltas[k][0].tolist()
            touched = [j for c in codes for x in (c >> 32, c & 0xFFFFFFFF) for j in makers.get(x, ())]
            touched += [j for j, _ in changers.get(best[0], ())]
            if any(j < k and j not in done for j in touched):
                break                                        # it touches a guess that is not picked
            a, b, token = tried[k]
            made = merged[token - FIRST_MERGED]
            done[k] = True
            pending.append(tried[k])
            merges.append((text(a), text(b), best[1]))
            pairs.apply(codes, deltas[k][1].tolist(), token)
            if made in known:                                # pairs of a token made twice may have been left out
                pairs = None
                break
            known.add(made)
            tokens.append(made)
        told = {a << 32 | b: deltas[k] for k, (a, b, _) in enumerate(tried) if k not in done}
        against = {c: [(tried[j][0] << 32 | tried[j][1], n) for j, n in found if n < 0 and j not in done]
                   for c, found in changers.items() if c in told}
        for k in done:
            sample.merge(*tried[k])
        steps = min(guesses, max(1024, 4 * len(done)))
        if passes % checkpoint_every == 0 and pending:
            sample.index()
            chunks, pending = materialize(_merged_chunks(chunks, pending), "bpe-words"), []
            if len(sample.lengths) == guess_words and sample.open_words() < guess_words * 3 // 4:
                sample = _sample(chunks, guess_words)        # many words are done: others tell more
    if stats is not None:
        stats.update(passes=passes, recounts=recounts)
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")
    merge_df = spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(merges)],
                                     "rank int, left string, right string, cnt long")
    return vocab, merge_df


def _byte_char(b: int) -> str:
    if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
        return chr(b)
    if b <= 32:
        return chr(256 + b)
    if 127 <= b <= 160:
        return chr(b + 162)
    return chr(323)
