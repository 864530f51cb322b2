"""Spelling variants: words one edit apart, by a relational trie frontier.

**Words.** Each task counts the words of its texts in lots of ``HELD_WORDS``
distinct words, and Spark's partial aggregation adds the lots up before the
shuffle, where it may spill: a very frequent word costs no more than another,
and a task's Python holds one lot whatever its texts.

**Trie.** Every frequent word is a path of nodes, a node being the prefix that
leads to it; the edge table holds one row per node below another, with the
letters that continue from there. One edit leaves the first or the second half
of a word as it is. So there are two tries in the table, of the words (``>``)
and of the words reversed (``<``); in the first a word starts at the node of
its first half, in the second at that of its second half, and edits come after.

**Frontier.** A state is (word, node, rest of the word, edits), the position
being the word's length less the rest's. Level by level, states meet the edges
of their level and follow a letter, replace it, insert one or leave one out;
a state with an edit must follow letters only. A state goes on only if its new
node is a word and nothing is left, or continues with the next letter wanted.
Finished states with one edit are neighbours. An edit inside a run of equal
letters is made at the run's end alone. Fan-out is bounded by the alphabet;
there are at most ``TRIE_LENGTH`` levels.

**Very long words.** A run of ten thousand letters would need as many levels
and a node for each. Pairs of words of ``TRIE_LENGTH`` or more letters meet by
127-bit hashes of the word without one of its letters instead: two words that
agree without their letter at the same place differ in that letter, and a word
that is another without a letter is found by its own hash. Rows are linear in
the letters, and only neighbours meet.

Defined results: null texts have no words; a null identifier hashes as empty;
repeated rows count as often as they occur; an empty table gives no words.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stage

MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
#: One word in so many, chosen by a hash of document and word, loses a letter.
NOISE = 199
HELD_WORDS = 1 << 15
#: Letters up to which pairs are found in the trie (one more on one side).
TRIE_LENGTH = 48


# ---------------------------------------------------------------------- words

def _counted_lots(batches: Iterator, min_length: int, noise: int | None) -> Iterator:
    """``word, n`` batches of (identifier, text) batches, a lot at a time."""
    import zlib
    from collections import Counter
    from itertools import islice

    import pyarrow as pa
    letters = bytearray(b" " * 256)                           # Latin-1: letters stay, A-Z in lower case
    for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]:
        letters[c] = c
    for c in range(0x41, 0x5B):
        letters[c] = c + 32
    crc = zlib.crc32
    held: Counter = Counter()

    def emit():
        rows = ((w, n) for b, n in held.items() if n and len(w := b.decode()) >= min_length)
        while some := list(islice(rows, 10_000)):
            words, counts = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
        held.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = batch.slice(lo, 64)
            for ident, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if not text:
                    continue
                runs = text.encode("latin-1", "replace").translate(letters)
                if not runs.isascii():
                    runs = runs.decode("latin-1").encode()
                words = [w for w in runs.split() if len(w) >= min_length]
                held.update(words)
                if noise:
                    begin = crc(b"%s:" % str("" if ident is None else ident).encode())
                    for w in words:
                        h = crc(w, begin)
                        if not h % noise:
                            held[w] -= 1
                            whole = w.decode()
                            at = h % len(whole)
                            held[(whole[:at] + whole[at + 1:]).encode()] += 1
            if len(held) >= HELD_WORDS:
                yield from emit()
    yield from emit()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                noise: int | None = NOISE) -> DataFrame:
    """``word, n``: letter runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower
    case, of at least ``min_length`` code points; with ``noise``, after one
    run in so many has lost a letter."""
    def run(batches: Iterator) -> Iterator:
        return _counted_lots(batches, min_length, noise)

    parts = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# ----------------------------------------------------------------------- trie

def _paths(words: DataFrame) -> DataFrame:
    """``word, n, path, start``: both directions, ``start`` the depth of the
    half that stays as it is (a node's depth is its letters)."""
    half = F.floor(F.length("word") / 2).cast("int")
    ahead = F.struct(F.concat(F.lit(">"), "word").alias("path"), half.alias("start"))
    back = F.struct(F.concat(F.lit("<"), F.reverse("word")).alias("path"), (F.length("word") - half).alias("start"))
    return words.select("word", "n", F.inline(F.array(ahead, back)))


def trie_edges(paths: DataFrame, least_depth: int) -> DataFrame:
    """``depth, node, letter, is_word, next``: the edge from ``node`` (of
    ``depth`` letters) by ``letter``, whether a word ends below it, and the
    letters that continue there (at most the alphabet)."""
    prefixes = paths.select("path", F.explode(F.sequence(F.lit(least_depth + 1), F.length("path") - 1)).alias("d"))
    ends = prefixes.select("d", F.expr("substring(path, 1, d + 1)").alias("child"), F.expr("substring(path, d + 2, 1)").alias("then"))
    nodes = ends.groupBy("d", "child").agg(F.max(F.col("then") == "").alias("is_word"),
                                           F.array_join(F.collect_set("then"), "").alias("next"))
    return nodes.select((F.col("d") - 1).alias("depth"), F.expr("left(child, length(child) - 1)").alias("node"),
                        F.expr("right(child, 1)").alias("letter"), "is_word", "next")


def _advance(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States of one level and its edges -> ``word, n, node, rest, edits,
    found``; ``found`` marks a neighbour at ``node``."""
    first, second = F.substring("rest", 1, 1), F.substring("rest", 2, 1)
    follows = F.col("letter") == first
    met = states.join(edges, "node").filter((F.col("edits") == 0) | follows)
    tail, after = F.expr("substring(rest, 2)"), F.expr("substring(rest, 3)")

    def step(when, rest, edits, found):
        return F.when(when, F.struct(rest.alias("rest"), edits.cast("byte").alias("edits"), found.alias("found")))

    def edited(when, rest):
        done = F.length(rest) == 0
        goes_on = F.when(done, F.col("is_word")).otherwise(F.col("next").contains(F.substring(rest, 1, 1)))
        return step(when & goes_on, rest, F.lit(1), done)

    clean = F.col("edits") == 0
    steps = F.array(
        step(clean & follows, tail, F.lit(0), F.lit(False)),
        step(clean & follows & (F.length(tail) == 1) & F.col("is_word"), F.lit(""), F.lit(1), F.lit(True)),   # last letter left out
        edited(~clean & follows, tail),
        edited(clean & ~follows & (F.length("rest") > 0), tail),                                              # replaced
        edited(clean & ~follows, F.col("rest")),                                                              # inserted
        edited(clean & (first != second) & (F.col("letter") == second), after))                               # left out
    return (met.select("word", "n", F.concat("node", "letter").alias("node"), F.explode(F.array_compact(steps)).alias("s"))
            .select("word", "n", "node", "s.rest", "s.edits", "s.found"))


def _shortened(words: DataFrame) -> DataFrame:
    """``id, hash, place``: a row per word and letter left out (``place``), and
    one of the whole word (place -1)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        prime, base = (1 << 127) - 1, 0x3C6EF372FE94F82BA54FF53A5F1D36F1
        for batch in batches:
            for ident, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, before, power = len(word), [0], [1]
                for c in word:
                    before.append((before[-1] * base + ord(c)) % prime)
                    power.append(power[-1] * base % prime)
                hashes = [before[n]]
                for i in range(n):                            # the letters before i, then those after it
                    after = before[n] - before[i + 1] * power[n - i - 1]
                    hashes.append((before[i] * power[n - i - 1] + after) % prime)
                for lo in range(0, n + 1, 20_000):
                    some = [h.to_bytes(16, "little") for h in hashes[lo:lo + 20_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(some)), pa.array(some, pa.binary()),
                                                      pa.array(range(lo - 1, lo - 1 + len(some)), pa.int32())], names=["id", "hash", "place"])
    return words.select("id", "word").mapInArrow(run, "id binary, hash binary, place int")


def _near_long(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of very long words, both ways."""
    words = stage(words.withColumn("id", F.unhex(F.sha2("word", 256))), "long-words")
    short = stage(_shortened(words), "shortened")
    left, right = short.filter("place >= 0"), short.select(F.col("id").alias("other"), "hash", "place")
    replaced = left.join(right, ["hash", "place"]).filter("id <> other").select("id", "other")
    dropped = left.join(right.filter("place < 0").drop("place"), "hash").select("id", "other")
    pairs = replaced.unionByName(dropped).unionByName(dropped.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    return (pairs.join(words.select("id", "word"), "id")
            .join(words.select(F.col("id").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
            .select("word", "near", "near_n"))


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, trie_length: int = TRIE_LENGTH) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words exactly one inserted,
    deleted or replaced code point apart. ``words`` is a written table of
    distinct ``word, n``, each of at least ``min_length`` >= 4 code points."""
    size = F.length("word")
    pairs = _near_in_trie(words.filter(size <= trie_length + 1), min_length)
    long_words = words.filter(size >= trie_length)
    if not long_words.isEmpty():
        pairs = pairs.unionByName(_near_long(long_words))
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def _near_in_trie(words: DataFrame, min_length: int) -> DataFrame:
    least = min_length // 2
    paths = stage(_paths(words), "paths")
    edges = stage(trie_edges(paths, least).sortWithinPartitions("depth"), "edges")
    starts = paths.select("start", "word", "n", F.expr("left(path, start + 1)").alias("node"),
                          F.expr("substring(path, start + 2)").alias("rest"), F.lit(0).cast("byte").alias("edits"))
    longest = paths.agg(F.max(F.length("path"))).head()[0] or 0
    found = []
    states = None
    for depth in range(least, longest):
        here = starts.filter(F.col("start") == depth).drop("start")
        if states is not None:
            here = here.unionByName(states.filter(~F.col("found")).drop("found"))
        states = stage(_advance(here, edges.filter(F.col("depth") == depth).drop("depth")), "states")
        found.append(states.filter("found").select("word", "n", "node"))
    if not found:
        return words.limit(0).select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    other = F.expr("substring(node, 2)")
    # the relation is symmetric, so a pair is read from the found word's side, with the searching word's count
    return pairs.select(F.when(F.col("node").startswith(">"), other).otherwise(F.reverse(other)).alias("word"),
                        F.col("word").alias("near"), F.col("n").alias("near_n"))


# ---------------------------------------------------------------------- forms

def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form; counts grow along forms, so
    chains are short and pointers double in few rounds."""
    links = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        nearer = stage(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(links)
        links = nearer


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, ratio: int = FORM_RATIO, noise: int | None = NOISE) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every frequent word: its form
    is its most frequent near word (ties: smallest in code-point order) if that
    is at least ``ratio`` times as frequent."""
    words = stage(word_counts(docs, id_col, text_col, min_length, noise).filter(F.col("n") >= min_count), "words")
    best = near_words(words, min_length).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    rated = stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "rated")
    roots = _roots(rated.filter("form IS NOT NULL"))
    return rated.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
