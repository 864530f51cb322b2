"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 majority bits of the XXH64 hashes of word shingles.

Linking all pairs within ``max_bits`` = t: the 64 bits are cut into three
blocks of 21, 21 and 22 bits. Each block, set into 23 bits, is covered by the
perfect binary Golay code: every word lies within R = 3 bits of exactly one of
4,096 code words. An anchor is a pair of code words of two blocks. Some two
blocks of a linked pair differ in at most floor(2 t / 3) = t' bits together, so
a fingerprint is at home at the anchor of its own two words and is replicated
to every anchor that t' bits beyond the radius can explain: at the home anchor
of one partner the other is present too. There full 64-bit distances are
compared. With t = 4 that is 183 rows a fingerprint and 24 bits of selectivity.

``width`` = 1 takes one block an anchor (12 bits, 19 rows a fingerprint); the
links found are the same, for some 350 times as many comparisons.

An anchor whose homes x replicas exceed ``PAIR_WORK`` comparisons is dealt
over several tasks: its replicas by hash, its homes copied to each. The counts
that decide this are taken by the anchor's first word, then by anchor where
that leaves the question open; the crowded anchors are a written table, which
Spark broadcasts or shuffles by its size. Equal fingerprints are one row from
the start, so copies cost nothing, and an anchor returns a spanning forest of
its links, never its pairs.

Defined results: null and empty texts have fingerprint zero, which links like
any other; fewer words than a shingle give one shingle of all words; repeated
identifiers are one document per row; a null identifier is ignored as a
component's name unless all are null. ``one_per_group`` returns exactly one
row of every component, whatever identifiers repeat or are null in others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, stage, text_or_empty
from tessera.llm.components import component_roots, merge_labels

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: The generator polynomial of the binary Golay code and its sizes.
GOLAY_POLYNOMIAL, GOLAY_LENGTH, GOLAY_CHECK_BITS, GOLAY_RADIUS = 0xC75, 23, 11, 3
BLOCKS = ((0, 21), (21, 21), (42, 22))                       # (first bit, bits)
WIDTH = 2                                                    # code words of an anchor
PAIR_WORK = 1 << 27                                          # comparisons of one task's group


def text_fingerprint(data: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text (unsigned)."""
    import numpy as np
    import xxhash
    words = data.lower().split()                             # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    k = min(words_per_shingle, len(words))
    stops = ends[k - 1:]
    starts = np.concatenate(([0], ends[:len(words) - k] + 1))
    digest = xxhash.xxh64_intdigest
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], HASH_SEED) for a, b in zip(starts.tolist(), stops.tolist())),
                         np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[lo:lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((ones * 2 > len(hashes)).astype(np.uint8), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = SHINGLE_WORDS, digest: Column | None = None) -> DataFrame:
    """``id, fp`` (and ``digest``) per row; the 64 bits of ``fp`` are a signed long."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    more = [] if digest is None else [digest.alias("digest")]
    if more:
        schema = schema.add("digest", T.StringType())

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((text_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words_per_shingle)
                                 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                                             names=[f.name for f in schema])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *more).mapInArrow(run, schema)


def golay_tables():
    """(syndrome of each 23-bit half word, coset members of weight <= limit by syndrome) builders."""
    import numpy as np

    def remainder(word: int) -> int:
        for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECK_BITS - 1, -1):
            if word >> bit & 1:
                word ^= GOLAY_POLYNOMIAL << (bit - GOLAY_CHECK_BITS)
        return word

    unit = [remainder(1 << i) for i in range(GOLAY_LENGTH)]
    syndromes = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for half, table in enumerate(syndromes):
        for i in range(12 - half):
            table ^= np.where(np.arange(len(table)) >> i & 1, unit[i + 12 * half], 0).astype(np.int32)
    return syndromes


def _errors_by_syndrome(reach: int):
    """Error patterns of weight <= reach sorted by syndrome then weight, with
    the first index of every syndrome."""
    from itertools import combinations

    import numpy as np
    low, high = golay_tables()
    patterns = np.array([sum(1 << i for i in c) for w in range(reach + 1) for c in combinations(range(GOLAY_LENGTH), w)],
                        np.int64)
    syndrome = low[patterns & 4095] ^ high[patterns >> 12]
    order = np.lexsort((np.bitwise_count(patterns), syndrome))
    first = np.searchsorted(syndrome[order], np.arange((1 << GOLAY_CHECK_BITS) + 1))
    return patterns[order], first


def anchored(distinct: DataFrame, max_bits: int = MAX_BITS, width: int = WIDTH) -> DataFrame:
    """``anchor, fp, home``: each fingerprint at every anchor within reach.
    An anchor is ``width`` code words of as many blocks."""
    from itertools import combinations
    beyond = max_bits * width // len(BLOCKS)                 # differing bits that some ``width`` blocks share at most

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        low, high = golay_tables()
        patterns, first = _errors_by_syndrome(GOLAY_RADIUS + beyond)

        def words_near(part, block):
            """(row, code word, bits beyond the radius) of one block."""
            shift, bits = BLOCKS[block]
            word = (part >> np.uint64(shift)).astype(np.int64) & ((1 << bits) - 1)
            syndrome = low[word & 4095] ^ high[word >> 12]
            n = first[syndrome + 1] - first[syndrome]
            row = np.repeat(np.arange(len(part)), n)
            error = patterns[first[syndrome][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            return row, word[row] ^ error, np.maximum(np.bitwise_count(error).astype(np.int64) - GOLAY_RADIUS, 0)

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fp), 4096):
                part = fp[lo:lo + 4096]
                near = [words_near(part, block) for block in range(len(BLOCKS))]
                for number, blocks in enumerate(combinations(range(len(BLOCKS)), width)):
                    row, anchor, excess = near[blocks[0]]
                    for block in blocks[1:]:
                        more_row, more_word, more_excess = near[block]
                        start = np.searchsorted(more_row, np.arange(len(part) + 1))
                        n = (start[1:] - start[:-1])[row]
                        left = np.repeat(np.arange(len(row)), n)
                        right = start[row[left]] + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                        both = excess[left] + more_excess[right]
                        fine = both <= beyond
                        left, right = left[fine], right[fine]
                        row, anchor, excess = row[left], anchor[left] << GOLAY_LENGTH | more_word[right], both[fine]
                    for at in range(0, len(row), 1 << 17):
                        cut = slice(at, at + (1 << 17))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor[cut] | number << (GOLAY_LENGTH * width)), pa.array(part[row[cut]].view(np.int64)),
                             pa.array(excess[cut] == 0)], names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(fp, home, start, max_bits: int):
    """Spanning forest (a, b) of the links inside groups of rows: distinct
    fingerprints, whether each is at home, and the first row of each group."""
    import numpy as np
    size = np.diff(np.append(start, len(fp)))
    of_row = np.repeat(np.arange(len(start)), size)
    homes = np.flatnonzero(home)
    n = size[of_row[homes]]
    past = np.cumsum(n)
    label = np.arange(len(fp))
    lo = 0
    while lo < len(homes):                                   # as many homes as compare a million rows, one at least
        hi = max(lo + 1, int(np.searchsorted(past, past[lo] - n[lo] + (1 << 20), "right")))
        u = np.repeat(homes[lo:hi], n[lo:hi])
        first = past[lo:hi] - n[lo:hi] - (past[lo] - n[lo])
        v = np.arange(len(u)) + np.repeat(start[of_row[homes[lo:hi]]] - first, n[lo:hi])
        near = np.bitwise_count(fp[u] ^ fp[v]) <= max_bits
        merge_labels(label, u[near], v[near])
        lo = hi
    child = np.flatnonzero(label != np.arange(len(fp)))
    return fp[child], fp[label[child]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, width: int = WIDTH) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints (distinct rows of
    ``fp``) joined by chains of distances <= ``max_bits``."""
    # a row becomes many: as many tasks as a shuffle has, not as few as the small table's files
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = anchored(distinct.select("fp").repartition(tasks, "fp"), max_bits, width)
    area = F.shiftright("anchor", GOLAY_LENGTH)              # the first word of a pair: at most 3 x 4,096 areas
    counts = F.count("*").alias("r"), F.count_if("home").alias("h")
    crowded = F.col("r") * F.col("h") > PAIR_WORK
    open_areas = rows.groupBy(area.alias("area")).agg(*counts).filter(crowded).select("area")
    work = stage(rows.join(F.broadcast(open_areas), area == F.col("area"), "left_semi")
                 .groupBy("anchor").agg(*counts).filter(crowded)
                 .select("anchor", F.ceil(F.col("r") * F.col("h") / PAIR_WORK).cast("int").alias("ways")), "crowded-anchors")
    dealt = rows.join(work, "anchor", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    everywhere = F.sequence(F.lit(0), F.col("ways") - 1)
    own = F.array(F.pmod(F.xxhash64("fp"), F.col("ways")).cast("int"))
    # a home is compared in every part, and is itself a replica in its own part
    dealt = dealt.withColumn("deal", F.explode(F.when(F.col("home"), everywhere).otherwise(own)))
    dealt = dealt.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held, key = [], None                                 # the rows of the last group so far

        def emit(parts):
            anchor, fp, home, deal = (np.concatenate(c) for c in zip(*parts))
            start = np.concatenate(([0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (deal[1:] != deal[:-1])) + 1))
            a, b = _forest(fp.view(np.uint64), home, start, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            anchor, deal = rows[0], rows[3]
            last = anchor[-1], deal[-1]
            if last == key:
                held.append(rows)
                continue
            differ = np.flatnonzero((anchor != last[0]) | (deal != last[1]))
            at = int(differ[-1]) + 1 if len(differ) else 0
            if held or at:
                yield emit(held + [[c[:at] for c in rows]])
            held, key = [[c[at:] for c in rows]], last
        if held:
            yield emit(held)

    return dealt.select("anchor", "fp", "home", "deal").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id``."""
    marked = stage(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = component_roots(links(distinct, max_bits))
    rooted = stage(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "component-names")
    named = stage(rooted.join(names, "root").select("fp", "component_id"), "named-fingerprints")
    discard(rooted, names)
    return (marked.join(named, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The document with the smallest identifier of each group, all columns; of
    several with that identifier, the one with the least digest of its text."""
    digest = F.sha2(text_or_empty(docs[text_col].cast("string")), 256)
    marked = fingerprints(docs, id_col, text_col, words_per_shingle, digest)
    first = F.min(F.struct(F.col("id").isNull(), "id", "digest"))
    distinct = stage(marked.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    roots = component_roots(links(distinct, max_bits))
    stay = (distinct.join(roots, F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select(F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest")))
    rows = docs.withColumn("__digest_of", digest)            # a text has one component: the pair names it
    return (rows.join(stay, rows[id_col].eqNullSafe(stay["__id"]) & (rows["__digest_of"] == stay["__digest"]), "left_semi")
            .dropDuplicates([id_col, "__digest_of"]).drop("__digest_of"))
