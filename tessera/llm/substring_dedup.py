"""Removal of every long repeated byte string, by distributed prefix doubling.

A position is *repeated at length K* when the K bytes that start there also
start elsewhere. Rounds run at growing lengths ``LENGTHS`` up to ``THRESHOLD``
bytes. In each round positions still alive are ranked by their K-byte strings:
the 64-bit rank of K bytes is put together from the ranks of shorter strings
at offsets of doubling size, Spark sorts the ranks, and positions whose rank
is unique leave. What survives the last round is repeated at ``THRESHOLD``.

Two things keep the rounds small, without changing the result:

* Positions are sampled. Of the K-byte strings inside a ``THRESHOLD``-byte
  string only the one with the least rank (the leftmost of equals), its
  anchor, is sorted. Equal long strings have equal anchors, so a string whose
  anchor is unique is unique. Neighbouring long strings share an anchor; such
  a run is one row. At the last length every string is its own anchor.
* A run whose whole content occurs again is settled at once, and one run
  of that content goes on as a partner for the others.

Ranks are combined inside each task before they are sorted, so of a string
that a third of all documents share at most one row per task is sorted.
Documents are written once, bucketed by a row number, and the rounds join
their candidate positions to the buckets without moving the texts again.
Ranks are random 64-bit hashes; a decision compares two independent ones.

Defined results: a null text counts as empty; matches do not cross documents;
rows that repeat an identifier are separate documents, so a repeated row's
strings are repeated; texts shorter than the threshold lose nothing; null
identifiers are passed through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, stage, text_or_empty
from tessera.llm.rolling import byte_table, window_hashes
from tessera.session import scratch_path

THRESHOLD = 200
LENGTHS = (50, 100, 150, 180, 200)
BLOCK = 1 << 15
BUFFER_BYTES = 1 << 20
COMBINE_ROWS = 1 << 21                                       # rows a task combines at once, at most about
# kinds of rows that a task hands to the sort
SINGLE, SEVERAL, MIXED, REPEATED, CANDIDATE = range(5)


def _runs(buffer, starts, length: int, threshold: int):
    """Runs of long strings with one anchor, in slices laid end to end.
    buffer: bytes; starts: first byte of each slice. Returns (rank, rank of the
    content, first byte, strings) arrays; slices are at least threshold long."""
    import numpy as np
    import xxhash
    table, other = byte_table(1), byte_table(2)
    span = threshold - length + 1
    n = len(buffer) - threshold + 1
    ends = np.append(starts[1:], len(buffer))
    change = np.zeros(len(buffer) + 1, np.int32)
    change[starts] += 1
    change[ends - threshold + 1] -= 1
    valid = np.cumsum(change[:n]) > 0
    ranks, firsts, counts, contents = [], [], [], []
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        codes = buffer[lo:hi + threshold - 1]
        rank = window_hashes(table[codes], length)
        if span == 1:
            first = np.flatnonzero(valid[lo:hi])
            ranks.append(rank[first])
            contents.append(window_hashes(other[codes], length)[first])
            firsts.append(first + lo)
            counts.append(np.ones(len(first), np.int64))
            continue
        low = (rank << np.uint64(16)) | np.arange(len(rank), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[:hi - lo], low[span - have:span - have + hi - lo])
        anchor = (low & np.uint64(0xFFFF)).astype(np.int64)
        alive = valid[lo:hi]
        new = np.ones(hi - lo, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (alive[1:] != alive[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, hi - lo))
        first, count = first[alive[first]], count[alive[first]]
        ranks.append(rank[anchor[first]])
        firsts.append(first + lo)
        counts.append(count)
    if span == 1:
        joined = [np.concatenate(x) for x in (ranks, contents, firsts, counts)]
        return tuple(joined)
    rank, first, count = (np.concatenate(x) for x in (ranks, firsts, counts))
    view, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + threshold - 1).tolist())),
                          np.uint64, len(first))
    return rank, content, first, count


def _combined(rank, content, doc, at, count):
    """What one task hands on: (key, content, doc, packed) arrays."""
    import numpy as np
    order = np.lexsort((content, rank))
    rank, content, doc, at, count = (x[order] for x in (rank, content, doc, at, count))
    first_rank = np.append(True, rank[1:] != rank[:-1])
    first_content = first_rank | np.append(True, content[1:] != content[:-1])
    of_rank, of_content = np.cumsum(first_rank) - 1, np.cumsum(first_content) - 1
    n_rank, n_content = np.bincount(of_rank)[of_rank], np.bincount(of_content)[of_content]
    n_contents = np.bincount(of_rank[first_content])[of_rank]
    one = n_contents == 1
    picked = [(one & (n_rank == 1), SINGLE), (one & (n_rank > 1) & first_rank, SEVERAL), (~one & first_rank, MIXED),
              (n_content > 1, REPEATED), (~one & first_content, CANDIDATE)]
    rows = np.concatenate([np.flatnonzero(mask) for mask, _ in picked])
    kind = np.concatenate([np.full(np.count_nonzero(mask), k) for mask, k in picked])
    packed = at[rows] << 12 | count[rows] << 4 | kind
    spread = (doc[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[rows].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    key = np.where(kind < REPEATED, rank[rows], spread)
    return key.view(np.int64), content[rows].view(np.int64), doc[rows], packed


def _ranked(docs: DataFrame, length: int, threshold: int) -> DataFrame:
    """docs: ``doc_no, text`` and, from the second round on, ``places``."""
    with_places = "places" in docs.columns

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        found, held, starts, owners, places, size = [], [], [], [], [], 0

        def combined():
            columns = _combined(*(np.concatenate(x) for x in zip(*found)))
            found.clear()
            for lo in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + (1 << 16)]) for c in columns],
                                                 names=["key", "content", "doc_no", "packed"])

        def flush():
            nonlocal size
            if held:
                buffer = np.frombuffer(b"".join(held), np.uint8)
                begin, owner, place = (np.array(x, np.int64) for x in (starts, owners, places))
                rank, content, first, count = _runs(buffer, begin, length, threshold)
                which = np.searchsorted(begin, first, side="right") - 1
                found.append((rank, content, owner[which], place[which] + first - begin[which], count))
            for x in (held, starts, owners, places):
                x.clear()
            size = 0

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, number in enumerate(numbers):
                data = texts[k].as_buffer()
                if data.size < threshold:
                    continue
                if with_places:
                    spots = np.sort(np.asarray(batch.column(2)[k].values))
                    a, b = spots >> 12, (spots >> 12) + (spots >> 4 & 255)
                    reach = np.maximum.accumulate(b)
                    cut = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                    slices = zip(a[cut].tolist(), reach[np.append(cut[1:], len(a)) - 1].tolist())
                else:
                    slices = ((0, data.size - threshold + 1),)
                for a, b in slices:
                    piece = data[a:b + threshold - 1]
                    held.append(piece)
                    starts.append(size)
                    owners.append(number)
                    places.append(a)
                    size += len(piece)
                if size >= BUFFER_BYTES:
                    flush()
                    if sum(len(f[0]) for f in found) >= COMBINE_ROWS:
                        yield from combined()
        flush()
        if found:
            yield from combined()

    return docs.mapInArrow(run, "key long, content long, doc_no long, packed long")


def _settled(rows: DataFrame) -> DataFrame:
    """``doc_no, packed, repeated``: runs that are repeated, and runs whose
    strings the next round must rank. One key has at most one row of each
    task (of each ``COMBINE_ROWS`` rows of a large one)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def settle(key, content, doc, packed):
            kind = packed & 15
            done = kind >= REPEATED
            first_key = np.append(True, key[1:] != key[:-1])
            first_content = first_key | np.append(True, content[1:] != content[:-1])
            of_key, of_content = np.cumsum(first_key) - 1, np.cumsum(first_content) - 1
            open_ = ~done & (kind != MIXED)
            weight = np.where(kind == SEVERAL, 2, 1) * open_
            n_content = np.bincount(of_content, weight)[of_content]
            contents = np.bincount(of_key[first_content], np.bincount(of_content, open_)[of_content[first_content]] > 0)
            mixed = ((contents > 1) | (np.bincount(of_key, (kind == MIXED) & ~done) > 0))[of_key]
            seen = np.cumsum(open_) - open_
            leads = open_ & (seen == seen[np.flatnonzero(first_content)][of_content])
            repeated = (kind == REPEATED) | (open_ & (kind == SINGLE) & (n_content > 1))
            candidate = (kind == CANDIDATE) | (mixed & leads)
            rows = np.concatenate((np.flatnonzero(repeated), np.flatnonzero(candidate)))
            return pa.RecordBatch.from_arrays(
                [pa.array(doc[rows]), pa.array(packed[rows]), pa.array(np.arange(len(rows)) < np.count_nonzero(repeated))],
                names=["doc_no", "packed", "repeated"])

        rest = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(rest, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [c[cut:] for c in columns]                # the last key may go on
            if cut:
                yield settle(*(c[:cut] for c in columns))
        if rest is not None and len(rest[0]):
            yield settle(*rest)

    return (rows.repartition("key").sortWithinPartitions("key", "content")
            .mapInArrow(run, "doc_no long, packed long, repeated boolean"))


def _bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents written once under the shared folder, in buckets of
    ``doc_no``."""
    spark = docs.sparkSession
    name = f"substring_docs_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.monotonically_increasing_id().alias("doc_no"), docs[id_col].alias("id"),
                 text_or_empty(docs[text_col].cast("string")).cast("binary").alias("text"))
     .repartition(buckets, "doc_no")
     .write.bucketBy(buckets, "doc_no").sortBy("doc_no").option("path", scratch_path(spark, f"llm-{name}")).saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")      # the files stay until the run ends; only the catalog's entry goes
    return table


def _places(settled: DataFrame) -> DataFrame:
    """Places by document; a text bounds its own."""
    return settled.groupBy("doc_no").agg(F.collect_list("packed").alias("places"))


def repeated_runs(table: DataFrame, lengths=LENGTHS, threshold: int = THRESHOLD) -> list[DataFrame]:
    """Staged frames whose ``repeated`` rows are the runs of repeated strings
    of the documents ``doc_no, text``."""
    alive, rounds = table.select("doc_no", "text"), []
    for length in lengths:
        rounds.append(stage(_settled(_ranked(alive, length, threshold)), f"repeated-{length}"))
        places = _places(rounds[-1].filter("not repeated"))
        alive = table.select("doc_no", "text").join(places, "doc_no")
    return rounds


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths=LENGTHS,
                   threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, spans,
    kept`` (``spans``: removed [start, end) byte ranges; ``kept``: the rest)."""
    if tuple(lengths)[-1] != threshold or max(threshold - n for n in lengths) > 254 or min(lengths) < 1:
        raise ValueError("lengths must grow to the threshold, from at most 254 bytes below it")
    table = _bucketed(docs, id_col, text_col)
    rounds = repeated_runs(table, lengths, threshold)
    runs = rounds[0].filter("repeated")
    for more in rounds[1:]:
        runs = runs.unionByName(more.filter("repeated"))
    runs = stage(runs.select("doc_no", "packed"), "repeated-runs")
    discard(*rounds)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                n_bytes, n_removed, spans, kept = [], [], [], []
                for k in range(rows.num_rows):
                    data = rows.column(1)[k].as_buffer()
                    removed, rest, done = [], [], 0
                    if rows.column(2)[k].is_valid:
                        spots = np.sort(np.asarray(rows.column(2)[k].values))
                        a, b = spots >> 12, (spots >> 12) + (spots >> 4 & 255) + threshold - 1
                        reach = np.maximum.accumulate(b)
                        first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
                        removed = [[int(x), int(y)] for x, y in zip(a[first], reach[np.append(first[1:], len(a)) - 1])]
                    for x, y in removed:
                        rest.append(data[done:x])
                        done = y
                    rest.append(data[done:])
                    n_bytes.append(data.size)
                    n_removed.append(sum(y - x for x, y in removed))
                    spans.append(removed)
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                     pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                     pa.array(kept, pa.binary())], names=[f.name for f in schema])

    return (table.join(_places(runs), "doc_no", "left").select("id", "text", "places").mapInArrow(cut, schema))
