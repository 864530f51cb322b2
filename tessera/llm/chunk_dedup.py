"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last ``WINDOW`` bytes cuts a text wherever its top
bits are zero, at least ``MIN_CHUNK`` bytes after the last cut, at a character
boundary (and after ``MAX_CHUNK`` bytes in any case). Cuts depend only on the
bytes before them, so after an insertion the cuts fall into step again and
equal passages give equal chunks wherever they lie. Chunks are compared by
128-bit digest; the first occurrence (smallest document, then place) stays and
every other is a duplicate. Neighbouring duplicates form runs; runs of at
least ``MIN_RUN`` bytes are removed, shorter ones (a shared phrase or licence
line) stay.

Equal chunks are combined inside each task, so of a chunk that a third of all
documents share at most one row per task is shuffled. The texts move once, to
meet their removed runs.

Defined results: a null text counts as empty; a text without a cut is one
chunk; rows that repeat both identifier and text are one document, each
reported alike; a null identifier orders before all others; non-integer
identifiers are ordered by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage, text_or_empty

WINDOW = 16
MIN_CHUNK = 24
CUT_BITS = 4
MAX_CHUNK = 4096
MIN_RUN = 96
BUFFER_BYTES = 1 << 20
COMBINE_ROWS = 1 << 21                                       # chunks a task combines at once, at most about
FIRST, DUPLICATE = 0, 1


def gear_hashes(data):
    """Gear hash at every byte of a buffer (32 bits, the last WINDOW bytes count)."""
    import numpy as np
    table = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)
    hashes, width = table[data], 1
    while width < WINDOW:
        longer = hashes.copy()
        longer[width:] += hashes[:-width] << np.uint32(width)
        hashes, width = longer, width * 2
    return hashes


def cut_points(buffer, starts):
    """Ends of all chunks of texts laid end to end (each text's end is one)."""
    import numpy as np
    wanted = gear_hashes(buffer) >> np.uint32(32 - CUT_BITS) == 0
    wanted[:-1] &= (buffer[1:] & 0xC0) != 0x80               # the next byte starts a character
    places = np.flatnonzero(wanted) + 1
    ends = np.append(starts[1:], len(buffer))
    out = []
    bounds = np.searchsorted(places, ends, side="left").tolist()
    places, k = places.tolist(), 0
    for start, end, stop in zip(starts.tolist(), ends.tolist(), bounds):
        last = start
        k = max(k, 0)
        for at in (*places[k:stop], end):
            while at - last > MAX_CHUNK:
                last += MAX_CHUNK
                while buffer[last] & 0xC0 == 0x80:
                    last -= 1
                out.append(last)
            if at == end or at - last >= MIN_CHUNK:
                out.append(at)
                last = at
        k = stop
    return np.array(out, np.int64)


def _order(id_col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(id_col.cast("long"), F.lit(-(1 << 63)))
    return F.coalesce(F.xxhash64(id_col), F.lit(-(1 << 63)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, ord, th, text``: (ord, th) names a document; ``th``, 64 bits of
    the text's hash, tells apart rows that repeat an identifier or have none."""
    text = text_or_empty(docs[text_col].cast("string"))
    return docs.select(docs[id_col].alias("id"), _order(docs[id_col], docs.schema[id_col].dataType).alias("ord"),
                       F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def _chunks(keyed: DataFrame) -> DataFrame:
    """``d1, d2, ord, th, packed`` of a task's distinct chunks and its duplicates.
    packed: place, length and kind from the top."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        found, held, starts, owners, size = [], [], [], [], 0

        def combined():
            d1, d2, ords, th, packed = (np.concatenate(x) for x in zip(*found))
            found.clear()
            order = np.lexsort((packed, th, ords, d2, d1))
            d1, d2, ords, th, packed = d1[order], d2[order], ords[order], th[order], packed[order]
            head = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))
            again = np.append(False, (ords[1:] != ords[:-1]) | (th[1:] != th[:-1]) | (packed[1:] != packed[:-1]))
            rows = np.flatnonzero(head | again)              # the same place of a repeated row is one
            kind = np.where(head[rows], FIRST, DUPLICATE)
            spread = np.where(kind == FIRST, d1[rows], (ords[rows] * 0x9E3779B1) ^ th[rows] ^ packed[rows])
            for lo in range(0, len(rows), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                some = rows[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread[cut]), pa.array(d2[some]), pa.array(ords[some]), pa.array(th[some]),
                     pa.array(packed[some] | kind[cut])], names=["d1", "d2", "ord", "th", "packed"])

        def flush():
            nonlocal size
            if held:
                data = b"".join(held)
                begin = np.array(starts, np.int64)
                ends = cut_points(np.frombuffer(data, np.uint8), begin)
                view, digest = memoryview(data), xxhash.xxh3_128_digest
                first = np.append(0, ends[:-1])
                sums = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), ends.tolist())]), "<i8")
                which = np.searchsorted(begin, first, side="right") - 1
                ords, th = (np.array([o[k] for o in owners], np.int64)[which] for k in (0, 1))
                packed = (first - begin[which]) << 16 | (ends - first) << 3
                found.append((sums[0::2], sums[1::2], ords, th, packed))
            for x in (held, starts, owners):
                x.clear()
            size = 0

        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for k, name in enumerate(names):
                data = batch.column(2)[k].as_buffer()
                if data.size:
                    held.append(data)
                    starts.append(size)
                    owners.append(name)
                    size += data.size
                if size >= BUFFER_BYTES:
                    flush()
                    if sum(len(f[0]) for f in found) >= COMBINE_ROWS:
                        yield from combined()
        flush()
        if found:
            yield from combined()

    return keyed.select("ord", "th", "text").mapInArrow(run, "d1 long, d2 long, ord long, th long, packed long")


def _duplicates(chunks: DataFrame) -> DataFrame:
    """``ord, th, packed`` of all chunks but the first of their digest."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def settle(d1, d2, ords, th, packed):
            known = packed & 7 == DUPLICATE
            head = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (known[1:] != known[:-1]) | known[1:])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            again = known | (ords != ords[lead]) | (th != th[lead]) | (packed != packed[lead])
            return pa.RecordBatch.from_arrays(
                [pa.array(ords[again]), pa.array(th[again]), pa.array(packed[again] >> 3)],
                names=["ord", "th", "packed"])

        rest = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(rest, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield settle(*(c[:cut] for c in columns))
        if rest is not None and len(rest[0]):
            yield settle(*rest)

    kind = F.col("packed").bitwiseAND(F.lit(7))
    return (chunks.repartition("d1").sortWithinPartitions("d1", kind, "d2", "ord", "th", "packed")
            .mapInArrow(run, "ord long, th long, packed long"))


def remove_duplicate_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, spans,
    kept_text`` (``spans``: removed [start, end) byte ranges)."""
    keyed = _keyed(docs, id_col, text_col)
    runs = stage(_duplicates(_chunks(keyed)), "duplicate-chunks")
    by_doc = runs.groupBy("ord", "th").agg(F.collect_set("packed").alias("places"))       # a text bounds its own
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept_text", T.StringType())])

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                n_bytes, removed, kept = [], [], []
                for k in range(rows.num_rows):
                    data = rows.column(1)[k].as_buffer()
                    spans = []
                    if rows.column(2)[k].is_valid:
                        spots = np.unique(np.asarray(rows.column(2)[k].values))
                        a, b = spots >> 13, (spots >> 13) + (spots & 8191)
                        first = np.flatnonzero(np.append(True, a[1:] != b[:-1]))
                        last = np.append(first[1:], len(a)) - 1
                        spans = [[int(x), int(y)] for x, y in zip(a[first], b[last]) if y - x >= min_run]
                    rest, done = [], 0
                    for x, y in spans:
                        rest.append(data[done:x])
                        done = y
                    rest.append(data[done:])
                    n_bytes.append(data.size)
                    removed.append(spans)
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_bytes, pa.int64()),
                     pa.array([sum(y - x for x, y in s) for s in removed], pa.int64()),
                     pa.array([len(s) for s in removed], pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=[f.name for f in schema])

    return (keyed.join(by_doc, ["ord", "th"], "left").select("id", "text", "places").mapInArrow(cut, schema))
