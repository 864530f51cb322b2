"""Packing documents into training sequences by concatenate-and-cut.

First pass: every document is tokenised where it lies (whole text, an end id
after it), its ids are written once as packed unsigned integers together with
its start inside its partition. Second pass: the partitions' token totals (one
row per partition) are summed to global offsets, and every document is cut at
the fixed windows it crosses, so each window's boundary records say which part
of which document it holds. No id moves between machines: only the totals do.

Every sequence is full except the last one, which is padded (``pad_to``).

Tokenising splits a text before each single space, and around each single line
end, between two characters that are not white space. The pre-tokenisation
pattern never lets a token cross such a place, so the ids of the units, joined,
are the ids of the text; texts with any other white-space neighbourhood are
encoded whole. Units repeat, and their ids are remembered per task up to
``CACHE_UNITS`` units of either kind.

Defined results: a null or empty text is its end id alone; repeated rows are
packed as often as they occur; an empty table gives no pieces; texts of any
length are cut, none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage

SEQUENCE_TOKENS = 1024
END_ID = 0
CACHE_UNITS = 400_000
PUBLIC_VOCABULARY = "byte_bpe_50k"


def make_encoder(vocabulary: str):
    """text -> numpy ids, equal to the ``tokenizers`` file ``vocabulary``.json
    with ``add_special_tokens=False``. The vocabulary's rank file is read by a
    faster encoder; a file without one is encoded by ``tokenizers`` itself."""
    import base64
    import os
    from array import array

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    try:
        rank_file = public_tokenizers.path(vocabulary + ".tiktoken")
    except (KeyError, FileNotFoundError):
        rank_file = ""
    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))
    kind = np.uint16 if whole.get_vocab_size() <= 1 << 16 else np.uint32
    if not (rank_file and os.path.exists(rank_file)):
        return lambda text: np.asarray(whole.encode(text, add_special_tokens=False).ids, kind), kind
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    leading: dict[str, bytes] = {}                           # units at the start of a line
    spaced: dict[str, bytes] = {}                            # units after a space

    code = "H" if kind is np.uint16 else "I"

    def packed(text: str) -> bytes:
        return array(code, fast.encode(text, allowed_special="all")).tobytes()

    def learn(known: dict, unit: str, prefix: str) -> bytes | None:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None                                      # no cut is possible beside this unit
        if len(known) >= CACHE_UNITS:
            known.clear()
        known[unit] = ids = array(code, fast.encode_ordinary(prefix + unit)).tobytes()
        return ids

    line_end = packed("\n")

    def encode(text: str):
        out: list[bytes] = []
        for line in () if any(name in text for name in special) else text.split("\n"):
            units = line.split(" ")
            start = leading.get(units[0])
            found = list(map(spaced.get, units[1:]))
            if start is None and (start := learn(leading, units[0], "")) is None:
                break
            if None in found:
                found = [learn(spaced, u, " ") if ids is None else ids for u, ids in zip(units[1:], found)]
                if None in found:
                    break
            out.append(start + b"".join(found))
        else:
            if out:
                return np.frombuffer(line_end.join(out), kind)
        return np.frombuffer(packed(text), kind)

    return encode, kind


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = PUBLIC_VOCABULARY,
                end_id: int = END_ID) -> DataFrame:
    """Staged ``id, part, start_in_part, n_tokens, ids`` (ids: packed little-endian)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def tokenise(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        encode, kind = make_encoder(vocabulary)
        end = np.asarray([end_id], kind).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = [encode(t or "").tobytes() + end for t in rows.column(1).to_pylist()]
                n = np.asarray([len(x) // np.dtype(kind).itemsize for x in ids], np.int64)
                starts = start + np.concatenate(([0], np.cumsum(n)[:-1]))
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n),
                     pa.array(ids, pa.binary())], names=["id", "part", "start_in_part", "n_tokens", "ids"])

    return stage(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
                 .mapInArrow(tokenise, schema), "tokens")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS,
                   vocabulary: str = PUBLIC_VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids`` (``ids`` as ``array<int>``)."""
    tokens = token_table(docs, id_col, text_col, vocabulary, end_id)
    wide = make_encoder(vocabulary)[1]().itemsize
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))        # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    placed = (tokens.join(F.broadcast(offsets), "part")                          # one row per partition
              .select("id", (F.col("before") + F.col("start_in_part")).alias("at"), "n_tokens", "ids"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           *[T.StructField(c, T.LongType()) for c in
                             ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        kind = np.uint16 if wide == 2 else np.uint32
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = batch.slice(lo, 64)
                out = [[] for _ in range(8)]
                for i, at, n, packed in zip(*(rows.column(k).to_pylist() for k in range(4))):
                    ids = np.frombuffer(packed, kind)
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, size)
                        length = min(size - offset, n - start)
                        piece = ids[start:start + length]
                        crc = zlib.crc32(piece.astype("<u4").tobytes())
                        for column, value in zip(out, (i, start, length, crc, n, sequence, offset, piece.astype(np.int32))):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], rows.schema.field(0).type), *[pa.array(c, pa.int64()) for c in out[1:7]],
                     pa.array(out[7], pa.list_(pa.int32()))], names=[f.name for f in schema])

    return placed.mapInArrow(cut, schema)


def pad_to(length: int, size: int = SEQUENCE_TOKENS) -> int:
    """Width of a sequence that holds ``length`` ids: its own when that is a
    power of two, else ``size``."""
    return length if length and length & (length - 1) == 0 else size
