"""Alignment of two tokenizers over the same text, with corpus-wide counts.

Every text, with a space before it, is cut into tokens by a byte-level BPE (A)
and by a piece model with byte fallback (B). Byte offsets where tokens of both
end cut them into groups; an A and a B token whose byte ranges overlap are a
link. A link's count is how many links of the whole corpus join the same two
ids.

**Fragments.** A byte range's tokens are reduced to a fragment: an open prefix
(tokens up to the first common end, whose group may have begun earlier), the
closed groups, and an open suffix (tokens after the last common end). Fragments
compose associatively (``combine``), so a document is the product of its parts
in any bracketing. Texts of up to ``CHUNK_BYTES`` are the product of their
units where they lie; longer ones are dealt as pieces over the tasks, their
tokens cut at multiples of ``CHUNK_BYTES``, and the fragments are composed in a
tree, ``FAN_IN`` at a time, level by level.

**Units.** A text may be cut before a single space or line end between two
characters that are not white space: the pattern of A ends a token there, and
no piece of B holds such a space except as its first character, while a line
end is a byte piece of its own. Units repeat, so a task remembers their tokens,
groups and links (up to ``CACHE_UNITS``). Any other white space stays inside
its unit, and a text without a cut is one unit.

**Counts.** Links are summed per block of ``BLOCK_BYTES`` of text in its task;
one row per block and id pair is shuffled, never one per link. The corpus-wide
counts go back to the blocks that hold the pair, and each block's documents,
kept as lists of the block's units, add them up.

Defined results: null and empty texts, and texts whose joined A or B bytes
differ from the space and the text (B reads U+2581 as a space), have zeros and
an empty group text; repeated rows and null or repeated identifiers are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage

BYTE_VOCABULARY = "byte_bpe_50k"
PIECE_VOCABULARY = "piece_bpe_32k"
CHUNK_BYTES = 1 << 16
BLOCK_BYTES = 8 << 20
CACHE_UNITS = 400_000
FAN_IN = 16
#: An id pair as one number: A id x PAIR_BASE + B id.
PAIR_BASE = 1 << 24


# ------------------------------------------------------------------ fragments

class Tokens(NamedTuple):
    """Two token runs: ids and byte ends of A and of B, as int64 arrays."""
    a: object
    a_ends: object
    b: object
    b_ends: object

    def __add__(self, other: Tokens) -> Tokens:
        import numpy as np
        return Tokens(*(np.concatenate(pair) for pair in zip(self, other)))

    def cut(self, start: int | None, end: int | None) -> Tokens:
        """The tokens with ``start < end of token <= end``."""
        import numpy as np

        def part(ids, ends):
            i = 0 if start is None else np.searchsorted(ends, start, "right")
            j = len(ends) if end is None else np.searchsorted(ends, end, "right")
            return ids[i:j], ends[i:j]
        return Tokens(*part(self.a, self.a_ends), *part(self.b, self.b_ends))


def no_tokens() -> Tokens:
    import numpy as np
    return Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


class Closed(NamedTuple):
    """What is kept of closed groups: their text, sizes, and links by id pair."""
    groups: str
    n_a: int
    n_b: int
    n_groups: int
    pairs: object                                            # sorted distinct codes
    times: object

    def __add__(self, other: Closed) -> Closed:
        import numpy as np
        pairs, where = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, where, np.concatenate([self.times, other.times]))
        return Closed(";".join(g for g in (self.groups, other.groups) if g), self.n_a + other.n_a,
                      self.n_b + other.n_b, self.n_groups + other.n_groups, pairs, times)


class Fragment(NamedTuple):
    """``cut`` tells whether a common end lies inside; if not, all tokens are
    in ``prefix`` and ``suffix`` is empty."""
    cut: bool
    prefix: Tokens
    closed: Closed
    suffix: Tokens


def links_of(t: Tokens):
    """Codes of the links of ``t``, in byte order, with the end of each. The
    ends of both cut the bytes into intervals, each the overlap of exactly one
    A and one B token."""
    import numpy as np
    ends = np.union1d(t.a_ends, t.b_ends)
    return t.a[np.searchsorted(t.a_ends, ends)] * PAIR_BASE + t.b[np.searchsorted(t.b_ends, ends)], ends


def group_texts(t: Tokens, common) -> list[str]:
    """``a1,a2|b1`` of every group of ``t``, which ends at a common end."""
    import numpy as np
    a, b = list(map(str, t.a.tolist())), list(map(str, t.b.tolist()))
    cuts_a = [0, *(np.searchsorted(t.a_ends, common) + 1).tolist()]
    cuts_b = [0, *(np.searchsorted(t.b_ends, common) + 1).tolist()]
    return [",".join(a[i:j]) + "|" + ",".join(b[k:m])
            for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]


def close(t: Tokens) -> Closed:
    """The groups of tokens that begin and end at common ends."""
    import numpy as np
    common = np.intersect1d(t.a_ends, t.b_ends)
    pairs, times = np.unique(links_of(t)[0], return_counts=True)
    return Closed(";".join(group_texts(t, common)), len(t.a), len(t.b), len(common), pairs, times.astype(np.int64))


def fragment(t: Tokens) -> Fragment:
    import numpy as np
    common = np.intersect1d(t.a_ends, t.b_ends)
    if not len(common):
        return Fragment(False, t, close(no_tokens()), no_tokens())
    return Fragment(True, t.cut(None, common[0]), close(t.cut(common[0], common[-1])), t.cut(common[-1], None))


def combine(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of the two neighbouring token runs; associative."""
    import numpy as np
    if not f.cut and not g.cut:
        return fragment(f.prefix + g.prefix)
    middle = (f.suffix if f.cut else f.prefix) + g.prefix
    common = np.intersect1d(middle.a_ends, middle.b_ends)
    first = None if f.cut or not len(common) else common[0]
    last = common[-1] if len(common) else None
    if not f.cut:                                            # g has a cut, so common ends there
        return Fragment(True, middle.cut(None, first), close(middle.cut(first, last)) + g.closed, g.suffix)
    if last is None:
        return Fragment(True, f.prefix, f.closed, middle)
    return Fragment(True, f.prefix, f.closed + close(middle.cut(None, last)) + g.closed,
                    g.suffix if g.cut else middle.cut(last, None))


def document(f: Fragment) -> Closed:
    """A whole document's fragment: its start and its end are common."""
    return close(f.prefix) + f.closed + close(f.suffix)


# ---------------------------------------------------------------- tokenizers

def make_tokenizers(byte_vocabulary: str, piece_vocabulary: str):
    """``encode_a(text)`` and ``encode_b(texts)`` -> ids of texts that start
    with a space or a line end, and the byte strings of all ids of each."""
    import base64
    import re

    import public_tokenizers
    import sentencepiece
    import tiktoken
    with open(public_tokenizers.path(byte_vocabulary + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    fast = tiktoken.Encoding(byte_vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bytes_a = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        bytes_a[rank] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_vocabulary + ".model"))
    byte_piece = re.compile("<0x([0-9A-F]{2})>")
    bytes_b = [bytes.fromhex(m[1]) if pieces.is_byte(i) and (m := byte_piece.fullmatch(pieces.id_to_piece(i)))
               else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]

    def encode_a(text: str) -> list[int]:
        return fast.encode_ordinary(text)

    def encode_b(texts: list[str]) -> list[list[int]]:
        """The model adds a space; before a line end it is a piece of its own."""
        ids = pieces.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        return [x if t[0] == " " else x[1:] for t, x in zip(texts, ids)]

    return encode_a, encode_b, bytes_a, bytes_b


class Units:
    """Tokens, groups and links of the units a task has met. A unit's key is
    the text after its space, or with its line end; a unit that begins or ends
    with white space besides that has a space and its whole text as key."""

    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        import re

        import numpy as np
        self.encode_a, self.encode_b, bytes_a, self.bytes_b = make_tokenizers(byte_vocabulary, piece_vocabulary)
        self.width_a, self.width_b = (np.asarray(list(map(len, x)), np.int64) for x in (bytes_a, self.bytes_b))
        self.places = re.compile(r"(?<=\S)(?=[ \n]\S)")
        self.clear()

    def clear(self) -> None:
        import numpy as np
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)              # A tokens, B tokens, groups, links, equal bytes
        self.links_at = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    @staticmethod
    def plain(key: str) -> bool:
        word = key[1:] if key[:1] == "\n" else key
        return bool(word) and not word[0].isspace() and not word[-1].isspace()

    @staticmethod
    def whole(key: str) -> str:
        return key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key

    def keys(self, text: str) -> list[str]:
        """The units of a space and ``text``."""
        keys = text.replace("\n", " \n").split(" ")
        number = self.number
        if keys[0][:1] != "\n" and all(map(self.plain, [k for k in keys if k not in number])):
            return keys
        return self.keys_of_piece(" " + text)

    def keys_of_piece(self, piece: str) -> list[str]:
        out = []
        for unit in self.places.split(piece):
            key = unit[1:] if unit[0] == " " else unit
            out.append(key if self.plain(key) and (unit[0] == "\n") == (key[0] == "\n") else " " + unit)
        return out

    def tokens_of(self, wholes: list[str]):
        """Token runs, end to end, of the units that B spells byte for byte,
        the units' ends, and which those are. Units after the first must begin
        where a text may be cut."""
        from itertools import chain

        import numpy as np
        raw, spell = [w.encode() for w in wholes], self.bytes_b.__getitem__
        b = self.encode_b(wholes)
        equal = [b"".join(map(spell, ids)) == r for ids, r in zip(b, raw)]
        ids_a = np.asarray(self.encode_a("".join(w for w, e in zip(wholes, equal) if e)), np.int64)
        ids_b = np.fromiter(chain.from_iterable(ids for ids, e in zip(b, equal) if e), np.int64)
        ends = np.cumsum(np.asarray([len(r) for r, e in zip(raw, equal) if e], np.int64))
        return Tokens(ids_a, np.cumsum(self.width_a[ids_a]), ids_b, np.cumsum(self.width_b[ids_b])), ends, np.asarray(equal, bool)

    def learn(self, keys: list[str]) -> None:
        """Plain units together, others one by one: they end in white space."""
        plain = [k for k in keys if k[0] != " "]
        for some in ([plain] if plain else []) + [[k] for k in keys if k[0] == " "]:
            self._learn(some)

    def _learn(self, keys: list[str]) -> None:
        import numpy as np
        run, ends, equal = self.tokens_of([self.whole(k) for k in keys])
        common = np.intersect1d(run.a_ends, run.b_ends)
        links, link_ends = links_of(run)
        sizes = np.zeros((len(keys), 5), np.int64)
        for column, at in enumerate((run.a_ends, run.b_ends, common, link_ends)):
            sizes[equal, column] = np.bincount(np.searchsorted(ends, at), minlength=len(ends))
        sizes[:, 4] = equal
        groups, at = group_texts(run, common), 0
        for key, n in zip(keys, sizes[:, 2].tolist()):
            self.number[key] = len(self.texts)
            self.texts.append(";".join(groups[at:at + n]))
            at += n
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links_at = np.concatenate([self.links_at, self.links_at[-1] + np.cumsum(sizes[:, 3])])
        self.links = np.concatenate([self.links, links])

    def numbers(self, keys: list[str]):
        import numpy as np
        found = list(map(self.number.get, keys))
        if None in found:
            self.learn(list(dict.fromkeys(k for k, i in zip(keys, found) if i is None)))
            found = list(map(self.number.__getitem__, keys))
        return np.asarray(found, np.int64)


# --------------------------------------------------------------------- tasks

def _packed(x) -> bytes:
    return x.astype("<i8").tobytes()


def _unpacked(x: bytes):
    import numpy as np
    return np.frombuffer(x, "<i8")


def _parts_schema(id_type: T.DataType) -> T.StructType:
    """One row per document of a block (kind 0), block (1), piece of a long document (2)."""
    names = {"kind": T.IntegerType(), "doc_key": T.LongType(), "id": id_type, "block": T.LongType(),
             "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(),
             "groups": T.StringType(), "units": T.BinaryType(), "unit_times": T.BinaryType(),
             "unit_links": T.BinaryType(), "unit_pairs": T.BinaryType(), "pairs": T.BinaryType(),
             "times": T.BinaryType(), "seq": T.LongType(), "piece": T.StringType()}
    return T.StructType([T.StructField(n, t) for n, t in names.items()])


def _batch(rows: list[dict], schema):
    import pyarrow as pa
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _align_task(byte_vocabulary: str, piece_vocabulary: str, write_groups: Callable[[str], str], chunk_bytes: int,
                block_bytes: int, schema: T.StructType):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        units = Units(byte_vocabulary, piece_vocabulary)
        first = TaskContext.get().partitionId() << 33
        row_no, block, size, docs = 0, first, 0, []

        def flush():
            held = [d["units"] for d in docs if d["units"] is not None]
            held = np.concatenate(held) if held else np.zeros(0, np.int64)
            often = np.bincount(held, minlength=len(units.texts))
            present = np.flatnonzero(often)
            local = np.zeros(len(units.texts), "<u4")
            local[present] = np.arange(len(present))
            n = units.sizes[present, 3]
            starts = units.links_at[present]
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else starts, n) + np.arange(n.sum())
            pairs, where = np.unique(units.links[at], return_inverse=True)
            times = np.bincount(where, weights=np.repeat(often[present], n), minlength=len(pairs)).astype(np.int64)
            for d in docs:
                d["units"] = None if d["units"] is None else local[d["units"]].tobytes()
                d["block"] = block
            for lo in range(0, len(docs), 512):
                yield _batch(docs[lo:lo + 512], arrow)
            yield _batch([{"kind": 1, "block": block, "unit_links": n.astype("<u4").tobytes(),
                           "unit_pairs": where.astype("<u4").tobytes(), "pairs": _packed(pairs), "times": _packed(times)}], arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                keys, cuts, own = [], [0], []
                for ident, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    doc = {"kind": 0, "doc_key": first + row_no, "id": ident, "n_a": 0, "n_b": 0, "n_groups": 0,
                           "n_links": 0, "groups": "", "units": None}
                    row_no += 1
                    width = len(text.encode()) if text else 0
                    if width > chunk_bytes:
                        for seq, piece in enumerate(_pieces(" " + text, units.places, chunk_bytes)):
                            yield _batch([{"kind": 2, "doc_key": doc["doc_key"], "id": ident, "seq": seq, "piece": piece}], arrow)
                        continue
                    docs.append(doc)
                    if text:
                        size += width
                        own.append(doc)
                        keys += units.keys(text)
                        cuts.append(len(keys))
                if own:
                    numbers = units.numbers(keys)
                    sizes = np.add.reduceat(units.sizes[numbers], cuts[:-1], axis=0).tolist()
                    spelt = units.texts
                    for doc, i, j, (n_a, n_b, n_groups, n_links, equal) in zip(own, cuts, cuts[1:], sizes):
                        if equal == j - i:
                            doc.update(n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, units=numbers[i:j],
                                       groups=write_groups(";".join([spelt[k] for k in numbers[i:j].tolist()])))
                if size >= block_bytes:
                    yield from flush()
                    block, size, docs = block + 1, 0, []
                    if len(units.texts) >= CACHE_UNITS:
                        units.clear()
        if docs:
            yield from flush()
    return run


def _pieces(text: str, places, chunk_bytes: int) -> Iterator[str]:
    """Runs of whole units of about ``chunk_bytes`` bytes (four bytes a character at most)."""
    at, step = 0, max(1, chunk_bytes // 2)
    while at < len(text):
        found = places.search(text, min(at + step, len(text)))
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


_FRAGMENT_COLUMNS = [*("prefix_" + c for c in Tokens._fields), *("suffix_" + c for c in Tokens._fields)]


def _fragment_schema(id_type: T.DataType) -> T.StructType:
    long, blob = T.LongType(), T.BinaryType()
    return T.StructType([T.StructField(n, t) for n, t in {
        "doc_key": long, "id": id_type, "at": long, "equal": T.BooleanType(), "cut": T.BooleanType(), "groups": T.StringType(),
        "n_a": long, "n_b": long, "n_groups": long, "pairs": blob, "times": blob,
        **dict.fromkeys(_FRAGMENT_COLUMNS, blob)}.items()])


def _to_row(f: Fragment) -> dict:
    return {"cut": f.cut, **f.closed._asdict(), "pairs": _packed(f.closed.pairs), "times": _packed(f.closed.times),
            **dict(zip(_FRAGMENT_COLUMNS, map(_packed, (*f.prefix, *f.suffix))))}


def _from_row(r: dict) -> Fragment:
    sides = [_unpacked(r[c]) for c in _FRAGMENT_COLUMNS]
    closed = Closed(r["groups"], r["n_a"], r["n_b"], r["n_groups"], _unpacked(r["pairs"]), _unpacked(r["times"]))
    return Fragment(r["cut"], Tokens(*sides[:4]), closed, Tokens(*sides[4:]))


def _fragment_task(byte_vocabulary: str, piece_vocabulary: str, chunk_bytes: int, schema: T.StructType):
    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        units = Units(byte_vocabulary, piece_vocabulary)
        for batch in batches:
            for row in batch.to_pylist():
                run, _, equal = units.tokens_of([row["piece"]])
                begin, width = row["base"], len(row["piece"].encode())
                if not equal.all():
                    yield _batch([{"doc_key": row["doc_key"], "id": row["id"], "at": begin, "equal": False,
                                   **_to_row(fragment(no_tokens()))}], arrow)
                    continue
                run = run._replace(a_ends=run.a_ends + begin, b_ends=run.b_ends + begin)
                cuts = [begin, *range((begin // chunk_bytes + 1) * chunk_bytes, begin + width, chunk_bytes), begin + width]
                for start, end in zip(cuts, cuts[1:]):
                    yield _batch([{"doc_key": row["doc_key"], "id": row["id"], "at": start, "equal": True,
                                   **_to_row(fragment(run.cut(start, end)))}], arrow)
    return run


def _compose_group(schema: T.StructType):
    def run(table):
        from functools import reduce

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        whole = reduce(combine, map(_from_row, rows))
        row = {"doc_key": rows[0]["doc_key"], "id": rows[0]["id"], "at": rows[0]["at"], "equal": all(r["equal"] for r in rows)}
        return pa.Table.from_pylist([row | _to_row(whole)], schema=to_arrow_schema(schema))
    return run


def _finish_task(write_groups: Callable[[str], str], schema: T.StructType):
    """A long document and its block: one unit for each of its id pairs."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                whole = document(_from_row(row) if row["equal"] else fragment(no_tokens()))
                each = np.arange(len(whole.pairs), dtype="<u4").tobytes()
                block = -1 - row["doc_key"]
                yield _batch([
                    {"kind": 0, "doc_key": row["doc_key"], "id": row["id"], "block": block, "n_a": whole.n_a, "n_b": whole.n_b,
                     "n_groups": whole.n_groups, "n_links": int(whole.times.sum()),
                     "groups": write_groups(whole.groups) if whole.groups else "", "units": each, "unit_times": _packed(whole.times)},
                    {"kind": 1, "block": block, "unit_links": np.ones(len(whole.pairs), "<u4").tobytes(), "unit_pairs": each,
                     "pairs": _packed(whole.pairs), "times": _packed(whole.times)}], arrow)
    return run


def _long_documents(parts: DataFrame, id_type: T.DataType, byte_vocabulary: str, piece_vocabulary: str,
                    write_groups: Callable[[str], str], chunk_bytes: int) -> DataFrame | None:
    """The document and block rows of texts over ``chunk_bytes``, composed in a tree."""
    from pyspark.sql import Window
    pieces = parts.filter("kind = 2").select("doc_key", "id", "seq", F.octet_length("piece").alias("width"))
    longest = pieces.groupBy("doc_key").agg(F.sum("width").alias("w")).agg(F.max("w")).head()[0]
    if longest is None:
        return None
    before = Window.partitionBy("doc_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.select("doc_key", "seq", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("base"))   # a row per piece, no texts
    schema = _fragment_schema(id_type)
    dealt = (parts.filter("kind = 2").select("doc_key", "id", "seq", "piece").join(base, ["doc_key", "seq"])
             .repartition("doc_key", "seq"))
    whole = stage(dealt.mapInArrow(_fragment_task(byte_vocabulary, piece_vocabulary, chunk_bytes, schema), schema), "fragments")
    span = chunk_bytes
    while span <= longest:
        span *= FAN_IN
        whole = stage(whole.groupBy("doc_key", F.floor(F.col("at") / F.lit(span)).alias("range"))
                      .applyInArrow(_compose_group(schema), schema), "fragments")
    out = _parts_schema(id_type)
    return whole.mapInArrow(_finish_task(write_groups, out), out)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    schema = "block long, pair long, n long"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                pairs, times = _unpacked(row["pairs"]), _unpacked(row["times"])
                for lo in range(0, len(pairs), 50_000):
                    part = pairs[lo:lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), row["block"], np.int64)), pa.array(part), pa.array(times[lo:lo + 50_000])],
                        names=["block", "pair", "n"])
    return blocks.select("block", "pairs", "times").mapInArrow(run, schema)


def _add_up(schema: T.StructType):
    """A block's documents with the corpus-wide counts of its pairs."""
    def run(left, right):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")
        total, best = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("total", "best"))
        out = []
        rows = left.to_pylist()
        block = next(r for r in rows if r["kind"] == 1)
        links = np.frombuffer(block["unit_links"], "<u4").astype(np.int64)
        pair = np.frombuffer(block["unit_pairs"], "<u4")
        ends = np.cumsum(links)
        sums = []
        for value in (best, total):
            running = np.concatenate(([0], np.cumsum(value[pair])))
            sums.append(running[ends] - running[ends - links])
        for r in rows:
            if r["kind"]:
                continue
            units = np.frombuffer(r["units"] or b"", "<u4")
            times = _unpacked(r["unit_times"]) if r["unit_times"] else 1
            out.append([r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"],
                        *(int((s[units] * times).sum()) for s in sums), r["groups"]])
        arrow = to_arrow_schema(schema)
        columns = list(zip(*out)) or [[]] * len(arrow)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return run


# ------------------------------------------------------------------ operator

def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_vocabulary: str = BYTE_VOCABULARY,
                 piece_vocabulary: str = PIECE_VOCABULARY, write_groups: Callable[[str], str] = str,
                 chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``id_col, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``. ``groups`` is ``write_groups`` of the document's group
    text (``a1,a2|b1;a3|b2,b3``), taken where the text lies."""
    id_type = docs.schema[id_col].dataType
    schema = _parts_schema(id_type)
    parts = stage(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
                  .mapInArrow(_align_task(byte_vocabulary, piece_vocabulary, write_groups, chunk_bytes, block_bytes, schema), schema),
                  "aligned")
    rows = parts.filter("kind < 2")
    longer = _long_documents(parts, id_type, byte_vocabulary, piece_vocabulary, write_groups, chunk_bytes)
    if longer is not None:
        rows = rows.unionByName(stage(longer, "aligned-long"))
    held = stage(_pair_rows(rows.filter("kind = 1")), "pairs")
    totals = stage(held.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    by_b = totals.groupBy((F.col("pair") % PAIR_BASE).alias("b")).agg(F.max("total").alias("most"))
    scored = stage(totals.withColumn("b", F.col("pair") % PAIR_BASE).join(by_b, "b")
                   .select("pair", "total", (F.col("total") == F.col("most")).cast("int").alias("best")), "pair-scores")
    wanted = held.select("block", "pair").join(scored, "pair")
    out = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups", T.StringType())])
    left = rows.select("kind", "id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "units", "unit_times",
                       "unit_links", "unit_pairs")
    return left.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_add_up(out), out)
