"""Training-data preparation: I1 (chunks), I2 (decode and re-encode), I3
(word-piece encoding of distinct words), I4 (left padding per batch), I5
(causal-LM collation), F1 (exact repeatable sample), B5 (rename).

Per-row work is done with array functions in the JVM, word pieces in Arrow
batches; the only shuffles are the batch windows (bounded by the batch size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code_points(text) -> Column:
    """Character ids of a text (the fixture's tokenised corpus)."""
    t = _c(text)
    return F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(t, ""), lambda ch: F.ascii(ch)))


def chunk_lengths(df: DataFrame, keys: list[str], length, context_length: int) -> DataFrame:
    """(keys, chunk_no, _n) of ``chunk_sequences`` from the sequence length
    alone, without building the chunks."""
    n = F.col(length) if isinstance(length, str) else length
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(context_length))).otherwise(F.array().cast("array<int>"))
    ex = df.select(*keys, n.alias("_len"), F.posexplode(starts).alias("chunk_no", "_start"))
    return ex.select(*keys, "chunk_no", F.least(F.lit(context_length), F.col("_len") - F.col("_start")).alias("_n"))


def chunk_sequences(df: DataFrame, keys: list[str], ids: str, context_length: int,
                    mask: str | None = None, packed: bool = False) -> DataFrame:
    """I1 ``group_texts``: one row per chunk of ``context_length`` ids (the last
    may be shorter; an empty sequence gives no row), with the mask sliced the
    same way (all ones when absent) and type ids of zeros as long as the chunk.
    ``packed``: ``ids`` is a text whose characters are the ids (``code_points``)
    and ``input_ids`` stays one, for a shuffle of a byte an id, not four."""
    count = F.length if packed else F.size
    size = count(ids)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(context_length))).otherwise(
        F.array().cast("array<int>"))
    ex = df.select(*keys, ids, *([mask] if mask else []), F.posexplode(starts).alias("chunk_no", "_start"))
    first = F.col("_start") + 1
    chunk = F.substr(F.col(ids), first, F.lit(context_length)) if packed else F.slice(ids, first, context_length)
    out = ex.withColumn("input_ids", chunk)
    m = F.slice(mask, first, context_length) if mask else F.array_repeat(F.lit(1), count("input_ids"))
    return out.select(*keys, "chunk_no", "input_ids", m.alias("attention_mask"),
                      F.array_repeat(F.lit(0), count("input_ids")).alias("token_type_ids"))


def pad_batches(df: DataFrame, order_cols: list[str], batch_size: int, ids: str, pad_id: int = 0,
                side: str = "left", max_length: int | None = None,
                lengths: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """I4 as a job: batches of ``batch_size`` rows in ``order_cols`` order.

    Ordinals and batch widths are computed on a narrow (keys, length) table;
    the wide id arrays are shuffled once, by the join that brings the width,
    and padded row-locally. ``lengths`` (keys + ``_n``, after the cut) may be
    given when it is cheaper to derive than the arrays themselves. ``packed``:
    ``ids`` is a text whose characters are the ids; it is shuffled as such and
    made an array after the join."""
    from tessera.operators.ordinals import batch_of, row_ordinals
    cut, count = (F.substring, F.length) if packed else (F.slice, F.size)
    x = cut(ids, 1, max_length) if max_length else F.col(ids)
    lens = lengths if lengths is not None else df.select(*order_cols, count(x).alias("_n"))
    o = row_ordinals(lens, order_cols).withColumn("batch_id", batch_of("rn", batch_size))
    widths = o.withColumn("_w", F.max("_n").over(Window.partitionBy("batch_id"))).select(*order_cols, "batch_id", "_w")
    t = df.withColumn(ids, x).join(widths, order_cols).withColumn("_n", count(ids))
    if packed:
        t = t.withColumn(ids, code_points(ids))
    pad = F.array_repeat(F.lit(pad_id), F.col("_w") - F.col("_n"))
    zeros = F.array_repeat(F.lit(0), F.col("_w") - F.col("_n"))
    ones = F.array_repeat(F.lit(1), F.col("_n"))
    if side == "left":
        t = t.withColumn(ids, F.concat(pad, ids)).withColumn("attention_mask", F.concat(zeros, ones))
    else:
        t = t.withColumn(ids, F.concat(ids, pad)).withColumn("attention_mask", F.concat(ones, zeros))
    return t.drop("_n", "_w")


def collate_batches(df: DataFrame, order_cols: list[str], batch_size: int, ids: str, pad_id: int = 0,
                    lengths: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """I5 as a job (see ``pad_batches``): right padding, pads -> -100 labels."""
    t = pad_batches(df, order_cols, batch_size, ids, pad_id, side="right", lengths=lengths, packed=packed)
    return t.withColumn("labels", F.transform(ids, lambda v: F.when(v == pad_id, F.lit(-100)).otherwise(v)))


def rename_ids(df: DataFrame, old: str = "input_ids", new: str = "evnt") -> DataFrame:   # B5
    return df.withColumnRenamed(old, new)


def sample_exact(df: DataFrame, key: str, ratio: float, seed: str = "42", digits: int = 4) -> DataFrame:
    """exactly ``int(N * ratio)`` rows (ratio 0 = all), repeatable: those
    with the smallest md5(seed || key), rows of one key in the order of the md5
    of all their columns. A NULL key counts as an empty text.

    Not a global sort: the two hashes form one text of 64 hex digits. Level by
    level, the rows that share the digits of the cut so far are counted by
    their next ``digits`` digits (at most 16^digits counts reach the driver)
    until a count ends exactly at the cut; one or two levels do for distinct
    keys. Rows that agree in all digits are copies of each other, of which as
    many as needed are taken.
    """
    if ratio == 0:
        return df
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    first = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    hashed = df.withColumn("_h", F.concat(first, F.md5(F.concat_ws("\x1f", *cells))))
    total = df.count()
    need = int(total * ratio)
    if need >= total:
        return df
    bound, rest = "", need
    while rest and len(bound) < 64:
        level = F.substring("_h", len(bound) + 1, digits)
        inside = hashed.where(F.col("_h").startswith(bound)) if bound else hashed
        for digit, n in sorted(tuple(r) for r in inside.groupBy(level.alias("d")).count().collect()):
            if n > rest:
                bound += digit
                break
            rest -= n
            if not rest:
                return hashed.where(F.substring("_h", 1, len(bound) + digits) <= bound + digit).drop("_h")
    below = hashed.where(F.col("_h") < bound)
    if rest:                                                 # copies of one row
        copies = (hashed.where(F.col("_h") == bound).limit(1)
                  .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(rest)))).drop("_copy"))
        below = below.unionByName(copies)
    return below.drop("_h")


# --------------------------------------------------------------- word pieces
# BERT's punctuation: the four ASCII symbol ranges and Unicode P* (fixed rule).
PUNCT = r"[\p{P}!-/:-@\[-`{-~]"
WORD = r"[^\s\p{P}!-/:-@\[-`{-~]+"


def basic_words(text, keep_whole: str | None = None) -> Column:
    """Whitespace and punctuation split; ``keep_whole`` is a regex of added
    tokens that must not be split (matched first)."""
    alts = ([keep_whole] if keep_whole else []) + [WORD, PUNCT]
    return F.regexp_extract_all(_c(text), F.lit("(?:" + "|".join(alts) + ")"), 0)


def piece_trie(tokens) -> tuple[list[dict], list[int], list[list[str]]]:
    """Trie of a word-piece vocabulary with failure links, for longest matches
    in one walk over a word: per node its children by character, the node to
    go on from when no child fits (-1: the word has a gap), and the pieces that
    are then complete. Node 0 starts a word, node 1 what follows a piece."""
    known = set(tokens)
    children: list[dict] = [{}, {}]
    text, link, pops = ["", "##"], [-1, -1], [[], []]
    for token in sorted(known):
        inner = token.startswith("##") and len(token) > 2
        for root, rest in ((1, token[2:]), (0, token)) if inner else ((0, token),):
            node = root
            for c in rest:
                below = children[node].get(c)
                if below is None:
                    below = children[node][c] = len(children)
                    children.append({})
                    text.append(text[node] + c)
                    link.append(-1)
                    pops.append([])
                node = below
    level = [0, 1]
    while level:                                             # shorter nodes first
        after = []
        for node in level:
            for c, below in children[node].items():
                after.append(below)
                if text[below] in known:
                    link[below], pops[below] = 1, [text[below]]
                    continue
                at, done = link[node], list(pops[node])
                while at >= 0 and c not in children[at]:
                    done += pops[at]
                    at = link[at]
                if at >= 0:
                    link[below], pops[below] = children[at][c], done
        level = after
    return children, link, pops


def longest_pieces(word: str, trie, max_chars: int, unk) -> list:
    """Greedy longest-match-first pieces of one word ('##' after the first), in
    time linear in the word; a word with a gap, or longer than ``max_chars``
    (the tokenizer's rule), is ``unk``."""
    if len(word) > max_chars:
        return [unk]
    children, link, pops = trie
    node, out = 0, []
    for c in word:
        below = children[node].get(c)
        while below is None:
            out += pops[node]
            node = link[node]
            if node < 0:
                return [unk]
            below = children[node].get(c)
        node = below
    while node != 1:
        if link[node] < 0:
            return [unk] if word else []
        out += pops[node]
        node = link[node]
    return out


#: Words a task remembers the pieces of, and rows whose distinct words it makes Python values of at once.
KNOWN_WORDS = 1 << 16
ENCODE_ROWS = 1024


def _pieces_of_rows(words, pieces, max_length: int | None = None):
    """Offsets and numbers of the pieces of rows of words (an Arrow list
    array), each row cut to ``max_length``. Arrow numbers the distinct words;
    ``pieces(word)`` is asked once for each."""
    from itertools import chain

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy()
    found = [pieces(w) for w in coded.dictionary.to_pylist()]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
    of_word = counts[which]
    ends = np.append(0, np.cumsum(of_word))
    at = np.repeat((np.cumsum(counts) - counts)[which] - ends[:-1], of_word) + np.arange(ends[-1])
    row_ends = ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy()))]
    of_row = np.diff(row_ends)
    if max_length:
        at = at[np.arange(len(at)) - np.repeat(row_ends[:-1], of_row) < max_length]
        of_row = np.minimum(of_row, max_length)
    return pa.array(np.append(0, np.cumsum(of_row)).astype(np.int32)), pa.array(flat[at])


def wordpiece_encode(texts: DataFrame, keys: list[str], text: str, vocab: DataFrame,
                     keep_whole: str | None = None, unk: str = "[UNK]", unk_id: int | None = None,
                     max_length: int | None = None, max_chars: int = 100, max_vocab: int = 1_000_000,
                     tasks: int | None = None) -> DataFrame:
    """Texts -> keys + ``tokens`` + ``ids``, cut to ``max_length``.

    The words are split in the JVM; their pieces are found where the text
    lies, in Arrow batches that remember ``KNOWN_WORDS`` words, ``ENCODE_ROWS``
    texts at a time, so no text or word is shuffled and a task's Python holds
    as much whatever the table. The distinct words of these texts are looked up
    once each, and the rows are put together as arrays. The vocabulary's trie is
    built once and broadcast: it may have at
    most ``max_vocab`` tokens, the limit a tokenizer is trained to; more is an
    error. ``tasks`` deals the texts to that many tasks first, for inputs of
    few large splits.
    """
    rows = vocab.select("token", "id").limit(max_vocab + 1).collect()
    if len(rows) > max_vocab:
        raise ValueError(f"a word-piece vocabulary of more than {max_vocab} tokens")
    ids = {r["token"]: r["id"] for r in rows}
    names = list(dict.fromkeys([*ids, unk]))                 # a piece is its place here until it is written
    place = {t: k for k, t in enumerate(names)}
    children, link, pops = piece_trie(ids)
    sent = texts.sparkSession.sparkContext.broadcast((
        (children, link, [[place[t] for t in p] for p in pops]), place[unk], names, [ids.get(t, unk_id) for t in names]))
    schema = (texts.select(*keys).schema.add("tokens", T.ArrayType(T.StringType()))
              .add("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        import pyarrow as pa
        trie, gap, names, ids = sent.value
        tokens, numbers = pa.array(names, pa.string()), pa.array(ids, pa.int32())
        known: dict[str, tuple] = {}

        def pieces(word: str) -> tuple:
            found = known.get(word)
            if found is None:
                found = tuple(longest_pieces(word, trie, max_chars, gap))
                if len(word) <= max_chars:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[word] = found
            return found

        for whole in batches:
            for lo in range(0, whole.num_rows, ENCODE_ROWS):
                batch = whole.slice(lo, ENCODE_ROWS)
                offsets, out = _pieces_of_rows(batch.column(len(keys)), pieces, max_length)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keys)], *(pa.ListArray.from_arrays(offsets, x.take(out)) for x in (tokens, numbers))],
                    names=schema.names)

    dealt = texts.repartition(tasks) if tasks else texts
    words = basic_words(text, keep_whole)
    if max_length:                                           # a word has a piece at least
        words = F.slice(words, 1, max_length)
    return dealt.select(*keys, words.alias("words")).mapInArrow(run, schema)


def piece_vocabulary(trained: DataFrame, unk: str = "[UNK]") -> DataFrame:
    """``token, id`` for I3 from a trained byte-level vocabulary (I6): a token
    that began with a space starts a word, any other continues one; tokens of
    characters outside ASCII or of white space alone are left out. All letters
    and digits met are in it in both places. ``unk`` is number 0."""
    ascii_only = trained.where(F.col("token").rlike(r"^\u0120?[!-~]+$"))
    starts = ascii_only.where(F.col("token").startswith("\u0120")).select(F.expr("substring(token, 2)").alias("token"))
    inner = ascii_only.where(~F.col("token").startswith("\u0120")).select("token")
    marked = inner.select(F.concat(F.lit("##"), "token").alias("token"))
    single = inner.where(F.length("token") == 1)
    all_of_them = starts.unionByName(marked).unionByName(single).where(F.col("token") != unk).distinct()
    order = Window.orderBy("token")                          # at most the vocabulary's size
    rows = all_of_them.select("token", F.row_number().over(order).alias("id"))
    return rows.unionByName(trained.sparkSession.createDataFrame([(unk, 0)], "token string, id int"))
