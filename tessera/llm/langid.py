"""Language identification of words by a linear-chain conditional random field.

Every word of a text gets a label. Its emission score adds learned weights of
its affixes (up to three letters), its letter trigrams and its entry in the
lexicon of the training sample; learned transitions join neighbours, so the
words of one language hold together and code-switched text is split where it
switches. Forward-backward gives each word's posterior over the labels; a
document's language is the label with the greatest mean posterior over its
words with letters, and that mean is its score: the share of the main language
in code-switched text. How sure the labels are, whatever their mixture, is the
certainty: the mean of each word's own greatest posterior. The word labels
come out as spans, runs of white-space separated words with one label.

Training (maximum likelihood with a Gaussian prior) uses at most
``per_label`` labelled documents of each language, chosen by a seeded hash,
and at most ``snippet_words`` words from a random place of each. Snippets of
different documents are strung together into sequences, which is where the
transitions between languages are learned. The sample bound is the parameter;
prediction covers every whole text, in blocks of ``BLOCK`` words that run in
lockstep and are joined exactly by their transfer matrices; memory is linear in
the longest single text.

Defined results: null texts and texts without a letter are ``und`` with score
0; with no labelled document at all every text is ``und``; words without
letters are neutral and do not count, and lie in the span their neighbours
give them; ``und`` texts have no spans; ties go to the label first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
PER_LABEL = 600
SNIPPET_WORDS = 60
BLOCK = 256
CACHE_WORDS = 300_000
BYTES_AT_ONCE = 2 << 20


class Field(NamedTuple):
    """A trained model: labels, feature rows, weights by row, transition scores."""
    labels: list
    rows: dict
    weights: object
    transitions: object


def word_features(word: str) -> list[str]:
    """Affixes, letter trigrams and lexicon entry of a lower-case word; none
    for a word without letters."""
    core = word if word.isalpha() else "".join(filter(str.isalpha, word))
    if not core:
        return []
    n = len(core)
    found = ["=" + core]
    for k in range(1, min(3, n) + 1):
        found.append("<" + core[:k])
        found.append(">" + core[n - k:])
    found += [core[i:i + 3] for i in range(n - 2)]
    return found


# ---- forward-backward over many chains in lockstep --------------------------

def _active(sizes):
    """Chains still running at every step; chains are sorted longest first."""
    import numpy as np
    return np.searchsorted(-sizes, -np.arange(int(sizes.max())), side="left").tolist()


def _chain_posteriors(emit, sizes, link, enter, leave):
    """Posteriors of chains in lockstep, longest first. emit: (steps, chains,
    labels), scores as factors; link: (labels, labels) factors; enter: message
    into each chain's first step; leave: message from what follows its last."""
    import numpy as np
    out = np.empty_like(emit)
    active = _active(sizes)
    message = enter.copy()
    for t, m in enumerate(active):
        here = message[:m] * emit[t, :m]
        here /= here.sum(axis=1, keepdims=True)
        out[t, :m] = here
        message = here @ link
    message = leave.copy()
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        both = out[t, :m] * message[:m]
        out[t, :m] = both / both.sum(axis=1, keepdims=True)
        before = (message[:m] * emit[t, :m]) @ link.T
        message[:m] = before / before.sum(axis=1, keepdims=True)
    return out


def _transfer(emit, sizes, link):
    """diag(emit 1) link diag(emit 2) ... link diag(emit n) of each chain, scaled."""
    import numpy as np
    product = np.broadcast_to(np.eye(emit.shape[2]), (emit.shape[1], *link.shape)).copy()
    for t, m in enumerate(_active(sizes)):
        moved = (product[:m] @ link if t else product[:m]) * emit[t, :m, None, :]
        product[:m] = moved / moved.sum(axis=(1, 2), keepdims=True)
    return product


def posteriors(scores, lengths, transitions):
    """Word posteriors of consecutive texts. scores: (words, labels), lengths:
    words of each text (all positive)."""
    import numpy as np
    link = np.exp(transitions - transitions.max())
    factors = np.exp(scores - scores.max(axis=1, keepdims=True))
    first = np.cumsum(lengths) - lengths
    blocks = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), blocks)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[text] + rank * BLOCK
    size = np.minimum(BLOCK, first[text] + lengths[text] - start)
    order = np.argsort(-size, kind="stable")
    text, rank, start, size = text[order], rank[order], start[order], size[order]
    inside = np.arange(int(size.max()))[:, None] < size[None, :]
    where = (start[None, :] + np.arange(int(size.max()))[:, None])[inside]
    emit = np.ones((*inside.shape, scores.shape[1]))
    emit[inside] = factors[where]
    enter, leave = np.ones((len(text), scores.shape[1])), np.ones((len(text), scores.shape[1]))
    if (blocks > 1).any():
        # exact messages between the blocks of one text
        longer = np.flatnonzero(blocks[text] > 1)            # still longest first
        core = np.zeros((len(text), *link.shape))
        core[longer] = _transfer(emit[:, longer], size[longer], link)
        place = np.zeros(len(text), np.int64)
        place[(np.cumsum(blocks) - blocks)[text] + rank] = np.arange(len(text))
        after = np.where(rank + 1 < blocks[text], place[np.minimum((np.cumsum(blocks) - blocks)[text] + rank + 1, len(text) - 1)], -1)
        for r in range(int(blocks.max()) - 1):
            here = np.flatnonzero((rank == r) & (after >= 0))
            message = (enter[here][:, None, :] @ core[here] @ link)[:, 0]
            enter[after[here]] = message / message.sum(axis=1, keepdims=True)
        for r in range(int(blocks.max()) - 2, -1, -1):
            here = np.flatnonzero((rank == r) & (after >= 0))
            message = (link @ core[after[here]] @ leave[after[here]][:, :, None])[:, :, 0]
            leave[here] = message / message.sum(axis=1, keepdims=True)
    out = np.empty_like(factors)
    out[where] = _chain_posteriors(emit, size, link, enter, leave)[inside]
    return out


# ---- training ----------------------------------------------------------------

def train(texts: list[tuple[str, str]], snippet_words: int = SNIPPET_WORDS, rounds: int = 60, prior: float = 1e-3,
          seed: int = 7) -> Field:
    """Fit on (text, label) pairs; each text is taken whole."""
    import numpy as np
    labels = sorted({label for _, label in texts})
    rng = np.random.default_rng(seed)
    number = {label: i for i, label in enumerate(labels)}
    snippets = []
    for text, label in texts:
        words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
        cuts = np.sort(rng.integers(0, len(words) + 1, 2)) if len(words) > 24 else (0, 0)
        for part in (words[:cuts[0]], words[cuts[0]:cuts[1]], words[cuts[1]:]):
            if part:
                snippets.append((part, number[label]))
    order = rng.permutation(len(snippets))
    words, truth, lengths = [], [], []
    for lo in range(0, len(order), 3):                       # three snippets of any language to a sequence
        before = len(words)
        for k in order[lo:lo + 3]:
            words += snippets[k][0]
            truth += [snippets[k][1]] * len(snippets[k][0])
        lengths.append(len(words) - before)
    if not words:
        return Field(labels, {}, np.zeros((1, len(labels))), np.zeros((len(labels), len(labels))))
    number_of = {w: i for i, w in enumerate(dict.fromkeys(words))}
    tokens = np.array([number_of[w] for w in words], np.int64)
    features = [word_features(w) for w in number_of]         # once per distinct word
    seen: dict[str, int] = {}
    for found, n in zip(features, np.bincount(tokens).tolist()):
        for f in found:
            seen[f] = seen.get(f, 0) + n
    rows = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    ids = [[rows[f] for f in found if f in rows] for found in features]
    per_word = np.array([len(found) for found in ids], np.int64)
    known = np.fromiter((i for found in ids for i in found), np.int64, int(per_word.sum()))
    n_of = per_word[tokens]
    owner = np.repeat(np.arange(len(words)), n_of)
    flat = known[(np.cumsum(per_word) - per_word)[tokens][owner] + np.arange(len(owner)) - (np.cumsum(n_of) - n_of)[owner]]
    del features, seen, ids
    truth, lengths = np.array(truth), np.array(lengths)
    n_words, k = len(words), len(labels)
    hot = np.eye(k)[truth]
    inner = np.ones(n_words, bool)
    inner[np.cumsum(lengths) - 1] = False
    inner = np.flatnonzero(inner)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (truth[inner], truth[inner + 1]), 1)
    theta = np.zeros((len(rows), k)), np.zeros((k, k))
    moment = [[np.zeros_like(x) for x in theta] for _ in range(2)]
    for step in range(1, rounds + 1):
        scores = np.stack([np.bincount(owner, theta[0][flat, j], n_words) for j in range(k)], axis=1)
        p = posteriors(scores, lengths, theta[1])
        rest = hot - p
        gradient = [np.stack([np.bincount(flat, rest[owner, j], len(rows)) for j in range(k)], axis=1) / n_words]
        # expected transitions from neighbouring posteriors and the pairwise factor
        link = np.exp(theta[1])
        factors = np.exp(scores - scores.max(axis=1, keepdims=True))
        joint = _pair_expectation(factors, p, link, inner)
        gradient.append((gold_pairs - joint) / n_words)
        for x, g, m, v in zip(theta, gradient, *moment):
            g = g - prior * x / n_words
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Field(labels, rows, np.asarray(theta[0], np.float64), theta[1])


def _pair_expectation(factors, p, link, inner):
    """Expected transition counts. With the posteriors p, the forward message
    of a word is recovered up to scale from p of its neighbour: the joint of
    (t, t + 1) is q(t) link q'(t + 1) with margins p(t) and p(t + 1), found by
    iterative proportional fitting, which keeps the odds ratios of ``link``."""
    import numpy as np
    left, right = p[inner], p[inner + 1]
    joint = left[:, :, None] * link[None]
    for _ in range(8):
        joint *= (right / np.maximum(joint.sum(axis=1), 1e-300))[:, None, :]
        joint *= (left / np.maximum(joint.sum(axis=2), 1e-300))[:, :, None]
    return joint.sum(axis=0)


def held_out(ident: Column) -> Column:
    """Whether a document is kept from training; a null identifier is."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_label: int = PER_LABEL, snippet_words: int = SNIPPET_WORDS) -> list[tuple[str, str]]:
    """At most ``per_label`` rows of every label, at most ``snippet_words``
    words of each, on the driver."""
    key = F.xxhash64(docs[id_col], F.lit("langid"))
    labelled = docs.filter(~held_out(docs[id_col]) & docs[lang_col].isNotNull())
    # a row per label, that is per class of the model; a label's share lets about four times the rows wanted through, of which the first stay
    counts = labelled.groupBy(docs[lang_col].alias("lang")).agg(F.count("*").alias("rows"))
    let_in = F.col("rows").cast("double") * F.shiftrightunsigned(F.col("key"), 11).cast("double") < F.lit(4.0 * per_label * 2 ** 53)
    usable = (labelled.select(docs[lang_col].alias("lang"), key.alias("key"), docs[text_col].alias("text"))
              .join(F.broadcast(counts), "lang").filter(let_in & F.col("text").rlike(r"\p{L}")))
    chosen = (usable.select("lang", "key")
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
              .filter(F.col("n") <= per_label).select("lang", "key").distinct())
    rows = (usable.select("lang", "key", F.split(F.trim("text"), r"\s+").alias("w"))
            .join(F.broadcast(chosen), ["lang", "key"], "left_semi")      # per_label rows a label at most
            .select("lang", "key", "w", (F.pmod(F.xxhash64("key"), F.greatest(F.size("w") - snippet_words + 1, F.lit(1)))
                                         + 1).cast("int").alias("at"))
            .select("lang", "key", F.array_join(F.slice("w", F.col("at"), snippet_words), " ").alias("text"))
            .dropDuplicates(["lang", "key"]))
    return sorted((r["text"], r["lang"]) for r in rows.collect())


# ---- prediction --------------------------------------------------------------

class _Scorer:
    """Emission scores of words, remembered up to CACHE_WORDS words."""

    def __init__(self, model: Field):
        import numpy as np
        self.model, self.known = model, {}
        self.table = np.zeros((1024, len(model.labels)))
        self.letters = np.zeros(1024, bool)
        self.used = 0

    def numbers(self, words: list[str]):
        import numpy as np
        if self.used > CACHE_WORDS:
            self.known, self.used = {}, 0
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            fresh = [w for w in dict.fromkeys(words) if w not in known]
            self._learn(fresh)
            found = list(map(known.__getitem__, words))
        return np.array(found, np.int64)

    def _learn(self, fresh):
        import numpy as np
        rows, weights = self.model.rows, self.model.weights
        n = self.used + len(fresh)
        if n > len(self.table):
            more = max(n, 2 * len(self.table))
            self.table = np.concatenate((self.table, np.zeros((more - len(self.table), self.table.shape[1]))))
            self.letters = np.concatenate((self.letters, np.zeros(more - len(self.letters), bool)))
        flat, owner = [], []
        for k, word in enumerate(fresh, self.used):
            features = word_features(word)
            self.letters[k] = bool(features)
            ids = [i for i in map(rows.get, features) if i is not None]
            flat += ids
            owner += [k - self.used] * len(ids)
            self.known[word] = k
        picked = weights[np.array(flat, np.int64)]
        owner = np.array(owner, np.int64)
        for j in range(self.table.shape[1]):
            self.table[self.used:n, j] = np.bincount(owner, picked[:, j], len(fresh))
        self.used = n


class Labelled(NamedTuple):
    """Of every text: label number or -1, score, certainty, and its spans from
    ``at[k]`` to ``at[k + 1]`` (label number, first word, words)."""
    best: object
    score: object
    certainty: object
    at: object
    spans: tuple


def label_text(scorer: _Scorer, texts: list[str | None]) -> Labelled:
    import numpy as np
    labels = scorer.model.labels
    nothing = np.zeros(0, np.int64)
    empty = Labelled(np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts) + 1, np.int64),
                     (nothing, nothing, nothing))
    if not labels:
        return empty
    words = [t.lower().split() if t else [] for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return empty
    numbers = scorer.numbers([x for k in some for x in words[k]])
    counts = scorer.letters[numbers]
    p = posteriors(scorer.table[numbers], lengths[some], scorer.model.transitions)
    told = p.argmax(axis=1)
    edges = np.cumsum(lengths[some]) - lengths[some]
    mass, n = np.add.reduceat(p * counts[:, None], edges), np.add.reduceat(counts.astype(np.int64), edges)
    sure = np.add.reduceat(p[np.arange(len(p)), told] * counts, edges) / np.maximum(n, 1)
    mean = mass / np.maximum(n, 1)[:, None]
    best, score, certainty = empty.best, empty.score, empty.certainty
    best[some] = np.where(n > 0, mean.argmax(axis=1), -1)
    score[some] = np.where(n > 0, np.minimum(mean.max(axis=1), 1.0), 0.0)
    certainty[some] = np.where(n > 0, np.minimum(sure, 1.0), 0.0)
    starts = np.append(True, told[1:] != told[:-1])
    starts[edges] = True
    first = np.flatnonzero(starts)
    owner = np.searchsorted(edges, first, side="right") - 1
    size = np.diff(np.append(first, len(told)))
    shown = n[owner] > 0
    first, owner, size = first[shown], owner[shown], size[shown]
    per_text = np.bincount(some[owner], minlength=len(texts))
    return Labelled(best, score, certainty, np.append(0, np.cumsum(per_text)), (told[first], first - edges[owner], size))


def slices_by_size(batch, column: int):
    """The batch in slices of about BYTES_AT_ONCE bytes of text, a text whole."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // BYTES_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.IntegerType()),
                                  T.StructField("n_words", T.IntegerType())]))


def predict(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """``id_col, lang_pred, score`` of every row, and with spans also
    ``certainty, spans`` (label, first word from 0, words)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    if with_spans:
        schema = schema.add("certainty", T.DoubleType()).add("spans", SPANS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        scorer = _Scorer(model)
        names = [*model.labels, UNDETERMINED]
        label_names = pa.array(model.labels, pa.string())
        for batch in batches:
            for rows in slices_by_size(batch, 1):
                found = label_text(scorer, rows.column(1).to_pylist())
                columns = [rows.column(0), pa.array([names[b] for b in found.best], pa.string()), pa.array(found.score)]
                if with_spans:
                    label, first, size = found.spans
                    parts = [label_names.take(pa.array(label, pa.int64())), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))]
                    spans = pa.StructArray.from_arrays(parts, names=["lang", "first_word", "n_words"])
                    columns += [pa.array(found.certainty), pa.ListArray.from_arrays(pa.array(found.at.astype(np.int32)), spans)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(docs[id_col], docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_label: int = PER_LABEL, with_spans: bool = False) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` (and ``certainty, spans``): train
    on the labelled documents that are not held out, predict all."""
    model = train(training_sample(docs, id_col, text_col, lang_col, per_label))
    found = predict(docs, model, id_col, text_col, with_spans)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), *found.columns[1:])


def accepted(docs: DataFrame, min_score: float, languages=None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_label: int = PER_LABEL) -> DataFrame:
    """The documents, all columns, whose words' languages are told with a
    certainty of at least ``min_score``, mixtures included (and whose main
    language is one of ``languages``, if given)."""
    model = train(training_sample(docs, id_col, text_col, lang_col, per_label))
    wanted = set(model.labels if languages is None else languages)
    at = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        scorer = _Scorer(model)
        for batch in batches:
            for rows in slices_by_size(batch, at):
                found = label_text(scorer, rows.column(at).to_pylist())
                keep = [b >= 0 and model.labels[b] in wanted and c >= min_score for b, c in zip(found.best, found.certainty)]
                yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
