"""Near-duplicate vectors by spherical-cap filters.

A filter is a cap of the sphere: the vectors whose product with the filter's
direction is at least a limit. Directions come from random product codes:
after a random rotation the dimensions are cut into two halves, each with
``codes`` random unit vectors, and a direction is one of each, so ``codes ** 2``
directions cost ``2 codes`` products. List decoding finds all directions a
vector exceeds: a first half is tried only if the best second half could still
lift it over the limit. Up to ``ROTATIONS`` independent codes even out the
number of caps a vector lies in.

The caps follow the data. ``codes`` grows with the root of the distinct vectors
of a label, so the rows of a cap stay at some ``ROWS_PER_CAP`` while labels
grow, within ``MIN_CODES``, ``MAX_CODES`` and what few dimensions can tell apart. The limit is fitted for each length of vector and
code (``fitted_limit``): the largest at which ``PAIRS`` random pairs at exactly
the wanted cosine share a cap, less ``MARGIN / sqrt(d)``; of 8,000 other such
pairs none was missed at 64, 16, 4 and 2 dimensions. So it is right for 2 dimensions
as for 768, and closer pairs share more caps. Vectors of one label that share a
cap are compared by cosine in double precision.

Equal vectors are one row with a count from the start. A cap with more than
``CELL`` rows is dealt as a grid of cells over several tasks. A pair that
shares several caps counts in the first of them only, so a cap returns counts
per vector and a spanning forest of its links, never its pairs.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, and vectors without a label, link with nothing; vectors
of different lengths do not link; rows that repeat a vector link with each
other, also when they repeat the identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage
from tessera.llm.components import component_roots, merge_labels

MIN_COSINE = 0.93
ROTATIONS = 16
ROWS_PER_CAP = 64
CAPS_PER_VECTOR = 50                                         # about; used to choose the length of the code only
MIN_CODES, MAX_CODES = 16, 512
PAIRS = 1000
MARGIN = 0.15
CELL = 4096
QUERY, TARGET = 1, 2


def product_codes(dimensions: int, codes: int, rotations: int = ROTATIONS):
    """[(rotation, (first codes, second codes))] with directions of length 1;
    under five dimensions fewer rotations do."""
    import numpy as np
    out = []
    for r in range(min(rotations, max(1, 4 * (dimensions - 1)))):
        rng = np.random.default_rng([11, r, dimensions])
        rotation, _ = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))
        halves = []
        for size in (dimensions - dimensions // 2, dimensions // 2):
            c = rng.normal(size=(codes, max(size, 1)))[:, :size]
            halves.append(c / (np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) * np.sqrt(2)))
        out.append((rotation, tuple(halves)))
    return out


def fitted_limit(dimensions: int, codes: int, min_cosine: float = MIN_COSINE, pairs: int = PAIRS, margin: float = MARGIN) -> float:
    """The limit at which simulated pairs at exactly ``min_cosine`` share a cap."""
    import numpy as np
    rng = np.random.default_rng([12, dimensions, codes])
    x, z = rng.normal(size=(2, pairs, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    y = min_cosine * x + np.sqrt(1 - min_cosine ** 2) * z
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    best = np.full(pairs, -1.0)
    for rotation, (first, second) in product_codes(dimensions, codes):
        cut = first.shape[1]
        halves = [((u @ rotation)[:, :cut] @ first.T, (u @ rotation)[:, cut:] @ second.T) for u in (x, y)]
        for lo in range(0, pairs, 16):
            least = np.minimum(*[a[lo:lo + 16, :, None] + b[lo:lo + 16, None, :] for a, b in halves])
            best[lo:lo + 16] = np.maximum(best[lo:lo + 16], least.reshape(len(least), -1).max(axis=1))
    return float(best.min() - margin / np.sqrt(dimensions))


def list_decode(unit, codes, limit: float):
    """(row, filter) arrays of all caps that hold the unit vectors, by row."""
    import numpy as np
    rows, filters = [], []
    for r, (rotation, (first, second)) in enumerate(codes):
        turned = unit @ rotation
        a, b = turned[:, :first.shape[1]] @ first.T, turned[:, first.shape[1]:] @ second.T
        row, head = np.nonzero(a >= limit - b.max(axis=1, keepdims=True))
        hit, tail = np.nonzero(a[row, head][:, None] + b[row] >= limit)
        rows.append(row[hit])
        filters.append((r * len(first) + head[hit]) * len(second) + tail)
    row, filter_ = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((filter_, row))
    return row[order], filter_[order].astype(np.int32)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col("vec")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"),
                          vectors[vector_col].alias("vec")).withColumn(
        "fit", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))


def _fitted(classes: DataFrame, min_cosine: float) -> DataFrame:
    """``classes`` with the code length and cap limit of each row's label and dimensions."""
    d = F.size("vec")
    wanted = F.sqrt(F.col("rows") * F.lit(CAPS_PER_VECTOR / (ROWS_PER_CAP * ROTATIONS)))
    length = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(wanted, F.lit(MIN_CODES)))))
    sizes = classes.groupBy("label", d.alias("d")).agg(F.count("*").alias("rows")).select(
        "label", "d", F.least(length, F.floor(F.col("d") * F.col("d") / 2) + 1, F.lit(MAX_CODES)).cast("int").alias("codes"))
    sizes = stage(sizes.withColumn("codes", F.greatest("codes", F.lit(2))), "cap-sizes")

    def fit(frames: Iterator) -> Iterator:
        for frame in frames:
            yield frame.assign(limit=[fitted_limit(d, c, min_cosine) for d, c in zip(frame["d"].tolist(), frame["codes"].tolist())])

    limits = stage(sizes.select("d", "codes").distinct().mapInPandas(fit, "d int, codes int, limit double"), "cap-limits")
    return classes.withColumn("d", d).join(sizes.join(limits, ["d", "codes"]), ["label", "d"]).drop("d")


def _capped(classes: DataFrame, with_vectors: bool) -> DataFrame:
    """One row per class and cap; ``caps`` is the class's whole list."""
    label_type = classes.schema["label"].dataType
    fields = [T.StructField("label", label_type), T.StructField("cap", T.IntegerType()), T.StructField("no", T.LongType())]
    if with_vectors:
        fields += [T.StructField("n", T.LongType()), T.StructField("vec", classes.schema["vec"].dataType),
                   T.StructField("caps", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        codes = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                size = np.diff(part.column(3).offsets.to_numpy())
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                begin = np.cumsum(size) - size
                length, limit = part.column(4).to_numpy(), part.column(5).to_numpy()
                for d, c in np.unique(np.stack((size, length)), axis=1).T.tolist():
                    which = np.flatnonzero((size == d) & (length == c))
                    if (d, c) not in codes:
                        codes[d, c] = product_codes(d, c)
                    x = flat[begin[which, None] + np.arange(d)]
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    row, cap = list_decode(x, codes[d, c], limit[which[0]])
                    take = pa.array(which[row])
                    columns = [part.column(0).take(take), pa.array(cap), part.column(1).take(take)]
                    if with_vectors:
                        per = np.bincount(row, minlength=len(which))
                        ends = np.append(0, np.cumsum(per)).astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cap))
                        columns += [part.column(2).take(take), part.column(3).take(take), lists.take(pa.array(row))]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return classes.select("label", "no", "n", "vec", "codes", "limit").mapInArrow(run, schema)


def _joined(held, k: int):
    """(starts, values) of the lists of several parts; part[k] and part[k + 1]
    are the starts and values of one."""
    import numpy as np
    values = np.concatenate([part[k + 1][part[k][0]:part[k][-1]] for part in held])
    sizes = np.concatenate([np.diff(part[k]) for part in held])
    return np.append(0, np.cumsum(sizes)), values


def _share(u, v, lists):
    """Per pair ``(u[i], v[i])`` of places in ``lists`` (sorted arrays of
    caps): have the two a cap in common? Few pairs look their caps up, dense
    groups go through products of blocks of the membership matrix."""
    import numpy as np
    size = np.array([len(c) for c in lists])
    flat = np.concatenate(lists)
    shared = np.zeros(len(u), bool)
    if not len(flat):
        return shared
    names, column = np.unique(flat, return_inverse=True)
    rows = np.repeat(np.arange(len(lists)), size)
    begin = np.cumsum(size) - size
    some, place = np.unique(u, return_inverse=True)
    if size[u].sum() * 2000 <= len(some) * len(lists) * len(names):
        held = rows * len(names) + column                    # sorted, as rows and lists are
        step = max(1, (1 << 21) // max(1, int(size.max())))
        for lo in range(0, len(u), step):
            a, b = u[lo:lo + step], v[lo:lo + step]
            pair = np.repeat(np.arange(len(a)), size[a])
            within = np.arange(len(pair)) - np.repeat(np.cumsum(size[a]) - size[a], size[a])
            looked = b[pair] * len(names) + column[begin[a][pair] + within]
            at = np.minimum(np.searchsorted(held, looked), len(held) - 1)
            shared[lo + pair[held[at] == looked]] = True
        return shared
    common = np.zeros((len(some), len(lists)), bool)
    for lo in range(0, len(names), 2048):
        inside = (column >= lo) & (column < lo + 2048)
        block = np.zeros((len(lists), 2048), np.float32)
        block[rows[inside], column[inside] - lo] = 1
        common |= block[some] @ block.T > 0
    return common[place, v]


def _cell_links(x, no, n, caps, cap: int, role, min_cosine: float):
    """Of one cell: the links counted here by row, and forest links (a, b).
    ``caps`` gives the caps of a row."""
    import numpy as np
    query, target = np.flatnonzero(role & QUERY), np.flatnonzero(role & TARGET)
    label = np.arange(len(no))
    counted = np.zeros(len(no), np.int64)
    step = max(1, (1 << 22) // max(1, len(target)))
    for lo in range(0, len(query), step):
        some = query[lo:lo + step]
        u, v = np.nonzero((x[some] @ x[target].T >= min_cosine) & (no[some][:, None] != no[target][None, :]))
        if not len(u):
            continue
        u, v = some[u], target[v]
        merge_labels(label, u, v)
        # a pair counts in its first common cap: look for an earlier one
        members = np.unique(np.concatenate((u, v)))
        earlier = [c[c < cap] for c in map(caps, members.tolist())]
        shared = _share(np.searchsorted(members, u), np.searchsorted(members, v), earlier)
        counted += np.bincount(u[~shared], n[v[~shared]], len(no)).astype(np.int64)
    child = np.flatnonzero(label != np.arange(len(no)))
    return counted, no[child], no[label[child]]


def _links(classes: DataFrame, min_cosine: float) -> DataFrame:
    """Staged ``a, b, links``: forest links (links null) and link counts of
    class ``a`` (b null)."""
    crowded = stage(_capped(classes, False).groupBy("label", "cap").agg(F.count("*").alias("rows"))
                    .filter(F.col("rows") > CELL).select("label", "cap", F.ceil(F.col("rows") / CELL).cast("int").alias("g")),
                    "crowded-caps")
    rows = _capped(classes, True).join(crowded, ["label", "cap"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    own = F.pmod(F.xxhash64("no"), F.col("g")).cast("int")
    cells = F.when(F.col("g") == 1, F.array(F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(QUERY | TARGET).alias("role"))))
    cells = cells.otherwise(F.concat(
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda c: F.struct(own.alias("r"), c.alias("c"), F.lit(QUERY).alias("role"))),
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda r: F.struct(r.alias("r"), own.alias("c"), F.lit(TARGET).alias("role")))))
    dealt = (rows.withColumn("cell", F.explode(cells))
             .select(F.xxhash64("label", "cap", "cell.r", "cell.c").alias("key"), "label", "cap", "cell.r", "cell.c", "cell.role",
                     "no", "n", "vec", "caps")
             .repartition("key").sortWithinPartitions("label", "cap", "r", "c"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held, key = [], None

        def emit():
            no, n, role = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
            (vec_at, vec), (caps_at, caps) = _joined(held, 3), _joined(held, 5)
            size = np.diff(vec_at)
            a, b, count = [], [], []
            for d in np.unique(size).tolist():
                some = np.flatnonzero(size == d)
                x = vec[vec_at[some, None] + np.arange(d)].astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                counted, child, root = _cell_links(x, no[some], n[some], lambda k: caps[caps_at[some[k]]:caps_at[some[k] + 1]],
                                                   key[1], role[some], min_cosine)
                hit = np.flatnonzero(counted)
                a += [no[some][hit], child]
                b += [np.full(len(hit), -1), root]
                count += [counted[hit], np.zeros(len(child), np.int64)]
            a, b, count = (np.concatenate(z).astype(np.int64) for z in (a, b, count))
            return pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b, mask=b < 0), pa.array(count, mask=b >= 0)], names=["a", "b", "links"])

        for batch in batches:
            names = batch.schema.names
            col = {name: batch.column(names.index(name)) for name in names}
            cap, r, c = (col[k].to_numpy() for k in ("cap", "r", "c"))
            hashed, no, n, role = (col[k].to_numpy() for k in ("key", "no", "n", "role"))
            vec_at, vec = col["vec"].offsets.to_numpy(), col["vec"].values.to_numpy(zero_copy_only=False)
            caps_at, caps = col["caps"].offsets.to_numpy(), col["caps"].values.to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(hashed) != 0) | (np.diff(cap) != 0) | (np.diff(r) != 0)
                                                      | (np.diff(c) != 0))), len(cap))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                now = (hashed[lo], cap[lo], r[lo], c[lo])
                if held and now != key:
                    yield emit()
                    held = []
                key = now
                held.append((no[lo:hi], n[lo:hi], role[lo:hi], vec_at[lo:hi + 1], vec, caps_at[lo:hi + 1], caps))
        if held:
            yield emit()

    return stage(dealt.mapInArrow(run, "a long, b long, links long"), "vector-links")


def vector_groups(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                  label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``."""
    rows = _usable(vectors, id_col, vector_col, label_col)
    classes = stage(rows.filter("fit").groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("n"))
                    .withColumn("no", F.monotonically_increasing_id()), "vector-classes")
    found = _links(stage(_fitted(classes, min_cosine), "fitted-classes"), min_cosine)
    roots = component_roots(found.filter("b is not null"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("no")).agg(F.sum("links").alias("links"))
    rooted = stage(classes.join(counts, "no", "left").join(roots, F.col("no") == F.col("node"), "left")
                   .select("label", "vec", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                           F.coalesce("root", "no").alias("root")), "vector-roots")
    names = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "vector-components")
    named = stage(rooted.join(names, "root").select("label", "vec", "n_links", "component_id"), "vector-names")
    linked = rows.filter("fit").join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.filter(~F.col("fit")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (linked.unionByName(alone)
            .select(F.col("id").alias(id_col), "n_links", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
