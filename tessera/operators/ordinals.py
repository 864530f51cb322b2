"""Global ordinals and prefix sums without a single-partition window
(E4 batches, E5 shards, B9 row slices, and the cumulative counts of D14/E6),
and scans inside keys without a window per key (E1, E2, D8).

Two passes: range-partition by the order key and sort inside partitions,
checkpoint (so every later read sees the same partition of every row), count
per partition, turn the counts into offsets (a table with one row per
partition: a proven bound, broadcast), add the local position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

_LOCAL_BITS = (1 << 33) - 1   # monotonically_increasing_id: low 33 bits = row in partition


def _parts(df: DataFrame, num_parts: int | None) -> int:
    return num_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _staged(df: DataFrame, order_cols: list[str], num_parts: int | None) -> DataFrame:
    """Range partition + local position, written once (the partition of each
    row is then fixed for every later read, whatever gets recomputed)."""
    staged = (df.repartitionByRange(_parts(df, num_parts), *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))))
    return materialize(staged, "ordinals")


def _offsets(per_part: DataFrame, value_cols: list[str]) -> DataFrame:
    """Exclusive running totals over the partition table (one row per
    partition, so the unpartitioned window here is bounded)."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cols = [F.col("_part")]
    for v in value_cols:
        cols.append(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_off_{v}"))
        cols.append(F.sum(v).over(everything).alias(f"_all_{v}"))
    return per_part.select(*cols)


def row_ordinals(df: DataFrame, order_cols: list[str], col: str = "rn",
                 total_col: str | None = None, num_parts: int | None = None) -> DataFrame:
    """1-based global row number by ``order_cols`` (a unique key), equal to
    ``row_number() OVER (ORDER BY order_cols)``. ``total_col`` adds N. The rows
    are staged whole (written once): number narrow frames."""
    staged = _staged(df, order_cols, num_parts)
    counts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    off = F.broadcast(_offsets(counts, ["n"]))
    out = staged.join(off, "_part").withColumn(col, (F.col("_off_n") + F.col("_local") + 1).cast("long"))
    if total_col:
        out = out.withColumn(total_col, F.col("_all_n").cast("long"))
    return out.drop("_part", "_local", "_off_n", "_all_n")


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                num_parts: int | None = None, suffix: str = "_before") -> DataFrame:
    """Adds ``<v>_before`` = sum of ``v`` over all rows strictly before in
    ``order_cols`` order (unique key), and ``<v>_total``."""
    staged = _staged(df, order_cols, num_parts)
    w = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_loc_{v}") for v in value_cols])
    per_part = staged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in value_cols])
    off = F.broadcast(_offsets(per_part, value_cols))
    out = local.join(off, "_part")
    for v in value_cols:
        out = (out.withColumn(f"{v}{suffix}", F.col(f"_off_{v}") + F.col(f"_loc_{v}"))
               .withColumn(f"{v}_total", F.col(f"_all_{v}")))
    drop = ["_part", "_local"] + [f"_{k}_{v}" for v in value_cols for k in ("loc", "off", "all")]
    return out.drop(*drop)


def segmented_sums(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                   num_parts: int | None = None, suffix: str = "_upto") -> DataFrame:
    """Adds ``<v>_upto`` = sum of ``v`` (NULL: 0) over the rows of the same key
    up to and with this one, in ``order_cols`` order.

    Rows are range-partitioned by key and order, so a key of any size spreads
    over partitions; a window holds the rows of one key in one partition. What
    the key has before that partition is carried in. Ranges are sorted, so a
    partition continues one key at most: the carries are one row per partition
    at most and are broadcast."""
    staged = _staged(df, [*keys, *order_cols], num_parts)
    value = {v: F.coalesce(F.col(v), F.lit(0)) for v in value_cols}
    inside = Window.partitionBy("_part", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.select("*", *[F.sum(c).over(inside).alias(f"_loc_{v}") for v, c in value.items()])
    held = staged.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_sum_{v}") for v, c in value.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = held.select(F.col("_part").alias("_to"), *[F.col(k).alias(f"_key_{k}") for k in keys],
                        F.count(F.lit(1)).over(earlier).alias("_parts_before"),
                        *[F.sum(f"_sum_{v}").over(earlier).alias(f"_car_{v}") for v in value_cols]).where("_parts_before > 0")
    same = F.col("_part") == F.col("_to")
    for k in keys:
        same = same & local[k].eqNullSafe(F.col(f"_key_{k}"))
    out = local.join(F.broadcast(carry), same, "left")
    return out.select(*df.columns, *[(F.col(f"_loc_{v}") + F.coalesce(f"_car_{v}", F.lit(0))).alias(f"{v}{suffix}") for v in value_cols])


def with_neighbours(df: DataFrame, keys: list[str], order_cols: list[str], col: str, before: int = 0, after: int = 0,
                    block: int = 1 << 16, num_parts: int | None = None) -> DataFrame:
    """Adds ``<col>_before_<i>`` and ``<col>_after_<i>``: the value of ``col``
    i rows earlier or later within the same key, else NULL, and
    ``has_before_<i>`` / ``has_after_<i>``, whether there is such a row.

    Rows numbered by key and order are dealt into blocks of ``block``; a block
    also gets the few rows next to it, so every window has at most
    ``block + before + after`` rows however long a key is."""
    if not 0 <= max(before, after) < block:
        raise ValueError("neighbours must lie within a block")
    place = F.col("_rn") - 1
    own = F.floor(place / F.lit(block))
    rows = row_ordinals(df, [*keys, *order_cols], "_rn", num_parts=num_parts)
    dealt = rows.withColumn("_block", F.explode(F.array_distinct(F.array(
        own, F.floor((place + before) / F.lit(block)), F.floor((place - after) / F.lit(block))))))
    w = Window.partitionBy("_block").orderBy("_rn")
    added = []
    for word, shift, most in (("before", F.lag, before), ("after", F.lead, after)):
        for i in range(1, most + 1):
            near = F.coalesce(shift(F.struct(*[F.col(k) for k in keys]), i).over(w).eqNullSafe(F.struct(*[F.col(k) for k in keys])), F.lit(False))
            added += [F.when(near, shift(col, i).over(w)).alias(f"{col}_{word}_{i}"), near.alias(f"has_{word}_{i}")]
    return dealt.select("*", *added).where(F.col("_block") == own).drop("_rn", "_block")


def batch_of(rn: str | Column, batch_size: int) -> Column:              # E4
    r = F.col(rn) if isinstance(rn, str) else rn
    return F.floor((r - 1) / F.lit(batch_size)).cast("long")


def shard_of(rn: str | Column, total: str | Column, world_size: int) -> Column:   # E5
    """``world_size`` contiguous shards of floor(N/W) rows; the last takes the rest."""
    r = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(total) if isinstance(total, str) else total
    split = F.floor(n / F.lit(world_size))
    return F.when(split == 0, F.lit(world_size - 1)).otherwise(
        F.least(F.floor((r - 1) / split), F.lit(world_size - 1))).cast("int")


def shard_start(shard: str | Column, total: str | Column, world_size: int) -> Column:
    s = F.col(shard) if isinstance(shard, str) else shard
    n = F.col(total) if isinstance(total, str) else total
    return (s * F.floor(n / F.lit(world_size))).cast("long")


def row_slice(df: DataFrame, order_cols: list[str], start: int, stop: int, ranges: int = 64) -> DataFrame:   # B9
    """Python ``frame[start:stop]`` in ``order_cols`` order.

    For a numeric first column the rows are counted in ``ranges`` value ranges
    (approximate quantiles) first; only the ranges that the slice touches, a
    filter that reaches the scan, are then numbered. Other types are numbered
    whole."""
    from pyspark.sql import types as T
    first = order_cols[0]
    if not isinstance(df.schema[first].dataType, T.NumericType):
        return row_ordinals(df, order_cols).where(F.col("rn").between(start + 1, stop)).drop("rn")
    edges = sorted(set(df.approxQuantile(first, [i / ranges for i in range(1, ranges)], 0.001)))
    passed = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e <= F.col(first)))
    place = F.when(F.col(first).isNull(), F.lit(-1)).otherwise(passed if edges else F.lit(0))
    counts = sorted(tuple(r) for r in df.groupBy(place.alias("p")).count().collect())     # ranges + 1 rows
    seen, before, touched = 0, 0, []
    for p, n in counts:
        if seen < stop and seen + n > start:
            before = before if touched else seen
            touched.append(p)
        seen += n
    if not touched:
        return df.limit(0)
    low = F.col(first) >= edges[touched[0] - 1] if touched[0] > 0 else F.lit(True)
    high = F.col(first) < edges[touched[-1]] if touched[-1] < len(edges) else F.lit(True)
    inside = low & high if touched[0] >= 0 else high | F.col(first).isNull()
    return (row_ordinals(df.where(inside), order_cols)
            .where(F.col("rn").between(start + 1 - before, stop - before)).drop("rn"))
