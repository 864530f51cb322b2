"""Connected components of a link table by alternating stars.

Large-star hangs every larger neighbour of a node on the smallest neighbour,
small-star every smaller one; both are a partial minimum per node, written to
the shared folder, and a join of two written tables, so a hub with a third of
all links is combined in the map tasks and Spark can split its join partition
(it cannot split the output of an aggregate). The links are written once a
round too; the rounds end when they no longer change (they are then stars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stage


def _meet_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with the least neighbour ``m`` of each ``hi``, and the written table of those."""
    low = stage(links.groupBy("hi").agg(F.min("lo").alias("m")), "least")
    return links.join(low, "hi"), low


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    met, low = _meet_least(both)
    out = stage(met.filter("lo > hi").select(F.col("lo").alias("hi"), F.least("hi", "m").alias("lo")).distinct(), "links")
    discard(low)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    met, low = _meet_least(links)
    moved = met.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    out = stage(moved.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
    discard(low)
    return out


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum((F.xxhash64("lo", "hi") % 1_000_003))).head()
    return tuple(row)


def component_roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` (smallest node reachable) of every node that has a link
    to another node; links may repeat, in either direction."""
    links = stage(links.filter(F.col(a) != F.col(b))
                  .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    state = _state(links)
    while state[0]:
        longer = _large_star(links)
        nearer = _small_star(longer)
        discard(longer)
        after = _state(nearer)
        discard(links)
        links = nearer
        if after == state:
            break
        state = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def merge_labels(label, u, v) -> None:
    """Join the nodes ``u[i]`` and ``v[i]`` in the array ``label`` (node -> its
    smallest known member, fully resolved), in place."""
    import numpy as np
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            nearer = label[label]
            if (nearer == label).all():
                break
            label[:] = nearer
