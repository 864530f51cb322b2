"""Connected components against union-find; a hub's join partition is split."""

import random

from tessera.llm import components


def plain(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def roots(spark, pairs):
    found = {r.node: r.root for r in components.component_roots(spark.createDataFrame(pairs, "a long, b long")).collect()}
    return found


def test_random_links_chains_and_repeats(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    pairs += [(b, a) for a, b in pairs[:50]] + pairs[:20]
    want = plain(pairs)
    got = roots(spark, pairs)
    assert all(got.get(x, x) == r for x, r in want.items()) and set(got) <= set(want)
    assert roots(spark, []) == {}


def test_hub_of_a_third_of_the_links_is_split(spark, monkeypatch):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    before = {k: spark.conf.get(k) for k in conf}
    plans, write = [], components.stage

    def watched(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hub = spark.range(1, 60_001).selectExpr("id AS a", "cast(0 AS long) AS b")
        rest = spark.range(0, 120_000, 1, 8).selectExpr("id + 1000000 AS a", "id % 40000 + 2000000 AS b")
        links = write(hub.unionByName(rest).selectExpr("greatest(a, b) AS lo", "least(a, b) AS hi").repartition(8), "hub")
        monkeypatch.setattr(components, "stage", watched)
        components._small_star(links)
        assert any("skew=true" in p for p in plans)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
