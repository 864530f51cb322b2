"""URL filter: rules, Bloom filter without false negatives, edges."""

from pyspark.sql import functions as F

from tessera.llm import url_filter as uf


def judged(spark, urls, listed=(), **options):
    frame = spark.createDataFrame([(i, u, "clash", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, block int")
    block = spark.createDataFrame([(x,) for x in listed], "canonical string")
    return {r.page_id: r for r in uf.filter_urls(frame, block, **options).collect()}


def test_rules_and_parts(spark):
    urls = ["http://A.Example.COM/en/x?y#z", "https://www.example.com/en/", "http://example.com/de/", "http://b.net/es/1", "http://net/fr/",
            "http://bnet.org/es/", "http://x.com", "no scheme", None, "ftp://h?q/en/", "http://x.net/esp/", "a://b://c/d", "http://notexample.com/en/",
            "HTTP://U@Host:80/p/", ""]
    got = judged(spark, urls)
    want = [("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
            ("example.com", "/de/", "com/", "allow"), ("b.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"),
            ("bnet.org", "/es/", None, "allow"), ("x.com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("h", "", None, "allow"), ("x.net", "/esp/", None, "allow"), ("b:", "//c/d", None, "allow"),
            ("notexample.com", "/en/", "com/", "allow"), ("u@host:80", "/p/", None, "allow"), ("", "", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == want


def test_listed_urls_are_exact_whatever_the_filter(spark):
    urls = [f"https://www.h{i % 50}.org/p{i}.html?x" for i in range(2000)] + ["http://h1.org/p1", "http://m.h1.org/p1/"]
    listed = [f"h{i % 50}.org/p{i}" for i in range(0, 2000, 7)] + ["h1.org/p1", "", "h1.org/p1"]
    for n_blocks in (1, 64, 1 << 16, None):                  # one block: everything is a possible hit; None: by the count
        got = judged(spark, urls, listed, n_blocks=n_blocks)
        want = {i for i, u in enumerate(urls[:2000]) if f"h{i % 50}.org/p{i}" in set(listed)} | {2000, 2001}
        assert {i for i, r in got.items() if r.listed} == want == {i for i, r in got.items() if r.verdict == "block"}
        assert len(got) == len(urls)


def test_filter_passes_few_others(spark):
    listed = spark.range(5000).select(F.concat(F.lit("in"), "id").alias("canonical"))
    bloom = uf.bloom_filter(listed, n_blocks=1 << 12)
    others = spark.range(20_000).select(F.concat(F.lit("out"), "id").alias("k"))
    block, bits = uf._block_and_bits(F.col("k"), 1 << 12)
    passed = others.select(block.alias("block"), bits.alias("bits")).join(bloom, "block").filter(F.expr("mask & bits = bits")).count()
    assert passed < 0.01 * 20_000 and bloom.count() <= 1 << 12


def test_filter_size_follows_the_list():
    assert [uf.blocks_for(n) for n in (0, 1, 256, 257, 5000)] == [64, 64, 64, 128, 2048]
    assert uf.blocks_for(4 << 20) == uf.blocks_for(10 ** 12) == uf.MAX_BLOCKS


def test_every_listed_family(spark):
    urls = [f"http://{x}.example.org/{i}" for i, x in enumerate(uf.LISTED_LABELS)] + ["http://adult-xx.example.org/", "http://good.org/spam-farm"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(frame, uf.listed_from_crawl(frame)).collect()}
    assert [got[i] for i in range(len(urls))] == ["block"] * len(uf.LISTED_LABELS) + ["allow"] * 2


def test_empty_and_repeated(spark):
    assert judged(spark, []) == {}
    frame = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    out = uf.filter_urls(frame, spark.createDataFrame([], "canonical string")).collect()
    assert len(out) == 3 and all(r.verdict == "allow" and not r.listed for r in out)
    long = "http://a.org/" + "x" * 1_000_000
    assert judged(spark, [long])[0].path == long[12:]
