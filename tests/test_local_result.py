"""A bounded local result: whole or an error, never cut."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.stats import frame_size_mb
from tessera.session import path_exists
from tessera.sources import sinks


@pytest.fixture()
def frame(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("w"), "id")).alias("word"),
                                    F.array("id", F.lit(None)).alias("ids"))


def test_whole_result_within_the_limits(spark, frame, monkeypatch):
    used = []
    monkeypatch.setattr(sinks, "delete_path", lambda s, p, plain=sinks.delete_path: (used.append(p), plain(s, p)))
    got = sinks.local_result(frame, max_rows=1000)
    assert sorted(got.to_pylist(), key=lambda r: r["id"]) == [
        {"id": i, "word": f"w{i}" if i % 7 else None, "ids": [i, None]} for i in range(1000)]
    assert len(used) == 1 and not path_exists(spark, used[0])
    empty = sinks.local_result(frame.limit(0), max_rows=0, max_bytes=0)
    assert empty.num_rows == 0 and empty.column_names == ["id", "word", "ids"]


@pytest.mark.parametrize("limits", [dict(max_rows=999), dict(max_rows=10_000, max_bytes=8000)])
def test_an_error_beyond_a_limit(frame, limits, monkeypatch):
    monkeypatch.setattr(type(frame), "toArrow", lambda self: pytest.fail("rows were sent"))
    with pytest.raises(sinks.ResultTooLarge, match="1000 rows"):
        sinks.local_result(frame, **limits)


def test_random_rows_are_computed_once(spark):
    got = sinks.local_result(spark.range(50).select(F.rand().alias("x")), max_bytes=400)
    assert got.num_rows == 50
    with pytest.raises(sinks.ResultTooLarge):
        sinks.local_result(spark.range(50).select(F.rand().alias("x")), max_bytes=399)


def test_size_statistic_uses_the_same_widths(spark):
    assert frame_size_mb(spark.range(1 << 17), "t").head()["mb"] == 1.0
