"""Registered queries that SQL can express, against their SQL on whole tables, and the registry itself."""

import pytest

from tessera.llm.queries import REGISTRY
from tools.oracle_check import check, duck

SF = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in REGISTRY) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(k for k, (_, sql) in REGISTRY.items() if sql))
def test_against_sql(spark, key):
    res = check(spark, duck(SF), SF, key, *REGISTRY[key])
    assert res["ok"] is True and res["rows"] > 0, res


def test_entry_adds_the_queries(spark):
    import __spark_entry__ as entry
    assert set(REGISTRY) | {"pipeline"} <= set(entry.queries())
    assert {"op2_exact_dedup", "op4_url_filter", "op8_mixing"} <= set(entry.oracle_sql())
