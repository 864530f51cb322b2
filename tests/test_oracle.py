"""Every registered query against its DuckDB oracle text on sf0.001
(the driver runs the same comparison at sf0.01)."""

import pytest

from tools.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
#: Too long for the SQL recursion; held against a sequential trainer and plain matching in test_bruteforce.py.
TESTED_ELSEWHERE = {"i6_bpe_train_full", "i3_wordpiece_trained"}


def _keys():
    from tessera.plans.catalog import load_all
    return sorted(set(load_all()) - TESTED_ELSEWHERE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", _keys())
def test_query(spark, con, key):
    from tessera.plans.catalog import load_all
    fn, sql = load_all()[key]
    res = check(spark, con, SF, key, fn, sql)
    assert res["ok"] is True, res       # a key without an oracle text fails
