"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from ledgerline.plans.check import compare, duck_connection
from ledgerline.plans.registry import ORACLES, PLANS, load_all

load_all()


@pytest.fixture(scope="module")
def con(sf):
    return duck_connection(sf)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_oracle(spark, sf, con, name):
    res = compare(spark, sf, name, con)
    assert res["status"] in ("match", "rows-only"), res


def test_every_query_has_an_oracle():
    assert sorted(set(PLANS) - set(ORACLES)) == []
