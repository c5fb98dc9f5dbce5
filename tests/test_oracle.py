"""Every registered query with SQL against DuckDB, on the smallest tables; TERRAPANEL_FULL=1 takes sf0.01."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FULL = os.environ.get("TERRAPANEL_FULL") == "1"
SF = "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001"
SQLS = entry.oracle_sql()
NAMES = sorted(SQLS)


#: Queries over districts with two areas: the smallest tables have none.
LARGER = ("HAVING count(DISTINCT area_id) >= 2", "'entity_district_year'")


@pytest.fixture(scope="module")
def cons():
    return {}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, cons, name):
    sf = "/root/testdata/sf0.01" if any(text in SQLS[name] for text in LARGER) else SF
    if sf not in cons:
        cons[sf] = duck(sf)
    out = compare(spark, entry.queries()[name], SQLS[name], sf, cons[sf])
    assert out.startswith("ok"), out


def test_every_oracle_has_a_query():
    assert set(SQLS) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
