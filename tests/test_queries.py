"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from siftwell.plans import catalog, records  # noqa: F401
from siftwell.plans.relations import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


#: Queries that find nothing on the smallest tables.
EMPTY: set[str] = set()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert rows or name in EMPTY


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_changed_measures_and_repeated_ids_are_reached(spark):
    found = catalog.QUERIES["readability_candidates"](spark, DATA).groupBy("rule_id", "class").count().collect()
    assert {(r.rule_id, r["class"]) for r in found} >= {(f"CQ-READ-00{k}", c) for k in (4, 5, 6) for c in ("new", "expanded", "improved", "unchanged")}
    assert {r.gate for r in catalog.QUERIES["readability_gates"](spark, DATA).select("gate").distinct().collect()} >= {"INCOMPLETE", "BLOCK"}


def test_weights_are_pruned_and_filters_pushed(spark):
    plan = catalog.QUERIES["score_focused_domain"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "BroadcastHashJoin" in plan
