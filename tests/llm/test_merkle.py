from __future__ import annotations

import duckdb
import pytest

from siftwell.llm import merkle

from .conftest import DATA

SCHEMA = "file_id bigint, offset bigint, record_id bigint, content string, node int"


def records(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def statuses(spark, a, b):
    return sorted((r.file_id, r.offset, r.status) for r in merkle.audit(merkle.digests(records(spark, a)), merkle.digests(records(spark, b))).collect())


def test_equals_sql(spark, tables):
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = duck.sql(merkle.SQL)
    got = merkle.audit(merkle.pages_as_records(tables("pages")), merkle.pages_as_records(tables("pages"), merkle.damaged))
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall())


def test_what_differs(spark):
    a = [(f, i * 40_000, f * 100 + i, f"record {f} {i}") for f in range(3) for i in range(60)]
    b = [list(r) for r in a if (r[0], r[1]) != (1, 80_000)]
    b[5][3] = "record 0 6"
    b.append([2, 99_999_999, 7, "new"])
    assert statuses(spark, a, b) == [(0, 200_000, "corrupt"), (1, 80_000, "missing"), (2, 99_999_999, "extra")]
    assert statuses(spark, a, a) == []


def test_equal_bytes_at_another_offset(spark):
    assert statuses(spark, [(1, 0, 1, "a"), (1, 5, 2, "b")], [(1, 0, 1, "a"), (1, 6, 2, "b")]) == [(1, 5, "missing"), (1, 6, "extra")]


@pytest.mark.parametrize("rows", [[], [(None, 0, 1, "x"), (1, None, 1, "x")]])
def test_empty_replicas(spark, rows):
    assert statuses(spark, rows, rows) == []
    assert statuses(spark, rows, [(1, 0, 1, "x")]) == [(1, 0, "extra")]
    assert statuses(spark, [(1, 0, 1, "x")], rows) == [(1, 0, "missing")]


def test_odd_contents(spark):
    a = [(1, 0, 1, None), (1, 1, 1, ""), (1, 2, 1, "y" * 500_000), (1, 3, 1, "twice"), (1, 3, 1, "twice")]
    assert statuses(spark, a, a) == []
    assert statuses(spark, a, a[:-1]) == [(1, 3, "corrupt")]
    assert statuses(spark, a, [(1, 0, 1, ""), *a[1:]]) == []


def test_only_mismatching_branches_are_visited(spark):
    rows = [(f, i * 70_000, i, f"{f}/{i}") for f in range(4) for i in range(40)]
    changed = [(f, o, i, c + ("!" if (f, i) == (2, 33) else "")) for f, o, i, c in rows]
    from pyspark.sql import functions as F

    both = merkle.entries(merkle.digests(records(spark, rows))).withColumn("replica", F.lit(0)).unionByName(merkle.entries(merkle.digests(records(spark, changed))).withColumn("replica", F.lit(1)))
    bad = [merkle.mismatches(level).collect() for level in merkle.trees(both)]
    assert [len(x) for x in bad] == [1] * (merkle.HEIGHT + 1) and {r.file_id for x in bad for r in x} == {2}


def test_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "h"), (2, "u", "h"), (2, "u", "h"), (1000, "u", "")], "page_id bigint, url string, html string")
    got = merkle.pages_as_records(pages).orderBy("file_id", "offset").collect()
    assert [r.file_id for r in got] == [0, 0, 0, 1] and got[0].offset == got[3].offset == 0 and got[1].offset == got[0].length and got[2].offset == got[1].offset + got[1].length
