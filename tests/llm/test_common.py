from __future__ import annotations

import os

import pytest

from siftwell.llm import common


def test_written_tables_are_read_back_and_go(spark):
    d = spark.createDataFrame([(1, "a"), (None, None)], "x int, y string")
    w = common.written(d)
    folder = w.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert sorted(map(str, w.collect())) == sorted(map(str, d.collect())) and os.path.isdir(folder)
    common.discard(w)
    assert not os.path.isdir(folder)


def test_bucketed_tables_are_grouped_where_they_lie(spark):
    d = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, v int")
    b = common.bucketed(d, "k", 7)
    assert b.count() == 50 and sorted(r.v for r in b.collect()) == [*range(50)]
    plan = b.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and {(r.k, r["count"]) for r in b.groupBy("k").count().collect()} == {(k, len(range(k, 50, 7))) for k in range(7)}
    assert common.bucketed(d.where("false"), "k", 0).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
