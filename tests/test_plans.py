"""What reaches the scan and which physical operators a plan has."""

import os

import pytest

from quillstone.operators import bm25, census, search
from quillstone.plans import memories
from quillstone.sources.tables import spread, table

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(ROOT), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    d = table(spark, ROOT, "drawers")
    text = plan(search.scoped(d, "quarry", "runbooks").select("id"))
    assert "EqualTo(wing,quarry)" in text and "EqualTo(room,runbooks)" in text
    assert "ReadSchema: struct<id:string,wing:string,room:string>" in text
    assert "ReadSchema: struct<wing:string,room:string>" in plan(census.taxonomy(d))


def test_top_k_is_bounded_and_counts_combine_first(spark):
    d = table(spark, ROOT, "drawers")
    assert "TakeOrderedAndProject" in plan(search.knn_one(d, [0.0] * 64, 5))
    assert plan(census.list_wings(d)).count("HashAggregate") == 2


def test_spread_keeps_pruning_and_leaves_large_scans_alone(spark):
    d = table(spark, ROOT, "documents")
    assert "ReadSchema: struct<doc_id:bigint>" in plan(spread(d).select("doc_id"))
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many


def test_before_after_makes_no_row_per_query_and_hit(spark, monkeypatch):
    monkeypatch.setattr(bm25, "scores", lambda *_: pytest.fail("a row per query and hit"))
    rows = {(r["mode"], r.kind): r for r in memories.before_after(spark, ROOT).collect()}
    asked = rows["before", "all"].n
    assert asked == rows["after", "all"].n == sum(r.n for (mode, kind), r in rows.items() if mode == "after" and kind != "all")
