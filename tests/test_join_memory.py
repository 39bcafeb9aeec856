"""Joins do not broadcast a table that is small only as encoded files."""

import pytest

from logweave.operators import relational


@pytest.fixture()
def tables(spark, tmp_path):
    """Facts (fk, fid) with repeated, null and unmatched keys; many and few dims (dk)."""
    path = str(tmp_path)
    spark.range(150_000).selectExpr("if(id % 9 = 0, null, id % 110000 - 50) as fk", "id as fid").write.parquet(f"{path}/facts")
    spark.range(0, 100_000, 1, 1).selectExpr("if(id % 7 = 0, null, id % 90000) as dk").write.parquet(f"{path}/many")
    spark.range(0, 300, 1, 1).selectExpr("if(id % 7 = 0, null, id % 200) as dk").write.parquet(f"{path}/few")
    return [spark.read.parquet(f"{path}/{n}") for n in ("facts", "many", "few")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(got, want):
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_shuffles_what_may_be_large(tables, how):
    facts, many, few = tables
    out = relational.outer_join(many, facts, "dk", "fk", how)
    assert "Broadcast" not in _plan(out) and "SortMergeJoin" in _plan(out)
    assert _same(out, many.join(facts, many.dk == facts.fk, how))
    small = relational.outer_join(few, facts, "dk", "fk", how)
    assert "BroadcastHashJoin" in _plan(small)
    assert _same(small, few.join(facts, few.dk == facts.fk, how))


def test_semi_join_shuffles_what_may_be_large(tables):
    facts, many, few = tables
    out = relational.semi_join(facts, many, "fk", "dk")
    assert "Broadcast" not in _plan(out)
    assert _same(out, facts.join(many, facts.fk == many.dk, "left_semi"))
    assert "BroadcastHashJoin" in _plan(relational.semi_join(facts, few, "fk", "dk"))
