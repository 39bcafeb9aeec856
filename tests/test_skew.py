"""A key holding a third of all rows: results stay whole, plans split or pre-reduce it."""

import pytest
from pyspark.sql import functions as F

from logweave.operators import aggregates, reconcile, relational

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _facts(spark, n=30000):
    # key 0 holds a third of the rows, the rest spread over 1000 keys
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("fk"),
        F.col("id").alias("fid"))


def test_inner_part_of_outer_join_splits_hot_key(spark, skew_conf):
    dims = spark.range(1200).select(F.col("id").alias("dk"))
    facts = _facts(spark)
    out = relational.outer_join(dims, facts, "dk", "fk", "left")
    assert len(out.collect()) == 30000 + (1200 - 1001)   # runs this plan, so AQE finalises it
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan, plan


def test_hot_key_aggregations_are_whole(spark):
    facts = _facts(spark)
    lines = facts.select(F.concat_ws(",", F.col("fk").cast("string"), F.lit("x"), F.lit("1")).alias("value"))
    tot = {r.key: r.reported for r in reconcile.reconcile(lines).collect()}
    assert tot["0"] == 10000 and sum(tot.values()) == 30000
    g = aggregates.grouped_values(facts.withColumn("v", (F.col("fid") % 2).cast("string")), "fk", "v")
    assert {r.v: r.n for r in g.where("fk = 0").collect()} == {"0": 5000, "1": 5000}


def test_plain_left_join_cannot_split_the_other_side(spark, skew_conf):
    """Why outer_join exists: AQE leaves a hot key of the non-preserved side whole."""
    dims = spark.range(1200).select(F.col("id").alias("dk"))
    facts = _facts(spark)
    plain = dims.join(facts, dims.dk == facts.fk, "left")
    plain.collect()
    assert "skew=true" not in plain._jdf.queryExecution().executedPlan().toString()


def test_grouped_values_accumulate_and_append(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, None), (2, "a"), (3, None)], "k int, v string")
    acc = {r.k: r.values_json for r in aggregates.values_json(df, "k", "v").collect()}
    app = {r.k: r.values_json for r in aggregates.values_json(df, "k", "v", always_array=True).collect()}
    assert acc == {1: '"a"', 2: '[null,"a","a","b"]', 3: "null"}
    assert app == {1: '["a"]', 2: '[null,"a","a","b"]', 3: "[null]"}
    rows = {(r.k, r.v): r.n for r in aggregates.grouped_values(df, "k", "v").collect()}
    assert rows == {(1, "a"): 1, (2, "a"): 2, (2, "b"): 1, (2, None): 1, (3, None): 1}


def test_full_outer_join_splits_a_hot_key(spark, skew_conf):
    """A hot key on one side of a full outer join: both sides of the inner
    part may be split, and the preserved side is shuffled once."""
    dims = spark.range(1200).select(F.col("id").alias("dk"))
    facts = _facts(spark)
    joined = relational.outer_join(dims, facts, "dk", "fk", "full")
    want = sorted(map(tuple, dims.join(facts, dims.dk == facts.fk, "full").collect()), key=repr)
    assert sorted(map(tuple, joined.collect()), key=repr) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan and "ReusedExchange" in plan
