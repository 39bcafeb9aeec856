"""F1-F3, R1, R2, S9 on FIXTURES.md 2.3."""

import pytest

from logweave.operators import reconcile

LINES = ["a,b,5", "a,b,+5", "a,b, 5", "a,b,1.5", "a,b,x", "a,b,123456789012345678",
         "a,b,1234567890123456789", "d,x,2024-01-01T00:00:00.1,k,z", "a,b,,", ",,,", "", "a,,5"]


def test_classify_rows(spark):
    df = spark.createDataFrame([(l,) for l in LINES], "value string")
    got = [tuple(r) for r in reconcile.classify(df).collect()]
    assert got == [("a", 5, 0), ("a", 5, 0), ("a", 0, 0), ("a", 0, 0), ("a", 0, 0),
                   ("a", 123456789012345678, 0), ("b", 0, 1), ("k", 0, 1), ("a", 5, 0)]


def test_reconcile_and_mismatch(spark):
    df = spark.createDataFrame([(l,) for l in LINES], "value string")
    tot = {r.key: (r.reported, r.actual) for r in reconcile.reconcile(df).collect()}
    assert tot == {"a": (123456789012345678 + 15, 0), "b": (0, 1), "k": (0, 1)}
    mm = {r.key for r in reconcile.mismatches(reconcile.reconcile(df)).collect()}
    assert mm == {"a", "b", "k"}


def test_invariant_kept_lines(spark):
    df = spark.createDataFrame([(l,) for l in LINES], "value string")
    c = reconcile.classify(df)
    summary = c.where("actual = 0").count()
    actual = c.groupBy().sum("actual").collect()[0][0]
    assert summary + actual == c.count() == 9


def test_pair_text(spark, tmpdir_path):
    df = spark.createDataFrame([("a,b,5",), ("x,y,1234567890123456789,k,z",)], "value string")
    reconcile.write_pair_text(reconcile.reconcile(df), tmpdir_path + "/out")
    got = sorted(r.value for r in spark.read.text(tmpdir_path + "/out").collect())
    assert got == ["(a,(5,0))", "(k,(0,1))"]


def test_sum_overflow_raises(spark):
    big = "a,b,999999999999999999"  # 18 digits: still a summary line
    df = spark.createDataFrame([(big,)] * 10, "value string")
    with pytest.raises(Exception):
        reconcile.reconcile(df).collect()


def test_detail_rule_counts_utf16_units(spark):
    # 17 characters, one outside the BMP: 18 UTF-16 units -> not a detail line
    # 18 characters, one outside the BMP: 19 units -> a detail line
    df = spark.createDataFrame([("a,b,1234567890123456\U0001F600",), ("a,b,12345678901234567\U0001F600,k,z",)],
                               "value string")
    assert [tuple(r) for r in reconcile.classify(df).collect()] == [("a", 0, 0), ("k", 0, 1)]


def test_value_pieces_join_to_the_whole(spark):
    import json

    from logweave.operators import aggregates
    from logweave.session import shared_dir

    data = [("hot", v) for v in [None, "a", "a", "b", "c"] * 300 + [f"v{i % 90}" for i in range(500)]] + [("one", "x"), ("null", None), (None, "y"), (None, "z"), (None, "y")]
    df = spark.createDataFrame(data, "k string, v string").repartition(6)
    for size in (1, 7, 1000, 10**6):
        pieces = aggregates.value_pieces(df, "k", "v", size, shared_dir(spark, "pieces")).collect()
        whole = {r.k: r for r in aggregates.values_json(df, "k", "v", always_array=True).collect()}
        for k, r in whole.items():
            mine = sorted((p for p in pieces if p.k == k), key=lambda p: p.piece)
            assert [p.piece for p in mine] == list(range(len(mine))) and all(p.n == size for p in mine[:-1]) and mine[-1].n <= size
            assert [v for p in mine for v in json.loads(p.values_json)] == json.loads(r.values_json)
        assert {p.k for p in pieces} == set(whole)
    assert aggregates.value_pieces(df.limit(0), "k", "v", 5, shared_dir(spark, "pieces")).count() == 0
