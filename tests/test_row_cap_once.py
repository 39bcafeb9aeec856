"""o4_row_cap_by_rank joins its tables once, however many rounds rank selection takes."""

from logweave.plans import all_queries


def test_capped_join_is_read_from_one_written_table(spark, tmp_path):
    # keys repeat on both sides, are null on both sides and lack partners on both sides
    orders = [(k if k % 17 else None, f"{k % 5}-P" if k % 11 else None) for k in range(1, 400)] + [(5, "0-P"), (6, None)]
    lines = [(k % 450 if k % 13 else None, k % 4) for k in range(3000)]
    sf = str(tmp_path)
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{sf}/lineitem.parquet")
    out = all_queries()["o4_row_cap_by_rank"](spark, sf)

    joined = [(p, k, n) for k, p in orders if k is not None for at, n in lines if at == k]
    cap = len(joined) // 3
    first = sorted(joined, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))[:cap]
    got = [(r.o_orderpriority, r.n) for r in out.collect()]
    assert {p: n for p, n in got if not str(p).startswith("any")} == {p: sum(1 for r in first if r[0] == p) for p in {r[0] for r in first}}
    assert dict(got)["any"] == cap
    files = out.inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
