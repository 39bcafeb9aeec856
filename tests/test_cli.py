"""The job entry points end to end on small file fixtures."""

import os

from logweave import cli


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_request_etl_appends_day_partition(spark, tmpdir_path):
    good = "t0 t1 t2 t3 t4 t5 t6 t7 /pv?city=sz&country=cn&pvuid=u%201 t9"
    _write(f"{tmpdir_path}/logs/2017/11/21/201711212011.log", [good, "too short"])
    _write(f"{tmpdir_path}/logs/2017/11/21/201711212101.log", [good])  # after now: skipped
    args = ["request-etl", "--root", f"{tmpdir_path}/logs", "--start", "2017-11-2120:10",
            "--now", "2017-11-21 21:00:30", "--table", "req_cli", "--location", f"{tmpdir_path}/table",
            "--reject-path", f"{tmpdir_path}/rejects"]
    cli.main(args)
    cli.main(args)  # the same range twice appends twice, as the original job
    rows = spark.table("req_cli").collect()
    assert len(rows) == 2 and {(r.city, r.pvuid, r.ds) for r in rows} == {("sz", "u 1", "20171121")}
    assert [r.value for r in spark.read.text(f"{tmpdir_path}/rejects").collect()] == ["too short"]
    spark.sql("DROP TABLE req_cli")


def test_reconcile_job(spark, tmpdir_path):
    _write(f"{tmpdir_path}/in/a.log", ["a,b,5", "x,y,1234567890123456789,a,z", ",,,"])
    _write(f"{tmpdir_path}/in/b.log", ["a,b,2"])
    cli.main(["reconcile", f"{tmpdir_path}/in/*.log", f"{tmpdir_path}/out"])
    assert [r.value for r in spark.read.text(f"{tmpdir_path}/out").collect()] == ["(a,(7,1))"]


def test_stream_tokens_from_files(spark, tmpdir_path):
    _write(f"{tmpdir_path}/in/f0.txt", ["a,b,a", "a,,b"])
    cli.main(["stream-tokens", "--files", f"{tmpdir_path}/in", "--available-now", "--show", "0",
              "--sink", f"{tmpdir_path}/sink", "--checkpoint", f"{tmpdir_path}/ckpt"])
    got = {(r.batch_id, r.token): r.n for r in spark.read.parquet(f"{tmpdir_path}/sink").collect()}
    assert got == {(0, "a"): 3, (0, "b"): 2, (0, ""): 1}
