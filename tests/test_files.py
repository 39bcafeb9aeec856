"""S1 file choice (FIXTURES.md 2.2), S2, S10, S6-S8 writes."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.sources import files, tables
from logweave.operators import weblog

START = files.parse_start("2017-11-2120:10")
NOW = datetime(2017, 11, 21, 21, 0, 30)


def _write(root, day, name, body):
    d = os.path.join(root, day)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w") as fh:
        fh.write(body)


def test_name_range_is_open_on_both_ends(spark, tmpdir_path):
    for name in ["201711212010.log", "201711212011.log", "201711212100.log", "201711212101.log", "short.log"]:
        _write(tmpdir_path, "2017/11/21", name, name + "\n")
    df = files.scan_time_range(spark, tmpdir_path, START, NOW)
    assert sorted(r.file_name for r in df.collect()) == ["201711212011.log", "201711212100.log"]
    assert _files_read(df) == 2   # the other three files are skipped before reading
    bad = files.unnamed_files(spark, tmpdir_path, START, NOW).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in bad] == ["short.log"]


def _files_read(df):
    def walk(p):
        yield p
        it = p.children().iterator()
        while it.hasNext():
            yield from walk(it.next())
    for node in walk(df._jdf.queryExecution().executedPlan()):
        if node.nodeName().startswith("Scan") and node.metrics().contains("numFiles"):
            return node.metrics().apply("numFiles").value()


def test_range_across_midnight(spark, tmpdir_path):
    _write(tmpdir_path, "2017/11/20", "201711202355.log", "x\n")
    _write(tmpdir_path, "2017/11/21", "201711210005.log", "y\n")
    start, now = datetime(2017, 11, 20, 23, 50), datetime(2017, 11, 21, 0, 10)
    assert files.scan_time_range(spark, tmpdir_path, start, now).count() == 2
    # the original single-folder behaviour misses the previous day
    assert files.scan_time_range(spark, tmpdir_path, start, now, single_day=True).count() == 1


def test_missing_folders_give_empty(spark, tmpdir_path):
    assert files.scan_time_range(spark, tmpdir_path, START, NOW).count() == 0


def test_partition_range_prunes(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "201711212010"), ("b", "201711212011"), ("c", "201711212100"),
                                ("d", "201711212101")], "value string, minute string")
    df.write.partitionBy("minute").text(tmpdir_path + "/logs")
    out = files.scan_partition_range(spark, tmpdir_path + "/logs", "minute", START, NOW)
    assert sorted(r.value for r in out.collect()) == ["b", "c"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()


def test_fingerprints(spark, tmpdir_path):
    _write(tmpdir_path, "f", "a.txt", "abc")
    m = files.fingerprint_manifest(spark, tmpdir_path + "/f/*.txt").collect()[0]
    assert (m.file_name, m.length) == ("a.txt", 3)
    assert m.md5 == hashlib.md5(b"abc").hexdigest() and m.sha1 == hashlib.sha1(b"abc").hexdigest()


def test_partition_insert_rerun(spark, tmpdir_path):
    line = "t0 t1 t2 t3 t4 t5 t6 t7 /pv?city=x t9"
    recs = weblog.extract_requests(spark.createDataFrame([(line,)], "value string"))
    name = "req_test_rerun"
    tables.create_request_table(spark, name, tmpdir_path + "/t", "parquet")
    for _ in range(2):
        tables.insert_partition(recs, name, "20240101", overwrite=True)
        tables.insert_partition(recs, name, "20240102", overwrite=False)
    got = {r.ds: r.n for r in spark.table(name).groupBy("ds").agg(F.count("*").alias("n")).collect()}
    assert got == {"20240101": 1, "20240102": 2}
    tables.insert_partition(recs.withColumn("ds", F.lit("20240101")), name, None, overwrite=True)
    got = {r.ds: r.n for r in spark.table(name).groupBy("ds").agg(F.count("*").alias("n")).collect()}
    assert got == {"20240101": 1, "20240102": 2}
    tables.drop_table(spark, name)


def test_staging_overwrite_rerun(spark, tmpdir_path):
    df = spark.range(5).withColumnRenamed("id", "x")
    tables.write_staging(df, tmpdir_path + "/stage", "orc")
    tables.write_staging(df, tmpdir_path + "/stage", "orc")  # a rerun replaces, does not add
    assert spark.read.orc(tmpdir_path + "/stage").count() == 5


def test_orc_table_writes_snappy(spark, tmpdir_path):
    import glob
    import pyarrow.orc as orc
    line = "t0 t1 t2 t3 t4 t5 t6 t7 /pv?city=x t9"
    recs = weblog.extract_requests(spark.createDataFrame([(line,)], "value string"))
    tables.create_request_table(spark, "req_orc_codec", tmpdir_path + "/t", "orc")
    tables.insert_partition(recs, "req_orc_codec", "20240101", overwrite=False)
    f = glob.glob(tmpdir_path + "/t/ds=20240101/*.orc")[0]
    assert orc.ORCFile(f).compression == "SNAPPY"
    tables.drop_table(spark, "req_orc_codec")


def test_json_records_split_rows_and_rejects(spark):
    texts = ['{"k": 1, "s": "a"}', "{}", '{"k": "x"}', '{"k": 1', "oops", "", None, "5", '{"k": 2, "other": [1]}', '{"k": 3, "s": null}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, line string")
    out = {r.id: (r.k, r.s, r.rejected) for r in files.json_records(df, "line", "k bigint, s string").collect()}
    assert {i: v[2] for i, v in out.items() if v[2] is not None} == {2: texts[2], 3: texts[3], 4: "oops", 5: "", 7: "5"}
    assert [out[i][:2] for i in (0, 1, 6, 8, 9)] == [(1, "a"), (None, None), (None, None), (2, None), (3, None)]
    with pytest.raises(ValueError):
        files.json_records(df.withColumn("rejected", F.lit(1)), "line", "k bigint")


def test_files_of_any_size_are_hashed(spark, tmpdir_path):
    import gzip
    import hashlib
    import os

    contents = {"newline": b"\n", "none": b"abc", "last": b"abc\n", "blank": b"\n\na\n\n", "cr": b"a\r\nb\rc\r", "mark": b"\xef\xbb\xbfab\nc",
                "mark_last": b"\xef\xbb\xbfab\nc\n", "two_marks": b"\xef\xbb\xbf\xef\xbb\xbfx", "bytes": os.urandom(200_000), "packed.gz": gzip.compress(b"x" * 5000)}
    for name, content in contents.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(content)
    rows = {r.file_name: r for r in files.fingerprint_manifest(spark, f"{tmpdir_path}/*", max_content=0).collect()}
    assert set(rows) == set(contents)
    for name, content in contents.items():
        want = (None, None) if name.endswith(".gz") else (hashlib.md5(content).hexdigest(), hashlib.sha1(content).hexdigest())
        assert (rows[name].md5, rows[name].sha1, rows[name].length) == (*want, len(content)), name


def test_large_files_are_hashed_in_pieces(spark, tmpdir_path):
    import gzip
    import hashlib
    import os

    lines = b"".join(b"%d,\n" % i for i in range(400_000))
    contents = {"small": b"abc", "a b%20é+.bin": os.urandom(17 << 20), "lines.txt": lines * 8, "one_line": b"x" * (18 << 20),
                "packed.gz": gzip.compress(os.urandom(17 << 20), 1)}
    for name, content in contents.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(content)
    manifest = files.fingerprint_manifest(spark, f"{tmpdir_path}/*")
    assert "MapInArrow" in manifest._jdf.queryExecution().executedPlan().toString()
    rows = {r.file_name: r for r in manifest.collect()}
    assert set(rows) == set(contents)
    for name, content in contents.items():
        assert (rows[name].md5, rows[name].sha1) == (hashlib.md5(content).hexdigest(), hashlib.sha1(content).hexdigest()), name
