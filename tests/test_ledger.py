"""S8 with a ledger: reruns, overlaps and broken runs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.session import shared_dir
from logweave.sources import files, ledger

START, NOW = datetime(2024, 1, 1), datetime(2024, 1, 5)


def _records(lines):
    return lines.select("value", F.substring("file_name", 1, 8).alias("ds"))


def _logs(spark, days):
    root = shared_dir(spark, "ledger_logs")
    for d in days:
        _add(spark, root, d, [f"{d} line {i}" for i in range(3)])
    return root


def _add(spark, root, day, lines, name=None):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{day[:4]}/{day[4:6]}/{day[6:]}/{name or day + '0900.log'}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    out.close()


def _rows(spark, location, book):
    return sorted((r.ds, r.value) for r in ledger.committed(spark, location, book).select(F.col("ds").cast("string").alias("ds"), "value").collect())


def test_reruns_overlaps_and_new_files(spark):
    root, location, book = _logs(spark, ["20240102", "20240103"]), shared_dir(spark, "t"), shared_dir(spark, "b")
    assert len(ledger.append_new_files(spark, root, START, NOW, location, book, _records)) == 1
    once = _rows(spark, location, book)
    assert len(once) == 6
    assert ledger.append_new_files(spark, root, START, NOW, location, book, _records) == []
    _add(spark, root, "20240103", ["late file"], "202401031000-2.log")
    assert len(ledger.append_new_files(spark, root, datetime(2024, 1, 3), NOW, location, book, _records)) == 1
    assert _rows(spark, location, book) == sorted([*once, ("20240103", "late file")])


@pytest.mark.parametrize("broken_after", ["begin", "write"])
def test_a_broken_run_is_finished(spark, broken_after):
    root, location, book = _logs(spark, ["20240102", "20240103"]), shared_dir(spark, "t"), shared_dir(spark, "b")
    run = ledger.begin_run(spark, files.list_time_range(spark, root, START, NOW), book)
    if broken_after == "write":
        ledger.write_run(spark, run, location, book, _records)
        assert _rows(spark, location, book) == []              # not seen before it is done
    _add(spark, root, "20240104", ["new"])
    done = ledger.append_new_files(spark, root, START, NOW, location, book, _records)
    assert run in done and len(done) == 2 and ledger.open_runs(spark, book) == []
    assert len(_rows(spark, location, book)) == 7
    assert ledger.append_new_files(spark, root, START, NOW, location, book, _records) == []


def test_a_write_that_raises_leaves_the_run_open(spark):
    root, location, book = _logs(spark, ["20240102"]), shared_dir(spark, "t"), shared_dir(spark, "b")

    def fails(lines):
        return _records(lines).where(F.raise_error(F.lit("stop")).cast("string").isNull())

    with pytest.raises(Exception, match="stop"):
        ledger.append_new_files(spark, root, START, NOW, location, book, fails)
    assert len(ledger.open_runs(spark, book)) == 1
    ledger.append_new_files(spark, root, START, NOW, location, book, _records)
    assert len(_rows(spark, location, book)) == 3


def test_no_files(spark):
    root, location, book = _logs(spark, []), shared_dir(spark, "t"), shared_dir(spark, "b")
    assert ledger.append_new_files(spark, root, START, NOW, location, book, _records) == []
