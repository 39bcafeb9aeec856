"""Append of new log files that is safe to rerun (S8 with S1).

A ledger beside the table says which files a run has taken. It has two
folders, each with one sub-folder for a run: ``intent`` names the run's files
and is written before the data, ``done`` is written after them. The rows of a
run go to partitions of their own, ``ds=<day>/run=<run>``, and are overwritten
if the run is done again. So whatever happens between the three writes:

* without an intent nothing has been written, the files are still new;
* an intent without a done mark is done again with exactly its files, and
  replaces what the broken run may have left;
* files of any intent are known, so a rerun of a range, or another range that
  overlaps it, takes the rest only.

One loader at a time may work on a ledger.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources import files

Records = Callable[[DataFrame], DataFrame]


def _runs(spark: SparkSession, ledger: str, part: str) -> DataFrame:
    """(path, run) of the ``intent`` or ``done`` folder; empty if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{part}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, run string")
    return spark.read.schema("path string, run string").parquet(f"{ledger}/{part}")


def begin_run(spark: SparkSession, found: DataFrame, ledger: str) -> str | None:
    """Note the files of ``found`` (path) that no run has taken as those of a
    new run; None if there are none."""
    new = found.select("path").join(_runs(spark, ledger, "intent"), "path", "left_anti")
    run = uuid.uuid4().hex
    new.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(f"{ledger}/intent")
    return run if _runs(spark, ledger, "intent").where(F.col("run") == run).limit(1).count() else None


def write_run(spark: SparkSession, run: str, location: str, ledger: str, records: Records, fmt: str = "orc") -> None:
    """Write the rows of a run's files, in place of any that it left before.
    ``records`` makes rows with a ``ds`` column of the lines."""
    paths = [r.path for r in _runs(spark, ledger, "intent").where(F.col("run") == run).select("path").collect()]
    rows = records(spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file_name")))
    (rows.withColumn("run", F.lit(run)).hint("rebalance", "ds").write.format(fmt).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy("ds", "run").save(location))


def end_run(spark: SparkSession, run: str, ledger: str) -> None:
    """Mark a run as done."""
    done = _runs(spark, ledger, "intent").where(F.col("run") == run)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{ledger}/done")


def open_runs(spark: SparkSession, ledger: str) -> list[str]:
    """Runs that were begun and not marked as done."""
    done = _runs(spark, ledger, "done").select("run").distinct()
    return [r.run for r in _runs(spark, ledger, "intent").select("run").distinct().join(done, "run", "left_anti").collect()]


def append_new_files(spark: SparkSession, root: str, start: datetime, now: datetime, location: str, ledger: str, records: Records,
                     fmt: str = "orc") -> list[str]:
    """Finish broken runs, then append the files of ``start < t < now``
    that no run has taken. Returns the runs that were written."""
    runs = open_runs(spark, ledger)
    new = begin_run(spark, files.list_time_range(spark, root, start, now), ledger)
    for run in [*runs, *([new] if new else [])]:
        write_run(spark, run, location, ledger, records, fmt)
        end_run(spark, run, ledger)
    return [*runs, *([new] if new else [])]


def committed(spark: SparkSession, location: str, ledger: str, fmt: str = "orc") -> DataFrame:
    """The rows of all runs that are done."""
    done = _runs(spark, ledger, "done").select("run").distinct()
    return spark.read.format(fmt).load(location).join(done, "run", "left_semi").drop("run")
