"""Table sinks: staging overwrite (S6), partitioned tables (S7), partition
insert (S8).

Writes never funnel through one task: the file count follows the input
splits (or AQE's rebalance) and ``maxRecordsPerFile`` caps file size.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.predicates import quote_literal
from logweave.operators.weblog import REQUEST_FIELDS

_DS_RE = re.compile(r"^[0-9A-Za-z_-]+$")

# Table properties of the request tables.
ORC_PROPERTIES = {"orc.compress": "SNAPPY", "orc.stripe.size": "268435456"}
PARQUET_PROPERTIES = {"parquet.compression": "SNAPPY"}
# The same settings as writer options: Spark's file sources read OPTIONS, not
# TBLPROPERTIES, when they write.
ORC_OPTIONS = {"compression": "snappy", "orc.stripe.size": "268435456"}
PARQUET_OPTIONS = {"compression": "snappy"}


def replace_staging_table(df: DataFrame, name: str, fmt: str = "orc", max_records_per_file: int = 5_000_000) -> None:
    """Drop the staging table if there is one and write it anew."""
    drop_table(df.sparkSession, name)
    (df.write.format(fmt).option("maxRecordsPerFile", max_records_per_file)
       .option("compression", "snappy").saveAsTable(name))


def write_staging(df: DataFrame, path: str, fmt: str = "orc", max_records_per_file: int = 5_000_000) -> None:
    """Overwrite a staging location in one pass.

    The original job forced one output file (all rows through one task);
    here each task writes its own files, capped at ``max_records_per_file``.
    """
    (df.write.mode("overwrite").format(fmt)
       .option("maxRecordsPerFile", max_records_per_file)
       .option("compression", "snappy").save(path))


def create_request_table(
    spark: SparkSession,
    name: str,
    location: str | None = None,
    fmt: str = "orc",
    fields: Sequence[str] = REQUEST_FIELDS,
) -> None:
    """``CREATE TABLE`` of string fields, partitioned by ``ds``, ORC or Parquet + snappy."""
    props = ORC_PROPERTIES if fmt == "orc" else PARQUET_PROPERTIES
    opts = ORC_OPTIONS if fmt == "orc" else PARQUET_OPTIONS
    cols = ", ".join(f"`{f}` STRING" for f in fields)
    loc = f" LOCATION {quote_literal(location)}" if location else ""
    kv = lambda d: ", ".join(f"{quote_literal(k)}={quote_literal(v)}" for k, v in d.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({cols}, ds STRING) USING {fmt} OPTIONS ({kv(opts)}) "
        f"PARTITIONED BY (ds){loc} TBLPROPERTIES ({kv(props)})"
    )


def insert_partition(
    df: DataFrame, table: str, ds: str | None = None, overwrite: bool = True, fields: Sequence[str] = REQUEST_FIELDS
) -> None:
    """Write records into partition ``ds`` of ``table``.

    ``overwrite=True`` replaces only the partition(s) written, so a rerun does
    not duplicate rows; ``overwrite=False`` appends like the original job.
    With ``ds`` given it is a static partition (``INSERT ... PARTITION
    (ds='...')``); with ``ds=None`` the frame's own ``ds`` column picks the
    partitions and only those present in the data are replaced: the files are
    written at the table's location with the per-write overwrite mode (no
    session setting changes) and the partitions are then registered.
    Rows are rebalanced before the write, by ``ds`` where it varies: AQE
    splits a hot day over several files and joins small ones.
    """
    spark = df.sparkSession
    cols = ", ".join(f"`{f}`" for f in fields)
    if ds is not None:
        if not _DS_RE.match(ds):
            raise ValueError(f"bad partition value {ds!r}")
        mode = "OVERWRITE" if overwrite else "INTO"
        spark.sql(f"INSERT {mode} TABLE {table} PARTITION (ds = {quote_literal(ds)}) SELECT {cols} FROM {{src}}",
                  src=df.select(*fields).hint("rebalance"))
        return
    rows = df.select(*fields, F.col("ds").cast("string").alias("ds")).hint("rebalance", "ds")
    if not overwrite:
        spark.sql(f"INSERT INTO TABLE {table} PARTITION (ds) SELECT {cols}, ds FROM {{src}}", src=rows)
        return
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    fmt = about["Provider"].lower()
    writer = rows.write.mode("overwrite").partitionBy("ds").option("partitionOverwriteMode", "dynamic")
    writer.options(**(ORC_OPTIONS if fmt == "orc" else PARQUET_OPTIONS)).format(fmt).save(about["Location"])
    spark.sql(f"MSCK REPAIR TABLE {table}")
    spark.catalog.refreshTable(table)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
