"""The three jobs as ``spark-submit`` entry points.

    spark-submit logweave/cli.py request-etl --root R --start 2017-11-2120:10 --table request_records
    spark-submit logweave/cli.py reconcile 'in/*.log' out/
    spark-submit logweave/cli.py stream-tokens --servers host:9092 --topics t --sink S --checkpoint C
    spark-submit logweave/cli.py stream-tokens --files in/ --available-now --sink S --checkpoint C
"""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from logweave.operators import reconcile as R  # noqa: E402
from logweave.operators import weblog  # noqa: E402
from logweave.session import remove_dir, shared_dir  # noqa: E402
from logweave.sources import files, kafka, tables  # noqa: E402
from logweave.streaming import tokens  # noqa: E402


def request_etl(spark: SparkSession, a: argparse.Namespace) -> None:
    """Log files of ``start < t < now`` -> request records -> partition ``ds`` (day of now).

    Successive runs cover successive ranges of the same day, so the default is
    to append to the day's partition (as the original job); ``--overwrite``
    replaces it. Rejected lines go to ``--reject-path`` when given.
    """
    now = datetime.strptime(a.now, "%Y-%m-%d %H:%M:%S") if a.now else datetime.now()
    start = files.parse_start(a.start)
    lines = files.scan_time_range(spark, a.root, start, now, single_day=a.single_day)
    skipped = files.unnamed_files(spark, a.root, start, now, single_day=a.single_day).count()
    if skipped:
        print(f"request-etl: skipped {skipped} file(s) whose names carry no time", file=sys.stderr)
    tables.create_request_table(spark, a.table, a.location, a.format)
    ds = now.strftime("%Y%m%d")
    if not a.reject_path:
        good = weblog.extract_requests(lines, "value", strict=True) if a.strict else weblog.good_requests(lines, "value")
        tables.insert_partition(good, a.table, ds, overwrite=a.overwrite)
        return
    # both kinds are wanted: one pass over the input writes them apart, the
    # partition and the reject files are filled from the written copy
    stage = shared_dir(spark, "etl")
    recs = weblog.extract_requests(lines, "value", keep=("value",), strict=a.strict)
    recs.withColumn("value", F.when(F.col("rejected"), F.col("value"))).write.partitionBy("rejected").parquet(stage)
    staged = spark.read.schema(recs.schema).parquet(stage)
    tables.insert_partition(staged.where("NOT rejected"), a.table, ds, overwrite=a.overwrite)
    staged.where("rejected").select("value").write.mode("overwrite").text(a.reject_path)
    remove_dir(spark, stage)


def reconcile_job(spark: SparkSession, a: argparse.Namespace) -> None:
    """Comma lines -> per key (reported, actual) -> ``(key,(reported,actual))`` text."""
    R.write_pair_text(R.reconcile(files.read_lines(spark, a.input)), a.output)


def stream_tokens(spark: SparkSession, a: argparse.Namespace) -> None:
    """Kafka topics (or a folder of text files) -> token counts of every
    micro-batch -> sink folders."""
    if a.files:
        reader = spark.readStream
        if a.max_files:
            reader = reader.option("maxFilesPerTrigger", a.max_files)
        src = reader.text(a.files)
    elif a.servers and a.topics:
        src = kafka.kafka_values(kafka.kafka_stream(spark, a.servers, a.topics.split(","), a.group_id))
    else:
        raise SystemExit("stream-tokens needs --servers and --topics, or --files")
    q = tokens.start_batch_token_counts(src, a.sink, a.checkpoint, interval=a.interval,
                                        available_now=a.available_now, show=a.show)
    q.awaitTermination()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="logweave")
    sub = p.add_subparsers(dest="job", required=True)
    e = sub.add_parser("request-etl")
    e.add_argument("--root", required=True, help="log root with yyyy/MM/dd day folders")
    e.add_argument("--start", required=True, help="yyyy-MM-ddHH:mm (exclusive)")
    e.add_argument("--now", help="'yyyy-MM-dd HH:mm:ss' (exclusive); default: current time")
    e.add_argument("--table", required=True)
    e.add_argument("--location")
    e.add_argument("--format", default="orc", choices=["orc", "parquet"])
    e.add_argument("--overwrite", action="store_true")
    e.add_argument("--single-day", action="store_true")
    e.add_argument("--strict", action="store_true")
    e.add_argument("--reject-path")
    r = sub.add_parser("reconcile")
    r.add_argument("input")
    r.add_argument("output")
    s = sub.add_parser("stream-tokens")
    s.add_argument("--servers")
    s.add_argument("--topics")
    s.add_argument("--files", help="folder of text files, one value per line (instead of Kafka)")
    s.add_argument("--max-files", type=int, default=0, help="most files of a micro-batch with --files (default: no limit)")
    s.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    s.add_argument("--group-id")
    s.add_argument("--sink", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--interval", default=tokens.BATCH_INTERVAL)
    s.add_argument("--show", type=int, default=10, help="counts printed per batch (0: none)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"logweave-{a.job}").getOrCreate()
    {"request-etl": request_etl, "reconcile": reconcile_job, "stream-tokens": stream_tokens}[a.job](spark, a)


if __name__ == "__main__":
    main()
