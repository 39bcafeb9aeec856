"""Session, shared-folder and table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_REMOVED_AT_EXIT: set[str] = set()


def get_session(master: str | None = None, app: str = "logweave", **conf: str) -> SparkSession:
    """Build (or reuse) a session.

    The local defaults above (shuffle width, UI off, UTC) are applied only for
    a ``local[...]`` master (tests, bench). Without a master the deployment's
    own settings stand; only ``conf`` given here is added.
    """
    b = SparkSession.builder.appName(app)
    settings = dict(conf)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            settings = {**_LOCAL_DEFAULTS, **conf}
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder comes from the session (``SparkContext.getCheckpointDir`` or
    the ``spark.checkpoint.dir`` setting the cluster names). Only a local
    session without either gets its own folder, created once; a cluster
    session without it is an error, since a machine-local folder is not
    visible to other executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a SparkContext handle (Spark Connect)
        sc = None
    root = sc.getCheckpointDir() if sc is not None else None
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="logweave-ckpt-")
        if sc is not None:
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir()
        else:
            spark.conf.set("spark.checkpoint.dir", root)
    name = "/".join([*parts, uuid.uuid4().hex]) if parts else uuid.uuid4().hex
    own = f"{root.rstrip('/')}/logweave"
    if sc is not None and root == sc.getCheckpointDir() and own not in _REMOVED_AT_EXIT:
        # the application's own folder: what nobody removes earlier goes when the driver ends
        target = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _REMOVED_AT_EXIT.add(own)
    return f"{own}/{name}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def once(spark: SparkSession, df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read back, for a frame that
    is dear to evaluate and read by several jobs. The folder goes when the
    driver ends."""
    path = shared_dir(spark, *parts)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
