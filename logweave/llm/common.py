"""Helpers shared by the operators: scratch tables, document keys, sized
broadcasts and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import shared_dir

#: ASCII white space, the word separator of most operators (Java regex).
SPACES = r"[ \t-\r]+"

#: Largest table, in bytes, that is sent to every executor; beyond it the
#: operators shuffle both sides.
BROADCAST_BYTES = 32 << 20

LOWEST = -(1 << 63)


class Scratch:
    """Written tables in the shared folder, one sub-folder per name.

    They cut lineage and survive lost executors. `drop` deletes a table as
    soon as nothing reads it any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_dir(spark, "llm", name)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Write `df` once and read it back."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def bytes(self, name: str) -> int:
        path = f"{self.root}/{name}"
        return self._fs(path).getContentSummary(self._path(path)).getLength()

    def drop(self, *names: str) -> None:
        for name in names:
            path = f"{self.root}/{name}"
            self._fs(path).delete(self._path(path), True)
        self.release()

    def release(self) -> None:
        """Let executors delete the shuffle files of the jobs that are done.

        Spark does so when the driver's garbage collector finds their plans,
        which on a driver with a large heap can be after the whole operator.
        """
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):      # not every system's C library has it
            ctypes.CDLL(None).malloc_trim(0)                    # what is freed goes back to the system
        self.spark._jvm.System.gc()

    def small(self, df: DataFrame, name: str, factor: int = 4) -> DataFrame:
        """`df` (read from table `name`) with a broadcast hint if the written
        table, `factor` times its file size, is within BROADCAST_BYTES; if not,
        with a hint to shuffle it, as Spark would still broadcast a table whose
        encoded files are small."""
        return F.broadcast(df) if self.bytes(name) * factor <= BROADCAST_BYTES else df.hint("merge")


def doc_order() -> list[Column]:
    """(did, th): a key of a row's document that is never null: the id (lowest
    long if null) and a hash of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"),
    ]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of `docs` has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, did, th, text) of every row, null texts as empty ones."""
    return docs.select("doc_id", *doc_order(), F.coalesce("text", F.lit("")).alias("text"))


def words_of(text: Column | str) -> Column:
    """Words of a text as an array, split at ASCII white space; no empty words."""
    return F.array_remove(F.split(text, SPACES), "")


def ascii_lower(text: Column | str) -> Column:
    """A-Z to a-z, all other characters unchanged (lower() would change more)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_constant(value: bytes, use: Callable[[Column], Column]) -> Column:
    """`use(c)` with c standing for a large constant. As the only element of a
    constant array it is a plain reference for every row, and the plan's text
    shows the array, not its bytes."""
    return F.get(F.transform(F.array(F.lit(value)), use), F.lit(0))


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b longs); root is the smallest
    node of the component.

    Alternates large-star and small-star steps until the edge set is a forest
    of stars and no longer changes. Each step is a partially aggregated minimum
    and a join with it; the minima are written first, so that both sides of the
    join are shuffled plainly and adaptive execution can split a hot node.
    """
    cur = scratch.write(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "cc_0")
    name, last = "cc_0", None
    for k in range(1, max_rounds + 1):
        sym = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mins = scratch.write(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"cc_min_{k}")
        large = scratch.write(
            sym.where("b > a").join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"cc_large_{k}")
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"cc_low_{k}")
        star = large.join(low, "a")
        new = scratch.write(
            star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
            .where("a != b").distinct(), f"cc_{k}")
        state = new.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first()
        scratch.drop(name, f"cc_min_{k}", f"cc_large_{k}", f"cc_low_{k}")
        cur, name = new, f"cc_{k}"
        if tuple(state) == last:
            # unchanged by a whole round: every edge leads to its root
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = tuple(state)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
