"""The corpus pipeline: documents -> language ID -> line dedup -> near dedup ->
benchmark decontamination -> mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
every stage's result as Parquet in the shared folder and hands the written
table to the next, so a lost executor costs tasks of one stage only. All
stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import langid, line_dedup, mixing, simhash, winnow
from logweave.llm.common import Scratch, doc_order, unused
from logweave.llm.queries import MIX_BUDGET, MIX_TARGETS
from logweave.session import table

#: Least mean posterior of a document's language.
MIN_LANGUAGE_SCORE = 0.35


def reject_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a determined language, or with hardly
    more certainty than chance, go."""
    model = langid.fit(docs)
    # columns that the operator names anew are carried under other names
    own = [c for c in docs.columns if c in ("lang_pred", "score")]
    other = dict(zip(own, unused(docs, *[f"lw_{c}" for c in own])))
    Scratch(spark, "language").release()        # the training sample and its arrays
    out = langid.identify(docs.withColumnsRenamed(other), model)
    known = out.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later matches of a line go; documents of which no text is
    left go, and n_chars follows the text."""
    # columns that the operator names anew are carried under other names
    own = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    other = dict(zip(own, unused(docs, *[f"lw_{c}" for c in own])))
    out = line_dedup.remove_later_lines(docs.withColumnsRenamed(other), threshold=0.8, min_words=1)
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash: of each component one row stays, that with the smallest id
    (rows without an id first, then by a hash of the text). Rows are told
    apart by id and text; of rows equal in both, one stays at most."""
    scratch = Scratch(spark, "near")
    key, number = unused(docs, "lw_key", "lw_number")
    keyed = docs.withColumn(key, F.xxhash64(*doc_order()))
    groups = simhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), size=3, max_bits=3)
    rows = groups.groupBy(F.col("doc_id").alias("k"), "component_id").agg(F.count("*").alias("n"))
    order = docs.select(*doc_order()).select(F.xxhash64("did", "th").alias("k"), "did", "th").distinct()
    placed = scratch.write(rows.join(order, "k"), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct("did", "th", "k")).alias("first"), F.count("*").alias("size")).where("size > 1")
    first = scratch.write(first.select("component_id", F.col("first.k").alias("of")), "first")
    gone = scratch.write(placed.join(scratch.small(first, "first"), "component_id").where("k != of").select(F.col("k").alias(key)), "gone")
    twice = scratch.write(placed.where("n > 1").select(F.col("k").alias(key)), "twice")
    left = keyed.join(scratch.small(gone, "gone"), key, "left_anti")
    # equal rows are written with a number, the lowest stays
    again = scratch.write(left.join(scratch.small(twice, "twice"), key, "left_semi").withColumn(number, F.monotonically_increasing_id()), "again")
    one = scratch.write(again.groupBy(key).agg(F.min(number).alias("number")), "one").select(F.col("number").alias(number))
    once = left.join(scratch.small(twice, "twice"), key, "left_anti").select(*docs.columns)
    return once.unionAll(again.join(scratch.small(one, "one"), number, "left_semi").select(*docs.columns))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing: documents that hold a window of a benchmark item go."""
    return winnow.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the sample that meets the target weights, with the probability
    each document was kept with."""
    return mixing.mix(docs, MIX_TARGETS, MIX_BUDGET, seed=1).where("kept").drop("kept")


STAGES = [
    ("language_id", reject_languages),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
]

#: SQL cannot express the language stage (a trained field); tests hold every
#: other stage against brute force or SQL, and the whole against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
