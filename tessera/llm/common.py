"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and white-space classes that the operators share, as Java regular expressions.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Spark's switch for an action to remove the files of its shuffles when it ends; it holds for DataFrames made while it is on.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; make one only where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of 2 MB: a worker then needs little memory whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """An action on a DataFrame that is made in here removes its shuffle files when it ends.

    Otherwise they stay until the driver collects garbage, which the plans of many small
    steps hardly bring about. Such a DataFrame is for one action: another repeats its shuffles.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, "false")
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; nothing reads its shuffles any more, so they go."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def join_spread(rows: DataFrame, found: DataFrame, key: str, least: int = 1_000, counted: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Left join of ``rows`` with ``found``, which has a row per key, though one key may hold a third of ``rows``.

    Keys of more than ``least`` rows, and more than 1/100,000 of all, are counted (in
    ``counted`` if given) and dealt over as many tasks as they have such shares, by the
    column ``by`` or else in turn; their rows of ``found`` go to each. Without ``by``
    ``rows`` must be checkpointed or a table, so that a retry deals alike.
    """
    counted = rows if counted is None else counted
    counts = checkpointed(counted.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col(key).isNotNull() & (F.col("_n") > least)))
    many = counts.limit(100_001).count() > 100_000
    share = max(least, counted.count() // 100_000) if many else least
    hot = F.broadcast(counts.filter(F.col("_n") > share).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / share).cast("int").alias("_shares")))  # at most 100,000 rows
    shares, turn = F.coalesce("_shares", F.lit(1)), F.xxhash64(by) if by else F.monotonically_increasing_id()
    dealt = rows.join(hot, rows[key] == F.col("_hot"), "left").withColumn("_at", F.pmod(turn, shares).cast("int")).drop("_hot", "_shares")
    known = found.withColumnRenamed(key, "_key").join(hot, F.col("_key") == F.col("_hot"), "left")
    known = known.withColumn("_to", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_hot", "_shares")
    return dealt.join(known, (dealt[key] == known["_key"]) & (dealt["_at"] == known["_to"]), "left").drop("_key", "_at", "_to")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(col: Column) -> Column:
    """Number of space-separated words; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(SPACED_WORD)), F.lit(0)).cast("long")
