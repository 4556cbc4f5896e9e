"""A corpus from documents to shards: judge, deduplicate, decontaminate, mix and shard.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns
the columns of ``documents``; the last adds each row's shard and slot. ``run``
chains them over Parquet in the shared folder, so each stage reads what the one
before it wrote and a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import edit_decontam, feistel_shards, kneser_ney, simhash_ball, source_schedule
from tessera.llm.common import checkpointed, ensure_checkpoint_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Up to so many kept rows, of 17 bytes each, are sent to the texts; more meet them by shuffle.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model does not reject. Null and empty texts are rejected; each of repeated rows is judged alike."""
    judged = kneser_ney.judge_quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return judged.filter("keep").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, null last, and of several such the one with the smallest hash.

    Rows are judged by their texts alone, so different texts of one id are different
    documents. Null texts and texts without words are copies of one another; of equal
    rows one stays.
    """
    docs = docs.select(COLUMNS)
    said = [F.concat(F.lit("\x01"), F.col(c).cast("string")) for c in COLUMNS]
    row = F.unhex(F.md5(F.concat_ws("\x02", *[F.coalesce(c, F.lit("")) for c in said])))
    placed = simhash_ball.similar_groups(docs.withColumn("_row", row), ["doc_id", "_row"])
    kept = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("s")).select("s._row")
    # rows that are equal in all columns have one hash, and only one of them stays
    several = placed.groupBy("_row").agg((F.count("*") > 1).alias("_several"))
    kept = checkpointed(kept.join(several, "_row"))
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept.hint("shuffle_merge")
    docs_kept = docs.withColumn("_row", row).join(kept, "_row")
    once = docs_kept.filter("_several").dropDuplicates(["_row"])
    return docs_kept.filter("not _several").select(COLUMNS).union(once.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; each of repeated rows is judged alike."""
    return edit_decontam.drop_leaks(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number of times.

    The schedule takes stretches of words; a document of which it takes at least
    half once more than n times comes n + 1 times. Without words: not at all.
    """
    mixed = source_schedule.mix_sources(docs)
    times = mixed.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    times = times.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.expr("int(round(taken / (size * rows)))").alias("_times")).filter("_size > 0 and _times > 0")
    sized = docs.select(COLUMNS).withColumn("_n", source_schedule.word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    return sized.join(times, same).withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot in a reproducible shuffle. Null texts have 8 bytes; repeated rows each have a slot."""
    sized = feistel_shards.with_sizes(docs.select(COLUMNS))
    return feistel_shards.assign_shards(sized, ["doc_id", "size", "text_crc32"]).select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can express neither the model nor the fingerprints; tests/llm compares each stage with a plain version of it, and run() with the stages one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's table stays in the checkpoint folder, the others go when they are read."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
