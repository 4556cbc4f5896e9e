"""Import jobs (S10-S12): validation, deduplication, cache reuse, parsing, chunks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.config import CompareConfig, FileMissing, ParserConfig, UnsupportedFile
from tessera.operators.chunk import chunk_documents
from tessera.sources.parse import ACCEPTED, LEGACY, parse_files, read_files


def options_hash(parser: ParserConfig, compare: CompareConfig) -> str:
    """The fingerprint of the eight options that change what a file parses to."""
    names = ("ignore_case", "ignore_punctuation", "ignore_whitespace", "language")
    told = vars(parser) | {n: getattr(compare, n) for n in names}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def checked_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """A missing or unsupported file stops the whole import before anything is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        ext = p.rpartition(".")[2].lower()
        if ext in LEGACY:
            raise UnsupportedFile(f"{p}: convert .{ext} files to docx or xlsx first")
        if ext not in ACCEPTED:
            raise UnsupportedFile(f"{p}: .{ext} is not among {', '.join(ACCEPTED)}")
        at = hadoop(p)
        if not at.getFileSystem(conf).exists(at):
            raise FileMissing(p)
    return list(dict.fromkeys(paths))


def new_files(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The first of files with equal content, without those that the workspace has parsed; failed ones do not count."""
    first = files.withColumn("_rn", F.row_number().over(Window.partitionBy("file_hash").orderBy("path"))).filter("_rn = 1").drop("_rn")
    if stored is None:
        return first
    return first.join(stored.filter("status != 'failed'").select("file_hash").distinct(), "file_hash", "left_anti")


def import_files(spark: SparkSession, paths: list[str], parser: ParserConfig | None = None, compare: CompareConfig | None = None, stored: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Parsed rows of new files; content that ``cache(file_hash, options_hash, ...)`` has under the same options is reused."""
    parser, compare = parser or ParserConfig(), compare or CompareConfig()
    files = new_files(read_files(spark, checked_paths(spark, paths)), stored)
    key = options_hash(parser, compare)
    if cache is None:
        return parse_files(files, parser).withColumn("options_hash", F.lit(key))
    known = cache.filter((F.col("options_hash") == key) & (F.col("status") == "parsed")).dropDuplicates(["file_hash"])
    reused = files.select("path", "file_hash").join(known.drop("path"), "file_hash").withColumn("parse_method", F.lit("cache"))
    fresh = parse_files(files.join(known.select("file_hash"), "file_hash", "left_anti"), parser).withColumn("options_hash", F.lit(key))
    return fresh.unionByName(reused.select(fresh.columns))


def chunks_of_import(parsed: DataFrame, parser: ParserConfig | None = None) -> DataFrame:
    """Chunks of all levels of parsed rows; doc_id is a hash of the file's content."""
    docs = parsed.filter("status = 'parsed'").select(F.xxhash64("file_hash").alias("doc_id"), "blocks")
    return chunk_documents(docs, parser)
