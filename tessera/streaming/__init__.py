"""Import of files as they arrive, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import ParserConfig
from tessera.sources.importing import chunks_of_import, new_files
from tessera.sources.parse import parse_files


def import_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, parser: ParserConfig | None = None) -> StreamingQuery:
    """Parse and chunk each new file of ``folder`` once; results go to ``out/documents`` and ``out/chunks``, one folder per batch.

    A batch that is run again replaces its own folder, so a failure in between duplicates nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), "content", F.sha2("content", 256).alias("file_hash"))

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_files(new_files(batch), parser).persist()
        parsed.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        chunks_of_import(parsed, parser).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        parsed.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
