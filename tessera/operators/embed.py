"""Vectors of chunks (F6, F12): a model hook with a cache, and the packed form of a vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What goes before a text that is indexed, and the texts that a model gets at once.
PREFIX, BATCH = "passage: ", 128


def with_vectors(chunks: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], model_id: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """vectors of ``chunks(job_id, cid, doc_id, text, normalized_hash)`` and the rows to add to the cache.

    ``model`` makes, once per task, the function that turns texts into rows of numbers.
    Each normalized hash is computed once, and not at all if ``cache(normalized_hash,
    model_id, vector)`` has it for this model.
    """

    @F.pandas_udf("array<float>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for s in batches:
            texts = [PREFIX + (t or "") for t in s]
            rows = [r for at in range(0, len(texts), BATCH) for r in np.asarray(run(texts[at : at + BATCH]), dtype=np.float32)]
            yield pd.Series(rows, dtype=object)

    wanted = chunks.groupBy("normalized_hash").agg(F.min("text").alias("text"))
    known = None if cache is None else cache.filter(F.col("model_id") == model_id).select("normalized_hash", "vector").dropDuplicates(["normalized_hash"])
    if known is not None:
        wanted = wanted.join(known, "normalized_hash", "left_anti")
    fresh = wanted.select("normalized_hash", F.lit(model_id).alias("model_id"), of("text").alias("vector"))
    every = fresh.select("normalized_hash", "vector")
    every = every if known is None else every.unionByName(known)
    return chunks.select("job_id", "cid", "doc_id", "normalized_hash").join(every, "normalized_hash").select("job_id", "cid", "doc_id", "vector"), fresh


def packed(vector: Column) -> Column:
    """a vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in s], dtype=object)

    return of(vector)


def unpacked(blob: Column) -> Column:
    """the vector of ``packed``; bytes beyond the last whole float are ignored."""

    @F.pandas_udf("array<float>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4") for b in s], dtype=object)

    return of(blob)
