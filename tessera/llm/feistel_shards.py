"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Every row gets a global number, its place in the order of a hash: rows fall into
buckets by the hash's leading bits, are counted per bucket, and are numbered within
their bucket after the rows of the buckets before. The numbers do not depend on the
number of buckets, which grows with the rows. A keyed Feistel network over a x b >= N points, walked until the
point is below N, permutes 0..N-1; shard and slot follow from the permuted number
alone (p mod shards, p div shards), for any row, without looking at another.

Law ``rows``: the shards' row counts differ by one at most. DataFrame functions
only; texts are not shuffled unless they are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import checkpointed

#: Rows of a bucket of the numbering, about, and the least bits of the hash that name one. Each bucket is one sorted run.
BUCKET_ROWS, BUCKET_BITS = 100_000, 12
ROUNDS = 4
SEED = 20_240_607


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the Feistel network over numbers left * b + right, left < a, right < b."""
    left, right = F.floor(x / F.lit(b)).cast("long"), x % F.lit(b)
    state = F.struct(left.alias("l"), right.alias("r"))

    def step(s: Column, i: Column) -> Column:
        # even rounds change the left half by the right one, odd rounds the right half by the left one
        l = F.when(i % 2 == 0, F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a))).otherwise(s["l"])
        r = F.when(i % 2 == 1, F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b))).otherwise(s["r"])
        return F.struct(l.alias("l"), r.alias("r"))

    end = F.aggregate(F.array(*[F.lit(i) for i in range(2 * ROUNDS)]), state, step)
    return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda z, e: e["l"] * F.lit(b) + e["r"])


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``x`` (0..n-1) in the shuffled order.

    The a x b grid has fewer than sqrt(n) + 1 points beyond n, so a walk is short:
    with up to 64 of them it is followed through all; with more, they are less than
    1/64 of the grid and 64 steps are never used up (the query would fail, not err).
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    x = x.cast("long")
    beyond = min(64, a * b - n)
    walk = F.aggregate(
        F.array(*[F.lit(i) for i in range(beyond)]) if beyond else F.array().cast("array<int>"),
        _once(x, a, b, seed),
        lambda y, _: F.when(y < n, y).otherwise(_once(y, a, b, seed)),
    )
    return F.aggregate(F.array(walk), F.lit(0).cast("long"), lambda z, y: F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def row_numbers(rows: DataFrame, by: list[str], bucket_rows: int = BUCKET_ROWS, out: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows from 0 in an order that depends on the columns ``by`` alone; and their count.

    Rows that are equal in ``by`` are interchangeable. No total sort: each bucket
    is sorted by itself and starts where the buckets before it end.
    """
    total = rows.count()
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, total / bucket_rows))))
    rows = rows.withColumn("_hash", F.xxhash64(*by)).withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = checkpointed(counts.select(F.col("_bucket").alias("_b"), "n").withColumn("_start", F.sum("n").over(upto) - F.col("n")))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *[F.col(c).asc_nulls_first() for c in by])) - 1
    numbered = rows.withColumn("_inside", inside)
    starts = starts.select("_b", "_start")  # 16 bytes for each 100,000 rows, or 4,096 of them
    numbered = numbered.join(F.broadcast(starts) if bits <= 20 else starts, F.col("_bucket") == F.col("_b"))
    return numbered.withColumn(out, F.col("_start") + F.col("_inside")).drop("_hash", "_bucket", "_b", "_start", "_inside"), total


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add size (UTF-8 bytes of the text, null none, plus 8) and text_crc32 (of those bytes, unsigned)."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")))
    return docs.withColumns({"size": size, "text_crc32": crc})


def assign_shards(docs: DataFrame, by: list[str], shards: int = 24, seed: int = SEED) -> DataFrame:
    """Add law, shard (0 to shards - 1), slot (gapless from 0 in each shard) and grown_shard (null).

    Any column of ``by`` may be null; rows that are equal in all of ``by`` get
    different slots, interchangeably. No rows give no rows.
    """
    numbered, n = row_numbers(docs, by)
    place = numbered.withColumn("_place", permuted(F.col("row_number"), n, seed))
    return place.withColumns({
        "law": F.lit("rows"), "shard": (F.col("_place") % shards).cast("int"),
        "slot": F.floor(F.col("_place") / shards).cast("long"), "grown_shard": F.lit(None).cast("int"),
    }).drop("_place", "row_number")
