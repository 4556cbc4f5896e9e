"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: all words are shared among the sources by weight; a source's target stops
at ``max_epochs`` times its own words and the excess is reshared by weight.

Schedule: slot i of the mix has the point frac(i * golden ratio); the source in
whose stretch of the cumulative weights the point falls owns the slot. Any run of
slots then has every source in its share, within the sequence's low discrepancy.
The slots of a source are ranked; its documents, shuffled by a hash of their id,
are cut into blocks of equally many words, and the slot of rank r takes block
r mod blocks. A document's taken words are those of its taken blocks. A source that
is small beside the mix has smaller blocks, and a stretch that is longer by as much.

DataFrame functions only. A source with a third of all rows is ordered in hash
buckets of which each is sorted by itself; blocks and slots meet by (source, block).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Slots of the whole mix, about: a block has 1/SLOTS of all words.
SLOTS = 100_000
#: A source of fewer blocks than this has blocks of its own, as many at least as its words allow.
LEAST_BLOCKS = 1_000
#: The golden ratio's fraction as 62 bits, so that frac(i * ratio) is exact integer arithmetic on both engines.
GOLDEN = 618_033_988_749_895
MODULUS = 1_000_000_000_000_000
CELLS = 4096
#: Rows of a hash bucket, about, and the least hexadecimal digits that name one.
BUCKET_ROWS, BUCKET_DIGITS = 100_000, 3
_ORDER_KEY = "md5(concat('mix|', coalesce(cast(doc_id as string), 'null'), '|', cast(size as string)))"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, size)`` to one row per source: source, rank, weight, source_size, target.

    The cap of the sources with the least cap per weight binds first, so resharing
    until none is above its cap is one pass over the sources in that order: the
    first whose share of what is left fits gets it, and so do all after it. The level
    (share per weight) rises up to that source and falls after it: it is the greatest.
    Sources without words have the target 0.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("rank"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = total.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * MAX_EPOCHS).withColumn("ratio", F.expr("cap / weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(after))
    fits = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * fits, F.col("cap").cast("double")))).select(
        "source", "rank", "weight", "source_size", "target"
    )


def source_slots(targets: DataFrame, n: int) -> DataFrame:
    """``n`` slots to ``(rank, r)``: the source of each, by ``targets(rank, share)``, and its rank among the source's slots.

    The point of a slot and the stretches of the sources meet in CELLS cells.
    """
    spark = targets.sparkSession
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = targets.withColumn("hi", F.sum("share").over(upto) / F.sum("share").over(whole))
    ends = ends.withColumn("hi", F.floor(F.col("hi") * MODULUS).cast("long"))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0).cast("long")))
    last = F.col("rank") == F.max("rank").over(whole)
    ends = ends.withColumn("hi", F.when(last, F.lit(MODULUS)).otherwise(F.col("hi"))).filter("hi > lo")
    width = MODULUS // CELLS + 1
    ends = ends.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    point = F.expr(f"cast(cast(id as decimal(20,0)) * {GOLDEN} % {MODULUS} as long)")
    slots = spark.range(n).select("id", point.alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    owned = slots.join(ends.select("cell", "lo", "hi", "rank"), "cell").filter("x >= lo and x < hi")
    return owned.select("rank", (F.row_number().over(Window.partitionBy("rank").orderBy("id")) - 1).cast("long").alias("r"))


def mix_sources(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Every row of ``docs(doc_id, source, text, ...)`` as doc_id, source, size, source_size, target, taken.

    size: words of the text (null 0). taken: words that the mix takes of this row,
    repeats counted, at most three times its size. Sources are ordered by code
    point, null last as a source of its own. Null ids and repeated rows take part
    one by one; a reordering of the input changes nothing but which of several
    equal rows gets which share. Without any words all targets are 0.
    """
    rows = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = checkpointed(source_targets(rows))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // slots))
    own = F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}"))
    targets = targets.withColumn("block", F.least(F.lit(block), own).cast("long"))
    # words of the target if each slot took a common block
    share = F.when(F.col("block") == block, F.col("target")).otherwise(F.col("target") * block / F.col("block"))
    targets = checkpointed(targets.withColumn("share", share))
    smaller = targets.filter((F.col("block") < block) & (F.col("source_size") > 0)).agg(F.count("*")).first()[0]
    n = math.ceil(targets.agg(F.sum("share")).first()[0] / block) if smaller else -(-total // block)
    # where each document starts in its source's shuffled order: bucket totals first, then within the bucket
    # the bucket is the start of the key, so its length changes no order
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(1, rows.count() / BUCKET_ROWS), 16)))
    keyed = rows.withColumn("k", F.expr(_ORDER_KEY)).withColumn("b", F.substring("k", 1, digits))
    short = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target", "block")
    keyed = keyed.join(short, keyed["source"].eqNullSafe(short["_source"])).drop("_source")
    sums = keyed.groupBy("rank", "b").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("rank").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy("rank", "b").orderBy("k", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("upto", F.sum("size").over(inside)).withColumn("copy", F.row_number().over(inside))
    placed = placed.join(sums, ["rank", "b"]).withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    # the blocks that it reaches into, with the number of slots that take each
    pieces = placed.withColumn("blk", F.explode(F.expr("if(size > 0, sequence(start div block, (start + size - 1) div block), array(-1L))")))
    part = F.expr("least(start + size, (blk + 1) * block) - greatest(start, blk * block)")
    pieces = pieces.withColumn("part", F.when(F.col("size") > 0, part).otherwise(F.lit(0)))
    blocks = targets.select("rank", F.expr("(source_size + block - 1) div block").alias("blocks"))
    taken = source_slots(targets, n).join(blocks, "rank").filter(F.col("r") < F.col("blocks") * MAX_EPOCHS)
    taken = taken.groupBy("rank", (F.col("r") % F.greatest("blocks", F.lit(1))).alias("blk")).agg(F.count("*").alias("times"))
    joined = pieces.join(taken, ["rank", "blk"], "left")
    keys = ["rank", "b", "copy", "doc_id", "source", "size", "source_size", "target"]
    out = joined.groupBy(*keys).agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = rf"""
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM total),
ranked AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[(rank % {len(WEIGHTS)} + 1)::INT] AS weight, source_size * {MAX_EPOCHS} AS cap FROM named),
levelled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM ranked),
fit AS (SELECT max(level) AS level FROM levelled WHERE cap / weight >= level),
targets AS (SELECT source, rank, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM fit), cap::DOUBLE)) AS target FROM levelled),
shape AS (
  SELECT t.total, greatest(1, (t.total + {SLOTS} - 1) // {SLOTS})::BIGINT AS block FROM (SELECT coalesce(sum(source_size), 0)::BIGINT AS total FROM targets) t),
ends AS (
  SELECT rank, CASE WHEN rank = max(rank) OVER () THEN {MODULUS}
                    ELSE floor(sum(target) OVER (ORDER BY rank) / sum(target) OVER () * {MODULUS})::BIGINT END AS hi FROM targets),
stretches AS (SELECT rank, hi, coalesce(lag(hi) OVER (ORDER BY rank), 0) AS lo FROM ends),
slots AS (
  SELECT i AS id, (i::HUGEINT * {GOLDEN} % {MODULUS})::BIGINT AS x
  FROM (SELECT unnest(range(0, ((total + block - 1) // block)::BIGINT)) AS i FROM shape)),
owned AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY id) - 1 AS r FROM slots JOIN stretches ON x >= lo AND x < hi),
blocks AS (SELECT rank, (source_size + block - 1) // block AS blocks FROM targets, shape),
taken AS (
  SELECT rank, r % blocks AS blk, count(*) AS times FROM owned JOIN blocks USING (rank) WHERE r < blocks * {MAX_EPOCHS} GROUP BY ALL),
placed AS (
  SELECT row_number() OVER () AS id, doc_id, size, rank, source_size, target,
         (sum(size) OVER (PARTITION BY rank ORDER BY md5(concat('mix|', coalesce(doc_id::VARCHAR, 'null'), '|', size::VARCHAR)), doc_id NULLS FIRST, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
pieces AS (
  SELECT p.*, unnest(range(start // block, CASE WHEN size > 0 THEN (start + size - 1) // block ELSE start // block END + 1)) AS blk, block
  FROM placed p, shape)
SELECT doc_id, size, source_size, target,
       sum(CASE WHEN size > 0 THEN (least(start + size, (blk + 1) * block) - greatest(start, blk * block)) * coalesce(times, 0) ELSE 0 END)::BIGINT AS taken
FROM pieces LEFT JOIN taken USING (rank, blk)
GROUP BY id, doc_id, size, source_size, target"""
