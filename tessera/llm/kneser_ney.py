"""Text quality by perplexity under an interpolated modified Kneser-Ney model of symbols.

The model is trained on all trusted text and scores every document. Its units are
the characters as they are, each a code point of its own; n-grams have the order
ORDER, and their number grows with the trusted text.

Training: every task counts the n-grams of its part; the counts are sharded by
n-gram and summed; context totals, continuation counts and the discounts of each
order come from sharded aggregations and joins of those counts. The probability of
every seen n-gram and the backoff weight of every seen context are joined order by
order.

Scoring: the n-gram counts of the documents are joined with the model by shards,
order by order. A really small model, of at most ``broadcast_entries`` rows, is
sent to the texts instead, with the same result. Perplexities then become z: how many times
its standard error a text's mean log-probability is off the mean of its language's
trusted text. A text is rejected if z is outside of the language's quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, checkpointed

ORDER = 4
#: Bits of a code point in a context, and the number of code points.
WIDTH = 21
CHARACTERS = 0x110000
#: Characters that a task looks at at a time, at about 150 bytes each.
SLICE = 1 << 17


# ------------------------------------------------------------------ character n-grams
def _characters(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, symbol, text) per character, SLICE of them at a time: the ORDER - 1 code points before it in one number, its own, and the text's place."""
    pad = "\n" * (ORDER - 1)
    cps = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + ORDER - 1
    stops = np.cumsum(lengths)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    owned = np.ones(len(cps), dtype=bool)
    for i in range(ORDER - 1):
        owned[stops[:-1] + i] = False
    for low in range(ORDER - 1, len(cps), SLICE):
        part = cps[low - (ORDER - 1) : low + SLICE].astype(np.int64)
        n = len(part) - (ORDER - 1)
        context = part[:n]
        for i in range(1, ORDER - 1):
            context = context << WIDTH | part[i : i + n]
        own = owned[low : low + n]
        yield context[own], part[ORDER - 1 :][own], text_of[low - (ORDER - 1) : low - (ORDER - 1) + n][own]


def _distinct(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, symbol) and how often each occurs."""
    parts = [*((context >> WIDTH * i) & (1 << WIDTH) - 1 for i in range(ORDER - 1)), symbol]
    used = np.zeros(CHARACTERS, dtype=bool)
    for part in parts:
        used[part] = True
    alphabet = np.nonzero(used)[0]
    if len(alphabet) > 1 << 64 // ORDER:  # so many kinds of characters do not fit in a number: half of the places at a time
        half = len(context) // 2
        halves = [_distinct(context[x], symbol[x]) for x in (slice(0, half), slice(half, None))]
        return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
    small = np.zeros(CHARACTERS, dtype=np.uint64)
    small[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    bits = 64 // ORDER
    key = small[symbol]
    for i, part in enumerate(parts[:-1], 1):
        key |= small[part] << np.uint64(bits * i)
    keys, counts = np.unique(key, return_counts=True)
    places = [(keys >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1) for i in range(ORDER)]
    context = np.zeros(len(keys), dtype=np.int64)
    for place in places[:0:-1]:
        context = context << WIDTH | alphabet[place.astype(np.int64)]
    return context, alphabet[places[0].astype(np.int64)], counts


# --------------------------------------------------------------------- training
def count_ngrams(texts: DataFrame) -> DataFrame:
    """``texts(text)`` to ``(context, symbol, c)`` of all ORDER-grams of characters; nulls count as empty."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for context, symbol, _ in _characters([t for t in pdf["text"] if t]):
                yield pd.DataFrame(dict(zip(("context", "symbol", "c"), _distinct(context, symbol), strict=True)))

    return texts.select("text").mapInPandas(of, "context long, symbol long, c long").groupBy("context", "symbol").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order, at least 1/20 so that nothing is impossible; 1/2, 1 and 3/2 where its counts of counts have a zero."""
    n = counts.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 1.0) for i in range(3)]


def _lower(context: Column, k: int) -> Column:
    """The last k - 2 characters of the k - 1 of a context of order k."""
    return context.bitwiseAND(F.lit((1 << WIDTH * (k - 2)) - 1))


def train(texts: DataFrame) -> DataFrame:
    """The model as rows: order, context, symbol, v.

    v: interpolated probability of the symbol after the context of order - 1
    characters; with symbol -1 the weight that the context gives to the next lower
    order. No text at all gives an empty model.
    """
    counts = {ORDER: checkpointed(count_ngrams(texts))}
    for k in range(ORDER, 1, -1):  # below the highest order: in how many contexts does it continue?
        counts[k - 1] = checkpointed(counts[k].groupBy(_lower(F.col("context"), k).alias("context"), "symbol").agg(F.count("*").alias("c")))
    below, rows = None, []
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        level = counts[k].withColumn("off", off)
        contexts = level.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("mass"))
        contexts = contexts.select("context", "total", F.expr("mass / total").alias("bow"))
        level = level.join(contexts, "context")
        if below is None:
            level = level.withColumn("q", F.lit(1.0 / CHARACTERS))
        else:
            level = level.withColumn("lower", _lower(F.col("context"), k)).join(below.select(F.col("context").alias("lower"), "symbol", F.col("v").alias("q")), ["lower", "symbol"])
        below = checkpointed(level.select("context", "symbol", F.expr("(c - off) / total + bow * q").alias("v")))
        rows.append(below.select(F.lit(k).alias("order"), "context", "symbol", "v"))
        rows.append(contexts.select(F.lit(k).alias("order"), "context", F.lit(-1).cast("long").alias("symbol"), F.col("bow").alias("v")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# ---------------------------------------------------------------------- scoring
class _Hashed:
    """(context, symbol) to v, by open addressing in arrays."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, v: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(2 * len(context) + 1)))
        size = 1 << self.bits
        self.context, self.symbol, self.v = np.zeros(size, dtype=np.int64), np.full(size, -2, dtype=np.int32), np.zeros(size)
        at, left = self._place(context, symbol), np.arange(len(context))
        while len(left):
            free = np.nonzero(self.symbol[at] == -2)[0]
            slots, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.context[slots], self.symbol[slots], self.v[slots] = context[left[put]], symbol[left[put]], v[left[put]]
            wait = np.ones(len(left), dtype=bool)
            wait[put] = False
            left, at = left[wait], (at[wait] + 1) & (size - 1)

    def _place(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        h = context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ symbol.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The v of each, NaN where there is none."""
        at = self._place(context, symbol)
        there = self.symbol[at]
        hit = (there == symbol) & (self.context[at] == context)
        out = np.where(hit, self.v[at], np.nan)
        left = np.nonzero(~hit & (there != -2))[0]
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.symbol[at]
            hit = (there == symbol[left]) & (self.context[at] == context[left])
            out[left[hit]] = self.v[at[hit]]
            more = ~hit & (there != -2)
            left, at = left[more], at[more]
        return out


class Lookup:
    """The model's rows in hashed arrays, of 20 bytes for each of two to four slots a row."""

    def __init__(self, order: np.ndarray, context: np.ndarray, symbol: np.ndarray, v: np.ndarray):
        self.levels = [_Hashed(context[at], symbol[at], v[at]) for at in (order == k for k in range(1, ORDER + 1))]

    def probability(self, context: np.ndarray, symbol: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Of each symbol after the last k - 1 characters of its context, seen or backed off."""
        if not k:
            return np.full(len(context), 1.0 / CHARACTERS)
        own = context & (1 << WIDTH * (k - 1)) - 1
        p = self.levels[k - 1].find(own, symbol)
        rest = np.nonzero(np.isnan(p))[0]
        if len(rest):
            weight = self.levels[k - 1].find(own[rest], np.full(len(rest), -1))
            p[rest] = np.where(np.isnan(weight), 1.0, weight) * self.probability(own[rest], symbol[rest], k - 1)
        return p

    def logp(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol after its context."""
        return np.log(self.probability(context, symbol))


def _scores_in_tasks(docs: DataFrame, model: DataFrame) -> DataFrame:
    rows = model.select("order", "context", "symbol", "v").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast([rows.column(i).to_numpy() for i in range(4)])

    @F.pandas_udf("n long, logp double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lookup = Lookup(*shared.value)
        for texts in batches:
            n, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            for context, symbol, text in _characters([t or "" for t in texts]):
                n += np.bincount(text, minlength=len(texts))
                total += np.bincount(text, lookup.logp(context, symbol), minlength=len(texts))
            yield pd.DataFrame({"n": n, "logp": total})

    return docs.withColumn("_s", of("text")).select("*", F.col("_s.n").alias("n"), F.col("_s.logp").alias("logp")).drop("_s")


def _scores_by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same by sharded joins: each document's n-gram counts with the model, order by order."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, text in zip(pdf["_row"], pdf["text"], strict=True):
                for context, symbol, _ in _characters([text] if text else []):
                    yield pd.DataFrame({"_row": row} | dict(zip(("context", "symbol", "k"), _distinct(context, symbol), strict=True)))

    keyed = docs.withColumn("_row", F.sha2(F.concat_ws("\x01", F.col("doc_id").cast("string"), F.col("text")), 256))
    counts = keyed.select("_row", "text").distinct().mapInPandas(of, "_row string, context long, symbol long, k long")
    grams = counts.select("context", "symbol").distinct()
    p = F.lit(1.0 / CHARACTERS)
    for k in range(1, ORDER + 1):
        level = model.filter(F.col("order") == k)
        grams = grams.withColumn("_own", F.col("context").bitwiseAND(F.lit((1 << WIDTH * (k - 1)) - 1)))
        probs = level.filter("symbol >= 0").select(F.col("context").alias("_own"), "symbol", F.col("v").alias(f"p{k}"))
        bows = level.filter("symbol < 0").select(F.col("context").alias("_own"), F.col("v").alias(f"b{k}"))
        grams = grams.join(probs, ["_own", "symbol"], "left").join(bows, "_own", "left").drop("_own")
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"b{k}"), F.lit(1.0)) * p)
    sums = counts.join(grams.select("context", "symbol", F.log(p).alias("lp")), ["context", "symbol"]).groupBy("_row").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("lp")).alias("logp"))
    out = keyed.join(sums, "_row", "left").drop("_row")
    return out.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "logp": F.coalesce("logp", F.lit(0.0))})


def score(docs: DataFrame, model: DataFrame, broadcast_entries: int = 1_000_000) -> DataFrame:
    """Add n (characters), logp (their sum) and perplexity to ``docs(doc_id, text, ...)``; null or empty text: 0, 0, null."""
    head = model.limit(broadcast_entries + 1)
    size = head.count()
    if size <= broadcast_entries:
        scored = _scores_in_tasks(docs, model)
    else:
        scored = _scores_by_join(docs, model)
    return scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))))


# ------------------------------------------------------------------- thresholds
def language_limits(trusted: DataFrame, low: float, high: float, prior: int = 100) -> DataFrame:
    """``trusted(lang, n, logp)`` to one row per language: mean, z_low, z_high; and a row with lang null for the rest.

    z = (logp / n - mean) * sqrt(n), off the language's own mean. Its quantiles are
    taken over counts of hundredths, which any number of rows can be summed into.
    A language's own quantiles count by its texts, those of all languages' z by
    ``prior`` texts; as its mean is uncertain too, the limits are wider by
    sqrt(1 + 1 / texts). The row for the rest is about the mean of all.
    """

    def means(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("lang").alias("_lang")).agg(F.expr("sum(logp) / sum(n)").alias("mean"), F.count("*").alias("texts"))

    def binned(rows: DataFrame, mean: DataFrame) -> DataFrame:
        off = F.round((F.col("logp") / F.col("n") - F.col("mean")) * F.sqrt("n"), 2)
        z = rows.join(mean, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "mean", "texts", off.alias("z"))
        return z.groupBy("lang", "mean", "texts", "z").agg(F.count("*").alias("k"))

    def quantiles(bins: DataFrame) -> DataFrame:
        bins = bins.withColumn("upto", F.expr("sum(k) over (partition by lang order by z)"))
        at = [F.min(F.when(F.col("upto") >= F.col("texts") * share, F.col("z"))).alias(name) for share, name in ((low, "z_low"), (high, "z_high"))]
        return bins.groupBy("lang", "mean", "texts").agg(*at)

    known = trusted.filter("n > 0")
    named = known.filter("lang is not null")
    every = known.withColumn("lang", F.lit(None).cast("string"))
    own = checkpointed(binned(named, means(named)))
    pooled = own.groupBy("z").agg(F.sum("k").alias("k")).withColumn("lang", F.lit("all")).withColumn("mean", F.lit(0.0))
    pooled = quantiles(pooled.withColumn("texts", F.lit(own.agg(F.sum("k")).first()[0]).cast("long")))
    every_low, every_high = pooled.select("z_low", "z_high").first() or (None, None)
    wider = F.sqrt(1 + 1 / F.col("texts"))
    shrunk = [((F.col(z) * F.col("texts") + F.lit(q) * prior) / (F.col("texts") + prior) * wider).alias(z) for z, q in (("z_low", every_low), ("z_high", every_high))]
    limits = quantiles(own).select("lang", "mean", *shrunk)
    return limits.union(quantiles(binned(every, means(every))).select("lang", "mean", "z_low", "z_high"))


def judge_quality(docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998, slack: float = 0.25, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Add n, logp, perplexity, z, z_low, z_high and keep to ``docs(doc_id, text, lang, ...)``.

    Trusted text: documents with a label of quality 1 and none of quality 0 or
    toxic 1. keep: z within the limits of its language (see language_limits) for the
    quantiles ``low`` and ``high``, widened by ``slack`` of their distance to 0. Null and empty
    texts have no perplexity and are rejected. Without any trusted text all others
    are kept. Repeated rows, also of ids, are judged one by one; a null id is
    never trusted.
    """
    bounded_batches(docs.sparkSession)
    clash = [c for c in ("n", "logp", "perplexity", "z", "z_low", "z_high", "keep", "_trusted") if c in docs.columns]
    docs = docs.drop(*clash)
    good = F.min(F.when((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)), 1).otherwise(0))
    trusted = labels.filter("doc_id is not null").groupBy("doc_id").agg(good.alias("_trusted")).filter("_trusted = 1").select("doc_id")
    trusted = checkpointed(trusted)
    # ids of 8 bytes go to the texts while they are few; beyond that texts and ids meet by shuffle
    trusted = F.broadcast(trusted) if trusted.count() <= broadcast_ids else trusted.hint("shuffle_merge")
    known = docs.join(trusted, "doc_id", "left_semi")
    model = checkpointed(train(known.select("text")))
    scored = score(docs, model)
    narrow = checkpointed(score(known, model).select("lang", "n", "logp"))
    limits = checkpointed(language_limits(narrow, low, high))
    rest = limits.filter("lang is null").first()
    mean, z_low, z_high = (rest["mean"], rest["z_low"], rest["z_high"]) if rest else (None, None, None)
    limits = limits.filter("lang is not null").select(F.col("lang").alias("_lang"), F.col("mean").alias("_mean"), F.col("z_low").alias("_low"), F.col("z_high").alias("_high"))
    if limits.count() <= 100_000:  # a row per language with trusted texts: the texts need not be shuffled
        limits = F.broadcast(limits)
    out = scored.join(limits, scored["lang"] == limits["_lang"], "left")
    out = out.withColumn("_mean", F.coalesce("_mean", F.lit(mean).cast("double")))
    out = out.withColumn("z_low", F.coalesce("_low", F.lit(z_low).cast("double")) * (1 + slack))
    out = out.withColumn("z_high", F.coalesce("_high", F.lit(z_high).cast("double")) * (1 + slack))
    out = out.withColumn("z", F.when(F.col("n") > 0, (F.col("logp") / F.col("n") - F.col("_mean")) * F.sqrt("n")))
    keep = (F.col("n") > 0) & F.coalesce((F.col("z") >= F.col("z_low")) & (F.col("z") <= F.col("z_high")), F.lit(True))
    return out.withColumn("keep", keep).drop("_lang", "_mean", "_low", "_high")
