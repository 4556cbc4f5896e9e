"""Job-level results (A1-A10): matrix, section heat, shared terms, price proximity, metadata flags, collusion."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.local import per_job
from tessera.operators.score import clamped

TERM_CHARS, TERMS, PRICE_OVERLAP, PRICE_GAP, HEAT = 4, 30, 3, 0.03, 0.5
SEVERITIES = ["high", "medium", "low", "review"]
TYPES = ["same", "minor_change", "changed", "rewrite", "added", "deleted", "conflict", "uncertain"]


def doc_matrix(primaries: DataFrame, scored: DataFrame, chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """A1: ``primaries(job_id, cluster_no, cid)`` to (job_id, doc_a, doc_b, sim), doc_a <= doc_b, the diagonal 1.

    ``scored`` should hold every pair of primaries, ``chunks`` the primaries and
    ``totals(job_id, doc_id, total)`` the characters of all documents; pairs without an
    edge count with their lexical score. Document pairs without a common cluster have no row.
    """
    side = primaries.join(chunks.select("job_id", "cid", "doc_id", "char_count"), ["job_id", "cid"])
    a = side.select("job_id", "cluster_no", F.col("cid").alias("a"), F.col("doc_id").alias("doc_a"), F.col("char_count").alias("chars_a"))
    b = side.select("job_id", "cluster_no", F.col("cid").alias("b"), F.col("doc_id").alias("doc_b"), F.col("char_count").alias("chars_b"))
    pairs = a.join(b, ["job_id", "cluster_no"]).filter("doc_a < doc_b")
    pairs = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    finals = scored.select("job_id", F.col("a").alias("lo"), F.col("b").alias("hi"), "final_score")
    sums = pairs.join(finals, ["job_id", "lo", "hi"], "left").groupBy("job_id", "doc_a", "doc_b").agg(
        F.sum(F.coalesce("final_score", F.lit(0.0)) * F.least("chars_a", "chars_b")).alias("common")
    )
    out = sums.join(totals.select("job_id", F.col("doc_id").alias("doc_a"), F.col("total").alias("ta")), ["job_id", "doc_a"])
    out = out.join(totals.select("job_id", F.col("doc_id").alias("doc_b"), F.col("total").alias("tb")), ["job_id", "doc_b"])
    sim = F.least(F.col("common") / F.greatest(F.least("ta", "tb"), F.lit(1)), F.lit(1.0))
    diagonal = totals.select("job_id", F.col("doc_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("sim"))
    return out.select("job_id", "doc_a", "doc_b", sim.alias("sim")).unionByName(diagonal)


def matrix_peaks(matrix: DataFrame) -> DataFrame:
    """The greatest off-diagonal similarity of each job; 0 if there is none."""
    off = F.when(F.col("doc_a") != F.col("doc_b"), F.col("sim"))
    return matrix.groupBy("job_id").agg(F.coalesce(F.max(off), F.lit(0.0)).alias("peak"))


def ranked_pairs(matrix: DataFrame) -> DataFrame:
    """A10: percent and band of each document pair, best first."""
    percent = F.round(F.col("sim") * 100).cast("int")
    band = F.when(percent >= 80, "high").when(percent >= 60, "medium").when(percent >= 30, "low").otherwise("none")
    out = matrix.filter("doc_a < doc_b").select("job_id", "doc_a", "doc_b", percent.alias("percent"), band.alias("band"))
    return out.orderBy(F.desc("percent"), "job_id", "doc_a", "doc_b")


def section_heat(best: DataFrame) -> DataFrame:
    """A2: per document and kind of section the best score and the number of chunks at HEAT or above."""
    value = F.coalesce("best", F.lit(0.0))
    return best.groupBy("job_id", "doc_id", "section_kind").agg(F.max(value).alias("intensity"), F.count_if(value >= HEAT).alias("matches"))


def shared_terms(chunks: DataFrame, terms: int = TERMS, grouped: bool = False) -> DataFrame:
    """A3: long tokens in two or more documents of a job; most documents first, then longest, then by name."""

    def of(table: pa.Table) -> pa.Table | None:
        docs: dict[str, set[int]] = defaultdict(set)
        for doc, tokens in zip(table["doc_id"].to_pylist(), table["tokens"].to_pylist(), strict=True):
            for t in set(tokens.split(" ")):
                docs[t].add(doc)
        found = sorted((-len(d), -len(t), t) for t, d in docs.items() if len(t) >= TERM_CHARS and len(d) >= 2)[:terms]
        if not found:
            return None
        n, _, names = zip(*found, strict=True)
        job = [table["job_id"][0].as_py()] * len(found)
        return pa.table({"job_id": job, "term": names, "n_docs": [-x for x in n], "rank": pa.array(range(1, len(found) + 1), pa.int32())})

    rows = chunks.select("job_id", "doc_id", F.array_join("tokens", " ").alias("tokens"))
    return per_job(rows, of, "job_id long, term string, n_docs long, rank int", grouped)


def max_amounts(docs: DataFrame) -> DataFrame:
    """The largest leading whole number among the amounts of ``docs(job_id, doc_id, amounts)``."""
    amount = docs.select("job_id", "doc_id", F.explode("amounts").alias("amount"))
    value = F.expr("try_cast(regexp_extract(amount, '^([0-9]+)', 1) as decimal(20, 0))")
    return amount.groupBy("job_id", "doc_id").agg(F.max(value).alias("amount"))


def price_proximity(amounts: DataFrame, overlaps: DataFrame) -> DataFrame:
    """A4: ``amounts(job_id, doc_id, amount)`` and ``overlaps(job_id, doc_a, doc_b, n)`` to close but different prices."""
    a = amounts.select("job_id", F.col("doc_id").alias("doc_a"), F.col("amount").alias("amount_a"))
    b = amounts.select("job_id", F.col("doc_id").alias("doc_b"), F.col("amount").alias("amount_b"))
    pairs = overlaps.filter(F.col("n") >= PRICE_OVERLAP).join(a, ["job_id", "doc_a"]).join(b, ["job_id", "doc_b"])
    gap = F.abs(F.col("amount_a") - F.col("amount_b")).cast("double") / F.greatest("amount_a", "amount_b").cast("double")
    pairs = pairs.filter("amount_a != amount_b and amount_a > 0 and amount_b > 0").withColumn("gap", gap)
    return pairs.filter(F.col("gap") < PRICE_GAP).select("job_id", "doc_a", "doc_b", "amount_a", "amount_b", "gap")


def cluster_overlaps(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many clusters each pair of documents shares."""
    docs = members.join(chunks.select("job_id", "cid", "doc_id"), ["job_id", "cid"]).select("job_id", "cluster_no", "doc_id").distinct()
    a, b = docs.withColumnRenamed("doc_id", "doc_a"), docs.withColumnRenamed("doc_id", "doc_b")
    return a.join(b, ["job_id", "cluster_no"]).filter("doc_a < doc_b").groupBy("job_id", "doc_a", "doc_b").agg(F.count("*").alias("n"))


def metadata_flags(docs: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """``docs(job_id, doc_id, <field>...)``: the fields whose non-blank value another document of the job shares.

    ``fields``: column to flag. The result has doc_id, flag and the number of documents.
    """
    fields = fields or {"author": "same_author", "last_modified_by": "same_last_modified_by"}
    pairs = F.array(*[F.struct(F.lit(flag).alias("flag"), F.trim(F.col(c)).alias("value")) for c, flag in fields.items()])
    long = docs.select("job_id", "doc_id", F.explode(pairs).alias("p")).select("job_id", "doc_id", "p.*").filter("value != ''")
    groups = long.groupBy("job_id", "flag", "value").agg(F.countDistinct("doc_id").alias("n_docs")).filter("n_docs >= 2")
    return long.join(groups, ["job_id", "flag", "value"]).select("job_id", "doc_id", "flag", "value", "n_docs")


def collusion_score(peak: Column, multi: Column, clusters: Column, flagged: Column, terms: Column, prices: Column) -> tuple[Column, Column, Column]:
    """Score, level and signals (kind, weight, detail) from a job's peak similarity and counts.

    multi: clusters of three or more documents; flagged: documents with shared
    metadata; prices: pairs with close prices.
    """
    parts = [
        ("similarity", F.when(peak >= 0.6, 0.4 * clamped((peak - 0.6) / 0.4))),
        ("cluster", F.when(multi > 0, 0.1 + 0.3 * F.least(multi / 5, F.lit(1.0))).when(clusters > 0, F.lit(0.1))),
        ("metadata", F.when(flagged >= 2, F.lit(0.25))),
        ("sharedTerms", F.when(terms >= 5, F.lit(0.1))),
        ("facts", F.when(prices > 0, F.lit(0.15))),
    ]
    total = F.lit(0.0)
    for _, weight in parts:
        total = total + F.coalesce(weight, F.lit(0.0))
    score = F.round(clamped(total), 9)
    level = F.when(score >= 0.6, "high").when(score >= 0.35, "medium").when(score > 0.1, "low").otherwise("none")
    told = {
        "similarity": F.concat(F.lit("最高相似 "), F.round(peak * 100).cast("int").cast("string"), F.lit("%")),
        "cluster": F.when(multi > 0, F.concat(F.lit("三份以上文档共有 "), multi.cast("string"), F.lit(" 组"))).otherwise(F.concat(F.lit("相似 "), clusters.cast("string"), F.lit(" 组"))),
        "metadata": F.concat(F.lit("元数据相同 "), flagged.cast("string"), F.lit(" 份")),
        "sharedTerms": F.concat(F.lit("共有术语 "), terms.cast("string"), F.lit(" 个")), "facts": F.concat(F.lit("报价接近 "), prices.cast("string"), F.lit(" 对")),
    }
    signals = F.array_compact(F.array(*[F.when(w.isNotNull(), F.struct(F.lit(k).alias("kind"), w.alias("weight"), told[k].alias("detail"))) for k, w in parts]))
    return score, level, signals


def job_collusion(jobs: DataFrame, peaks: DataFrame, clusters: DataFrame, flags: DataFrame, terms: DataFrame, prices: DataFrame) -> DataFrame:
    """A7 for all jobs: job_id, peak, level, score, signals. Missing evidence counts 0."""
    counted = clusters.groupBy("job_id").agg(F.count_if(F.col("n_docs") >= 3).alias("multi"), F.count("*").alias("clusters"))
    out = jobs.select("job_id").distinct().join(peaks, "job_id", "left").join(counted, "job_id", "left")
    out = out.join(flags.groupBy("job_id").agg(F.countDistinct("doc_id").alias("flagged")), "job_id", "left")
    out = out.join(terms.groupBy("job_id").agg(F.count("*").alias("terms")), "job_id", "left")
    out = out.join(prices.groupBy("job_id").agg(F.count("*").alias("prices")), "job_id", "left")
    out = out.na.fill(0)
    score, level, signals = collusion_score(*[F.col(c) for c in ("peak", "multi", "clusters", "flagged", "terms", "prices")])
    return out.select("job_id", "peak", level.alias("level"), score.alias("score"), signals.alias("signals"))


def summary(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """A5: clusters by type, those of high risk, and the numbers of clusters and chunks of each job in ``docs(job_id, chunks)``."""
    counts = [F.count_if(F.col("cluster_type") == t).alias(f"{t}_count") for t in TYPES]
    by_job = clusters.groupBy("job_id").agg(*counts, F.count_if(F.col("severity") == "high").alias("high_risk_count"), F.count("*").alias("cluster_count"))
    return docs.groupBy("job_id").agg(F.sum("chunks").alias("chunk_count")).join(by_job, "job_id", "left").na.fill(0)
