"""Pages, filters and details over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a preview.
PREVIEW_ROWS = 5000
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "review": 3}


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def filtered_clusters(clusters: DataFrame, members: DataFrame | None = None, doc_id: object = None, **equal: str | None) -> DataFrame:
    """Equality on the given columns, and (J12) only clusters that a document has a part in."""
    for column, value in equal.items():
        if value is not None:
            clusters = clusters.filter(F.col(column) == value)
    if doc_id is not None:
        clusters = clusters.join(members.filter(F.col("doc_id") == doc_id), ["job_id", "cluster_no"], "left_semi")
    return clusters


def cluster_page(clusters: DataFrame, limit: int = 50, offset: int = 0, score: str = "score", ident: list[str] | None = None) -> tuple[DataFrame, int]:
    """L1: one page, the gravest first, then the best score, then by id; and the total count."""
    order = [severity_rank(F.col("severity")), F.desc(score), *(ident or ["job_id", "cluster_no"])]
    page = clusters.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 500))
    return page, clusters.count()


def pair_texts(members: DataFrame, chunks: DataFrame, clusters: DataFrame, doc_a: object, doc_b: object, limit: int = 40) -> DataFrame:
    """Texts of both documents' primaries in their common clusters, best first."""
    sides = members.filter("role = 'primary'").join(chunks.select("job_id", "cid", "doc_id", "text", "chunk_type"), ["job_id", "cid"])
    a = sides.filter(F.col("doc_id") == doc_a).select("job_id", "cluster_no", F.col("text").alias("text_a"), F.col("chunk_type").alias("type_a"))
    b = sides.filter(F.col("doc_id") == doc_b).select("job_id", "cluster_no", F.col("text").alias("text_b"), F.col("chunk_type").alias("type_b"))
    some = clusters.filter(~F.col("cluster_type").isin("added", "deleted")).select("job_id", "cluster_no", "cluster_type", "score")
    return a.join(b, ["job_id", "cluster_no"]).join(some, ["job_id", "cluster_no"]).orderBy(F.desc("score"), "job_id", "cluster_no").limit(limit)


def cluster_detail(cluster: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The members of clusters with their texts, by document, the primary first."""
    rows = cluster.select("job_id", "cluster_no").join(members, ["job_id", "cluster_no"]).join(chunks, ["job_id", "cid"])
    return rows.orderBy("job_id", "cluster_no", "doc_id", F.col("role") != "primary", "order_index")


def member_facts(cluster: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts of clusters' members, by document."""
    rows = cluster.select("job_id", "cluster_no").join(members, ["job_id", "cluster_no"]).join(facts, ["job_id", "cid"])
    return rows.orderBy("job_id", "cluster_no", "doc_id", "cid")


def preview(chunks: DataFrame, doc_id: object, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The paragraphs and headings of one document, in its order."""
    rows = chunks.filter(F.col("doc_id") == doc_id)
    if "chunk_level" in chunks.columns:
        rows = rows.filter("chunk_level = 'paragraph'")
    return rows.orderBy("order_index").limit(limit)


#: L4: how each list is ordered; the newest first but where a list grows at its end.
LIST_ORDERS = {"documents": "created_at", "templates": "created_at", "annotations": "created_at", "jobs": "-created_at", "workspaces": "-updated_at"}


def listed(rows: DataFrame, kind: str, ident: str) -> DataFrame:
    """L4: the rows of a list in its order; ``ident`` decides ties."""
    column = LIST_ORDERS[kind]
    return rows.orderBy(F.desc(column[1:]) if column.startswith("-") else F.asc(column), ident)


def cluster_feed(clusters: DataFrame, limit: int = 40) -> DataFrame:
    """The first page of clusters, and of these all but added and deleted ones."""
    return cluster_page(clusters, limit)[0].filter(~F.col("cluster_type").isin("added", "deleted"))


def latest_by(df: DataFrame, keys: list[str], value: str, when: str, tie: str) -> DataFrame:
    """The value of the latest row of each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(when, tie)).alias(f"latest_{value}"), F.count("*").alias("n"))


def retained(jobs: DataFrame, now: Column, days: int, finished: list[str], when: str = "finished_at") -> DataFrame:
    """Jobs that retention keeps: unfinished, starred, or young enough."""
    old = F.col("status").isin(finished) & ~F.coalesce(F.col("starred"), F.lit(False)) & (F.col(when) < now - F.expr(f"interval {days} days"))
    return jobs.filter(~F.coalesce(old, F.lit(False)))


def without_children(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A cascade: the rows whose parent is not among those deleted."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones with the same key."""
    return stored.join(new, keys, "left_anti").unionByName(new)


def inserted_or_ignored(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows stay; new keys are added once."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored, keys, "left_anti"))


def filtered_jobs(jobs: DataFrame, name_part: str = "", starred_only: bool = False) -> DataFrame:
    """Compare jobs by part of the name, starred ones only if asked; newest first (L4)."""
    out = jobs.filter(F.col("job_type") == "compare")
    if name_part:
        out = out.filter(F.contains(F.lower("name"), F.lit(name_part.lower())))
    if starred_only:
        out = out.filter("starred")
    return out.orderBy(F.desc("created_at"), "job_id")
