"""Clusters of similar chunks (G1-G14): split components per job, then declarative classification."""

from __future__ import annotations

from collections import defaultdict
from math import fsum

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.operators.local import per_job
from tessera.schemas import CLUSTERS

MIN_SPLIT, MIN_DENSITY = 4, 0.55
MAX_CLUSTERS, MAX_DELETED, DELETED_FLOOR, MOVED_SPAN = 5000, 200, 0.55, 0.25


def _components(edges: list[tuple]) -> list[list[tuple]]:
    """Edges by connected component."""
    parent: dict = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e in edges:
        a, b = find(e[0]), find(e[1])
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for e in edges:
        groups[find(e[0])].append(e)
    return [groups[k] for k in sorted(groups)]


def cohesive_parts(edges: list[tuple]) -> list[list[tuple]]:
    """From loose components the weakest edges go, one by one, until each part is dense or small.

    ``edges`` are (a, b, final, ...); ties go by (final, a, b). Nodes that lose all edges vanish.
    """
    done, todo = [], _components(edges)
    while todo:
        part = sorted(todo.pop(), key=lambda e: (e[2], e[0], e[1]))
        while part:
            n = len({x for e in part for x in e[:2]})
            if n < MIN_SPLIT or len(part) / (n * (n - 1) / 2) >= MIN_DENSITY:
                done.append(part)
                break
            part = part[1:]
            pieces = _components(part)
            if len(pieces) != 1 or len({x for e in part for x in e[:2]}) < n:
                todo.extend(pieces)
                break
    return sorted(done, key=lambda p: min(e[0] for e in p))


def describe_part(edges: list[tuple]) -> dict | None:
    """Statistics, roles and member scores of one part; None if it has one document only.

    ``edges``: (a, b, final, lexical, semantic, doc_a, doc_b). Strengths are exact sums,
    compared to 9 digits: equal chunks tie whatever the order of their edges.
    """
    doc, ties, peak = {}, defaultdict(list), defaultdict(float)
    for a, b, final, _, _, da, db in edges:
        doc[a], doc[b] = da, db
        for x in (a, b):
            peak[x] = max(peak[x], final)
            if da != db:
                ties[x].append(final)
    if len(set(doc.values())) < 2:
        return None
    members = sorted(doc)
    first = {}
    strength = {x: round(fsum(ties[x]), 9) for x in members}
    for m in sorted(members, key=lambda x: (-strength[x], x)):
        first.setdefault(doc[m], m)
    finals = [e[2] for e in edges]
    semantic = [e[4] for e in edges if e[4] is not None and e[4] == e[4]]
    return {
        "members": members, "primaries": [first[d] for d in sorted(first)], "avg": fsum(finals) / len(finals), "peak": max(finals),
        "min_pair": min(finals), "lex_avg": fsum(e[3] for e in edges) / len(edges), "sem_avg": sum(semantic) / len(semantic) if semantic else None,
        "member_scores": [peak[m] for m in members],
    }


EDGE_COLUMNS = ["a", "b", "final_score", "lexical", "semantic", "doc_id_a", "doc_id_b"]


def clusters_of(edges: list[tuple]) -> list[dict]:
    """The clusters of one job's edges (EDGE_COLUMNS) with their numbers, best average first, 5000 at most."""
    found = [d for d in map(describe_part, cohesive_parts(sorted(edges, key=lambda e: e[:2]))) if d]
    found.sort(key=lambda d: (-d["avg"], d["members"][0]))
    return [{"cluster_no": k, **d} for k, d in enumerate(found[:MAX_CLUSTERS])]


def job_clusters(scored: DataFrame, threshold: float) -> DataFrame:
    """``scored`` pairs that are kept to one row per cluster and job (see schemas.CLUSTERS).

    The split depends on the order of removals, so a job is one group; jobs have ten documents at most.
    """
    fields = to_arrow_schema(StructType.fromDDL(CLUSTERS))

    def of(table: pa.Table) -> pa.Table | None:
        job = table["job_id"][0].as_py()
        found = clusters_of(list(zip(*(table[c].to_pylist() for c in EDGE_COLUMNS), strict=True)))
        return pa.Table.from_pylist([{"job_id": job, **d} for d in found], schema=fields) if found else None

    kept = scored.filter(F.col("keep") & (F.col("final_score") >= threshold))
    return per_job(kept.select("job_id", *EDGE_COLUMNS), of, CLUSTERS)


def cluster_members(clusters: DataFrame) -> DataFrame:
    """One row per member: job_id, cluster_no, cid, role, score."""
    zipped = F.explode(F.arrays_zip(F.col("members").alias("cid"), F.col("member_scores").alias("score")))
    rows = clusters.select("job_id", "cluster_no", "primaries", zipped.alias("m"))
    role = F.when(F.array_contains("primaries", F.col("m.cid")), "primary").otherwise("duplicate_candidate")
    return rows.select("job_id", "cluster_no", F.col("m.cid").alias("cid"), role.alias("role"), F.col("m.score").alias("score"))


def cluster_class(same_hash: Column) -> tuple[Column, Column]:
    """Type and severity from a cluster's statistics."""
    same = same_hash | (F.col("min_pair") >= 0.95)
    rewrite = (F.col("sem_avg") >= 0.80) & (F.col("lex_avg") < 0.50)
    kind = F.when(same, "same").when(rewrite, "rewrite").when(F.col("avg") >= 0.85, "minor_change").when(F.col("avg") >= 0.70, "changed").otherwise("uncertain")
    severity = F.when(same, "low").when(rewrite, "medium").when(F.col("avg") >= 0.85, "low").when(F.col("avg") >= 0.70, "medium").otherwise("review")
    return kind, severity


def classified_clusters(clusters: DataFrame, chunks: DataFrame, base_docs: DataFrame | None = None, detect_moved: bool = True) -> DataFrame:
    """One row per cluster with type, severity, topic, summary, kind and base place.

    ``base_docs(job_id, base_doc)`` names the base document of jobs in base mode.
    """
    columns = ["doc_id", "text", "normalized_hash", "section_path", "section_kind", "rel_pos"]
    columns += [c for c in ("page",) if c in chunks.columns]
    members = cluster_members(clusters).join(chunks.select("job_id", "cid", *columns), ["job_id", "cid"])
    if "page" not in members.columns:
        members = members.withColumn("page", F.lit(None).cast("int"))
    if base_docs is None:
        members = members.withColumn("base_doc", F.lit(None).cast("long"))
    else:
        members = members.join(base_docs, "job_id", "left")
    head = F.when(F.length("text") > 18, F.concat(F.substring("text", 1, 18), F.lit("…"))).otherwise(F.col("text"))
    primary = F.col("role") == "primary"
    is_base = F.col("doc_id") == F.col("base_doc")
    # the base document's primary, else that of the first document
    place = F.struct(F.when(F.coalesce(is_base, F.lit(False)), 0).otherwise(1), "doc_id")
    stats = members.groupBy("job_id", "cluster_no").agg(
        F.countDistinct("doc_id").alias("n_docs"), (F.countDistinct("normalized_hash") == 1).alias("same_hash"),
        F.min_by(F.when(F.size("section_path") > 0, F.element_at("section_path", -1)), F.when(F.size("section_path") > 0, F.col("cid"))).alias("path_topic"),
        F.min_by(head, "cid").alias("text_topic"),
        (F.max(F.when(primary, F.col("rel_pos"))) - F.min(F.when(primary, F.col("rel_pos")))).alias("span"),
        F.max("base_doc").alias("base_doc"), F.max(F.coalesce(is_base, F.lit(False)).cast("int")).alias("has_base"),
        F.min_by(F.struct("cid", "doc_id", "section_path", "page"), F.when(primary, place)).alias("base"),
    )
    votes = members.groupBy("job_id", "cluster_no", "section_kind").count()
    votes = votes.groupBy("job_id", "cluster_no").agg(F.min_by("section_kind", F.struct(-F.col("count"), F.col("section_kind"))).alias("section_kind"))
    out = clusters.join(stats, ["job_id", "cluster_no"]).join(votes, ["job_id", "cluster_no"])
    kind, severity = cluster_class(F.col("same_hash"))
    added = F.col("base_doc").isNotNull() & (F.col("has_base") == 0)
    out = out.withColumn("cluster_type", F.when(added, "added").otherwise(kind)).withColumn("severity", F.when(added, "low").otherwise(severity))
    moved = F.lit(detect_moved) & F.col("cluster_type").isin("same", "minor_change") & (F.col("span") > MOVED_SPAN)
    percent = F.format_string("%.0f%%", F.col("avg") * 100)
    summary = F.concat(F.col("n_docs").cast("string"), F.lit(" 份文档 · 平均相似 "), percent, F.when(moved, F.lit(" · 位置移动")).otherwise(F.lit("")))
    return out.withColumns({
        "topic": F.coalesce("path_topic", "text_topic"), "moved": moved, "summary": summary, "score": F.col("avg"),
        "base_chunk": F.col("base.cid"), "base_page": F.col("base.page"),
        "base_section_path": F.when(F.size("base.section_path") > 0, F.array_join("base.section_path", " › ")),
    }).drop("path_topic", "text_topic", "span", "base", "same_hash", "has_base")


def deleted_chunks(lone: DataFrame) -> DataFrame:
    """``lone`` chunks of base documents (see evidence) as rows job_id, cid, topic, score."""
    topic = F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).otherwise(F.substring("text", 1, 18))
    score = F.coalesce("best", F.lit(0.0)).alias("score")
    return lone.select("job_id", "cid", "doc_id", topic.alias("topic"), score, "section_kind", F.lit("deleted").alias("cluster_type"), F.lit("low").alias("severity"))
