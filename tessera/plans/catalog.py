"""The catalogue of the engine's queries over the given tables, and their SQL.

Ten documents of neighbouring ids are one comparison job; a chunk is a line of ten
characters or more. Scores are rounded to 6 digits at this edge.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.config import CompareConfig, ParserConfig
from tessera.functions import diff as D
from tessera.functions import entities as E
from tessera.functions import text as X
from tessera.operators import aggregate, chunk, cluster, embed, facts, listing, recall
from tessera.plans import oracle as O
from tessera.plans.compare import CompareResult, compare, document_chunks, job_documents, jobs_of_documents
from tessera.sources import export, parse

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register the function below under its name, with its SQL."""

    def keep(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _r6(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 6)


def _half_up6(c: str) -> F.Column:
    """Six digits by plain double arithmetic: ratios of small integers can lie exactly between two, where engines differ."""
    return F.floor(F.col(c) * 1000000 + 0.5) / 1000000


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph chunks with what the cheap queries need, all in the JVM."""
    return chunk.paragraph_chunks(jobs_of_documents(_docs(spark, sf_dir).select("doc_id", "text")))


def _light(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """Comparable chunks with tokens, normalized text and rel_pos but without entities; grouped: the rows of a job together."""
    out = chunk.paragraph_chunks(job_documents(_docs(spark, sf_dir))) if grouped else _flat(spark, sf_dir)
    out = out.withColumns({"tokens": X.tokens(F.col("text")), "normalized": X.normalized(F.col("text"))})
    out = chunk.with_rel_pos(out, ["job_id", "doc_id"]).filter(F.size("tokens") > 0)
    return out.withColumn("normalized_hash", X.exact_hash(F.col("normalized")))


def _result(spark: SparkSession, sf_dir: str, **more: DataFrame) -> CompareResult:
    return compare(document_chunks(_docs(spark, sf_dir)), CompareConfig(), grouped=True, **more)


# ------------------------------------------------------------ chunks and text
@query(f"WITH {O.CHUNKS} SELECT doc_id, chunk_type, order_index, text FROM chunks")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph chunks of all documents."""
    return _flat(spark, sf_dir).select("doc_id", "chunk_type", F.col("order_index").cast("long").alias("order_index"), "text")


@query(f"""WITH RECURSIVE {O.LINES},
parts AS (SELECT doc_id, coalesce(row_text, line) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM ruled WHERE row_text IS NULL OR row_text != ''),
walk AS (
  SELECT doc_id, rn, 0 AS section, length(text) + 1 AS chars FROM parts WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.rn, CASE WHEN w.chars > 6000 THEN w.section + 1 ELSE w.section END, CASE WHEN w.chars > 6000 THEN 0 ELSE w.chars END + length(p.text) + 1
  FROM walk w JOIN parts p ON p.doc_id = w.doc_id AND p.rn = w.rn + 1),
sections AS (SELECT doc_id, section, max(chars) - 1 AS n_chars FROM walk GROUP BY ALL HAVING max(chars) - 1 >= 10)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS order_index, n_chars::BIGINT AS n_chars, '' AS path FROM sections""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section chunks; a section ends with the line that takes it beyond 6000 characters."""
    docs = _docs(spark, sf_dir).select("doc_id", chunk.text_blocks(F.col("text")).alias("blocks"))
    out = chunk.chunk_documents(docs).filter("chunk_level = 'section'")
    return out.select("doc_id", F.col("order_index").cast("long").alias("order_index"), F.length("text").cast("long").alias("n_chars"), F.array_join("section_path", " › ").alias("path"))


@query(f"WITH {O.LINES} SELECT doc_id, line_no, row_text AS row FROM ruled WHERE row_text IS NOT NULL AND row_text != ''")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return chunk.flat_lines(_docs(spark, sf_dir)).filter("row != ''").select("doc_id", "line_no", "row")


@query(f"SELECT doc_id, {O.normal('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, N4 with default options."""
    return _docs(spark, sf_dir).select("doc_id", X.normalized(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, sha256(text) AS exact_hash, sha256({O.normal('text')}) AS normalized_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5."""
    return _docs(spark, sf_dir).select("doc_id", X.exact_hash(F.col("text")).alias("exact_hash"), X.exact_hash(X.normalized(F.col("text"))).alias("normalized_hash"))


@query("SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents; hashes are counted, texts are not shuffled."""
    hashed = _docs(spark, sf_dir).select("doc_id", X.exact_hash(F.col("text")).alias("file_hash"))
    return hashed.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("""
WITH hashed AS (SELECT doc_id, source, sha256(text) AS file_hash FROM documents),
stored AS (SELECT DISTINCT file_hash FROM hashed WHERE source = 'src0'),
batch AS (SELECT doc_id, file_hash, row_number() OVER (PARTITION BY file_hash ORDER BY doc_id) AS rn FROM hashed WHERE source IS DISTINCT FROM 'src0')
SELECT doc_id, file_hash FROM batch WHERE rn = 1 AND file_hash NOT IN (SELECT file_hash FROM stored)""")
def import_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch the first of equal files, without those that the workspace (source src0) has."""
    hashed = _docs(spark, sf_dir).select("doc_id", "source", X.exact_hash(F.col("text")).alias("file_hash"))
    stored = hashed.filter("source = 'src0'").select("file_hash")
    first = hashed.filter("not source <=> 'src0'").groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    return first.join(stored, "file_hash", "left_anti").select("doc_id", "file_hash")


@query(f"WITH {O.GRAMS} SELECT cid, size AS n_grams FROM sizes")
def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the number of different 2- and 3-grams of each chunk."""
    out = _light(spark, sf_dir).select("cid", X.gram_count(F.col("normalized")).alias("n_grams"))
    return out.filter("n_grams > 0")


@query(f"WITH {O.FEATURES} SELECT cid, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM comp")
def tokenize_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    return _light(spark, sf_dir).select("cid", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


_LANGUAGE = """CASE WHEN len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) = 0
  OR len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]')) * 100 >= len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) * 15 THEN 'zh' ELSE 'en' END"""


@query(f"SELECT conv_id, turn, {_LANGUAGE} AS language FROM conversations")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.detected_language(F.col("text")).alias("language"))


@query(f"WITH {O.IDF} SELECT job_id, token, df, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    return recall.term_frequencies(_light(spark, sf_dir, True), True).select("job_id", "token", "df", _r6("idf").alias("idf"))


@query(f"WITH {O.IDF} SELECT cid, token, round(w, 6) AS weight FROM tfidf")
def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    return recall.term_weights(_light(spark, sf_dir, True), True).select("cid", "token", _r6("w").alias("weight"))


_EN_TECH, _EN_BIZ = ["system", "design", "the", "version"], ["price", "license", "and", "terms"]


@query(f"""WITH {O.CHUNKS}
SELECT cid, CASE WHEN t > b THEN 'tech' WHEN b > t THEN 'business' ELSE 'other' END AS section_kind
FROM (SELECT cid, len(list_filter({_EN_TECH}, lambda k: contains(text, k))) AS t, len(list_filter({_EN_BIZ}, lambda k: contains(text, k))) AS b FROM chunks)""")
def section_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 with keyword lists that occur in these texts."""
    return _flat(spark, sf_dir).select("cid", X.section_kind(F.col("text"), _EN_TECH, _EN_BIZ).alias("section_kind"))


@query(f"""WITH {O.FEATURES},
templates AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2) AS tokens FROM benchmark),
a AS (SELECT cid, token, count(*) AS n FROM (SELECT cid, unnest(tokens) AS token FROM comp) GROUP BY ALL),
b AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(tokens) AS token FROM templates) GROUP BY ALL),
na AS (SELECT cid, sqrt(sum(n * n)) AS norm FROM a GROUP BY ALL), nb AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY ALL)
SELECT cid, item_id AS template_id, round(cosine, 6) AS cosine FROM (
  SELECT cid, item_id, sum(a.n * b.n) / (any_value(na.norm) * any_value(nb.norm)) AS cosine
  FROM a JOIN b USING (token) JOIN na USING (cid) JOIN nb USING (item_id) GROUP BY ALL)
WHERE cosine >= 0.7""")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are the text of a benchmark item, taken as templates."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("template_id"), X.tokens_en(F.col("text")).alias("tokens"))
    chunks = _light(spark, sf_dir).select(F.col("cid").alias("key"), "tokens")
    out = chunk.template_scores(chunks, items)
    return out.select(F.col("key").alias("cid"), "template_id", _r6("cosine").alias("cosine"))


@query(f"WITH {O.FEATURES} SELECT cid, round(rel_pos, 6) AS rel_pos FROM comp")
def rel_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    return _light(spark, sf_dir).select("cid", _r6("rel_pos").alias("rel_pos"))


# --------------------------------------------------------------------- recall
@query(f"WITH {O.FEATURES}{O.HASHED} SELECT job_id, x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS n_pairs FROM by_hash JOIN comp x USING (job_id) JOIN comp y USING (job_id) WHERE x.cid = a AND y.cid = b GROUP BY ALL")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many equal chunks each pair of documents of a job has. The flagship query."""
    return recall.hash_pairs(_light(spark, sf_dir, True), grouped=True).groupBy("job_id", "doc_a", "doc_b").agg(F.count("*").alias("n_pairs"))


@query(f"WITH {O.FEATURES}{O.HASHED} SELECT job_id, a, b FROM by_hash")
def recall_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2."""
    return recall.hash_pairs(_light(spark, sf_dir, True), grouped=True).select("job_id", "a", "b")


@query(f"WITH {O.GRAMS} SELECT job_id, a, b, shared, floor(char_ngram * 1000000 + 0.5) / 1000000 AS char_ngram FROM by_ngram JOIN overlap USING (job_id, a, b)")
def recall_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, ranked by the exact Jaccard similarity that MinHash estimates."""
    pairs = recall.candidate_pairs(_light(spark, sf_dir, True), grouped=True).filter("by_ngram")
    return pairs.select("job_id", "a", "b", F.col("shared").cast("long").alias("shared"), _half_up6("char_ngram").alias("char_ngram"))


@query(f"WITH {O.TFIDF} SELECT job_id, a, b, round(lexical, 6) AS lexical FROM by_tfidf JOIN dots USING (job_id, a, b)")
def recall_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    return recall.candidate_pairs(_light(spark, sf_dir, True), grouped=True).filter("by_tfidf").select("job_id", "a", "b", _r6("lexical").alias("lexical"))


@query(f"WITH {O.RECALL} SELECT job_id, a, b FROM candidates")
def recall_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    return recall.candidate_pairs(_light(spark, sf_dir, True), grouped=True).select("job_id", "a", "b")


@query()
def minhash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5 on the pairs of J2 and J3; the signature is not SQL."""
    return recall.minhash_pairs(_light(spark, sf_dir, True), grouped=True)


@query("""
WITH v AS (SELECT vec_id // 50 AS job_id, vec_id AS cid, label AS doc_id, embedding::DOUBLE[] AS x FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
p AS (SELECT a.job_id, a.cid AS a, b.cid AS b, CASE WHEN a.norm * b.norm > 0 THEN list_dot_product(a.x, b.x) / (a.norm * b.norm) ELSE 0 END AS semantic
      FROM n a JOIN n b ON a.job_id = b.job_id AND a.cid < b.cid AND a.doc_id != b.doc_id)
SELECT job_id, a, b, round(semantic, 6) AS semantic FROM p WHERE round(semantic, 9) >= 0.1
QUALIFY row_number() OVER (PARTITION BY job_id, a ORDER BY round(semantic, 9) DESC, b) <= 5""")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors; 50 vectors are a job, labels are documents, the floor fits these vectors."""
    v = _table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("job_id"), F.col("vec_id").alias("cid"), F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("vector"))
    return recall.semantic_pairs(v, floor=0.1).select("job_id", "a", "b", _r6("semantic").alias("semantic"))


# ---------------------------------------------------------------- pair scores
@query(f"WITH {O.SCORED} SELECT job_id, a, b, round(lexical, 6) AS lexical, floor(char_ngram * 1000000 + 0.5) / 1000000 AS char_ngram, round(order_score, 6) AS order_score, round(final_score, 6) AS final_score FROM scored")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K4; these texts have no entities and no section paths, so those dimensions do not count."""
    scored = _result(spark, sf_dir).scored
    return scored.select("job_id", "a", "b", _half_up6("char_ngram").alias("char_ngram"), *[_r6(c).alias(c) for c in ("lexical", "order_score", "final_score")])


@query(f"WITH {O.SCORED} SELECT job_id, a, b, threshold, round(final_score, 6) AS final_score FROM edges")
def short_text_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, P5: the pairs that reach the threshold of their length."""
    return _result(spark, sf_dir).kept.select("job_id", "a", "b", "threshold", _r6("final_score").alias("final_score"))


@query(f"WITH {O.SCORED} SELECT job_id, cid, round(best, 6) AS best FROM best")
def best_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5."""
    return _result(spark, sf_dir).best.filter("best is not null").select("job_id", "cid", _r6("best").alias("best"))


# ------------------------------------------------------------------- clusters
@query(f"WITH {O.COMPONENTS} SELECT job_id, root AS first_chunk, n_members, round(avg_score, 6) AS avg_score, round(peak, 6) AS peak, round(min_pair, 6) AS min_pair, round(lex_avg, 6) AS lex_avg FROM described")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G4, G6. The SQL has no cohesive split; at this scale no component is loose enough to need one."""
    raw = _result(spark, sf_dir).raw_clusters
    return raw.select("job_id", F.array_min("members").alias("first_chunk"), F.size("members").cast("long").alias("n_members"), _r6("avg").alias("avg_score"), _r6("peak").alias("peak"), _r6("min_pair").alias("min_pair"), _r6("lex_avg").alias("lex_avg"))


@query(f"WITH {O.COMPONENTS} SELECT job_id, root AS first_chunk, cid, role, round(score, 6) AS score FROM member")
def cluster_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, G13."""
    result = _result(spark, sf_dir)
    first = result.raw_clusters.select("job_id", "cluster_no", F.array_min("members").alias("first_chunk"))
    return result.members.join(first, ["job_id", "cluster_no"]).select("job_id", "first_chunk", "cid", "role", _r6("score").alias("score"))


@query(f"WITH {O.COMPONENTS} SELECT job_id, root AS first_chunk, n_docs, cluster_type, severity FROM described")
def cluster_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7, G10-G12."""
    return _result(spark, sf_dir).clusters.select("job_id", F.array_min("members").alias("first_chunk"), "n_docs", "cluster_type", "severity")


@query(f"""WITH {O.COMPONENTS}, base AS (SELECT doc_id // 10 AS job_id, min(doc_id) AS base_doc FROM documents GROUP BY ALL),
spans AS (SELECT job_id, root, max(rel_pos) - min(rel_pos) AS span, arg_min(cid, (CASE WHEN doc_id = base_doc THEN 0 ELSE 1 END, doc_id)) AS base_chunk FROM primary_member JOIN base USING (job_id) GROUP BY ALL),
topics AS (SELECT job_id, root, arg_min(CASE WHEN length(text) > 18 THEN substring(text, 1, 18) || '…' ELSE text END, cid) AS topic, bool_or(doc_id = base_doc) AS has_base FROM member JOIN base USING (job_id) GROUP BY ALL)
SELECT job_id, root AS first_chunk, topic, 'other' AS section_kind, base_chunk, has_base AND cluster_type IN ('same', 'minor_change') AND span > 0.25 AS moved FROM described JOIN spans USING (job_id, root) JOIN topics USING (job_id, root)""")
def cluster_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, kind of section, base chunk and whether the passage moved, with the first document of each job as its base."""
    result = _result(spark, sf_dir, base_docs=_base(spark, sf_dir))
    return result.clusters.select("job_id", F.array_min("members").alias("first_chunk"), "topic", "section_kind", "base_chunk", "moved")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.expr("doc_id div 10").alias("job_id"), "doc_id")
    return docs.groupBy("job_id").agg(F.min("doc_id").alias("base_doc"))


@query(f"""WITH {O.COMPONENTS},
base AS (SELECT doc_id // 10 AS job_id, min(doc_id) AS base_doc FROM documents GROUP BY ALL),
added AS (SELECT job_id, root AS cid, 'added' AS cluster_type, avg_score AS score FROM described d JOIN base USING (job_id)
          WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.job_id = d.job_id AND m.root = d.root AND m.doc_id = base_doc)),
deleted AS (SELECT c.job_id, c.cid, 'deleted' AS cluster_type, coalesce(best, 0) AS score
            FROM comp c JOIN base ON base.job_id = c.job_id AND base_doc = c.doc_id LEFT JOIN best b ON b.job_id = c.job_id AND b.cid = c.cid
            WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.job_id = c.job_id AND m.cid = c.cid) AND coalesce(best, 0) < 0.55
            QUALIFY row_number() OVER (PARTITION BY c.job_id ORDER BY c.cid) <= 200)
SELECT job_id, cid, cluster_type, round(score, 6) AS score FROM added UNION ALL SELECT job_id, cid, cluster_type, round(score, 6) FROM deleted""")
def added_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, G9, J13 with the first document of each job as its base."""
    result = _result(spark, sf_dir, base_docs=_base(spark, sf_dir))
    added = result.clusters.filter("cluster_type = 'added'").select("job_id", F.array_min("members").alias("cid"), "cluster_type", _r6("score").alias("score"))
    return added.unionByName(result.deleted.select("job_id", "cid", "cluster_type", _r6("score").alias("score")))


# ------------------------------------------------------------- job aggregates
@query(f"WITH {O.COMPONENTS} SELECT job_id, doc_a, doc_b, round(sim, 6) AS sim FROM matrix")
def doc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J15."""
    return _result(spark, sf_dir).matrix.select("job_id", "doc_a", "doc_b", _r6("sim").alias("sim"))


@query(f"WITH {O.COMPONENTS} SELECT job_id, round(peak, 6) AS peak FROM peaks")
def doc_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return aggregate.matrix_peaks(_result(spark, sf_dir).matrix).select("job_id", _r6("peak").alias("peak"))


@query(f"""WITH {O.COMPONENTS}, p AS (SELECT job_id, doc_a, doc_b, round(sim * 100)::INT AS percent FROM matrix WHERE doc_a < doc_b)
SELECT *, CASE WHEN percent >= 80 THEN 'high' WHEN percent >= 60 THEN 'medium' WHEN percent >= 30 THEN 'low' ELSE 'none' END AS band FROM p""")
def pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return aggregate.ranked_pairs(_result(spark, sf_dir).matrix)


@query(f"WITH {O.SCORED} SELECT job_id, doc_id, 'other' AS section_kind, round(max(coalesce(best, 0)), 6) AS intensity, count(*) FILTER (WHERE coalesce(best, 0) >= 0.5) AS matches FROM comp LEFT JOIN best USING (job_id, cid) GROUP BY job_id, doc_id")
def section_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return _result(spark, sf_dir).sections.select("job_id", "doc_id", "section_kind", _r6("intensity").alias("intensity"), "matches")


@query(f"""WITH {O.FEATURES}, counted AS (
  SELECT job_id, term, count(DISTINCT doc_id) AS n_docs FROM (SELECT job_id, doc_id, unnest(tokens) AS term FROM comp) WHERE length(term) >= 4 GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2)
SELECT job_id, term, n_docs FROM counted QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n_docs DESC, length(term) DESC, term) <= 30""")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return aggregate.shared_terms(_light(spark, sf_dir, True), grouped=True).select("job_id", "term", "n_docs")


@query("""
WITH price AS (SELECT o_custkey AS doc_id, o_custkey % 50 AS job_id, max(floor(o_totalprice))::BIGINT AS amount FROM orders GROUP BY ALL),
parts AS (SELECT DISTINCT o_custkey AS doc_id, o_custkey % 50 AS job_id, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
overlap AS (SELECT a.job_id, a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n FROM parts a JOIN parts b ON a.job_id = b.job_id AND a.l_partkey = b.l_partkey AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT o.job_id, doc_a, doc_b, a.amount AS amount_a, b.amount AS amount_b, round(abs(a.amount - b.amount) / greatest(a.amount, b.amount), 6) AS gap
FROM overlap o JOIN price a ON a.doc_id = doc_a JOIN price b ON b.doc_id = doc_b
WHERE n >= 3 AND a.amount != b.amount AND a.amount > 0 AND b.amount > 0 AND abs(a.amount - b.amount) / greatest(a.amount, b.amount) < 0.03""")
def price_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: customers as documents, their greatest order as the price, common parts as the overlap."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    job = (F.col("o_custkey") % 50).alias("job_id")
    amounts = orders.groupBy(job, F.col("o_custkey").alias("doc_id")).agg(F.max(F.floor("o_totalprice")).cast("long").alias("amount"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(job, F.col("o_custkey").alias("doc_id"), "l_partkey").distinct()
    a, b = parts.withColumnRenamed("doc_id", "doc_a"), parts.withColumnRenamed("doc_id", "doc_b")
    overlaps = a.join(b, ["job_id", "l_partkey"]).filter("doc_a < doc_b").groupBy("job_id", "doc_a", "doc_b").agg(F.count("*").alias("n"))
    return aggregate.price_proximity(amounts, overlaps).select("job_id", "doc_a", "doc_b", "amount_a", "amount_b", _r6("gap").alias("gap"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs_of_documents(_docs(spark, sf_dir)).select("job_id", "doc_id", F.col("lang").alias("author"), F.lit("").alias("last_modified_by"))


@query("""SELECT job_id, doc_id, 'same_author' AS flag, value, n_docs FROM (
  SELECT doc_id // 10 AS job_id, doc_id, trim(lang) AS value, count(*) OVER (PARTITION BY doc_id // 10, trim(lang)) AS n_docs FROM documents WHERE trim(lang) != '') WHERE n_docs >= 2""")
def metadata_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 with the language as the author."""
    return aggregate.metadata_flags(_metadata(spark, sf_dir))


@query(f"WITH {O.COMPONENTS} SELECT job_id, round(peak, 6) AS peak, score, CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' WHEN score > 0.1 THEN 'low' ELSE 'none' END AS level FROM collusion")
def collusion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7; these texts have no amounts, so no price signal."""
    found = _result(spark, sf_dir, metadata=_metadata(spark, sf_dir)).collusion
    return found.select("job_id", _r6("peak").alias("peak"), "score", "level")


@query(f"""WITH {O.COMPONENTS} SELECT c.job_id, c.chunk_count, coalesce(k.cluster_count, 0) AS cluster_count, coalesce(same_count, 0) AS same_count, coalesce(minor_change_count, 0) AS minor_change_count,
  coalesce(changed_count, 0) AS changed_count, coalesce(uncertain_count, 0) AS uncertain_count
FROM (SELECT job_id, count(*) AS chunk_count FROM comp GROUP BY ALL) c LEFT JOIN (
  SELECT job_id, count(*) AS cluster_count, count(*) FILTER (WHERE cluster_type = 'same') AS same_count, count(*) FILTER (WHERE cluster_type = 'minor_change') AS minor_change_count,
         count(*) FILTER (WHERE cluster_type = 'changed') AS changed_count, count(*) FILTER (WHERE cluster_type = 'uncertain') AS uncertain_count FROM described GROUP BY ALL) k USING (job_id)""")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return _result(spark, sf_dir).summary.select("job_id", "chunk_count", "cluster_count", "same_count", "minor_change_count", "changed_count", "uncertain_count")


# ------------------------------- entities, numerals, facts: clauses made of the tables' columns
_DIGITS = "零一二三四五六七八九"


def _spelled(n: str) -> str:
    """SQL for a number from 1 to 9999 in Chinese numerals."""
    digit = lambda x: f"substring('{_DIGITS}', int({x}) + 1, 1)"
    t, h, e, u = f"({n} div 1000)", f"({n} div 100 % 10)", f"({n} div 10 % 10)", f"({n} % 10)"
    thousands = f"if({t} > 0, concat({digit(t)}, '千'), '')"
    hundreds = f"if({h} > 0, concat({digit(h)}, '百'), if({t} > 0 and {n} % 100 > 0, '零', ''))"
    tens = f"if({e} > 0, concat({digit(e)}, '十'), if({h} > 0 and {u} > 0, '零', ''))"
    return f"concat({thousands}, {hundreds}, {tens}, if({u} > 0, {digit(u)}, ''))"


@query("""SELECT p_partkey, concat('工期', p_partkey % 9999 + 1, '天，预付', (p_partkey % 97 + 1) * 10000, '元，让利', p_size, '%，', 1990 + p_size % 40, '年') AS rewritten FROM part""")
def cn_number_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals spelled from the parts' numbers are rewritten to these numbers."""
    year = "translate(cast(1990 + p_size % 40 as string), '0123456789', '〇一二三四五六七八九')"
    text = f"concat('工期', {_spelled('(p_partkey % 9999 + 1)')}, '天，预付', {_spelled('(p_partkey % 97 + 1)')}, '万元，让利百分之', {_spelled('p_size')}, '，', {year}, '年')"
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(text).alias("text"))
    return rows.select("p_partkey", X.normalized(F.col("text"), case=False, punctuation=False, space=False).alias("rewritten")).withColumn("rewritten", F.replace("rewritten", F.lit(","), F.lit("，")))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice)::BIGINT AS price FROM orders)
SELECT o_orderkey, 'date' AS kind, concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日') AS value FROM o
UNION ALL SELECT o_orderkey, 'amount', concat(price, '元') FROM o UNION ALL SELECT o_orderkey, 'percentage', concat(o_orderkey % 50, '%') FROM o
UNION ALL SELECT o_orderkey, 'duration', concat(o_custkey % 36 + 1, '个月') FROM o""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what clauses made of the orders say."""
    date = "concat(year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日')"
    text = f"concat('合同金额', cast(floor(o_totalprice) as bigint), ' 元，', {date}, '前支付，质保', o_custkey % 36 + 1, ' 个月，折扣', o_orderkey % 50, '%')"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", E.entities(F.expr(text)).alias("entities"))
    return rows.select("o_orderkey", F.explode("entities").alias("e")).select("o_orderkey", "e.kind", "e.value")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 36 AS d, floor(o_totalprice)::BIGINT // 50000 AS amount, o_orderkey % 3 AS p, lead(o_orderkey) OVER w AS other,
             lead(floor(o_totalprice)::BIGINT // 50000) OVER w AS amount_b, lead(o_orderkey % 3) OVER w AS p_b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
n AS (SELECT *, 1 + (amount = amount_b)::INT + (p = p_b)::INT AS same FROM o WHERE other IS NOT NULL)
SELECT o_orderkey, other, round(same / (6 - same), 6) AS similarity FROM n""")
def entity_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, K3: between neighbouring orders of a customer, from what their clauses say."""
    text = "concat('合同金额', cast(floor(o_totalprice) as bigint) div 50000, '万元，质保', o_custkey % 36, '个月，折扣', o_orderkey % 3, '%')"
    rows = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", E.entities(F.expr(text)).alias("e"))
    after = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = rows.withColumn("other", F.lead("o_orderkey").over(after)).withColumn("f", F.lead("e").over(after)).filter("other is not null")
    return pairs.select("o_orderkey", "other", F.round(X.entity_jaccard(F.col("e"), F.col("f")), 6).alias("similarity"))


@query("""
WITH p AS (SELECT p_partkey, p_type, p_brand, p_size % 4 AS depth, lead(p_type) OVER w AS type_b, lead(p_brand) OVER w AS brand_b, lead(p_size % 4) OVER w AS depth_b FROM part WINDOW w AS (PARTITION BY p_partkey // 2 ORDER BY p_partkey)),
q AS (SELECT *, CASE WHEN least(depth, depth_b) >= 1 AND p_type = type_b THEN CASE WHEN least(depth, depth_b) >= 2 AND p_brand = brand_b THEN least(depth, depth_b) ELSE 1 END ELSE 0 END AS common FROM p WHERE depth_b IS NOT NULL)
SELECT p_partkey, CASE WHEN depth = 0 OR depth_b = 0 THEN NULL ELSE round(2.0::DOUBLE * common / (depth + depth_b), 6) END AS similarity FROM q""")
def path_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: between neighbouring parts, with type, brand and one more level as section paths."""
    path = "slice(array(p_type, p_brand, 'leaf'), 1, p_size % 4)"
    pair = Window.partitionBy(F.expr("p_partkey div 2")).orderBy("p_partkey")
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(path).alias("x")).withColumn("y", F.lead("x").over(pair)).filter("y is not null")
    return rows.select("p_partkey", F.round(X.path_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""
WITH j AS (SELECT DISTINCT c_custkey // 4 AS job_id FROM customer),
c AS (SELECT job_id, CASE job_id % 3 WHEN 0 THEN [[0, 1], [2, 3]] WHEN 1 THEN [[1, 2, 3]] ELSE [[0, 1, 2, 3]] END AS parts FROM j)
SELECT job_id, array_to_string(list_transform(m, lambda x: (job_id * 4 + x)::VARCHAR), ',') AS members, len(m) AS n_members FROM (SELECT job_id, unnest(parts) AS m FROM c)""")
def cohesive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of four chunks: chains that part in the middle, chains that lose an end, and dense ones that stay."""
    jobs = _table(spark, sf_dir, "customer").select(F.expr("c_custkey div 4").alias("job_id")).distinct()
    kinds = F.array(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 1, 0.82), (1, 2, 0.71), (2, 3, 0.84))]),
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 1, 0.70), (1, 2, 0.81), (2, 3, 0.84))]),
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 1, 0.75), (1, 2, 0.71), (2, 3, 0.84), (0, 2, 0.9), (1, 3, 0.8))]),
    )
    edges = jobs.select("job_id", F.explode(F.get(kinds, F.col("job_id") % 3)).alias("e"))
    first, second = (F.col("job_id") * 4 + F.col(f"e.{x}") for x in "ab")
    score_ = F.col("e.w").cast("double")
    scored = edges.select(
        "job_id", first.alias("a"), second.alias("b"), first.alias("doc_id_a"), second.alias("doc_id_b"), score_.alias("final_score"), score_.alias("lexical"),
        F.lit(None).cast("double").alias("semantic"), F.lit(True).alias("keep"),
    )
    out = cluster.job_clusters(scored, 0.5)
    return out.select("job_id", F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("n_members"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause per line item: orders as groups, lines as documents."""
    party = "if(l_returnflag = 'R', '乙方', '甲方')"
    text = f"concat({party}, '应支付货物款', cast(floor(l_extendedprice) as bigint), '元，质保期', cast(l_quantity as int), '个月，比例', cast(round(l_discount * 100) as int), '%')"
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("long").alias("doc"), F.expr(text).alias("text"))


_CLAUSE_SQL = """t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '乙方' ELSE '甲方' END AS party,
  concat(floor(l_extendedprice)::BIGINT, '元') AS amount, concat(l_quantity::INT, '个月') AS duration, concat(round(l_discount * 100)::INT, '%') AS percentage FROM lineitem)"""


@query(f"WITH {_CLAUSE_SQL} SELECT l_orderkey AS clause, l_linenumber::BIGINT AS doc, party AS subject, '支付' AS action, '付款义务' AS obligation_type, '货物' AS object, amount, duration, percentage, 0.75 AS confidence FROM t")
def fact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of clauses made of the line items."""
    told = facts.with_facts(_clauses(spark, sf_dir).withColumn("entities", E.entities(F.col("text"))))
    return told.select(F.col("group").alias("clause"), "doc", *[f"fact.{c}" for c in ("subject", "action", "obligation_type", "object", "amount", "duration", "percentage", "confidence")])


@query(f"""WITH {_CLAUSE_SQL}, k AS (SELECT DISTINCT * FROM t),
c AS (SELECT l_orderkey, count(DISTINCT amount) > 1 AS amount, count(DISTINCT duration) > 1 AS duration, count(DISTINCT percentage) > 1 AS percentage, count(DISTINCT party) > 1 AS party
      FROM (SELECT l_orderkey, l_linenumber, any_value(amount) AS amount, any_value(duration) AS duration, any_value(percentage) AS percentage, any_value(party) AS party FROM k GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL)
SELECT l_orderkey AS clause, CASE WHEN amount OR duration OR party THEN 'high' ELSE 'medium' END AS risk,
       concat_ws(',', CASE WHEN amount THEN 'amount' END, CASE WHEN duration THEN 'duration' END, CASE WHEN percentage THEN 'percentage' END, CASE WHEN party THEN 'subject' END) AS fields
FROM c WHERE amount OR duration OR percentage OR party""")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of an order contradict one another; a line number that an order has twice is no document."""
    rows = _clauses(spark, sf_dir).distinct().groupBy("group", "doc").agg(F.first("text").alias("text"), F.count("*").alias("n")).filter("n = 1")
    told = facts.with_facts(rows.withColumn("entities", E.entities(F.col("text")))).select("group", "doc", "fact")
    return facts.fact_conflicts(told).select(F.col("group").alias("clause"), "risk", F.array_join(F.col("fields.field"), ",").alias("fields"))


@query(f"WITH {O.SCORED} SELECT a, b, x.text AS left_text, y.text AS right_text FROM edges JOIN comp x ON x.cid = a JOIN comp y ON y.cid = b")
def graded_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D5 of all similar pairs; what is checked is that the script rebuilds both sides."""
    result = _result(spark, sf_dir)
    text = result.nodes.select("cid", "text", "chunk_type")
    pairs = result.edges.select("a", "b").join(text.withColumnsRenamed({"cid": "a", "text": "ta", "chunk_type": "ka"}), "a").join(text.withColumnsRenamed({"cid": "b", "text": "tb", "chunk_type": "kb"}), "b")
    rows = (F.col("ka") == "table_row") & (F.col("kb") == "table_row")
    ops = pairs.withColumn("ops", D.diff_column(F.col("ta"), F.col("tb"), rows))

    def side(skip: str) -> F.Column:
        return F.array_join(F.transform(F.filter("ops", lambda o: o["op"] != skip), lambda o: o["text"]), "")

    return ops.select("a", "b", side("ins").alias("left_text"), side("del").alias("right_text"))


def _shown(ops: F.Column) -> F.Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["op"], F.lit(":"), o["text"])), "|")


@query("""
SELECT p_partkey, 'char' AS kind, concat('eq:', p_name, '|ins: ', p_brand) AS script FROM part
UNION ALL SELECT p_partkey, 'word', concat('eq:', repeat('lorem ', 12), '|del:alpha|ins:', 'omega', '|eq: ', repeat('dolor ', 12)) FROM part
UNION ALL SELECT p_partkey, 'sentence', concat('eq:', repeat('x', 420), '。|ins:第', p_partkey, '条。') FROM part
UNION ALL SELECT p_partkey, 'row', concat('eq:', p_partkey, ' | ', p_name, '|del: | ', p_brand) FROM part""")
def diff_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits between texts made of the parts' columns, by characters, words, sentences and columns."""
    cases = {
        "char": ("p_name", "concat(p_name, ' ', p_brand)"),
        "word": ("concat(repeat('lorem ', 12), 'alpha ', repeat('dolor ', 12))", "concat(repeat('lorem ', 12), 'omega ', repeat('dolor ', 12))"),
        "sentence": ("concat(repeat('x', 420), '。')", "concat(repeat('x', 420), '。第', p_partkey, '条。')"),
        "row": ("concat(p_partkey, ' | ', p_name, ' | ', p_brand)", "concat(p_partkey, ' | ', p_name)"),
    }
    cases = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(a).alias("a"), F.expr(b).alias("b")) for k, (a, b) in cases.items()])
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.explode(cases).alias("c"))
    return rows.select("p_partkey", "c.kind", _shown(D.diff_column(F.col("c.a"), F.col("c.b"), F.col("c.kind") == "row")).alias("script"))


# ------------------------------------------------------ files, previews, reports
@query(f"WITH {O.CHUNKS}, one AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1) SELECT doc_id, order_index, chunk_type, text FROM chunks JOIN one USING (doc_id) ORDER BY order_index LIMIT 5000")
def preview_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 for the longest document."""
    one = _docs(spark, sf_dir).orderBy(F.desc("n_chars"), "doc_id").select("doc_id").first()
    rows = listing.preview(_flat(spark, sf_dir), one[0] if one else None)
    return rows.select("doc_id", F.col("order_index").cast("long").alias("order_index"), "chunk_type", "text")


def _parsed(rows: DataFrame, extension: str, content: F.Column, key: str) -> DataFrame:
    files = rows.select(F.col(key).cast("string").alias("path"), F.sha2(content, 256).alias("file_hash"), F.lit(extension).alias("extension"), content.alias("content"))
    return parse.parse_files(files, ParserConfig(remove_header_footer=False))


@query("""SELECT doc_id, greatest(1, length(text) // 1500)::INT AS pages, length(text) AS char_count, 'text' AS parse_method, text FROM documents WHERE text IS NOT NULL""")
def parse_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file with a byte order mark."""
    docs = _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.encode(F.concat(F.lit("\ufeff"), "text"), "UTF-8").alias("content"))
    out = _parsed(docs, "txt", F.col("content"), "doc_id")
    return out.select(F.col("path").cast("long").alias("doc_id"), "pages", "char_count", "parse_method", F.col("blocks")[0]["text"].alias("text"))


def _files(rows: DataFrame, key: str, write: Callable[[list[tuple]], bytes]) -> DataFrame:
    """``rows(key, cells)`` to one file per key with its rows in their order; keys are few rows each."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("cells")).alias("all_cells"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [write([tuple(r.values()) for r in cells]) for cells in pdf["all_cells"]]})

    return grouped.mapInPandas(of, f"{key} long, content binary")


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, 1 AS page, concat_ws(' | ', o_orderkey, o_orderstatus, CASE WHEN o_totalprice = floor(o_totalprice) THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END) AS text FROM orders""")
def parse_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer are written to a workbook and read back."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.struct("o_orderkey", "o_orderstatus", "o_totalprice").alias("cells"))
    files = _files(orders, "o_custkey", lambda rows: export.workbook({"orders": [list(r) for r in rows]}))
    blocks = _parsed(files, "xlsx", F.col("content"), "o_custkey").select("path", F.explode("blocks").alias("b")).filter("b.is_table_row")
    return blocks.select(F.col("path").cast("long").alias("o_custkey"), F.col("b.block_idx").cast("long").alias("line"), "b.page", "b.text")


@query("""
WITH p AS (SELECT n_nationkey, n_name, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS rn FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT n_nationkey::BIGINT AS n_nationkey, 0::BIGINT AS line, 1 AS heading_level, n_name AS text FROM p WHERE rn = 1
UNION ALL SELECT n_nationkey, rn * 2 - 1, 2, c_name FROM p UNION ALL SELECT n_nationkey, rn * 2, NULL, concat('segment ', c_mktsegment) FROM p""")
def parse_word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers are written to a Word file, with headings, and read back."""
    nations, customers = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    rows = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.struct("c_custkey", "c_name", "c_mktsegment", "n_name").alias("cells"))

    def write(cells: list[tuple]) -> bytes:
        return export.document([(1, cells[0][3])] + [x for _, name, segment, _ in cells for x in ((2, name), (0, f"segment {segment}"))])

    blocks = _parsed(_files(rows, "n_nationkey", write), "docx", F.col("content"), "n_nationkey").select("path", F.explode("blocks").alias("b"))
    return blocks.select(F.col("path").cast("long").alias("n_nationkey"), F.col("b.block_idx").cast("long").alias("line"), "b.heading_level", "b.text")


_REPORT_JOB = "one AS (SELECT job_id FROM by_hash GROUP BY job_id ORDER BY count(*) DESC, job_id LIMIT 1)"


def _report(spark: SparkSession, sf_dir: str) -> dict | None:
    """The report of the job with most pairs of equal chunks; only that job is compared."""
    top = recall.hash_pairs(_light(spark, sf_dir, True), grouped=True).groupBy("job_id").count().orderBy(F.desc("count"), "job_id").first()
    if top is None:
        return None
    return export.assemble(compare(document_chunks(_docs(spark, sf_dir).filter(F.expr("doc_id div 10") == top[0])), grouped=True), top[0])


@query(f"""WITH {O.COMPONENTS}, {_REPORT_JOB}
SELECT CASE d.cluster_type WHEN 'same' THEN '相同' WHEN 'minor_change' THEN '轻微修改' WHEN 'changed' THEN '修改' ELSE '待确认' END AS kind,
       CASE d.severity WHEN 'low' THEN '低' WHEN 'medium' THEN '中' ELSE '复核' END AS severity,
       substring('甲乙丙丁戊己庚辛壬癸', (dense_rank() OVER (ORDER BY m.doc_id))::INT, 1) AS doc_rank_tag, m.doc_id, CASE m.role WHEN 'primary' THEN '主' ELSE '重复' END AS role, m.text
FROM member m JOIN one USING (job_id) JOIN described d ON d.job_id = m.job_id AND d.root = m.root""".replace("(dense_rank() OVER (ORDER BY m.doc_id))::INT", "(SELECT count(DISTINCT c.doc_id) FROM comp c WHERE c.job_id = m.job_id AND c.doc_id <= m.doc_id)::INT").replace("AS doc_rank_tag, m.doc_id,", "AS doc,"))
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the job with most equal chunks, written as CSV and read back."""
    report = _report(spark, sf_dir)
    schema = "kind string, severity string, doc string, role string, text string"
    rows = [] if report is None else list(csv.DictReader(io.StringIO(export.export(report, "csv").decode("utf-8-sig"))))
    return spark.createDataFrame([(r["类型"], r["风险"], r["文档"], r["角色"], r["文本"]) for r in rows], schema)


@query(f"""WITH {O.COMPONENTS}, {_REPORT_JOB}
SELECT p.doc_id AS doc_a, q.doc_id AS doc_b, p.text AS text_a, q.text AS text_b, d.cluster_type
FROM primary_member p JOIN one USING (job_id) JOIN primary_member q ON q.job_id = p.job_id AND q.root = p.root AND p.doc_id < q.doc_id JOIN described d ON d.job_id = p.job_id AND d.root = p.root
QUALIFY row_number() OVER (PARTITION BY p.doc_id, q.doc_id ORDER BY d.avg_score DESC, p.root) <= 40""")
def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the same report with their edits, as JSON; both texts are put together from the edits."""
    report = _report(spark, sf_dir)
    schema = "doc_a long, doc_b long, text_a string, text_b string, cluster_type string"
    told = [] if report is None else json.loads(export.export(report, "json"))["pairs"]
    side = lambda ops, other: "".join(text for op, text in ops if op != other)
    return spark.createDataFrame([(p["docA"], p["docB"], side(t["ops"], "ins"), side(t["ops"], "del"), t["type"]) for p in told for t in p["texts"]], schema)


@query(f"WITH {O.COMPONENTS} SELECT job_id, root AS first_chunk, cid, doc_id, NULL::VARCHAR AS amount, 0.0 AS confidence FROM primary_member")
def member_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the clusters' primaries; these texts state none, so every fact is empty."""
    result = _result(spark, sf_dir)
    first = result.clusters.select("job_id", "cluster_no", F.array_min("members").alias("first_chunk"))
    rows = listing.member_facts(first, result.members, result.facts).join(first, ["job_id", "cluster_no"])
    return rows.select("job_id", "first_chunk", "cid", "doc_id", "fact.amount", F.col("fact.confidence").alias("confidence"))


@query("SELECT vec_id, octet_length(''::BLOB) + 4 * len(embedding) AS n_bytes, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors packed to bytes and read back."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", embed.packed(F.col("embedding")).alias("blob"))
    rows = rows.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), embed.unpacked(F.col("blob")).alias("v"))
    return rows.select("vec_id", "n_bytes", F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


@query(f"""WITH {O.FEATURES} SELECT cid, (length(f.first_text) + 9)::DOUBLE AS value FROM comp JOIN (SELECT normalized_hash, min(text) AS first_text FROM comp GROUP BY ALL) f USING (normalized_hash)""")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 with a model that says how long a text is: each normalized hash is computed once."""

    def model() -> Callable:
        return lambda texts: np.array([[len(t)] for t in texts], dtype=np.float32)

    vectors, _ = embed.with_vectors(_light(spark, sf_dir), model, "length")
    return vectors.select("cid", F.col("vector")[0].cast("double").alias("value"))


# ----------------------------------------------------------- lists and control
_SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' ELSE 'review' END"


@query(f"""SELECT o_orderkey, {_SEVERITY} AS severity, o_totalprice AS score FROM orders
ORDER BY CASE {_SEVERITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def cluster_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 with orders as clusters: the third page of 50."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SEVERITY).alias("severity"), F.col("o_totalprice").alias("score"))
    return listing.cluster_page(rows, 50, 100, ident=["o_orderkey"])[0]


@query(f"SELECT o_orderkey, {_SEVERITY} AS severity FROM orders WHERE {_SEVERITY} = 'high' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def cluster_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, J12 with orders as clusters and suppliers as documents."""
    rows = _table(spark, sf_dir, "orders").select(F.lit(0).alias("job_id"), F.col("o_orderkey").alias("cluster_no"), F.expr(_SEVERITY).alias("severity"))
    members = _table(spark, sf_dir, "lineitem").select(F.lit(0).alias("job_id"), F.col("l_orderkey").alias("cluster_no"), F.col("l_suppkey").alias("doc_id"))
    out = listing.filtered_clusters(rows, members, doc_id=7, severity="high")
    return out.select(F.col("cluster_no").alias("o_orderkey"), "severity")


@query(f"""WITH {O.COMPONENTS}, best_pair AS (SELECT job_id, doc_a, doc_b FROM matrix WHERE doc_a < doc_b QUALIFY row_number() OVER (ORDER BY round(sim, 9) DESC, job_id, doc_a, doc_b) = 1)
SELECT p.job_id, p.text AS text_a, q.text AS text_b, d.cluster_type, round(avg_score, 6) AS score
FROM best_pair t JOIN primary_member p ON p.job_id = t.job_id AND p.doc_id = doc_a JOIN primary_member q ON q.job_id = t.job_id AND q.doc_id = doc_b AND q.root = p.root
JOIN described d ON d.job_id = p.job_id AND d.root = p.root ORDER BY avg_score DESC, p.root LIMIT 40""")
def pair_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 for the most similar pair of documents of all jobs."""
    result = _result(spark, sf_dir)
    top = result.matrix.filter("doc_a < doc_b").orderBy(F.desc(F.round("sim", 9)), "job_id", "doc_a", "doc_b").first()
    a, b = (top["doc_a"], top["doc_b"]) if top else (-1, -1)
    texts = listing.pair_texts(result.members, result.nodes, result.clusters, a, b)
    return texts.select("job_id", "text_a", "text_b", "cluster_type", _r6("score").alias("score"))


@query(f"""WITH p AS (SELECT o_orderkey, {_SEVERITY} AS severity, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE 'changed' END AS cluster_type FROM orders
ORDER BY CASE {_SEVERITY} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 40) SELECT * FROM p WHERE cluster_type = 'changed'""")
def cluster_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10b with orders as clusters: the first forty, and of these all but added and deleted ones."""
    kind = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'deleted' ELSE 'changed' END")
    rows = _table(spark, sf_dir, "orders").select(F.lit(0).alias("job_id"), F.col("o_orderkey").alias("cluster_no"), F.expr(_SEVERITY).alias("severity"), kind.alias("cluster_type"), F.col("o_totalprice").alias("score"))
    return listing.cluster_feed(rows).select(F.col("cluster_no").alias("o_orderkey"), "severity", "cluster_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'red') AND p_size % 2 = 0")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 with parts as jobs: by part of the name, starred ones only."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.expr("if(p_type = 'ECONOMY', 'compare', 'import')").alias("job_type"), F.expr("p_size % 2 = 0").alias("starred"), F.col("p_size").alias("created_at"), F.col("p_partkey").alias("job_id"))
    return listing.filtered_jobs(rows, "RED", True).select("p_partkey", F.col("name").alias("p_name"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 with orders as jobs: the newest hundred."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    return listing.listed(rows, "jobs", "o_orderkey").limit(100).select("o_orderkey")


@query(f"WITH {O.COMPONENTS} SELECT job_id, root AS first_chunk, doc_id, cid, role, text FROM member")
def cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of all clusters with their texts."""
    result = _result(spark, sf_dir)
    first = result.raw_clusters.select("job_id", "cluster_no", F.array_min("members").alias("first_chunk"))
    rows = listing.cluster_detail(first, result.members, result.nodes).join(first, ["job_id", "cluster_no"])
    return rows.select("job_id", "first_chunk", "doc_id", "cid", "role", "text")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest_event_type, count(*) AS n FROM events GROUP BY user_id")
def latest_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, A8 with events as jobs and users as workspaces."""
    return listing.latest_by(_table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", "event_id")


@query("SELECT n_name, count(DISTINCT c_custkey) AS documents, count(o_orderkey) AS jobs FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over left joins; orders are counted per customer first."""
    nation, customer = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    jobs = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"))
    rows = customer.join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("documents"), F.sum("jobs").alias("jobs"))
    out = nation.join(rows, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS level FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_level_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    out = _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("level"))
    return out.filter("level is not null")


@query("""SELECT event_id FROM events WHERE NOT coalesce(event_type IN ('purchase', 'click') AND NOT coalesce(user_id % 7 = 0, false)
  AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY, false)""")
def retention_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished unstarred jobs older than ten days go; real timestamps, so no day is lost."""
    events = _table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    jobs = events.select("event_id", F.col("event_type").alias("status"), (F.col("user_id") % 7 == 0).alias("starred"), F.col("ts").alias("finished_at"))
    return listing.retained(jobs, now, 10, ["purchase", "click"]).select("event_id")


@query("""WITH lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity >= 45 GROUP BY ALL)
SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS n FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey WHERE o_orderstatus != 'F'""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status F are deleted with their lines; a left outer count of what is left."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    gone = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = _table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_orderkey")
    kept = listing.without_children(lines, gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))
    out = orders.filter("o_orderstatus != 'F'").join(kept, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT doc_id, quality, toxic FROM (
  SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY doc_id ORDER BY layer DESC) AS rn
  FROM (SELECT doc_id, quality, toxic, 0 AS layer FROM labels UNION ALL SELECT doc_id, 1, 0, 1 FROM documents WHERE n_chars < 500)) WHERE rn = 1""")
def upsert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents' labels replace the stored ones."""
    stored = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    new = _docs(spark, sf_dir).filter("n_chars < 500").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return listing.upserted(stored, new, ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
