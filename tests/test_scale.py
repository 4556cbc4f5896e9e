"""What a query may not do as its input grows: plans, and equality of the fast ways with the plain ones."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import cluster
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pair_scores", "short_text_threshold", "best_per_chunk", "recall_union", "recall_hash", "minhash_similarity", "shared_terms", "idf", "tfidf_vectors"])
def test_only_texts_are_shuffled(spark, name):
    told = plan(catalog.queries()[name](spark, SF))
    assert told.count("Exchange ") == 1 and "Join" not in told and "InMemoryTableScan" not in told and "parts" not in told[: told.index("Generate")]


@pytest.mark.parametrize("name", ["added_deleted", "job_summary", "doc_matrix", "cluster_detail"])
def test_neither_chunks_nor_pairs_are_kept(spark, name):
    told = plan(catalog.queries()[name](spark, SF))
    kept = re.findall(r"InMemoryRelation \[(.*?)\]", told)
    assert kept and {re.sub("#.*", "", c) for c in kept[0].split(", ")} == {"job_id", "kind", "edge", "cluster", "doc", "chunk", "best"}


def test_clusters_need_no_group_of_their_own(spark):
    assert "FlatMapGroups" not in plan(catalog.queries()["cohesive_split"](spark, SF))


TEXTS = ["", "Ab c-d", "Größe: 5 m", "ŉx ĳ Ŀ ŀ ſ", "a\x85b\xa0c·d", "价格：5万元 abc", "ﬁne", "x y", "Ž-ŽŽ", "1² 22", "日本 ab", "…—", None]


def test_latin_text_is_normalized_and_split_as_any_other(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    slow = F.when(X.detected_language(t) == "en", X.tokens_en(t)).otherwise(X.tokens_zh(t))
    for r in rows.select(t, X.normalized(t).alias("n"), X.is_plain(t).alias("p"), t.rlike(X.PLAIN).alias("q"), X.tokens(t).alias("x"), slow.alias("y"), X.section_kind(t).alias("k")).collect():
        assert r["n"] == (None if r["t"] is None else X.normalize_text(r["t"])) and r["p"] == r["q"] and r["x"] == r["y"]


def test_texts_are_split_once(spark):
    assert plan(catalog.queries()["chunk_lines"](spark, SF)).count("split(text") == 1


@pytest.mark.parametrize("name", ["recall_tfidf", "pair_ranking", "member_facts", "added_deleted", "collusion_score", "section_heat", "tfidf_vectors", "chunk_vectors", "job_summary", "cluster_detail", "pair_texts"])
def test_more_queries_equal_their_sql(spark, name):
    from tests.test_engine import test_query_equals_its_sql

    test_query_equals_its_sql(spark, name)


def test_equal_strengths_go_by_id_whatever_the_order_of_edges():
    up, down = [0.7, 0.8, 0.9, 0.1], [0.9, 0.8, 0.7, 0.1]  # added one by one, down is more than up by the last digit
    edges = [(1, 10 + k, f, f, None, 0, 1 + k) for k, f in enumerate(up)] + [(2, 10 + k, f, f, None, 0, 1 + k) for k, f in enumerate(down)]
    assert [cluster.describe_part(e)["primaries"][0] for e in (edges, edges[::-1])] == [1, 1]
