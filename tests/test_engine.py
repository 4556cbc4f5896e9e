"""The comparison from chunks to collusion on small jobs, sources, exports, configuration, and some SQL equality."""

import io
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import CompareConfig, InvalidRequest, UnsupportedFile, merged_config, validated_request
from tessera.functions import diff
from tessera.functions import entities as E
from tessera.operators import aggregate, cluster, embed, facts, listing, recall
from tessera.plans import catalog
from tessera.plans.compare import compare, document_chunks
from tessera.sources import export, importing, parse

SF = "/root/testdata/sf0.001"


def test_loose_components_split_and_dense_ones_stay():
    chain = [(0, 1, 0.82, 0, None, 0, 1), (1, 2, 0.71, 0, None, 1, 2), (2, 3, 0.84, 0, None, 2, 3)]
    assert [{x for e in p for x in e[:2]} for p in cluster.cohesive_parts(chain)] == [{0, 1}, {2, 3}]
    dense = [(a, b, 0.8, 0, None, a, b) for a in range(5) for b in range(a + 1, 5)][:8]
    assert len(cluster.cohesive_parts(dense)) == 1
    assert cluster.describe_part([(0, 1, 0.9, 0.5, None, 7, 7)]) is None
    told = cluster.describe_part([(0, 2, 0.9, 0.5, None, 7, 8), (1, 2, 0.8, 0.5, 0.7, 7, 8)])
    assert told["primaries"] == [0, 2] and told["sem_avg"] == 0.7 and told["member_scores"] == [0.9, 0.8, 0.9]


@pytest.fixture(scope="module")
def result(spark):
    common = ["The supplier shall install the platform and train forty people on site", "Every interface is documented and tested before the first delivery takes place", "Maintenance answers within four working hours on each day of the year"]
    only = ["Our quote covers licences servers and cables for seventeen branch offices", "Painting the northern corridor needs nine buckets of weatherproof green", "Breakfast for visitors is served between seven and ten in the garden hall"]
    docs = [(0, "\n".join(common + only[:1])), (1, "\n".join(common[::-1] + only[1:2])), (2, "\n".join(common[:2] + only[2:])), (10, only[0]), (11, only[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    base = spark.createDataFrame([(0, 0)], "job_id long, base_doc long")
    meta = spark.createDataFrame([(0, 0, "li", ""), (0, 1, "li", ""), (0, 2, "wu", "")], "job_id long, doc_id long, author string, last_modified_by string")
    return compare(document_chunks(df), CompareConfig(similarity_threshold=0.5), base_docs=base, metadata=meta)


def test_compare_end_to_end(result):
    rows = {r["cluster_no"]: r for r in result.clusters.collect()}
    assert len(rows) == 3 and all(r["cluster_type"] == "same" for r in rows.values())
    assert sorted(r["n_docs"] for r in rows.values()) == [2, 3, 3]
    assert sum(r["moved"] for r in rows.values()) >= 1
    matrix = {(r["doc_a"], r["doc_b"]): r["sim"] for r in result.matrix.filter("job_id = 0").collect()}
    assert matrix[(0, 0)] == 1 and matrix[(0, 1)] > 0.6 and matrix[(0, 1)] > matrix[(0, 2)]
    assert [r["cid"] for r in result.deleted.collect()] == [3]
    found = {r["job_id"]: r for r in result.collusion.collect()}
    assert found[0]["level"] in ("medium", "high") and found[1]["level"] == "none"
    assert {s["kind"] for s in found[0]["signals"]} >= {"similarity", "cluster", "metadata"}
    counts = {r["job_id"]: r for r in result.summary.collect()}
    assert counts[0]["same_count"] == counts[0]["cluster_count"] == 3 and counts[1]["cluster_count"] == 0
    scores = result.scored.select(F.min("final_score"), F.max("final_score")).first()
    assert 0 <= scores[0] <= scores[1] <= 1


def test_exports(result):
    report = export.assemble(result, 0)
    for kind in export.FORMATS:
        data = export.export(report, kind)
        assert data.startswith(b"PK") if kind in ("docx", "xlsx") else "forty people" in data.decode()
    assert export.export(report, "csv").startswith(b"\xef\xbb\xbf")
    again, _, _ = parse.parse_xlsx(export.to_xlsx(report))
    assert sum(b["heading_level"] == 1 for b in again) == 5
    blocks, _, _ = parse.parse_docx(export.to_docx(report))
    assert blocks[0]["heading_level"] == 1
    pairs = {p["tags"]: p["texts"] for p in report["pairs"]}
    assert len(pairs["甲乙"]) == 3 and all("".join(x for o, x in t["ops"] if o != "ins") == t["textA"] for t in pairs["甲乙"])
    assert "逐对差异" in export.export(report, "md").decode()
    short = export.assemble(result, 0, include_text=False)
    assert not any("ops" in t for p in short["pairs"] for t in p["texts"])
    assert all(len(m["text"]) <= export.SHORT + 1 for c in short["clusters"] for m in c["members"])


def test_gram_channel_equals_the_inverted_index(spark, result):
    kernel = {(r["a"], r["b"], r["shared"]) for r in result.candidates.filter("by_ngram").collect()}
    from tessera.functions import text as X

    grams = result.chunks.select("job_id", "cid", "doc_id", F.explode(X.char_grams(F.col("normalized"))).alias("gram"))
    sizes = result.chunks.groupBy("job_id").agg(F.count("*").alias("n"))
    assert {(r["a"], r["b"], r["shared"]) for r in recall.exploded_candidates(grams, sizes).collect()} == kernel


def test_fact_conflicts(spark):
    texts = [(1, 0, "甲方支付预付款5%"), (1, 1, "甲方支付预付款8%"), (2, 0, "支付50000元，30000元"), (2, 1, "支付50000元"), (3, 0, "甲方承担赔偿"), (3, 1, "乙方承担赔偿"), (4, 0, "100元"), (4, 1, "200元"), (5, 0, "甲方支付100元"), (5, 1, "甲方支付200元")]
    rows = spark.createDataFrame(texts, "group long, doc long, text string").withColumn("entities", E.entities(F.col("text")))
    told = {r["group"]: (r["risk"], [f["field"] for f in r["fields"]]) for r in facts.fact_conflicts(facts.with_facts(rows)).collect()}
    assert told == {1: ("medium", ["percentage"]), 3: ("high", ["subject"]), 4: ("review", ["amount"]), 5: ("high", ["amount"])}


def test_price_proximity(spark):
    amounts = spark.createDataFrame([(0, 0, 1000), (0, 1, 1010), (0, 2, 1000), (0, 3, 5000)], "job_id long, doc_id long, amount long")
    overlaps = spark.createDataFrame([(0, 0, 1, 3), (0, 0, 2, 9), (0, 0, 3, 9), (0, 1, 2, 2)], "job_id long, doc_a long, doc_b long, n long")
    assert [(r["doc_a"], r["doc_b"]) for r in aggregate.price_proximity(amounts, overlaps).collect()] == [(0, 1)]


def test_config_layers():
    c = merged_config({"compare": {"similarity_threshold": 0.5, "nonsense": 1}}, {"compare": {"similarity_threshold": None, "scope": "tech"}}, None)
    assert c.compare.similarity_threshold == 0.5 and c.compare.scope == "tech"
    with pytest.raises(InvalidRequest):
        merged_config({"parser": {"detect_table": "yes"}})
    with pytest.raises(InvalidRequest):
        validated_request([1, 1])
    assert validated_request([1, 2], 2, CompareConfig(similarity_threshold=3.0, candidate_top_k=1)).config.similarity_threshold == 0.99


def _docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:creator>li</dc:creator></c>')
    return out.getvalue()


def test_docx_blocks():
    p = lambda t, style="": f'<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>'
    inner = f"<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl>"
    body = p("Title", '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + p("x", "<w:pPr><w:numPr/></w:pPr>") + f"<w:tbl><w:tr><w:tc>{p('a')}{inner}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    blocks, _, fingerprint = parse.parse_docx(_docx(body))
    assert [(b["text"], b["heading_level"], b["is_table_row"], b["is_list_item"]) for b in blocks] == [("Title", 2, False, False), ("x", None, False, True), ("a in | b", None, True, False)]
    assert fingerprint["author"] == "li"


def test_header_footer_and_decoding():
    pages = [parse.block(f"Head\nbody {i}\nmore text\nFoot\n{i}", page=i) for i in range(1, 5)]
    assert [b["text"] for b in parse.strip_header_footer(pages)][0] == "body 1\nmore text\nFoot"
    assert parse.strip_header_footer(pages[:2]) == pages[:2]
    assert parse.decode_text("﻿中".encode()) == "中" and parse.decode_text("中文".encode("gb18030")) == "中文"
    assert parse.parse_file("doc", b"")["status"] == parse.parse_file("docx", b"no")["status"] == "failed"


def _pdf(objects: dict[int, bytes], trailer: bytes) -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n" + trailer


def _stream(data: bytes, more: bytes = b"") -> bytes:
    packed = zlib.compress(data)
    return b"<</Length %d/Filter/FlateDecode%s>>\nstream\n%s\nendstream" % (len(packed), more, packed)


def test_pdf_pages_and_fingerprint():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <4e2d> <0002> <D83DDE00> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    inner = [b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>", b"<</Type/Page/Parent 2 0 R/Contents[6 0 R 7 0 R]>>"]
    head = b"3 0 4 %d " % len(inner[0])
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Count 2/Resources<</Font<</F1 8 0 R/F2 9 0 R>>>>>>",
        5: _stream(b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Hello \\(w\\157rld\\)) Tj 0 -14 Td [(sec)-20(ond)-300(line)] TJ ET"),
        6: _stream(b"BT /F2 9 Tf <00010002> Tj T* <001000110012> Tj"), 7: _stream(b" ET BI /W 1 ID \x00(\xff EI BT /F1 1 Tf (end) Tj ET"),
        8: b"<</Type/Font/Subtype/Type1>>", 9: b"<</Type/Font/ToUnicode 10 0 R>>", 10: _stream(cmap), 11: _stream(head + b"".join(inner), b"/Type/ObjStm/N 2/First %d" % len(head)),
        12: b"<</Author(\xfe\xff\x67\x4e)/Producer(P)/Creator(C)/CreationDate(D:20240305101112+08'00')>>",
    }
    data = _pdf(objects, b"<</Root 1 0 R/Info 12 0 R>>")
    told = parse.parse_file("pdf", data)
    assert told["parse_error"] is None and told["pages"] == 2
    assert [(b["text"], b["page"]) for b in told["blocks"]] == [("Hello (world)\nsecond line", 1), ("中😀\nabc\nend", 2)]
    assert told["fingerprint"]["author"] == "李" and told["fingerprint"]["app"] == "P" and told["fingerprint"]["created"] == "2024-03-05T10:11:12"
    for bad in (b"", b"%PDF-1.4", data.replace(b"/Info", b"/Encrypt 1 0 R/Info"), data[:200], _pdf({1: b"<</Type/Page/Contents 2 0 R>>", 2: b"<</Filter/DCTDecode>>\nstream\nx\nendstream"}, b"<<>>")):
        assert parse.parse_file("pdf", bad)["status"] == "failed"


def test_import(spark, tmp_path):
    for name, data in {"a.txt": b"alpha text that is long enough", "b.txt": b"beta", "c.txt": b"alpha text that is long enough", "d.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / n) for n in ("a.txt", "b.txt", "c.txt", "d.docx")]
    first = importing.import_files(spark, paths).cache()
    assert sorted(r["status"] for r in first.collect()) == ["failed", "parsed", "parsed"]
    assert importing.import_files(spark, paths, stored=first).count() == 1
    assert {r["parse_method"] for r in importing.import_files(spark, paths, cache=first).filter("status = 'parsed'").collect()} == {"cache"}
    assert importing.chunks_of_import(first).filter("chunk_level = 'paragraph'").count() == 1
    with pytest.raises(UnsupportedFile):
        importing.checked_paths(spark, ["x.exe"])


def test_vectors_are_computed_once_and_cached(spark):
    rows = spark.createDataFrame([(0, 1, 10, "aa", "h1"), (0, 2, 11, "aa", "h1"), (1, 3, 12, "b", "h2")], "job_id long, cid long, doc_id long, text string, normalized_hash string")

    def model():
        return lambda texts: np.array([[len(t), t.startswith("passage: ")] for t in texts])

    first, fresh = embed.with_vectors(rows, model, "m")
    assert {r["cid"]: list(r["vector"]) for r in first.collect()} == {1: [11, 1], 2: [11, 1], 3: [10, 1]} and fresh.count() == 2
    cache = spark.createDataFrame([("h1", "m", [5.0]), ("h2", "other", [6.0])], "normalized_hash string, model_id string, vector array<float>")
    again, fresh = embed.with_vectors(rows, model, "m", cache)
    assert {r["cid"]: list(r["vector"]) for r in again.collect()} == {1: [5], 2: [5], 3: [10, 1]} and [r["normalized_hash"] for r in fresh.collect()] == ["h2"]
    blob = first.select(embed.packed(F.col("vector")).alias("b")).first()["b"]
    assert len(blob) == 8


def test_preview_lists_and_facts_of_members(spark):
    chunks = spark.createDataFrame([(1, "heading", "paragraph", i) for i in range(9)] + [(1, "sentence", "sentence", 0), (2, "x", "paragraph", 0)], "doc_id long, chunk_type string, chunk_level string, order_index int")
    assert [r["order_index"] for r in listing.preview(chunks, 1, 5).collect()] == [0, 1, 2, 3, 4]
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, 5)], "id long, created_at long")
    assert [r["id"] for r in listing.listed(rows, "jobs", "id").collect()] == [2, 1, 3] and [r["id"] for r in listing.listed(rows, "documents", "id").collect()] == [1, 3, 2]
    clusters = spark.createDataFrame([(0, 0, "same", "low", 0.9), (0, 1, "added", "low", 0.95)], "job_id long, cluster_no int, cluster_type string, severity string, score double")
    assert [r["cluster_no"] for r in listing.cluster_feed(clusters).collect()] == [0]
    members = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "job_id long, cluster_no int, cid long")
    told = spark.createDataFrame([(0, 5, 9, "x"), (0, 7, 9, "y")], "job_id long, cid long, doc_id long, fact string")
    assert [r["fact"] for r in listing.member_facts(clusters, members, told).collect()] == ["x"]


def test_results_are_stored_by_job(spark, result, tmp_path):
    export.write_results(result, str(tmp_path))
    for name in ("edges", "clusters", "members", "facts", "deleted"):
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == getattr(result, name).count()
    assert spark.read.json(f"{tmp_path}/_state").first()["state"] == "complete"


@pytest.mark.parametrize(("a", "b", "ops"), [
    ("付款5万元", "付款8万元", [("eq", "付款"), ("del", "5"), ("ins", "8"), ("eq", "万元")]),
    ("", "x", [("ins", "x")]),
    ("one two three " * 6, "one four three " * 6, [("eq", "one "), ("del", "two"), ("ins", "four")]),
    ("甲" * 210 + "。" + "乙" * 200 + "。", "甲" * 210 + "。" + "丙" * 200 + "。", [("eq", "甲" * 210 + "。"), ("del", "乙" * 200), ("ins", "丙" * 200), ("eq", "。")]),
])
def test_edits_by_length(a, b, ops):
    got = diff.graded_diff(a, b)
    assert got[: len(ops)] == ops
    assert "".join(t for o, t in got if o != "ins") == a and "".join(t for o, t in got if o != "del") == b


def test_edits_of_rows_by_column():
    assert diff.graded_diff("1 | 服务器 | 2台", "1 | 服务器 | 3台 | 新", rows=True) == [("eq", "1 | 服务器 | "), ("del", "2"), ("ins", "3"), ("eq", "台"), ("ins", " | 新")]


def test_listing(spark):
    rows = spark.createDataFrame([(1, "low", 0.9), (2, "high", 0.1), (3, "high", 0.8), (4, "review", 1.0)], "cluster_no long, severity string, score double")
    page, total = listing.cluster_page(rows, 2, 1, ident=["cluster_no"])
    assert [r["cluster_no"] for r in page.collect()] == [2, 1] and total == 4
    stored, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, listing.upserted(stored, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, listing.inserted_or_ignored(stored, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


@pytest.mark.parametrize("name", ["chunk_lines", "table_rows", "normalize_text", "dup_pairs", "idf", "recall_ngram", "clusters", "doc_matrix", "semantic_topk", "fact_conflicts", "fact_extract", "entity_extract", "cn_number_normalize", "graded_diff", "template_match", "parse_text_files", "parse_workbooks", "parse_word_files", "cluster_details", "chunk_sections", "cohesive_split", "diff_scripts", "entity_similarity", "path_similarity", "report_csv", "report_pairs"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark embeddings conversations orders lineitem part customer nation".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    told = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: [str(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in row]
    assert sorted(key([r[n] for n in names]) for r in got.collect()) == sorted(key(r) for r in told.fetchall())


def test_minhash_similarity_estimates_every_gram_pair(spark):
    from tessera.functions.minhash import signature
    from tessera.functions.text import gram_set

    sf_dir = "/root/testdata/sf0.001"
    light = catalog._light(spark, sf_dir)
    texts = {r["cid"]: r["normalized"] for r in light.select("cid", "normalized").collect()}
    every = recall.candidate_pairs(light).filter("by_hash or by_ngram").select("a", "b").collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in catalog.queries()["minhash_similarity"](spark, sf_dir).collect()}
    assert got.keys() == {(r["a"], r["b"]) for r in every} and any(0 < s < 1 for s in got.values())
    for a, b in sorted(got)[:: max(1, len(got) // 50)]:
        same = signature(sorted(gram_set(texts[a]))) == signature(sorted(gram_set(texts[b])))
        assert abs(got[a, b] - same.mean()) < 1e-9
