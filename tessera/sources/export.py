"""Reports in six formats (O1-O6, O10). A report is one job: its rows are bounded, its files written by the driver."""

from __future__ import annotations

import csv
import html
import io
import json
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.config import ExportFailed
from tessera.functions.diff import diff_column
from tessera.operators.listing import severity_rank
from tessera.plans.compare import CompareResult

# Labels and limits of the report.
TYPES = {"same": "相同", "minor_change": "轻微修改", "changed": "修改", "rewrite": "改写", "added": "新增", "deleted": "缺失", "conflict": "冲突", "uncertain": "待确认"}
SEVERITIES = {"high": "高", "medium": "中", "low": "低", "review": "复核"}
KINDS = {"tech": "技术", "business": "商务", "other": "其他"}
HEADER = ["组号", "类型", "风险", "确认状态", "标段", "组内相似", "主题", "涉及文档", "文档", "角色", "页码", "章节路径", "文本"]
LIMITS = {"html": 800, "md": 1000, "docx": 500}
STEMS = "甲乙丙丁戊己庚辛壬癸"
SHORT = 40
#: Edits in one line of text.
MARKS = {"eq": "{}", "del": "[-{}-]", "ins": "{{+{}+}}"}


def report_rows(result: CompareResult, job_id: int) -> DataFrame:
    """Clusters with members and texts of one job, the gravest and most similar first."""
    clusters = result.clusters.filter(F.col("job_id") == job_id)
    columns = ["job_id", "cid", "doc_id", "text", "section_path"] + [c for c in ("page",) if c in result.nodes.columns]
    rows = clusters.join(result.members, ["job_id", "cluster_no"], "inner").drop("score").join(result.nodes.select(*columns), ["job_id", "cid"])
    return rows.orderBy(severity_rank(F.col("severity")), F.desc("avg"), "cluster_no", "doc_id", "cid")


def pair_diffs(result: CompareResult, job_id: int, limit: int = 40) -> dict[tuple, list[dict]]:
    """O1: for each pair of documents of a job its best common clusters, with the edits between both primaries."""
    columns = result.nodes.select("job_id", "cid", "doc_id", "text", "chunk_type")
    sides = result.members.filter((F.col("job_id") == job_id) & (F.col("role") == "primary")).join(columns, ["job_id", "cid"])
    a, b = (sides.select("job_id", "cluster_no", *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "text", "chunk_type")]) for x in "ab")
    some = result.clusters.filter(~F.col("cluster_type").isin("added", "deleted")).select("job_id", "cluster_no", "cluster_type", "score")
    rows = a.join(b, ["job_id", "cluster_no"]).filter("doc_id_a < doc_id_b").join(some, ["job_id", "cluster_no"])
    best = F.row_number().over(Window.partitionBy("doc_id_a", "doc_id_b").orderBy(F.desc("score"), "cluster_no"))
    rows = rows.withColumn("_rn", best).filter(F.col("_rn") <= limit)
    both_rows = (F.col("chunk_type_a") == "table_row") & (F.col("chunk_type_b") == "table_row")
    rows = rows.withColumn("ops", diff_column(F.col("text_a"), F.col("text_b"), both_rows)).orderBy("doc_id_a", "doc_id_b", "_rn")
    out: dict[tuple, list[dict]] = {}
    for r in rows.toLocalIterator():
        told = {"type": r["cluster_type"], "score": r["score"], "textA": r["text_a"], "textB": r["text_b"], "ops": [(o["op"], o["text"]) for o in r["ops"]]}
        out.setdefault((r["doc_id_a"], r["doc_id_b"]), []).append(told)
    return out


def assemble(result: CompareResult, job_id: int, include_text: bool = True, config: dict | None = None) -> dict:
    """O1, O2: the nested report of one job."""
    result = result.of_job(job_id)
    docs = [r[0] for r in result.chunks.filter(F.col("job_id") == job_id).select("doc_id").distinct().orderBy("doc_id").collect()]
    if not docs:
        raise ExportFailed(f"no job {job_id}")
    tag = {d: STEMS[i] if i < len(STEMS) else "?" for i, d in enumerate(docs)}
    clusters: dict[int, dict] = {}
    for r in report_rows(result, job_id).toLocalIterator():
        c = clusters.setdefault(r["cluster_no"], {
            "index": len(clusters) + 1, "type": r["cluster_type"], "severity": r["severity"], "topic": r["topic"], "summary": r["summary"], "score": r["avg"],
            "reviewStatus": "pending", "sectionKind": r["section_kind"], "members": [],
        })
        text = r["text"] if include_text or len(r["text"]) <= SHORT else r["text"][:SHORT] + "…"
        c["members"].append({"doc": r["doc_id"], "tag": tag[r["doc_id"]], "role": r["role"], "sectionPath": list(r["section_path"] or []), "text": text, "page": r.asDict().get("page")})
    pairs = [{"docA": a, "docB": b, "tags": tag[a] + tag[b], "texts": t} for (a, b), t in pair_diffs(result, job_id).items()]
    if not include_text:
        for p in pairs:
            p["texts"] = [{k: v for k, v in t.items() if k in ("type", "score")} for t in p["texts"]]
    of_job = lambda df: [x.asDict(True) for x in df.filter(F.col("job_id") == job_id).collect()]
    out = {
        "jobId": job_id, "documents": [{"id": d, "tag": tag[d]} for d in docs], "summary": (of_job(result.summary) or [None])[0], "matrix": of_job(result.matrix),
        "collusion": (of_job(result.collusion) or [None])[0], "sharedTerms": of_job(result.shared_terms), "sections": of_job(result.sections),
        "clusters": list(clusters.values()), "pairs": pairs, **({"config": config} if config is not None else {}),
    }
    result.unpersist()
    return out


def _members(report: dict) -> list[list]:
    out = []
    for c in report["clusters"]:
        docs = "·".join(dict.fromkeys(m["tag"] for m in c["members"]))
        for m in c["members"]:
            out.append([
                c["index"], TYPES.get(c["type"], c["type"]), SEVERITIES.get(c["severity"], ""), "待确认", KINDS.get(c["sectionKind"], "其他"), f"{c['score'] * 100:.0f}%",
                c["topic"] or "", docs, m["tag"], "主" if m["role"] == "primary" else "重复", m["page"] or "", " › ".join(m["sectionPath"]), m["text"],
            ])
    return out


def to_csv(report: dict) -> bytes:
    """O3."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(HEADER)
    writer.writerows(_members(report))
    return ("﻿" + out.getvalue()).encode()


def to_json(report: dict) -> bytes:
    """O4."""
    return json.dumps(report, ensure_ascii=False, indent=1, default=str).encode()


def _lines(report: dict, limit: int) -> list[tuple[int, str]]:
    """(heading level or 0, text) of the readable formats; what is left out is said."""
    found = report["collusion"] or {"level": "none", "score": 0}
    out = [(1, f"比对报告 {report['jobId']}"), (0, f"围标风险：{found['level']}（{found['score']:.2f}）"), (2, "文档")]
    out += [(0, f"{d['tag']}：{d['id']}") for d in report["documents"]]
    out += [(2, "相似矩阵")] + [(0, f"{m['doc_a']} – {m['doc_b']}：{m['sim'] * 100:.0f}%") for m in report["matrix"] if m["doc_a"] != m["doc_b"]]
    out.append((2, "条款"))
    for c in report["clusters"][:limit]:
        out.append((3, f"{c['index']}. {TYPES.get(c['type'], c['type'])} · {c['topic'] or ''} · {c['summary'] or ''}"))
        out += [(0, f"{m['tag']}：{m['text']}") for m in c["members"]]
    if len(report["clusters"]) > limit:
        out.append((0, f"仅列出前 {limit} 组，共 {len(report['clusters'])} 组。"))
    shown = [(p["tags"], t) for p in report["pairs"] for t in p["texts"] if "ops" in t]
    if shown:
        out.append((2, "逐对差异"))
    for tags, t in shown[:limit]:
        out.append((0, f"{tags} · {TYPES.get(t['type'], t['type'])} · {t['score'] * 100:.0f}%：" + "".join(MARKS[op].format(text) for op, text in t["ops"])))
    if len(shown) > limit:
        out.append((0, f"仅列出前 {limit} 处，共 {len(shown)} 处。"))
    return out


def to_html(report: dict) -> bytes:
    body = "".join(f"<h{n}>{html.escape(t)}</h{n}>" if n else f"<p>{html.escape(t)}</p>" for n, t in _lines(report, LIMITS["html"]))
    return f'<!doctype html><html lang="zh"><meta charset="utf-8"><title>{report["jobId"]}</title><body>{body}</body></html>'.encode()


def to_markdown(report: dict) -> bytes:
    return "\n\n".join("#" * n + " " * bool(n) + t for n, t in _lines(report, LIMITS["md"])).encode()


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


_TYPES_NS, _RELS_NS = "http://schemas.openxmlformats.org/package/2006/content-types", "http://schemas.openxmlformats.org/package/2006/relationships"
_DOC_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument."


def _clean(text: str) -> str:
    return escape("".join(c for c in text if c in "\t\n" or ord(c) >= 32))


def to_docx(report: dict) -> bytes:
    return document(_lines(report, LIMITS["docx"]))


def document(lines: list[tuple[int, str]]) -> bytes:
    """A Word file of paragraphs: (heading level or 0, text)."""
    paragraphs = []
    for n, t in lines:
        style = f'<w:pPr><w:pStyle w:val="Heading{n}"/></w:pPr>' if n else ""
        paragraphs.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{_clean(t)}</w:t></w:r></w:p>')
    return _archive({
        "[Content_Types].xml": f'<Types xmlns="{_TYPES_NS}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_KIND}wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS_NS}"><Relationship Id="r1" Type="{_DOC_NS}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(paragraphs)}</w:body></w:document>',
    })


def to_xlsx(report: dict) -> bytes:
    """Five sheets."""
    summary, docs = report["summary"] or {}, [d["id"] for d in report["documents"]]
    sim = {(m["doc_a"], m["doc_b"]): m["sim"] for m in report["matrix"]}
    tags = {d["id"]: d["tag"] for d in report["documents"]}
    return workbook({
        "概览": [["项目", "值"], *[[k, v] for k, v in summary.items()]],
        "矩阵": [["", *[tags[d] for d in docs]], *[[tags[a], *[sim.get((min(a, b), max(a, b)), 0.0) for b in docs]] for a in docs]],
        "条款": [HEADER, *_members(report)],
        "冲突": [["组号", "摘要"], *[[c["index"], c["summary"]] for c in report["clusters"] if c["type"] == "conflict"]],
        "逐对": [["文档", "类型", "相似度", "左", "右"], *[[p["tags"], TYPES.get(t["type"], t["type"]), t["score"], t.get("textA", ""), t.get("textB", "")] for p in report["pairs"] for t in p["texts"]]],
    })


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An Excel file of named sheets: numbers as numbers, all else as text."""

    def sheet(rows: list[list]) -> str:
        told = []
        for row in rows:
            cells = [f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{_clean(str(v or ""))}</t></is></c>' for v in row]
            told.append(f"<row>{''.join(cells)}</row>")
        return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(told)}</sheetData></worksheet>'

    n = range(1, len(sheets) + 1)
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_KIND}spreadsheetml.worksheet+xml"/>' for i in n)
    names = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{i}" Type="{_DOC_NS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
    return _archive({
        "[Content_Types].xml": f'<Types xmlns="{_TYPES_NS}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}spreadsheetml.sheet.main+xml"/>{overrides}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS_NS}"><Relationship Id="r1" Type="{_DOC_NS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{_DOC_NS}"><sheets>{names}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELS_NS}">{links}</Relationships>',
        **{f"xl/worksheets/sheet{i}.xml": sheet(rows) for i, rows in enumerate(sheets.values(), 1)},
    })


FORMATS = {"csv": to_csv, "json": to_json, "html": to_html, "md": to_markdown, "docx": to_docx, "xlsx": to_xlsx}


def export(report: dict, kind: str) -> bytes:
    """O10."""
    if kind not in FORMATS:
        raise ExportFailed(f"no format {kind!r}; there are {', '.join(FORMATS)}")
    return FORMATS[kind](report)


def write_results(result: CompareResult, path: str) -> None:
    """The tables of all jobs of a result, replaced job by job; the marker of success is written last.

    A job that is compared again replaces its rows in every table, and its facts.
    """
    spark = result.chunks.sparkSession
    tables = {"edges": result.edges, "clusters": result.clusters, "members": result.members, "facts": result.facts, "deleted": result.deleted}
    for name, table in tables.items():
        if table is not None:
            table.repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{path}/{name}")
    spark.createDataFrame([("complete",)], "state string").coalesce(1).write.mode("overwrite").json(f"{path}/_state")
