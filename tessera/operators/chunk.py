"""Chunking (C1-C7, C11): three levels for any block list, and a native path for flat text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.config import ParserConfig
from tessera.functions import entities as E
from tessera.functions import text as X
from tessera.schemas import RAW_CHUNK

SECTION_LIMIT = 6000
TEMPLATE_COSINE = 0.7
#: Ids of chunks: document id times this plus the order in the document.
ID_STEP = 1_000_000

# Texts of usual boilerplate clauses.
SEED_TEMPLATES = {
    "t-law": "根据《中华人民共和国招标投标法》及其实施条例，以及《中华人民共和国政府采购法》的相关规定，本项目严格遵循公开、公平、公正和诚实信用的原则组织实施。",
    "t-qual": "投标人具备独立法人资格，持有有效的营业执照、税务登记证及与本项目相适应的行业资质证书与质量管理体系认证，所有证照均在有效期内。",
    "t-after": "我方承诺提供 7×24 小时技术支持服务，质保期内免费维护，接到故障报修后及时响应并在约定时限内解决，确保系统稳定运行。",
}

_LIST = re.compile(r"[-*•·]\s|[（(][0-9]{1,3}[)）]|[0-9]{1,3}[.、)）](?![0-9])")
_BAR = re.compile(r"\s*\|\s*")
_HEADING = re.compile(r"(#{1,6}) (.*)", re.S)
_SENTENCE_END = re.compile("[。！？；;]")


def plain_row(line: str) -> str | None:
    """The row that a line of text stands for: joined cells, '' for a separator, None for no row."""
    if "|" not in line:
        return None
    cells = _BAR.split(line.strip().strip("|").strip())
    if sum(map(bool, cells)) < 2:
        return None
    rule = not "".join(cells).strip("-:")  # dashes and colons alone
    return "" if rule else " | ".join(cells)


class _Chunker:
    """State while one document's blocks pass: open headings, the section so far, and an order per level."""

    def __init__(self, options: ParserConfig):
        self.options, self.out = options, []
        self.order = {"section": 0, "paragraph": 0, "sentence": 0}
        self.headings: list[tuple[int, str]] = []
        self.section: list[str] = []
        self.section_chars, self.section_page = 0, None

    def emit(self, kind: str, level: str, text: str, page: int | None) -> None:
        path = [title for _, title in self.headings]
        self.out.append((kind, level, path, text, page if self.options.preserve_page_number else None, self.order[level]))
        self.order[level] += 1

    def grow(self, text: str, page: int | None) -> None:
        self.section.append(text + "\n")
        self.section_chars += len(text) + 1
        self.section_page = page if self.section_page is None else self.section_page

    def end_section(self) -> None:
        text = "".join(self.section).strip()
        page = self.section_page
        self.section, self.section_chars, self.section_page = [], 0, None
        if len(text) >= self.options.min_paragraph_length:
            self.emit("section", "section", text, page)

    def heading(self, level: int, title: str, page: int | None) -> None:
        self.end_section()
        self.headings = [h for h in self.headings if h[0] < level] + [(level, title)]
        if len(title) >= 2:
            self.emit("heading", "paragraph", title, page)
        self.grow(title, page)

    def body(self, kind: str, text: str, page: int | None) -> None:
        if not text:
            return
        self.grow(text, page)
        if self.section_chars > SECTION_LIMIT:
            self.end_section()
        least = self.options.min_paragraph_length
        if len(text) >= least:
            self.emit(kind, "paragraph", text, page)
            if kind == "table_row":
                self.emit(kind, "sentence", text, page)
        if kind != "table_row":
            for part in map(str.strip, _SENTENCE_END.split(text)):
                if len(part) >= least:
                    self.emit("sentence", "sentence", part, page)

    def line(self, line: str, page: int | None) -> None:
        row = plain_row(line) if self.options.detect_table else None
        if m := _HEADING.fullmatch(line):
            self.heading(len(m[1]), m[2].strip(), page)
        elif row is not None:
            self.body("table_row", row, page)
        else:
            self.body("list_item" if _LIST.match(line) else "paragraph", line, page)

    def block(self, b: dict) -> None:
        page = b.get("page")
        if b.get("heading_level"):
            self.heading(int(b["heading_level"]), b["text"].strip(), page)
        elif b.get("is_table_row"):
            self.body("table_row" if self.options.detect_table else "paragraph", b["text"], page)
        elif b.get("is_list_item"):
            self.body("list_item", b["text"].strip(), page)
        else:
            for line in map(str.strip, b["text"].splitlines()):
                if line:
                    self.line(line, page)


def chunk_blocks(blocks: list[dict], options: ParserConfig | None = None) -> list[tuple]:
    """Chunks (type, level, section path, text, page, order) of one document's blocks."""
    chunker = _Chunker(options or ParserConfig())
    for b in blocks:
        chunker.block(b)
    chunker.end_section()
    return chunker.out


def chunk_documents(docs: DataFrame, options: ParserConfig | None = None) -> DataFrame:
    """``docs(doc_id, blocks array<struct>)`` to raw chunks of all levels; the outline needs a document in order."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, blocks in zip(pdf["doc_id"], pdf["blocks"], strict=True):
                clean = [{k: None if v is None or v != v else v for k, v in b.items()} for b in (blocks if blocks is not None else [])]
                rows = pd.DataFrame(chunk_blocks(clean, options), columns=["chunk_type", "chunk_level", "section_path", "text", "page", "order_index"])
                rows["page"] = pd.array(rows["page"], dtype="Int32")
                rows.insert(0, "doc_id", doc)
                yield rows

    return docs.select("doc_id", "blocks").mapInPandas(of, f"doc_id long, {RAW_CHUNK}")


def text_blocks(text: Column) -> Column:
    """A plain text as its single block."""
    block = F.struct(
        F.lit(0).alias("block_idx"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("int").alias("heading_level"),
        F.lit(None).cast("int").alias("page"), F.lit(False).alias("is_table_row"), F.lit(False).alias("is_list_item"),
    )
    return F.array(block)


def flat_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to its trimmed non-empty lines: doc_id, line_no, line, row (C4)."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select("doc_id", "line_no", X.trimmed(F.col("line")).alias("line")).filter("line != ''")
    return lines.withColumn("row", X.table_row(F.col("line")))


def paragraph_chunks(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Paragraph chunks of texts without headings, in the JVM: the columns of ``docs`` but text, then doc_rows, order_index, chunk_type, text, cid.

    A document's lines are an array of its row, so their order and number need
    neither a window nor a shuffle. The outer explode keeps the optimizer from
    inferring filters on the array, which split every text twice more.
    """
    others = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.transform(F.split("text", "\n"), X.trimmed), lambda line: line != "")
    rows = F.transform(lines, lambda line: F.struct(line.alias("line"), X.table_row(line).alias("row")))

    def part(p: Column) -> Column:
        kind = F.when(p["row"].isNotNull(), "table_row").when(X.is_list_line(p["line"]), "list_item").otherwise("paragraph")
        return F.struct(kind.alias("chunk_type"), F.coalesce(p["row"], p["line"]).alias("text"))

    parts = docs.select(*others, F.filter(F.transform(rows, part), lambda p: F.length(p["text"]) >= min_chars).alias("parts"))
    # counted below the explode, whose rows would else each carry all lines of their document
    parts = parts.withColumn("doc_rows", F.size("parts"))
    out = parts.select(*others, "doc_rows", F.posexplode_outer("parts").alias("order_index", "part")).filter("order_index is not null")
    return out.select(*others, "doc_rows", "order_index", "part.*", (F.col("doc_id") * ID_STEP + F.col("order_index")).alias("cid"))


def with_features(chunks: DataFrame, language: str = "auto", case: bool = True, punctuation: bool = True, space: bool = True) -> DataFrame:
    """Add normalized, hashes, tokens, entities, section_kind, char_count; section_path stays or is empty."""
    text = F.col("text")
    out = chunks.withColumn("normalized", X.normalized(text, case, punctuation, space))
    out = out.withColumns({
        "char_count": F.length(text), "exact_hash": X.exact_hash(text), "normalized_hash": X.exact_hash(F.col("normalized")),
        "tokens": X.tokens(text, language), "entities": E.entities(F.col("normalized")), "section_kind": X.section_kind(text),
    })
    return out if "section_path" in out.columns else out.withColumn("section_path", F.array().cast("array<string>"))


def with_rel_pos(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """C11: order_index / (rows - 1) among the document's rows; 0 if it has one. ``doc_rows`` has the number if it is there."""
    n = F.col("doc_rows") if "doc_rows" in chunks.columns else F.count("*").over(Window.partitionBy(*keys))
    return chunks.withColumn("rel_pos", F.when(n > 1, F.col("order_index") / (n - 1)).otherwise(F.lit(0.0)))


def template_scores(chunks: DataFrame, templates: DataFrame, least: float = TEMPLATE_COSINE) -> DataFrame:
    """Pairs of ``chunks(key, tokens)`` and ``templates(template_id, tokens)`` with a cosine of ``least`` (above 0): key, template_id, cosine.

    Tokens are in one order, those of few templates first. Two vectors with that
    cosine have in common a token from which on to the end both have at least
    ``least`` of their length; only such tokens are joined, so common words make no
    pairs. The cosine is then taken of the pairs found.
    """

    def counted(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))

    a, b = counted(chunks, "key"), counted(templates, "template_id")
    order = b.groupBy("token").agg(F.count("*").alias("df"))

    def profile(long: DataFrame, key: str) -> DataFrame:
        """One row per vector: its norm, its known tokens with counts, and those that may be the first in common."""
        known = F.filter(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "n"))), lambda x: x["df"] > 0)
        rows = long.join(order, "token", "left").groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), known.alias("known"))
        squares = F.transform("known", lambda x: x["n"] * x["n"])
        at = F.sequence(F.lit(1), F.size("known"))
        tails = F.transform(at, lambda i: F.aggregate(F.slice(squares, i, F.size("known")), F.lit(0).cast("long"), lambda z, x: z + x))
        enough = F.lit(least * least * (1 - 1e-9)) * F.col("norm") * F.col("norm")
        first = F.slice("known", F.lit(1), F.size(F.filter(tails, lambda t: t >= enough)))
        return rows.filter(F.size("known") > 0).select(key, "norm", "known", F.transform(first, lambda x: x["token"]).alias("first"))

    x, y = profile(a, "key"), profile(b, "template_id")
    found = x.select("key", F.explode("first").alias("token")).join(y.select("template_id", F.explode("first").alias("token")), "token").select("key", "template_id").distinct()
    counts = F.map_from_entries(F.transform("known", lambda x: F.struct(x["token"], x["n"])))
    pairs = found.join(x.select("key", F.col("norm").alias("norm_a"), counts.alias("counts")), "key").join(y.select("template_id", F.col("norm").alias("norm_b"), "known"), "template_id")
    dot = F.aggregate("known", F.lit(0).cast("long"), lambda z, t: z + t["n"] * F.coalesce(F.element_at("counts", t["token"]), F.lit(0)))
    return pairs.select("key", "template_id", (dot / (F.col("norm_a") * F.col("norm_b"))).alias("cosine")).filter(F.col("cosine") >= least)


def with_template_flag(chunks: DataFrame, templates: DataFrame, key: str = "cid") -> DataFrame:
    """Add is_template: the cosine with any template is at least TEMPLATE_COSINE."""
    flagged = template_scores(chunks.select(F.col(key).alias("key"), "tokens"), templates)
    flagged = flagged.select(F.col("key").alias("_key"), F.lit(True).alias("_flag")).distinct()
    out = chunks.join(flagged, chunks[key] == flagged["_key"], "left")
    return out.withColumn("is_template", F.coalesce("_flag", F.lit(False))).drop("_key", "_flag")
