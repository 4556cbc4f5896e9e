"""Main text of web pages, with site templates found by counting element subtrees per host.

Every page is parsed into a tree. A subtree's hash covers its tag, class, text
and children. Spark counts, per host, in how many different pages each hash
occurs; subtrees that recur across many pages of their host are the site's
template and are cut out of its pages. A place (the tags and classes from the root
down) whose subtrees mostly are ones that the host repeats is a template place, as
of a rotating advert: what stands there is cut, however seldom it occurs itself.

What counting cannot tell, as on a host of few pages, HTML names: navigation,
scripts, forms, usual class words of adverts and comments, and the article.

Prose elements inside an ``article`` are never cut for recurring: a passage or a
whole article that many pages share is text. Copies of a page count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, checkpointed

# Names of the HTML standard and usual class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr caption ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr caption figcaption b i em strong a span br code sub sup u s q cite small abbr mark".split())
NO_CONTENT = frozenset(
    "script style noscript template head title nav footer aside form button input select textarea iframe svg canvas object "
    "embed video audio map dialog menu datalist search".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments disqus respond reply replies share sharing social related recommended "
    "recommendations widget toolbar pagination pager skip".split()
)
COMMENT_CLASSES = frozenset("comment comments comment-body comment-list".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr div section article main body html aside nav header footer form blockquote td th select menu".split())


class Node:
    """An element: its tag, words of class and id, and children (nodes and strings)."""

    __slots__ = ("attrs", "children", "key", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.key = tag, attrs, [], 0


class _Tree(HTMLParser):
    """A tolerant tree: unclosed and wrongly nested tags end where HTML says, or with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _close(self, tags: frozenset[str], scopes: frozenset[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                del self.open[at:]
                return
            if tag in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in BLOCK:
            self._close(frozenset(["p"]), SCOPES)
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES - CLOSED_BY[tag] - {"td", "th"} if tag == "tr" else SCOPES - CLOSED_BY[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if tag not in BLOCK and self.open[at].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # what HTML makes of <![...; the inherited one refuses unknown names


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    if re.match(r"<[a-zA-Z/!?]", tree.rawdata):
        tree.rawdata = ""  # a tag or comment that the page's end cuts off
    tree.close()
    return tree.root


def _walk(root: Node) -> list[tuple[Node, bool]]:
    """All elements under ``root``, parents first, each with whether an article holds it."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        out.append((node, inside))
        within = inside or node.tag == "article"
        todo.extend((c, within) for c in reversed(node.children) if isinstance(c, Node))
    return out


def _has(node: Node, tag: str) -> bool:
    return any(n.tag == tag for n, _ in _walk(node))


def is_no_content(node: Node, in_article: bool) -> bool:
    """Whether the element's own name, role or class says that it is not the article."""
    tag, attrs = node.tag, node.attrs
    if tag in NO_CONTENT:
        return True
    if tag in ("html", "body", "main"):
        return False
    classes = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if tag == "article":
        return any(c in COMMENT_CLASSES for c in classes)
    if tag == "header" and not in_article:
        return True
    if attrs.get("role", "").lower() in NO_CONTENT_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "").lower()):
        return True
    words = {w for c in classes for w in re.split(r"[-_]+", c)}
    if words & NO_CONTENT_WORDS:
        return True
    return "header" in words and not in_article and not _has(node, "h1")


def _hash(node: Node) -> None:
    """Give the element and all below it their subtree hashes; children before parents."""
    if node.key:
        return
    for n, _ in reversed(_walk(node)):
        parts = [n.tag, n.attrs.get("class", "")]
        parts += [" ".join(c.split()) if isinstance(c, str) else f"\x01{c.key:x}" for c in n.children]
        n.key = xxhash.xxh64_intdigest("\x00".join(p for p in parts if p).encode("utf-8", "surrogatepass"))


def _candidates(root: Node) -> list[Node]:
    """Elements that may be template, with their hashes: all but prose in an article, and what holds an article."""
    nodes, holds = _walk(root), set()
    for node, _ in reversed(nodes):
        if node.tag in ("html", "body", "main", "article") or any(id(c) in holds for c in node.children if isinstance(c, Node)):
            holds.add(id(node))
    found = [n for n, inside in nodes if id(n) not in holds and n.tag not in VOID and not (inside and n.tag in PROSE)]
    for node in found:
        _hash(node)
    return found


def _host_key(host: str, key: int) -> int:
    return xxhash.xxh64_intdigest(f"{key:x}\x00{host}".encode("utf-8", "surrogatepass"))


def _places(root: Node) -> dict[int, int]:
    """The hash of the tags and classes from the root down, of each element (by its id()) that is outside of articles and no prose."""
    out, todo = {}, [(root, 0)]
    while todo:
        node, above = todo.pop()
        for c in node.children:
            if isinstance(c, Node) and c.tag not in ("article", "main") and c.tag not in PROSE:
                out[id(c)] = xxhash.xxh64_intdigest(f"{above:x} {c.tag} {c.attrs.get('class', '')}".encode("utf-8", "surrogatepass"))
                todo.append((c, out[id(c)]))
    return out


def subtree_keys(html: str | None, host: str) -> list[int]:
    """Keys, each once, of the page's subtrees that may be template."""
    return sorted({key for key, _ in _page_keys(html, host)[1]})


def _page_keys(html: str | None, host: str) -> tuple[int, list[tuple[int, int]]]:
    """(hash of the page's content, (subtree key, place key or 0)). The content is the text of its articles, else the whole page."""
    root = parse(html)
    found = [n for n, inside in _walk(root) if n.tag == "article" and not inside]
    texts = [" ".join(" ".join(c for n, _ in _walk(a) for c in n.children if isinstance(c, str)).split()) for a in found]
    content = "\x00".join(texts) if texts else html or ""
    places = _places(root)
    keys = {(_host_key(host, n.key), _host_key(host, places[id(n)]) if id(n) in places else 0) for n in _candidates(root)}
    return xxhash.xxh64_intdigest(content.encode("utf-8", "surrogatepass")), sorted(keys)


class _Text:
    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.now: list[str] = []

    def end(self) -> None:
        if self.now:
            text = " ".join("".join(self.now).split())
            if text:
                self.blocks.append(text)
            self.now = []


def _render(root: Node, cut: set[int], inside: bool) -> list[str]:
    """Blocks under ``root``; an explicit stack, for trees deeper than Python's."""
    text = _Text()
    todo: list = [(root, inside)]
    while todo:
        item, within = todo.pop()
        if item is None:
            text.end()
        elif isinstance(item, str):
            text.now.append(item)
        elif id(item) in cut or item is not root and is_no_content(item, within):
            if item.tag in BLOCK:
                text.end()
        else:
            if item.tag in ("br", "td", "th"):
                text.now.append(" ")
            if item.tag in BLOCK:
                text.end()
                todo.append((None, within))
            deeper = within or item.tag == "article"
            todo.extend((c, deeper) for c in reversed(item.children))
    text.end()
    return text.blocks


def template_elements(root: Node, host: str, template: frozenset[int] | set[int]) -> set[int]:
    """The id() of each element of the page that counting found to be template."""
    if not template:
        return set()
    places = _places(root)
    return {id(n) for n in _candidates(root) if _host_key(host, n.key) in template or id(n) in places and _host_key(host, places[id(n)]) in template}


def extract(html: str | None, host: str = "", template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text, without the subtrees whose own or whose place's keys are in ``template``."""
    if not html:
        return ""
    root = parse(html)
    cut = template_elements(root, host, template)
    roots, todo = {"article": [], "main": []}, [(root, False, False)]
    while todo:
        node, inside, within = todo.pop()
        if id(node) in cut or node is not root and is_no_content(node, inside):
            continue
        kind = "article" if node.tag == "article" else "main" if node.tag == "main" or node.attrs.get("role") == "main" else ""
        if kind == "article" and not inside or kind == "main" and not within:
            roots[kind].append(node)
        todo.extend((c, inside or kind == "article", within or kind == "main") for c in reversed(node.children) if isinstance(c, Node))
    chosen = roots["article"] or roots["main"] or [root]
    return "\n\n".join(b for r in chosen for b in _render(r, cut, r.tag == "article"))


# ------------------------------------------------------------------------ Spark
def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; null or without: empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` to one row per page and candidate subtree: host, sig (of the whole page), content (of its text), key, place; and one per page with the key null."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                told = [_page_keys(h, host) for h, host in zip(part["html"], part["host"], strict=True)]
                sigs = [xxhash.xxh64_intdigest((h or "").encode("utf-8", "surrogatepass")) for h in part["html"]]
                n = [len(keys) + 1 for _, keys in told]
                found = [k for _, keys in told for k in ((0, 0), *keys)]
                key, place = (np.array([k[i] for k in found], dtype=np.uint64).view(np.int64) for i in (0, 1))
                yield pd.DataFrame({
                    "host": np.repeat(part["host"].to_numpy(dtype=object), n),
                    "sig": np.repeat(np.array(sigs, dtype=np.uint64).view(np.int64), n),
                    "content": np.repeat(np.array([c for c, _ in told], dtype=np.uint64).view(np.int64), n),
                    "key": pd.arrays.IntegerArray(key, key == 0),
                    "place": pd.arrays.IntegerArray(place, place == 0),
                })

    return pages.select("host", "html").mapInPandas(of, "host string, sig long, content long, key long, place long")


def site_templates(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, place_pages: int = 20, place_share: float = 0.5) -> DataFrame:
    """Keys of a site's template: of recurring subtrees, and of the places of such.

    A subtree is template if it is in at least ``min_pages`` pages of different
    content and ``min_share`` of all such of its host. A place is if it is in at
    least ``place_pages`` of them and its subtrees are ones that another page has
    too in at least ``place_share``. Pages with the same article count once, however
    their surroundings differ.
    """
    seen = page_subtrees(pages).select("host", "content", "key", "place").distinct()
    counts = checkpointed(seen.groupBy("host", "key", "place").agg(F.count("*").alias("n")))
    subtrees = counts.filter("key is not null").groupBy("host", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    hosts = counts.filter("key is null").select("host", F.col("n").alias("pages"))
    often = subtrees.join(hosts, "host").filter(F.col("n") >= F.col("pages") * min_share).select("key")
    places = counts.filter("place is not null").groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"))
    return often.union(places.filter((F.col("n") >= place_pages) & (F.col("shared") >= F.col("n") * place_share)).select("place"))


def extract_main_text(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Add ``text`` to ``pages(page_id, url, html, ...)``.

    Null or empty html gives an empty text, and any other html a tree; pages without
    a host share the empty host; repeated rows stay. The template keys go to the tasks as one
    sorted array of 8 bytes each while there are at most ``broadcast_keys``; beyond
    that each page gets its own keys by a join.
    """
    bounded_batches(pages.sparkSession)
    spark = pages.sparkSession
    work = pages.withColumn("_host", host_of(F.col("url")))
    found = site_templates(work.select(F.col("_host").alias("host"), "html"), min_pages, min_share).distinct()
    head = [r[0] for r in found.limit(broadcast_keys + 1).collect()]
    if len(head) <= broadcast_keys:
        shared = spark.sparkContext.broadcast(np.sort(np.array(head, dtype=np.int64)))

        @F.pandas_udf("string")
        def whole(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            template = frozenset(shared.value.view(np.uint64).tolist())
            for htmls, hosts in batches:
                yield pd.Series([extract(h, host, template) for h, host in zip(htmls, hosts, strict=True)], dtype=object)

        return work.withColumn("text", whole("html", "_host")).drop("_host")

    @F.pandas_udf("string")
    def each(htmls: pd.Series, hosts: pd.Series, keys: pd.Series) -> pd.Series:
        own = [frozenset(np.asarray(k, dtype=np.int64).view(np.uint64).tolist()) if k is not None else frozenset() for k in keys]
        return pd.Series([extract(h, host, k) for h, host, k in zip(htmls, hosts, own, strict=True)], dtype=object)

    of_page = page_subtrees(work.select(F.col("_host").alias("host"), "html")).select("host", "sig", F.explode(F.array("key", "place")).alias("key"))
    pairs = of_page.distinct().join(found, "key")
    keys = pairs.groupBy(F.col("host").alias("_h"), F.col("sig").alias("_s")).agg(F.collect_set("key").alias("_keys"))

    @F.pandas_udf("long")
    def sig_of(htmls: pd.Series) -> pd.Series:
        return pd.Series(np.array([xxhash.xxh64_intdigest((h or "").encode("utf-8", "surrogatepass")) for h in htmls], dtype=np.uint64).view(np.int64))

    work = work.withColumn("_sig", sig_of("html"))
    out = work.join(keys, (work["_host"] == keys["_h"]) & (work["_sig"] == keys["_s"]), "left")
    return out.withColumn("text", each("html", "_host", "_keys")).drop("_host", "_sig", "_h", "_s", "_keys")
