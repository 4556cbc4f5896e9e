"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits. Split into k + 1 pieces,
at least one piece is then there unchanged. All pieces of all items are searched
at once by an automaton; around each hit the item is compared with the document's
characters by Myers' bit-parallel approximate matching.

Items too short for an edit are searched exactly, between word boundaries.

The items are a small table: their texts go to the tasks as one broadcast while
they have at most ``max_chars`` characters; more are dealt by hash into passes of
about that size over the documents, and the driver holds one pass at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

#: One edit for each so many characters of an item; pieces are then about as long.
CHARS_PER_EDIT = 20
#: Characters of the items of one pass: their automaton takes some 50 bytes each in every task.
MAX_CHARS = 2_000_000
MATCH = "item_id:long,distance:int,edits:int,start:int,stop:int"


def normalize(text: str | None) -> str:
    """Lower case, each run of white space one blank."""
    return " ".join((text or "").lower().split())


def budget(n: int) -> int:
    """Edits allowed in an item of n characters."""
    return n // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 nearly equal pieces."""
    k = budget(len(item)) + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, limit: int, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of the text, and the first end with it.

    Bit-parallel: the columns of the dynamic programme are two integers of one bit
    per pattern character. Above ``limit`` the result is (limit + 1, -1).
    """
    m = len(pattern)
    if masks is None:
        masks = pattern_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = (m, 0) if m <= limit else (limit + 1, -1)
    for i, ch in enumerate(text):
        eq = masks.get(ch, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        straight = eq | down
        up = minus | (full & ~(straight | plus))
        down = plus & straight
        if score < best:
            best, end = score, i + 1
    return best, end


def pattern_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def _bounded(text: str, start: int, stop: int) -> bool:
    """Whether neither end of the stretch is inside a word."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not left and not (stop < len(text) and text[stop].isalnum() and text[stop - 1].isalnum())


class Matcher:
    """Finds a set of (id, normalized item) in texts. Empty items are nowhere."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = [i for i in items if i[1]]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item):
                found.setdefault(piece, []).append((i, offset))
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, edits allowed, start, stop) of the best match of each item, in the normalized text.

        Hits of one item on one diagonal, give or take its edits, are one candidate;
        the window around it is as long as the item and twice its edits.
        """
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for end, (length, at) in self.automaton.iter(text):
            for i, offset in at:
                start = end + 1 - length - offset
                k = budget(len(self.items[i][1]))
                if not k:
                    if i not in exact and _bounded(text, start, end + 1):
                        exact[i] = start
                    continue
                spans = windows.setdefault(i, [])
                if spans and start - k <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + k)
                    spans[-1][0] = min(spans[-1][0], start - k)
                else:
                    spans.append([start - k, start + k])
        out = [(self.items[i][0], 0, 0, start, start + len(self.items[i][1])) for i, start in sorted(exact.items())]
        for i, spans in sorted(windows.items()):
            ident, item = self.items[i]
            k = budget(len(item))
            masks = self.masks.setdefault(i, pattern_masks(item))
            best = (k + 1, -1)
            for low, high in spans:
                low = max(0, low)
                got, end = myers(item, text[low : high + len(item) + k], k, masks)
                if got < best[0]:
                    best = (got, low + end)
                    if not got:
                        break
            if best[0] <= k:
                back, length = myers(item[::-1], text[max(0, best[1] - len(item) - k) : best[1]][::-1], k)
                out.append((ident, best[0], k, best[1] - length, best[1]))
        return out


def _known(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's distinct items, normalized, in passes of about ``max_chars`` characters."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // max_chars))
    for i in range(n):
        alike = F.lower(F.regexp_replace("text", r"(?U)\s+", ""))  # the same for texts with one normalized form
        part = known.filter(F.pmod(F.xxhash64("item_id", alike), F.lit(n)) == i).distinct()
        items = {(r[0], normalize(r[1])) for r in part.toLocalIterator()}
        if items:
            yield sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _matches(items: Broadcast) -> Callable:
    @F.pandas_udf(f"array<struct<{MATCH}>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "edits", "start", "stop"), m, strict=True)) for m in matcher.find(normalize(t))] for t in texts])

    return of


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per document row and benchmark item that it holds: id, item_id, distance, edits, start, stop.

    start and stop count characters of the normalized text. Null and empty items and
    null texts match nothing. Items of fewer than CHARS_PER_EDIT normalized characters
    match exactly and not inside a word. Items with equal texts each match; an item
    with a null id has a null item_id. Repeated rows and null ids of documents are
    matched one by one. Without items the result is empty.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"))
    out = docs.select(F.col("_id").alias(id_col), F.lit(None).cast(f"struct<{MATCH}>").alias("m")).filter("false").select(id_col, "m.*")
    for items in _known(benchmark, max_chars):
        of = _matches(docs.sparkSession.sparkContext.broadcast(items))
        out = out.union(docs.select("_id", F.explode(of("_text")).alias("m")).select(F.col("_id").alias(id_col), "m.*"))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay.

    Each row is judged by its own text, so nothing is shuffled and null or repeated
    ids do not matter.
    """
    bounded_batches(docs.sparkSession)
    for items in _known(benchmark, max_chars):
        of = _matches(docs.sparkSession.sparkContext.broadcast(items))
        docs = docs.filter(F.size(of("text")) == 0)
    return docs
