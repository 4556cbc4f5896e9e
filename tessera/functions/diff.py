"""Graded text diff (D1-D5): lists of (op, text), op one of eq, del, ins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHAR_LIMIT, WORD_LIMIT = 60, 400
TYPE = "array<struct<op:string,text:string>>"


def _edits(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A shortest edit script, by the greedy furthest-reaching paths of Myers."""
    n, m = len(a), len(b)
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    head, tail = [("eq", x) for x in a[:start]], [("eq", x) for x in a[n - end :]]
    a, b = a[start : n - end], b[start : m - end]
    n, m = len(a), len(b)
    reach, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append({k: reach[k] for k in range(-d - 1, d + 2) if k in reach})
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= n and x - k >= m:
                return head + _walk_back(a, b, trail, d) + tail
    return head + tail


def _walk_back(a: list[str], b: list[str], trail: list[dict[int, int]], steps: int) -> list[tuple[str, str]]:
    x, y, out = len(a), len(b), []
    for d in range(steps, -1, -1):
        reach, k = trail[d], x - y
        down = k == -d or k != d and reach[k - 1] < reach[k + 1]
        px = reach[k + 1] if down else reach[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > max(px, 0) and y > max(py, 0) and (d == 0 or (x, y) != (px + (not down), py + down)):
            x, y = x - 1, y - 1
            out.append(("eq", a[x]))
        if d:
            if down:
                y -= 1
                out.append(("ins", b[y]))
            else:
                x -= 1
                out.append(("del", a[x]))
    out.reverse()
    return out


def _merged(ops: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for op, text in ops:
        if not text:
            continue
        if out and out[-1][0] == op:
            out[-1][1] += text
        else:
            out.append([op, text])
    return [(op, text) for op, text in out]


def char_diff(a: str, b: str) -> list[tuple[str, str]]:
    """D2."""
    return _merged(_edits(list(a), list(b)))


def word_diff(a: str, b: str) -> list[tuple[str, str]]:
    """D3: over words, single Han characters and single other characters."""
    split = re.compile(r"[^\W\u3400-\u9fff]+|.", re.S).findall
    return _merged(_edits(split(a), split(b)))


def sentence_diff(a: str, b: str) -> list[tuple[str, str]]:
    """A run of deleted sentences next to a run of inserted ones is compared by characters."""
    split = re.compile(r"[^。！？；;\n]*[。！？；;\n]|[^。！？；;\n]+").findall
    runs = _merged(_edits(split(a), split(b)))
    out, i = [], 0
    while i < len(runs):
        if runs[i][0] == "del" and i + 1 < len(runs) and runs[i + 1][0] == "ins":
            out += char_diff(runs[i][1], runs[i + 1][1])
            i += 2
        else:
            out.append(runs[i])
            i += 1
    return _merged(out)


def table_row_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Column by column; columns of one side only are inserted or deleted with their separator."""
    left, right, out = a.split(" | "), b.split(" | "), []
    for i in range(max(len(left), len(right))):
        op = "eq" if i < min(len(left), len(right)) else "del" if i < len(left) else "ins"
        if i:
            out.append((op, " | "))
        out += char_diff(left[i], right[i]) if op == "eq" else [(op, (left if op == "del" else right)[i])]
    return _merged(out)


def graded_diff(a: str, b: str, rows: bool = False) -> list[tuple[str, str]]:
    """By characters up to 60, by words up to 400, else by sentences; table rows by column."""
    if rows:
        return table_row_diff(a, b)
    n = max(len(a), len(b))
    return (char_diff if n <= CHAR_LIMIT else word_diff if n <= WORD_LIMIT else sentence_diff)(a, b)


def diff_column(a: Column, b: Column, rows: Column) -> Column:
    @F.pandas_udf(TYPE)
    def of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys, rs in batches:
            yield pd.Series([[{"op": o, "text": t} for o, t in graded_diff(x or "", y or "", bool(r))] for x, y, r in zip(xs, ys, rs, strict=True)], dtype=object)

    return of(a, b, rows)
