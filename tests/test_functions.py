"""Text functions: numerals, normalization, chunk kinds, entities, diff, minhash, columns against strings."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import diff as D
from tessera.functions import entities as E
from tessera.functions import minhash as M
from tessera.functions import text as X
from tessera.functions.numerals import rewrite_numbers, to_number
from tessera.operators.chunk import chunk_blocks, plain_row
from tessera.sources.parse import block


@pytest.mark.parametrize(("text", "value"), [("一万二", 12000), ("一百八", 180), ("一百零八", 108), ("十", 10), ("二十三", 23), ("三千五百万", 35_000_000), ("一亿二千万", 120_000_000), ("两百", 200), ("零", 0), ("a", None), ("", None)])
def test_numerals(text, value):
    assert to_number(text) == value


@pytest.mark.parametrize(("text", "out"), [("百分之三十", "30%"), ("一百八十个日历日", "180个日历日"), ("5万元", "50000元"), ("五万元", "50000元"), ("二〇二六年", "2026年"), ("五年", "5年"), ("统一", "统一"), ("十个亿", "十个亿"), ("12.5万元", "125000元"), ("0.00001万元", "0.00001万元")])
def test_rewrite(text, out):
    assert rewrite_numbers(text) == out


def test_columns_agree_with_strings(spark):
    texts = ["Abc, d|e. 1-2", "１２３ＡＢＣ。五万元", "Éàü – x", "", "ﬁ ½", "甲方 应在 十日 内（付款）", "a　b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for case in (True, False):
        got = [r[0] for r in df.select(X.normalized(F.col("text"), case=case)).collect()]
        assert got == [X.normalize_text(t, case) for t in texts]
    lines = ["| a | b |", "a | b", "|---|:--|", "a |", "x", "- item", "1. item", "3.5 no", "（2）yes", "12345. no"]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    got = df.select(X.table_row(F.col("line")), X.is_list_line(F.col("line"))).collect()
    assert [r[0] for r in got] == [plain_row(t) for t in lines]
    assert [r[1] for r in got] == [False] * 5 + [True, True, False, True, False]


def test_tokens_language_and_sets(spark):
    df = spark.createDataFrame([("Hello a wide_World 42", ["a", "b"], ["b", "c"], [1.0, 0.0], [1.0, 1.0])], "t string, x array<string>, y array<string>, u array<double>, v array<double>")
    r = df.select(
        X.tokens(F.col("t")), X.detected_language(F.lit("中文abc")), X.detected_language(F.lit("...")), X.jaccard(F.col("x"), F.col("y")), X.dense_cosine(F.col("u"), F.col("v")),
        X.path_similarity(F.col("x"), F.array(F.lit("a"), F.lit("z"), F.lit("b"))), X.tokens(F.lit("投标文件abc")), X.char_grams(F.lit("abc")), X.char_grams(F.lit("a")),
    ).first()
    assert r[0] == ["Hello", "wide", "World", "42"] and r[1] == "zh" and r[2] == "zh"
    assert r[3] == pytest.approx(1 / 3) and r[4] == pytest.approx(0.5**0.5) and r[5] == pytest.approx(2 / 5)
    assert r[6] == ["投标", "标文", "文件", "abc"]
    assert sorted(r[7]) == ["ab", "abc", "bc"] and r[8] == []


def test_entities_by_precedence():
    told = [(e["kind"], e["value"]) for e in E.find_entities("2026年9月付50000 元，10%，30天，2026-01-02")]
    assert told == [("date", "2026年9月"), ("date", "2026-01-02"), ("amount", "50000元"), ("percentage", "10%"), ("duration", "30天")]


@given(st.text("ab| 。x\n", max_size=60), st.text("ab| 。x\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_diffs_rebuild_both_sides(a, b):
    for f in (D.char_diff, D.word_diff, D.sentence_diff, D.table_row_diff, D.graded_diff):
        ops = f(a, b)
        assert "".join(t for o, t in ops if o != "ins") == a
        assert "".join(t for o, t in ops if o != "del") == b
        assert all(x[0] != y[0] for x, y in zip(ops, ops[1:], strict=False))


def test_minhash_estimates_jaccard():
    a, b = [f"g{i}" for i in range(300)], [f"g{i}" for i in range(100, 400)]
    assert abs(np.mean(M.signature(a) == M.signature(b)) - 0.5) < 0.15
    assert (M.signature([]) == np.uint64(2**64 - 1)).all()


def test_outline_sections_and_options():
    text = "# Part one\nThis is the first paragraph。And a second sentence！\n## Inner\n- a list item of length\n| a cell | b cell |\n|---|---|\nshort"
    out = chunk_blocks([block(text)])
    kinds = [(c[0], c[1], c[2]) for c in out]
    assert ("heading", "paragraph", ["Part one"]) in kinds and ("list_item", "paragraph", ["Part one", "Inner"]) in kinds
    assert [c[0] for c in out if c[1] == "sentence"] == ["sentence", "sentence", "sentence", "table_row"]
    assert [c[2] for c in out if c[1] == "section"] == [["Part one"], ["Part one", "Inner"]]
    for level in ("paragraph", "sentence", "section"):
        assert [c[5] for c in out if c[1] == level] == list(range(sum(c[1] == level for c in out)))
