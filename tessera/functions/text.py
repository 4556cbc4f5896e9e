"""Text functions as Spark columns: normalization, chunk kinds, tokens, grams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.numerals import rewrite_numbers

# The punctuation class (ASCII, vertical forms U+FE30-FE4F, CJK marks) and half-width forms.
CJK_MARKS = "。，、；：？！“”‘’（）《》〈〉【】〔〕「」『』…—–·￥～〜"
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"
PUNCTUATION = ASCII_PUNCTUATION + r"\x{FE30}-\x{FE4F}" + CJK_MARKS
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HALF_WIDTH = {
    "。": ".", "，": ",", "、": ",", "；": ";", "：": ":", "？": "?", "！": "!", "“": '"', "”": '"', "‘": "'", "’": "'",
    "（": "(", "）": ")", "《": "<", "〈": "<", "「": "<", "『": "<", "【": "<", "〔": "<",
    "》": ">", "〉": ">", "」": ">", "』": ">", "】": ">", "〕": ">", "·": ".", "～": "~", "〜": "~",
}
#: Text that NFKC and the numeral rewrite leave alone: ASCII and Latin letters with marks.
PLAIN = r"^[\x{0}-\x{7F}\x{C0}-\x{17F}&&[^\x{132}\x{133}\x{13F}\x{140}\x{149}\x{17F}]]*$"

# Keywords of the two kinds of section.
BUSINESS_WORDS = [
    "报价", "价格", "费用", "金额", "商务", "资质", "营业执照", "法定代表人", "法人", "投标函", "投标保证金", "财务", "审计",
    "纳税", "社保", "承诺函", "授权委托", "信誉", "业绩", "注册资本", "报价表",
]
TECHNICAL_WORDS = [
    "技术", "方案", "架构", "系统", "设计", "实施", "部署", "接口", "性能", "安全", "数据", "功能", "平台", "集成", "运维",
    "网络", "服务器", "算法", "模块", "容灾",
]


def _python_class(java: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java)


_SPACES = re.compile(f"[{_python_class(SPACE)}]")
_MARKS = re.compile(f"[{_python_class(PUNCTUATION)}]")


def normalize_text(text: str, case: bool = True, punctuation: bool = True, space: bool = True) -> str:
    """N1 for one string: NFKC, numerals, then drop (or unify) blanks and punctuation, then lower case."""
    out = rewrite_numbers(unicodedata.normalize("NFKC", text))
    out = _SPACES.sub("" if space else " ", out)
    out = _MARKS.sub("", out) if punctuation else _MARKS.sub(lambda m: HALF_WIDTH.get(m[0], m[0]), out)
    return "".join(c.lower() for c in out) if case else out


def is_latin(text: Column) -> Column:
    """ASCII and Latin letters with marks only. A class of one range: Java tests unions and intersections some twenty times as long."""
    return ~text.rlike(r"[^\x{0}-\x{17F}]")


def is_plain(text: Column) -> Column:
    """The same as PLAIN."""
    out = is_latin(text) & ~text.rlike(r"[\x{80}-\x{BF}]")
    for c in "\u0132\u0133\u013f\u0140\u0149\u017f":
        out = out & ~text.contains(c)
    return out


def normalized(text: Column, case: bool = True, punctuation: bool = True, space: bool = True) -> Column:
    """Plain Latin text stays in the JVM, other text goes through one Arrow UDF."""

    @F.pandas_udf("string")
    def other(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else normalize_text(t, case, punctuation, space) for t in s], dtype=object)

    return F.coalesce(other(F.when(~is_plain(text), text)), normalized_plain(text, case, punctuation, space))


def normalized_plain(text: Column, case: bool = True, punctuation: bool = True, space: bool = True) -> Column:
    """N1 for text that NFKC leaves alone, without Python."""

    def of(blanks: str, marks: str) -> Column:
        if punctuation and space:
            return F.regexp_replace(text, f"[{blanks}{marks}]+", "")
        out = F.regexp_replace(text, f"[{blanks}]", "" if space else " ")
        return F.regexp_replace(out, f"[{marks}]+", "") if punctuation else out

    out = F.when(is_plain(text), of(r"\s", ASCII_PUNCTUATION)).otherwise(of(SPACE, PUNCTUATION))
    return F.lower(out) if case else out


def exact_hash(text: Column) -> Column:
    """N5."""
    return F.sha2(text, 256)


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def table_row(line: Column) -> Column:
    """C4: 'a | b | c' if the line is a table row, '' if it is a separator row, else null."""
    cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), trimmed)
    filled = F.filter(cells, lambda c: c != "")
    separator = F.forall(filled, lambda c: c.rlike("^[-:]*$"))
    return F.when(line.contains("|") & (F.size(filled) >= 2), F.when(separator, F.lit("")).otherwise(F.array_join(cells, " | ")))


def is_list_line(line: Column) -> Column:
    """C5."""
    return line.rlike(r"^([-*•·]\s|[（(][0-9]{1,3}[)）]|[0-9]{1,3}[.、)）]([^0-9]|$))")


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, else null."""
    return F.when(line.rlike("^#{1,6} "), F.length(F.regexp_extract(line, "^(#+)", 1)))


def section_kind(text: Column, technical: list[str] | None = None, business: list[str] | None = None) -> Column:
    """Which kind has more of its keywords in the text."""

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(text, k)))

    t, b = hits(technical or TECHNICAL_WORDS), hits(business or BUSINESS_WORDS)
    kind = F.when(t > b, "tech").when(b > t, "business").otherwise("other")
    if any(ord(min(w)) < 0x180 for w in (technical or TECHNICAL_WORDS) + (business or BUSINESS_WORDS)):
        return kind
    return F.when(is_latin(text), "other").otherwise(kind)


def detected_language(text: Column) -> Column:
    """Zh if CJK letters are 15 % of letters and digits, or there are none; else en."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"))
    alnum = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return F.when((alnum == 0) | (cjk * 100 >= alnum * 15), "zh").otherwise("en")


def tokens_en(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def tokens_zh(text: Column) -> Column:
    """Without a segmenter: every two neighbouring Han characters, and other words whole."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{IsHan}]+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))

    def parts(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(r"^\p{IsHan}") & (F.length(run) > 2), pairs).otherwise(F.array(run))

    return F.filter(F.flatten(F.transform(runs, parts)), lambda w: F.length(w) >= 2)


def tokens(text: Column, language: str = "auto") -> Column:
    """Tokens of the raw text, case kept."""
    if language == "en":
        return tokens_en(text)
    if language == "zh":
        return tokens_zh(text)
    # Latin text is English or has no letters and digits, so no tokens in either language
    return F.when(is_latin(text) | (detected_language(text) == "en"), tokens_en(text)).otherwise(tokens_zh(text))


def gram_set(text: str) -> set[str]:
    """F2 for one string."""
    return {text[i : i + n] for n in (2, 3) for i in range(len(text) - n + 1)}


def char_grams(text: Column) -> Column:
    """the set of 2-grams and 3-grams, sorted; too short texts have fewer or none.

    One Arrow UDF: as higher-order functions every gram is an interpreted call, and
    the whole takes some twenty times as long.
    """

    @F.pandas_udf("array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else sorted(gram_set(t)) for t in s], dtype=object)

    return of(text)


def gram_count(text: Column) -> Column:
    """The number of grams that ``char_grams`` has."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([0 if t is None else len(gram_set(t)) for t in s])

    return of(text)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def entity_jaccard(a: Column, b: Column) -> Column:
    """F8: null if neither side has an entity."""
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, F.lit(None).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def path_similarity(a: Column, b: Column) -> Column:
    """K2: Dice over the common beginning of two section paths; null if either is empty."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    common = F.aggregate(same, F.lit(0), lambda n, s: F.when(s & (n >= 0), n + 1).otherwise(F.when(n >= 0, -n - 1).otherwise(n)))
    prefix = F.when(common < 0, -common - 1).otherwise(common)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(None).cast("double")).otherwise(2.0 * prefix / (F.size(a) + F.size(b)))


def dense_cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def minhash_similarity(a: Column, b: Column) -> Column:
    """the share of equal slots; 0 if the lengths differ or are 0."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), equal / F.size(a)).otherwise(F.lit(0.0))
