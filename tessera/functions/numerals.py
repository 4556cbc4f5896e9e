"""Chinese numerals in text (N2, N3). Pure Python; used inside the normalization UDF."""

from __future__ import annotations

import re

# Digits, multipliers and the units that may follow a number, longest first.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL = {"十": 10, "百": 100, "千": 1000}
UNITS = ["日历日", "工作日", "个月", "万元", "小时", "分钟", "日", "天", "月", "年", "元", "个", "周", "次", "期", "项", "条", "款", "名", "家", "%", "％"]
U64 = 2**64

_UNIT = "|".join(map(re.escape, UNITS))
_NUMBER = "[零一二三四五六七八九十百千万亿两]+"
_SPELLED = "[零〇一二三四五六七八九]{2,}"
_RUN = re.compile("([零一二三四五六七八九两]+)([十百千]?)|()([十百千])")
_NUMERAL = re.compile("(?=.*[零一二三四五六七八九两十])[零一二三四五六七八九两十百千万亿]+")
# the alternatives in order of precedence at one place; a run of digits is always taken whole
_ANY = re.compile(
    rf"百分之(?P<percent>{_NUMBER})|(?P<year>{_SPELLED})年|(?P<count>{_NUMBER})(?P<unit>{_UNIT})|(?P<arabic>[0-9][0-9.]*)(?:(?P<scale>[万亿])(?={_UNIT}))?"
)


def _section(text: str, bare: int | None) -> int:
    """A numeral without 万 and 亿: runs of digits, of which the last counts, each with its multiplier.

    ``bare``: what a last digit counts that follows no multiplier, or None if it is one
    of units whatever it follows.
    """
    value, tenth = 0, bare
    for m in _RUN.finditer(text):
        run, times = m[1] or "", m[2] or m[4]
        last = DIGITS[run[-1]] if run else 0
        if times:
            value += (last or times == "十") * SMALL[times]
            tenth = bare and SMALL[times] // 10
        else:
            value += last * (1 if tenth is None or "零" in run else tenth)
    return value


def to_number(text: str) -> int | None:
    """The value of a positional numeral; a bare last digit counts in the unit below (一万二 is 12000).

    What stands before 亿 is a numeral of its own, and so is what stands before 万
    within it. None for no numeral and for more than 64 bits can hold.
    """
    if not _NUMERAL.fullmatch(text):
        return None
    *before, rest = text.split("亿")
    value, bare = 0, 10_000_000 if before else 1
    for part in before:
        *myriads, units = part.split("万")
        value = (value + sum(_section(m, None) for m in myriads) * 10_000 + _section(units, None)) * 100_000_000
    *myriads, units = rest.split("万")
    value += sum(_section(m, None) for m in myriads) * 10_000 + _section(units, 1000 if myriads else bare)
    return value if value < U64 else None


def rewrite_numbers(text: str) -> str:
    """One pass from the left: percentages, years digit by digit, numerals with a unit, 万 and 亿 after digits."""
    if not re.search("[零〇一二三四五六七八九十百千万亿两]", text):
        return text
    out, at = [], 0
    while m := _ANY.search(text, at):
        out.append(text[at : m.start()])
        new, end = _one(m, text)
        if new is None:  # nothing to rewrite here: keep one character and look again behind it
            new, end = text[m.start()], m.start() + 1
        out.append(new)
        at = end
    return "".join(out) + text[at:]


def _one(m: re.Match, text: str) -> tuple[str | None, int]:
    if m["percent"]:
        n = to_number(m["percent"])
        if n is not None:
            return f"{n}%", m.end()
    elif m["year"]:
        return "".join(str(DIGITS[c]) for c in m["year"]) + "年", m.end()
    elif m["count"]:
        compound = m["unit"] == "个" and text[m.end() : m.end() + 1] in ("万", "亿")
        n = None if compound else to_number(m["count"])
        if n is not None:
            return f"{n}{m['unit']}", m.end()
    else:
        return _scaled(m)
    return None, 0


def _scaled(m: re.Match) -> tuple[str, int]:
    """12.5万 before a unit becomes 125000 if that is whole; other digits stay."""
    if m["scale"]:
        try:
            value = float(m["arabic"]) * (1e4 if m["scale"] == "万" else 1e8)
        except ValueError:
            value = 0.0
        if value == int(value) and 0 < value < 9e15:
            return str(int(value)), m.end()
    return m["arabic"], m.end("arabic")
