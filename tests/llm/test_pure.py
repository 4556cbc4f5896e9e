"""The operators' cores without Spark: brute force, round trips and hostile input."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat_template as C
from tessera.llm import edit_decontam as E
from tessera.llm import html_extract as H
from tessera.llm import kneser_ney as K
from tessera.llm import media_chunks as M
from tessera.llm import simhash_ball as S

TEXTS = st.text(alphabet=st.sampled_from(list("ab <>|\\\n\t中é😀_imstarend")), max_size=40)


# ------------------------------------------------------------------------- op1
def test_html_keeps_the_article_only():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><a>x</a></nav>"
        "<div class='ad-slot'>buy</div><article><header><h1>Head&amp;er</h1></header><p>one <b>two<br>three <p>four&nbsp;\n five</p><aside>side</aside>"
        "<form><p>form</p></form><div class='comments'><p>reader</p></div><ul><li>x<li>y</ul></article><div id='cookie-notice'>ok</div><footer>f</footer>"
    )
    assert H.extract(page) == "Head&er\n\none two three\n\nfour five\n\nx\n\ny"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "</p></p>", "<!--", "<script>x", "&am", "<table><td>1<tr><td>2"])
def test_html_survives_broken_pages(html):
    assert isinstance(H.extract(html), str)


def test_html_deep_nesting_and_template_cut():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.extract(deep) == "x"
    page = "<body><div class=bar><p>Follow us</p></div><p>text</p></body>"
    keys = H.subtree_keys(page, "h")
    cut = H._host_key("h", next(n.key for n in H._candidates(H.parse(page)) if n.tag == "div"))
    assert cut in keys
    assert H.extract(page, "h", {cut}) == "text"
    assert H.extract(page, "other", {cut}) == "Follow us\n\ntext"


# ------------------------------------------------------------------------- op3
@given(st.lists(TEXTS, max_size=8), st.integers(1, 50))
def test_ngrams_are_those_of_each_text(texts, size):
    want, got, places = Counter(), Counter(), Counter()
    for t in texts:
        want.update(("\n\n\n" + t)[i : i + 4] for i in range(len(t)))
    old, K.SLICE = K.SLICE, size
    try:
        for context, symbol, text in K._characters(texts):
            places.update(text.tolist())
            for c, s, n in zip(*(x.tolist() for x in K._distinct(context, symbol)), strict=True):
                got["".join(chr(c >> 21 * i & (1 << 21) - 1) for i in (2, 1, 0)) + chr(s)] += n
    finally:
        K.SLICE = old
    assert got == want
    assert places == Counter({i: len(t) for i, t in enumerate(texts) if t})


def test_ngrams_of_very_many_kinds_of_characters():
    text = "".join(chr(c) for c in range(0x1000, 0x1000 + 70_000) if not 0xD800 <= c < 0xE000)
    (context, symbol, _), *rest = K._characters([text])
    got = [K._distinct(context, symbol)]
    assert not rest and sum(len(g[0]) for g in got) == len(text) and sum(g[2].sum() for g in got) == len(text)


@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.integers(-1, 40)), unique=True, max_size=60))
def test_hashed_rows_are_found(rows):
    context, symbol = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    table = K._Hashed(context, symbol, np.arange(len(rows)) + 0.5)
    assert table.find(context, symbol).tolist() == [i + 0.5 for i in range(len(rows))]
    other = np.array([41, 42, 43])
    assert np.isnan(table.find(np.array([1, 2, 3]), other)).all()


# ------------------------------------------------------------------------- op4
def brute_fingerprint(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet=st.sampled_from(list("aB \t\n\x0b\x85\xa0é\x1c")), max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_is_the_defined_one(text):
    assert S.shingle_fingerprint(text) == brute_fingerprint(text)


def test_meet_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = list(base)
    for f in base:
        for _ in range(4):
            g = f
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                g ^= np.uint64(1) << np.uint64(b)
            fps.append(g)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    want = S._forest(np.stack([fps[i[near]], fps[j[near]]], axis=1))
    for bits in (0, 3, 6):
        masks = [int(m) for m in S._masks(bits, min(2, bits))] if bits else [0]
        sent = {}
        for f in fps.tolist():
            for m in masks:
                sent.setdefault((f >> (64 - bits) if bits else 0) ^ m, []).append(f)
        edges = np.concatenate([S.meet(np.array(v, dtype=np.uint64), p, bits, 2, 4) for p, v in sent.items()])
        got = S._forest(edges)
        assert sorted(map(tuple, got.tolist())) == sorted(map(tuple, want.tolist()))
        assert (np.bitwise_count(edges[:, 0] ^ edges[:, 1]) >= 1).all()


# ------------------------------------------------------------------------- op5
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n<|im_end|>", ""]), TEXTS), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    text, spans = C.compile_template(C.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert C.read_back(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


@pytest.mark.parametrize("bad", ["{{ ''.__class__ }}", "{{ f('x') }}", "{% for x in y %}", "{{ 'x' * 9 }}", "{% import os %}", "{{ x.y", "{{ x | system }}"])
def test_chat_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)({"y": 1})


def test_chat_constants_fold():
    assert C.fold(C.parse("{% if 1 + 1 == 2 %}a{{ 'b' ~ 3 }}{% else %}c{% endif %}d")) == [("text", "ab3d")]


@pytest.mark.parametrize("source", [
    C.TEMPLATE, "a{% for m in messages %}{{ loop.index }}{% if loop.first %}^{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}${% endif %}{% endfor %}{{ m }}z",
    "{% set n = 1 %}{% for m in messages %}{{ n }}{% set n = n + 1 %}{% endfor %}{{ n }}", "{{ messages | length }}{% for m in messages %}{{ messages[0].text }}{% endfor %}",
    "{% if 1 == 2 %}{{ messages }}{% endif %}x", "{% for messages in messages %}{{ messages.role }}{% endfor %}",
    "{% set m = 7 %}{% for m in messages %}{{ m.role }}{% endfor %}{{ m }}", "{% for m in messages %}{% set messages = 2 %}{{ m.text }}{% endfor %}{{ messages }}",
])
def test_pieces_of_any_size_are_the_whole(source):
    turns = [{"role": "assistant" if i % 2 else "user", "text": "ab" * i} for i in range(7)]
    for messages in (turns, turns[:1], []):
        text, spans = C.compile_template(source)({"messages": messages})
        for size in (0, 5, 10**6):
            pieces, at, told = list(C.compile_pieces(source, size)(iter(messages))), 0, []
            for part, marks in pieces:
                told += [(at + a, at + b) for a, b in marks]
                at += len(part)
            assert "".join(p for p, _ in pieces) == text and told == spans
    assert len(list(C.compile_pieces(C.TEMPLATE, 5)(turns))) > 3


# ------------------------------------------------------------------------- op8
@given(st.binary(max_size=3000), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data, times):
    payload = data * times + b" "
    chunks = M.chunks_of(payload)
    assert b"".join(c for _, c in chunks) == payload
    assert M.load_media(M.store_media(chunks)) == payload


def test_media_cuts_depend_on_content_alone():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    a, b = M.chunks_of(common), M.chunks_of(b"0123456789" * 7 + common)
    assert len({d for d, _ in a} & {d for d, _ in b}) > 0.8 * len(a)
    broken = bytearray(M.store_media(a))
    broken[-1] ^= 1
    with pytest.raises(M.MediaError):
        M.load_media(bytes(broken))


# ------------------------------------------------------------------------- op9
def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row), row.index(min(row))


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=100))
@settings(max_examples=150, deadline=None)
def test_myers_is_the_edit_distance(p, t):
    assert E.myers(p, t, 1000) == brute_distance(p, t)


@given(st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_items_with_edits_in_budget_are_found(seed):
    rng = np.random.default_rng(seed)
    item = "".join(rng.choice(list("abcdefghij "), 120)).strip()
    item = E.normalize(item)
    s, k = list(item), E.budget(len(item))
    for _ in range(k):
        at, what = rng.integers(len(s)), rng.integers(3)
        if what == 0:
            s[at] = "#"
        elif what == 1:
            del s[at]
        else:
            s.insert(at, "#")
    text = "zzz " * 20 + "".join(s) + " yyy" * 20
    assert [m[0] for m in E.Matcher([(3, item)]).find(text)] == [3]
    assert E.Matcher([(3, item)]).find("nothing of that kind " * 30) == []
