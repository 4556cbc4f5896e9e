"""The operators on small tables: brute-force results, nulls, empty and clashing input."""

import functools
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat_template, common, edit_decontam, feistel_shards, html_extract, kneser_ney, license_diagonals, media_chunks, simhash_ball, source_schedule, url_reputation
from tessera.llm.common import checkpointed, join_spread
from tessera.llm.components import connected_components

WORDS = "the of and to in is on by it with as for was that are this be from or have".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def sentence(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i // 3) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, sentence(i), "en", f"s{i % 3}", 0, "x") for i in range(20)]
    out += [(20, sentence(3), "en", "s0", 0, "x"), (21, sentence(4) + " more", "en", None, 0, None), (22, None, None, None, None, None), (23, "", "en", "s1", 0, "x")]
    out += [(24, "  \n\t ", "en", "s1", 0, "x"), (None, sentence(5), "en", "s2", 0, "x"), (None, None, None, None, None, None), (25, "long " * 30_000, "de", "s0", 0, "x")]
    return out + [(7, sentence(7), "en", "s1", 0, "x"), (7, sentence(7), "en", "s1", 0, "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_components_are_those_of_union_find(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (200, 200), (300, 301), (301, 300), (50, 7)] + [(1000, 1001 + i) for i in range(60)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 0, 100: 100, 101: 100, 102: 100, 300: 300, 301: 300, **{1000 + i: 1000 for i in range(61)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_components_against_all_pairs(docs):
    got = simhash_ball.with_components(simhash_ball.with_fingerprint(docs).select("doc_id", "fp", "extra")).collect()
    fps = sorted({r["fp"] for r in got})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for r in got:
        least[find(r["fp"])].append(r["doc_id"])
    for r in got:
        ids = [i for i in least[find(r["fp"])] if i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert len(got) == docs.count()


def test_links_of_many_near_copies_in_one_prefix(spark):
    rng = np.random.default_rng(5)
    fps = np.full(260, 0xDEADBEEFCAFEF00D, dtype=np.uint64)
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    far = np.full(40, 0xDEADBEEF00000000, dtype=np.uint64) | rng.integers(0, 2**32, 40).astype(np.uint64)
    fps = np.unique(np.concatenate([fps, far]))
    near = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 4]]
    want = {tuple(e) for e in simhash_ball._forest(np.array(near, dtype=np.uint64)).tolist()}
    assert 200 < len(want) < len(fps) - 30
    df = spark.createDataFrame([(v, int(f)) for v in (0, 1) for f in fps.view(np.int64)], "view int, fp long")
    for group, block in ((10**9, 10**9), (60_000, 5_000), (20_000, 100)):
        got = simhash_ball.fingerprint_links(df, 4, group, block).collect()
        for view in (0, 1):
            edges = np.array([(r["u"], r["v"]) for r in got if r["view"] == view], dtype=np.int64).view(np.uint64)
            assert {tuple(e) for e in simhash_ball._forest(edges).tolist()} == want
    heaviest = simhash_ball._routed(df, 0, 2, 20_000).groupBy("view", "bits", "prefix").count().agg(F.max("count"), F.max("bits")).first()
    assert heaviest[0] < len(fps) and heaviest[1] > 6


def test_components_replace_a_column_and_keep_null_fingerprints(spark):
    df = spark.createDataFrame([(1, 7, "x"), (2, 6, "y"), (3, None, "z"), (None, None, "z")], "doc_id long, fp long, component_id string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_ball.with_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, None: None}
    assert simhash_ball.with_components(df.limit(0)).count() == 0


def test_near_duplicate_groups_catch_copies(spark):
    texts = {i: sentence(i, 300) for i in range(30)}
    near = {100 + i: re.sub(r"\b(\w+) (\w+)$", r"\2 changed", texts[i]) for i in range(10)}
    rows = [(k, v) for k, v in {**texts, **near, 200: texts[4]}.items()] + [(None, "x"), (None, texts[5]), (7, texts[8]), (300, None), (301, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash"))
    got = [(r["doc_id"], r["component_id"]) for r in simhash_ball.near_duplicate_groups(df).collect()]
    want = [(i, i) for i in range(30)] + [(100 + i, i) for i in range(10)] + [(200, 4), (None, None), (None, 5), (7, 7), (300, 300), (301, 300)]
    want = [(i, 7) if c == 8 else (i, c) for i, c in want]
    assert Counter(got) == Counter(want)
    assert simhash_ball.near_duplicate_groups(df.limit(0)).count() == 0


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicate_groups_are_those_of_exact_similarity(spark):
    texts = {}
    for i in range(12):
        base = " ".join(f"b{i}x{j % 90 if i % 2 else j}" for j in range(300))
        texts |= {i: base, 100 + i: base + " " + " ".join(f"p{i}y{j}" for j in range(10 + 8 * i)), 200 + i: " ".join(sorted(base.split()))}
        texts |= {300 + i: base + " " + " ".join(f"p{i}y{j}" for j in range(40 + 30 * i))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    for i in sorted(texts):
        for j in sorted(texts):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_ball.near_duplicate_groups(df).collect()}
    assert got == {i: find(i) for i in texts}
    assert 12 < len(set(got.values())) < len(texts)


def test_html_templates_are_cut_by_both_paths(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><div class=box><span>Follow us</span></div><p>text {i}</p></body>") for i in range(12)]
    rows += [(90 + i, "http://h.com/c", f"<body><i>{i}</i><article><div>copied</div></article></body>") for i in range(9)]
    rows += [(50, None, None), (51, "x", ""), (None, "http://o.org", "<div class=box><span>Follow us</span></div><p>t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))
    for limit in (1000, 0):
        got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract_main_text(pages, broadcast_keys=limit).collect()}
        assert [got[(i, f"http://h.com/{i}")] for i in range(12)] == [f"text {i}" for i in range(12)]
        assert got[(90, "http://h.com/c")] == "copied"
        assert got[(50, None)] == got[(51, "x")] == ""
        assert got[(None, "http://o.org")] == "Follow us\n\nt"
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_html_templates_are_cut_on_hosts_of_copies(spark):
    body = "<body><div class=box><span>Follow us</span></div><article><div class=box><span>Share it</span></div><p>text {}</p></article></body>"
    rows = [(i, "http://h.com/x", body.format(max(0, i - 110))) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_main_text(pages).collect()} == {f"text {i}" for i in range(10)}


def test_html_places_of_rotating_adverts_are_cut(spark):
    page = "<body><div class=x1><p>offer {}</p></div><div class=x2><p>story {}</p><div class=x3>pay {}</div></div></body>"
    rows = [(i, "http://h.com/x", page.format(i % 9 if i else "once", i, i % 30)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (1000, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages, broadcast_keys=limit).collect()}
        assert got == {i: f"story {i}" for i in range(60)}


def test_html_of_any_kind_survives(spark):
    rows = [(0, "http://h.com", "<![foo[x]]>a"), (1, "http://h.com", "<p>b<!-- c"), (2, "http://h.com", "<p>d</p><![if !IE]>e<![endif]>"), (3, None, "\ud83d</"), (4, "x", "<div " * 3000)]
    rows += [(5, "x", "<b>" * 3000 + "deep"), (6, "x", "<main><p>f</p></main><div>no</div><div role=main>g<main>h</main></div>")]
    pages = spark.createDataFrame(rows[:3] + rows[4:] + rows[:1], "page_id long, url string, html string").withColumn("_host", F.lit(1)).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    assert got == {0: "a", 1: "b", 2: "d\n\ne", 4: "", 5: "deep", 6: "f\n\ng\n\nh"}


def test_url_rules_and_reputation(spark):
    urls = ["http://example.org/es/x", "http://example.org/en/12", "https://A.Example.ORG/en/2", "x://shop.com/de/", "x://shop.com/fr/1?q", "x://org/", "x://notorg/", "http://example.org", None, "nothing"]
    rows = list(enumerate(urls)) + [(100 + i, f"http://bad{i % 2}.net/p") for i in range(60)] + [(200 + i, f"http://good{i % 3}.info/p") for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(60)] + [(200 + i, 1, 0) for i in range(60)] + [(None, 0, 1), (0, None, None)]
    pages, known = spark.createDataFrame(rows, "page_id long, url string").withColumn("doc_id", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, known).collect()}
    assert [got[i]["verdict"] for i in range(6)] == ["block", "block", "allow", "block", "allow", "allow"]
    assert [got[i]["rule"] for i in range(10)] == ["example.org/es/", "example.org/en/1", "org/", "com/de/", "com/fr/", "org/", None, None, None, None]
    assert got[2]["host"] == "a.example.org" and got[8]["host"] == got[9]["host"] == "" and got[7]["path"] == ""
    assert all(got[100 + i]["verdict"] == "block" for i in range(60)) and all(got[200 + i]["verdict"] == "allow" for i in range(60))
    assert url_reputation.judge_urls(pages, known.limit(0)).count() == len(rows)
    assert url_reputation.judge_urls(pages.limit(0), known).count() == 0


def test_quality_rejects_junk_and_both_scorings_agree(spark):
    good = [(i, sentence(i, 80).translate(str.maketrans("", "", "0123456789")), "en") for i in range(160)]
    junk = [(500 + i, " ".join(w.upper() + "!!" for w in sentence(i, 80).split()), "en") for i in range(15)] + [(600, None, None), (601, "", "en"), (None, good[0][1], "xx")]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string").withColumn("n", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(None, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in kneser_ney.judge_quality(docs, labels).collect()}
    held_out = [got[i]["keep"] for i in range(120, 160)]
    assert sum(held_out) >= 38
    assert not any(got[500 + i]["keep"] for i in range(15))
    assert not got[600]["keep"] and not got[601]["keep"] and got[None]["keep"]
    model = kneser_ney.train(docs.filter("doc_id < 40").select("text")).persist()
    some = docs.filter("doc_id between 100 and 130 or doc_id >= 600")
    a = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(some.drop("n"), model).collect()}
    b = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(some.drop("n"), model, broadcast_entries=10).collect()}
    assert a.keys() == b.keys() and all(b[k] is None if v is None else abs(v - b[k]) < 1e-3 * v for k, v in a.items())
    assert kneser_ney.judge_quality(docs, labels.limit(0)).filter("keep").count() == 176


def brute_kneser_ney(texts, order=4):
    """Interpolated modified Kneser-Ney by its definition: a function from a text to its log-probability."""
    grams = Counter(("\n" * 3 + t)[i : i + order] for t in texts for i in range(len(t)))
    counts = {order: dict(grams)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        discount[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)] if all(n) else [0.5, 1.0, 1.5]

    followed = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            followed[k][g[:-1]][g] = n

    @functools.cache
    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / 0x110000
        after = followed[k].get(gram[:-1])
        if not after:
            return probability(gram[1:])
        d = discount[k]
        n, total, mass = after.get(gram, 0), sum(after.values()), sum(d[min(x, 3) - 1] for x in after.values())
        return (n - (d[min(n, 3) - 1] if n else 0)) / total + mass / total * probability(gram[1:])

    return lambda t: sum(math.log(probability(("\n" * 3 + t)[i : i + order])) for i in range(len(t)))


def test_model_is_modified_kneser_ney(spark):
    texts = [sentence(i, 12) for i in range(8)] + ["Ünï 中文 " + sentence(40, 3), "", None]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string")).persist()
    logp = brute_kneser_ney([t for t in texts if t])
    probes = [texts[0], sentence(99, 10), "中文 zzz", "Q", "😀 to be", None, ""]
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    for limit in (1_000_000, 0):
        for r in kneser_ney.score(df, model, limit).collect():
            text = probes[r["doc_id"]] or ""
            assert r["n"] == len(text) and abs(r["logp"] - logp(text)) < 1e-6 * (1 + abs(r["logp"]))
            assert r["perplexity"] is None if not text else abs(r["perplexity"] - math.exp(-logp(text) / len(text))) < 1e-4 * r["perplexity"]


def test_model_keeps_every_character_apart(spark):
    greek = ["".join(chr(0x3B1 + (i * j + j // 3) % 8) for j in range(60)) for i in range(1, 6)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in greek], "text string")).persist()
    folded_alike = ["".join(chr(ord(c) + 8) for c in t) for t in greek]
    df = spark.createDataFrame(list(enumerate(greek + folded_alike)), "doc_id long, text string")
    for limit in (1_000_000, 0):
        got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.score(df, model, limit).collect()}
        assert max(got[i] for i in range(5)) * 10 < min(got[i] for i in range(5, 10))
    grams = {t[max(0, i - 3) : i + 1].rjust(4, "\n") for t in greek for i in range(len(t))}
    assert model.filter("order = 4 and symbol >= 0").count() == len(grams)
    context = model.filter("order = 4 and symbol >= 0").first()["context"]
    lookup = kneser_ney.Lookup(*[model.toPandas()[c].to_numpy() for c in ("order", "context", "symbol", "v")])
    every = range(kneser_ney.CHARACTERS)
    import numpy as np

    assert abs(np.exp(lookup.logp(np.full(len(every), context), np.array(every))).sum() - 1) < 1e-6


def test_rare_language_has_its_own_limits(spark):
    rows = [("en", 400, -800.0 + i % 41 - 20) for i in range(2000)] + [("xx", 400, -1200.0 + i - 2) for i in range(5)] + [(None, 400, -800.0)]
    got = {r["lang"]: r for r in kneser_ney.language_limits(spark.createDataFrame(rows, "lang string, n long, logp double"), 0.002, 0.998).collect()}
    assert abs(got["xx"]["mean"] + 3) < 0.01 and abs(got["en"]["mean"] + 2) < 0.01
    assert -1.2 < got["xx"]["z_low"] < -0.9 and 0.9 < got["xx"]["z_high"] < 1.2
    assert None in got


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>b"), (1, 1, "assistant", None), (None, None, None, None), (2, 5, "system", "s\nt")]
    df = chat_template.with_hostile_conversation(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0)))
    for size in (4_000_000, 1):
        got = {r["conv_id"]: r for r in chat_template.digest_pieces(chat_template.format_conversations(df, piece_chars=size)).collect()}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\nhi\nassistant\n\nassistant\na<|im_end|>b\n")
        assert got[1]["loss_chars"] == 12 and got[1]["loss_sha256"] == sha("a<|im_end|>b")
        said = "<|im_end|><|im_start|>assistant ok"
        assert got[-1]["n_turns"] == 2 and got[-1]["loss_sha256"] == sha(said) and got[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n")
        assert got[None]["n_turns"] == 1 and got[None]["turns_sha256"] == sha("\n\n")
        assert set(got) == {1, 2, -1, None}
    assert chat_template.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 25, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel_shards.permuted(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))


def test_shards_are_even_and_reproducible(docs, rows):
    def run(df):
        return feistel_shards.assign_shards(feistel_shards.with_sizes(df).drop("text"), ["doc_id", "size", "text_crc32"]).collect()

    got = run(docs)
    assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in run(docs.repartition(7)))
    places = defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    counts = [len(places[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert feistel_shards.assign_shards(feistel_shards.with_sizes(docs.limit(0)), ["doc_id"]).count() == 0


def test_licenses(spark):
    texts = [
        "Foo. Licensed under the Apache License, Version 2.0.", "Released under the MIT License. mit license MIT LICENSE", "nothing here", None, "",
        "This work is licensed under the GNU General Public Licence, version 3. general public license",
        "This work is licensed, in part, under the GNU General Public License, version 3.", "All rights reserved.", "the " * 50_000 + "all rights reserved", "licénse mit license",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[0])], "doc_id long, text string").withColumn("key", F.lit(1))
    got = license_diagonals.scan_licenses(df).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        starts = [(p, label) for phrase, label in license_diagonals.PHRASES for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = by[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(starts)
        assert (r["first_word"], r["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in starts}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert by[0]["labels"] == "apache,apache-2.0" and by[None]["score"] == 1.0 and by[2]["labels"] == "" and by[7]["labels"] == by[8]["labels"] == "all-rights-reserved"
    assert "gpl-3.0" in by[6]["labels"]
    assert license_diagonals.scan_licenses(df.limit(0)).count() == 0


def plain_licenses(text):
    """(labels of the method, score) by all hits of each template's word triples, diagonal by diagonal."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = defaultdict(list)
    for p in range(len(words) - 2):
        at[tuple(words[p : p + 3])].append(p)
    labels, best = set(), 0.0
    for label, template in license_diagonals.TEMPLATES:
        w = template.split()
        n = len(w) - 2
        hits = [(p, t) for t in range(n) for p in at[tuple(w[t : t + 3])]]
        diagonals, islands = sorted({p - t for p, t in hits}), []
        for d in diagonals:
            if islands and d - islands[-1][-1] <= license_diagonals.GAP:
                islands[-1].append(d)
            else:
                islands.append([d])
        for island in islands:
            own = [(p, t) for p, t in hits if island[0] <= p - t <= island[-1]]
            places = [p for p, _ in own]
            if max(places) - min(places) + 1 <= 2 * n:
                parts = [{t for _, t in own}]
            else:
                parts = [{t for p, t in own if p // n in (k, k + 1)} for k in range(min(places) // n - 1, max(places) // n + 1)]
            cover = max(len(x) for x in parts) / n
            best = max(best, cover)
            if cover >= license_diagonals.MIN_COVER:
                labels.add(label)
    return labels, best


def test_license_labels_are_those_of_all_hits(spark):
    rng, notices = random.Random(8), [t for _, t in license_diagonals.TEMPLATES]
    texts = list(notices) + ["the " * 900 + notices[1], " ".join([notices[9]] * 40), " ".join(f"{notices[3][: 40 + 9 * i]} or" for i in range(30))]
    for i in range(60):
        words = rng.choice(notices).split()
        for _ in range(i // 6):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = rng.choice([[], ["extra"], ["the", "software"], [words[0]]])
        texts.append(" ".join([sentence(i, 12), *words * rng.randrange(1, 4), sentence(i + 9, 9)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in license_diagonals.scan_licenses(df).collect():
        labels, best = plain_licenses(texts[r["doc_id"]])
        own = set(filter(None, r["labels"].split(","))) - set(filter(None, r["base_labels"].split(",")))
        assert own == labels - set(filter(None, r["base_labels"].split(","))) and abs(r["score"] - best) < 1e-9


def test_row_numbers_do_not_depend_on_the_buckets(docs):
    sized = feistel_shards.with_sizes(docs).select("doc_id", "size", "text_crc32")
    for size in (1, 100_000):
        numbered, n = feistel_shards.row_numbers(sized, ["doc_id", "size", "text_crc32"], size)
        got = sorted((r["row_number"], r["doc_id"], r["size"]) for r in numbered.collect())
        assert [r[0] for r in got] == list(range(n))
        first = got if size == 1 else first
    assert got == first


def plain_media(text):
    """The fields of a text's stored form, written out by the definition alone: cuts from each place's own 32 bytes."""
    data = (text or "").encode()
    data += b" " * (-len(data) % 192 if data else 192)
    gear = [xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)]
    ends, start, h = [], 0, 0
    for i, b in enumerate(data, 1):
        h = (h * 2 + gear[b]) % 2**32
        if i - start > 16_384:
            start += 16_384
            ends.append(start)
        if h < 2**21 and i - start >= 256:
            ends.append(i)
            start = i
    if start < len(data):
        ends.append(len(data))
    chunks = [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
    digests = [hashlib.blake2b(c, digest_size=16).digest() for c in chunks]
    media = b"CDC1" + len(chunks).to_bytes(4, "little") + b"".join(len(c).to_bytes(4, "little") + d for c, d in zip(chunks, digests, strict=True))
    media += b"".join(dict(zip(digests, chunks, strict=True)).values())
    n, total, square = len(data), sum(data), sum(x * x for x in data)
    crossings = sum((x * n > total) != (y * n > total) for x, y in zip(data, data[1:], strict=False))
    feature = f"mean={total * 1000 // n};var={(square * n - total * total) * 1000 // (n * n)};crossings={crossings}"
    return len((text or "").encode()), n, hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def test_media_by_both_paths(spark, docs, rows):
    texts = [sentence(i, 900) for i in range(3)]
    more = [(100, texts[0] + texts[1]), (101, texts[1] + "é" + texts[2]), (102, texts[0]), (103, "x" * 40_000)] + [(200 + i, texts[2]) for i in range(30)]
    both = docs.select("doc_id", "text", F.lit("clash").alias("key")).union(spark.createDataFrame([(i, t, "clash") for i, t in more], "doc_id long, text string, key string"))
    want = Counter((i, *plain_media(t)) for i, t in [(r[0], r[1]) for r in rows] + more)
    for limit in (1000, 0):
        got = media_chunks.media_column(both, broadcast_digests=limit).collect()
        assert Counter((r["doc_id"], r["n_bytes"], *[r[f] for f in media_chunks._FIELDS]) for r in got) == want
    one = next(r for r in got if r["doc_id"] == 22)
    assert (one["n_bytes"], one["payload_bytes"], one["tail_crc32"]) == (0, 192, zlib.crc32(b" " * 16))
    assert media_chunks.media_column(docs.limit(0)).count() == 0


def test_join_spread_is_a_left_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}" if i % 2 else None) for i in range(300)], "i long, key string")
    found = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "key string, v long")
    rows = checkpointed(rows)
    want = Counter(tuple(r) for r in rows.join(found, "key", "left").select("i", "key", "v").collect())
    for least in (5, 1000):
        joined = join_spread(rows, found, "key", least)
        assert joined.columns == ["i", "key", "v"] and Counter(tuple(r) for r in joined.collect()) == want


def test_leaks(spark, docs):
    items = [(1, sentence(2)[:150]), (2, sentence(3)[20:170].upper()), (3, "ong"), (4, None), (None, sentence(6)), (5, "not in any of these documents at all, whatever one does"), (6, "more"), (7, " "), (1, sentence(2)[:150] + " ")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for size in (5_000_000, 100):
        got = [(r["doc_id"], r["item_id"], r["distance"]) for r in edit_decontam.find_leaks(docs, bench, max_chars=size).collect()]
        assert Counter(got) == Counter([(2, 1, 0), (3, 2, 0), (6, None, 0), (20, 2, 0), (21, 6, 0)])
        left = edit_decontam.drop_leaks(docs, bench, size)
        assert left.columns == docs.columns and left.count() == docs.count() - 5
    assert edit_decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert edit_decontam.find_leaks(docs.limit(0), bench).count() == 0


def brute_distance(item, text):
    """The least edit distance of the item to any substring of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j - 1] + (a != b), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_leaks_are_those_of_the_plain_table(spark):
    rng = random.Random(3)
    items = [(i, sentence(i * 3 + 1, 5 + i)) for i in range(8)]
    texts = []
    for i in range(24):
        part = list(edit_decontam.normalize(items[i % 8][1]))
        for _ in range(i // 4):
            part.insert(rng.randrange(len(part)), "q")
        texts.append((i, f"{sentence(50 + i, 8)} {''.join(part)} {sentence(90 + i, 6)}"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in edit_decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in texts:
        for i, item in items:
            item = edit_decontam.normalize(item)
            n = brute_distance(item, edit_decontam.normalize(text))
            if n <= len(item) // 20:
                want[d, i] = n
    assert got == want and 5 < len(want) < 24


def brute_targets(sizes, weights):
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mix(spark):
    rows = [(i, "w " * (5 + i % 40), "big" if i % 3 else f"s{i % 7}") for i in range(600)] + [(None, "a b c", None), (1000, None, "empty"), (3, "w " * 8, "s3"), (3, "w " * 8, "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1))
    got = source_schedule.mix_sources(df, slots=3000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in names:
        assert abs(taken[s] - want[s]) <= max(30, 0.02 * want[s]), (s, taken[s], want[s])
    again = source_schedule.mix_sources(df.repartition(5), slots=3000).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    assert source_schedule.mix_sources(df.limit(0)).count() == 0


def test_small_sources_keep_their_share(spark):
    rows = [(i, "w " * 20_000, f"big{i % 2}") for i in range(200)] + [(1000 + i, "w " * 10, "tiny") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_schedule.mix_sources(df, slots=400).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    for r in got:
        assert abs(r["taken"] - r["target"]) <= max(10, 0.02 * r["target"]), r


def plain_groups(texts):
    """The group of each text: all pairs of five-word shingle sets, linked at 0.8."""
    split = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) - {()} for w in split]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def test_groups_of_many_copies_that_differ_are_exact(spark):
    rng, base = random.Random(4), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        words = list(base)
        for k in range(rng.randrange(8)):
            words[rng.randrange(120)] = f"x{i}y{k}" if k % 3 else "shared"
        texts.append(" ".join(words[: 120 - rng.randrange(12)] + [f"tail{i % 9}"] * rng.randrange(6)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash_ball.similar_groups(df, ["doc_id"]).collect()}
    want = plain_groups(texts)
    same = lambda of: Counter(frozenset(i for i in range(160) if of[i] == g) for g in {of[i] for i in range(160)})
    assert same(got) == same(want) and 5 < len(set(want)) < 100
    sets = [simhash_ball.shingle_set(t) for t in texts]
    rows = [(simhash_ball._digest(x), i % 7, x.tobytes()) for i, x in enumerate(sets)]
    known = checkpointed(spark.createDataFrame(list({r[0]: r for r in rows}.values()), "node long, comp long, shingles binary"))
    pairs = {(r["u"], r["v"]) for r in simhash_ball._similar_by_prefix(known.select("node", "comp"), known.select("node", "shingles"), 0.8).collect()}
    by = {r["node"]: r for r in known.collect()}
    for u in by:
        for v in by:
            if u > v and by[u]["comp"] != by[v]["comp"] and simhash_ball.similar(by[u]["shingles"], by[v]["shingles"], 0.8):
                assert (u, v) in pairs


def test_rows_of_a_very_common_shingle_are_dealt_over_tasks(spark):
    posted = [(7, 1 + i % 3 // 2, i) for i in range(6000)] + [(8, 5, i) for i in range(2500)] + [(i, i % 2, 0) for i in range(9, 30)] + [(i, 4, 1) for i in range(9, 20)]
    known = checkpointed(spark.createDataFrame(posted, "token long, comp long, node long"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = simhash_ball._with_main(known)
        rows = [tuple(r) for r in found.select("token", "comp", "node", "main").collect()]
        tasks = found.filter("token = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(*r, 1) for r in posted if r[0] == 7] + [(*r, 4) for r in posted if 9 <= r[0] < 20]
    assert Counter(rows) == Counter(want)
    assert max(r["count"] for r in tasks) <= 4000 and sum(r["count"] for r in tasks) == 6000


def test_checkpoints_leave_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, switch = files(), spark.conf.get(common._REMOVE_SHUFFLES)
    rows = spark.range(2000).select((F.col("id") % 50).alias("u"), (F.col("id") % 70).alias("v"), F.lit(1).alias("n"))
    least = rows.groupBy("u").agg(F.min("v").alias("least"))
    out = checkpointed(rows.join(least.hint("shuffle_merge"), "u").drop("n").distinct())
    for _ in range(100):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common._REMOVE_SHUFFLES) == switch
    # what was made before is read again as it was
    assert {tuple(r) for r in out.collect()} == {(i % 50, i % 70, i % 10) for i in range(2000)}
    assert rows.join(least, "u").count() == 2000 and out.join(least, "u").count() == out.count()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    clean = [(i, sentence(i, 200).translate(str.maketrans("", "", "0123456789")) + f" end {sentence(i + 500, 40)}", "en", f"s{i % 4}", 0) for i in range(150)]
    copies = [(1000 + i, clean[i][1], "en", "s0", 0) for i in range(10)] + [(1020 + i, clean[i][1] + " and a few more words", "en", None, None) for i in range(10)]
    leak = [(2000, clean[149][1] + " " + sentence(900, 25), "en", "s1", 0)]
    junk = [(3000 + i, "ABC!! " * 200, "en", "s1", 0) for i in range(3)] + [(None, clean[60][1] + " x", "en", "s2", 0), (4000, None, None, None, None), (4001, "", "en", "s0", 0)]
    same = [(5, clean[140][1] + " " + sentence(77, 90), "en", "s1", 0), (None, sentence(40, 150), None, "s1", 0), (None, sentence(40, 150), None, "s1", 0), clean[11], clean[11]]
    rows = clean[:149] + copies + leak + junk + same
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_row": F.lit(1), "component": F.lit("x"), "size": F.lit(2)})
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, sentence(900, 25).upper()), (2, None), (None, "abc!!")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_stages_against_plain_versions(spark, corpus):
    import corpus_pipeline

    read = lambda df: [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]
    all_docs = spark.read.parquet(f"{corpus}/documents.parquet")
    # quality: the limits by definition, over the brute-force model
    judged = read(corpus_pipeline.quality(spark, all_docs, corpus))
    rows = read(all_docs)
    trusted = [r for r in rows if r[0] is not None and r[0] < 140]
    logp = brute_kneser_ney([r[1] for r in trusted])
    score = {r[1]: logp(r[1]) for r in {*rows} if r[1]}
    means, z = {}, {}
    for name, some in (("en", [r for r in trusted if r[2] == "en"]), (None, trusted)):
        mean = sum(score[r[1]] for r in some) / sum(len(r[1]) for r in some)
        off = sorted(round((score[r[1]] / len(r[1]) - mean) * math.sqrt(len(r[1])), 2) for r in some)
        means[name] = mean
        z[name] = [next(x for i, x in enumerate(off, 1) if i >= len(off) * q) for q in (0.002, 0.998)]
    wider = math.sqrt(1 + 1 / len(trusted))
    low, high = (x * wider * 1.25 for x in z["en"])
    limits = {"en": (means["en"], low, high), None: (means[None], z[None][0] * 1.25, z[None][1] * 1.25)}
    want = []
    for r in rows:
        mean, low, high = limits.get(r[2], limits[None])
        if r[1] and low <= (score[r[1]] / len(r[1]) - mean) * math.sqrt(len(r[1])) <= high:
            want.append(r)
    assert Counter(judged) == Counter(want) and 160 < len(want) < len(rows)
    # near duplicates: one row of each group, of all rows
    kept = read(corpus_pipeline.near_duplicates(spark, all_docs, corpus))
    groups = defaultdict(list)
    for r, g in zip(rows, plain_groups([r[1] for r in rows]), strict=True):
        groups[g].append(r)
    assert len(kept) == len(groups) and not Counter(kept) - Counter(rows)
    first = {min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()}
    assert {(r[0] is None, r[0] or 0) for r in kept} == first
    assert sum(r[0] == 5 for r in kept) == 2 and sum(r[0] is None for r in kept) == 1
    # decontamination: by substring, as the items of this corpus are there verbatim
    left = read(corpus_pipeline.decontaminate(spark, all_docs, corpus))
    items = [edit_decontam.normalize(t) for t in (sentence(900, 25).upper(), "abc!!")]
    assert Counter(left) == Counter(r for r in rows if not any(i in edit_decontam.normalize(r[1]) for i in items))
    # mix: each row about as often as its source's target asks for
    mixed = Counter(read(corpus_pipeline.mix(spark, all_docs, corpus)))
    words = Counter()
    for r in rows:
        words[r[3]] += len((r[1] or "").split())
    names = sorted(s for s in words if s is not None) + [None]
    target, taken = brute_targets(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}), Counter()
    for r, n in mixed.items():
        taken[r[3]] += n * len((r[1] or "").split())
        assert n <= 3 * rows.count(r)
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 500 for s in names), (taken, target)
    # shard: every row once, counts at most one apart, slots gapless
    placed = corpus_pipeline.shard(spark, all_docs, corpus).collect()
    assert Counter(tuple(r)[:5] for r in placed) == Counter(rows)
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {len(rows) // 24, len(rows) // 24 + 1}


def test_pipeline_runs_its_stages_one_after_another(spark, corpus):
    import corpus_pipeline

    docs, steps = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, corpus))
        steps.append([tuple(r) for r in docs.collect()])
        assert name == "shard" or docs.columns == corpus_pipeline.COLUMNS
    final = [tuple(r) for r in corpus_pipeline.run(spark, corpus).collect()]
    assert Counter(final) == Counter(steps[-1]) and final
    ids = [{r[0] for r in rows} for rows in steps]
    assert not ids[0] & {3000, 3001, 3002, 4000, 4001} and not ids[1] & {*range(1000, 1030)} and 2000 in ids[1] and 2000 not in ids[2]


def test_pipeline_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, columns in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b", None, None, None)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        stage(spark, docs, str(tmp_path)).count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
