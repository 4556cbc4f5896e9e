"""License scans by diagonal voting.

Every rolling word k-gram of a document is hashed and joined with the positions of
the same k-gram in license templates. A hit votes for the diagonal document
position - template position: a verbatim notice is one diagonal, one with words
added or left out a few neighbouring ones. Votes are aggregated per diagonal,
neighbouring diagonals are merged, and a merged span counts as the license if it
holds enough of the template's k-grams. A span longer than two templates, as of a
notice that is repeated, is verified in windows of that length, each half over the
next.

DataFrame functions only. k-grams with a word that is in no template can hit
nothing and are left out before the join; hits are compared word by word, not by
hash alone. Texts that are equal are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm.common import ascii_lower, checkpointed, join_spread

K = 3
#: Diagonals at most this far apart are neighbours.
GAP = 2
#: Share of the template's k-grams that a span must hold.
MIN_COVER = 0.7
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template tables up to this many k-grams are broadcast; larger ones are joined by shuffle.
BROADCAST_GRAMS = 200_000

# Base phrases with their labels, and wordings of usual license notices.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                   "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit-notice", "released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
                 "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
                 "and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _grams(templates: tuple) -> list[tuple[str, int, int, str]]:
    """(label, template, position, k words) of all templates."""
    out = []
    for t, (label, text) in enumerate(templates):
        words = text.split()
        if len(words) < K:
            raise ValueError(f"template {text!r} has fewer than {K} words")
        out += [(label, t, i, " ".join(words[i : i + K])) for i in range(len(words) - K + 1)]
    return out


def _phrase_starts(w: Column, phrase: str) -> Column:
    """The start positions of a phrase in the words ``w``, found from its last word."""
    *before, last = phrase.split()
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)))
    ends = F.filter(places, lambda i: F.get(w, i) == last)

    def holds(i: Column) -> Column:
        ok = i >= len(before)
        for back, word in enumerate(reversed(before), 1):
            ok = ok & F.coalesce(F.get(w, i - back) == word, F.lit(False))
        return ok

    return F.transform(F.filter(ends, holds), lambda i: i - len(before))


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty; nothing found gives empty labels and the score 0.
    score: the largest share of a template's k-grams in one span. Repeated rows and
    null ids stay.
    """
    spark = docs.sparkSession
    grams = _grams(templates)
    vocabulary = sorted({word for g in grams for word in g[3].split()})
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("key"), words.alias("w"))
    w = F.col("w")
    places = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))

    def may_hit(i: Column) -> Column:
        ok = F.get(w, i).isin(vocabulary)
        for j in range(1, K):
            ok = ok & F.get(w, i + j).isin(vocabulary)
        return ok

    def gram(i: Column) -> Column:
        text = F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)])
        return F.struct(i.alias("pos"), text.alias("gram"))

    starts = [(_phrase_starts(w, phrase), label) for phrase, label in phrases]
    rows = rows.select(
        "doc_id", "key", F.size(w).cast("long").alias("n_words"),
        F.concat(*[s for s, _ in starts]).alias("starts"),
        F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, label in starts])).alias("base"),
        F.transform(F.filter(places, may_hit), gram).alias("hits"),
    )
    rows = checkpointed(rows)

    hits = rows.filter(F.size("hits") > 0).select("key", F.explode("hits").alias("hit")).select("key", "hit.pos", "hit.gram").distinct()
    hits = hits.withColumn("h", F.xxhash64("gram"))
    at = spark.createDataFrame([(label, t, i, g) for label, t, i, g in grams], "label string, template int, tpos int, tgram string")
    lengths = {t: sum(g[1] == t for g in grams) for t in range(len(templates))}
    n_grams = F.element_at(F.array(*[F.lit(lengths[t]) for t in range(len(templates))]), F.col("template") + 1)
    at = at.withColumn("th", F.xxhash64("tgram")).withColumn("n_grams", n_grams)
    at = F.broadcast(at) if len(grams) <= BROADCAST_GRAMS else at
    votes = hits.join(at, (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")))
    diagonals = votes.groupBy("key", "label", "template", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("seen"), F.min("pos").alias("start"), F.max("pos").alias("stop")
    )
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True)).cast("int")
    islands = diagonals.withColumn("new", new).withColumn("island", F.sum("new").over(order))
    island = Window.partitionBy("key", "template", "island")
    islands = islands.withColumn("length", F.max("stop").over(island) - F.min("start").over(island) + 1)
    fits = F.col("length") <= 2 * F.col("n_grams")
    seen = islands.filter(fits).groupBy("key", "label", "template", "n_grams", "island").agg(F.flatten(F.collect_list("seen")).alias("seen"))
    spans = seen.select("key", "label", "n_grams", F.size(F.array_distinct("seen")).alias("seen"))
    hits = islands.filter(~fits).select("key", "label", "template", "n_grams", "island", "diagonal", F.explode("seen").alias("tpos"))
    window = F.floor((F.col("diagonal") + F.col("tpos")) / F.col("n_grams"))
    hits = hits.withColumn("window", F.explode(F.array(window - 1, window)))
    windows = hits.groupBy("key", "label", "template", "n_grams", "island", "window").agg(F.size(F.collect_set("tpos")).alias("seen"))
    spans = spans.union(windows.select("key", "label", "n_grams", "seen")).withColumn("cover", F.col("seen") / F.col("n_grams"))
    found = spans.groupBy("key").agg(
        F.collect_set(F.when(F.col("cover") >= MIN_COVER, F.col("label"))).alias("own"), F.max("cover").alias("cover")
    )
    out = join_spread(rows, found, "key")
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("cover", F.lit(0.0)).alias("score"),
    )
