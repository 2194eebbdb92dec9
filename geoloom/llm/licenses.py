"""Licence scan: phrases, and templates found by the places of their rarest words and proven by key phrases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.store import ascii_lower, if_small, pinned, staged

#: Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, phrases that must occur, and words of well-known licence texts.
TEMPLATES = (
    (
        "mit",
        ("without restriction", "substantial portions of the software"),
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache",
        ("in compliance with the license", "without warranties or conditions of any kind"),
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        ("redistributions of source code must retain",),
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "gpl",
        ("terms of the gnu general public license",),
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    (
        "isc",
        ("with or without fee is hereby granted",),
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        ("terms of the mozilla public license",),
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "cc-by",
        ("creative commons attribution",),
        "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit "
        "http creativecommons org licenses by 4 0",
    ),
)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _has(phrase: str) -> Column:
    return F.contains("norm", F.lit(f" {phrase} "))


def _postings(spark: SparkSession, templates) -> DataFrame:
    """``(word, template, tpos)``; as large as the templates are."""
    rows = ", ".join(f"({k}, '{text}')" for k, (_, _, text) in enumerate(templates))
    return spark.sql(f"SELECT k AS template, tpos, word FROM VALUES {rows} AS t(k, text) LATERAL VIEW posexplode(split(text, ' ')) AS tpos, word")


def _ranked(templates, weight: dict[str, int]) -> Column:
    """A constant: for each template its number, its words from the rarest on, and the words that its key phrases need."""
    texts = lambda words: F.array(*map(F.lit, words))
    return F.array(*(
        F.struct(
            F.lit(k).alias("template"),
            texts(sorted(set(text.split()), key=lambda w: (-weight.get(w, 0), w))).alias("ranked"),
            texts(sorted(set(" ".join(need).split()))).alias("must"),
        )
        for k, (_, need, text) in enumerate(templates)
    ))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, slack: int = 16, top: int = 8, votes: int = 4) -> DataFrame:
    """``(row, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row of ``docs``.

    Base labels come from places where the words of a phrase stand side by side. The others
    come from an index of the templates' words by place. Of each template, the ``top`` words of highest IDF
    among those that the text holds are looked up, so neither a word's share of the corpus nor other licences in the text
    can push a template out; a template whose key phrases lack a word in the text is not looked up, as it
    can't be proven. At every place they have, these words meet the postings and vote for where the template would start
    (in windows of ``2 * slack`` words that overlap by half). A template with ``votes`` different places of
    it in one window counts if all its key phrases stand in the text. The score is 1 with a base label, else the
    best share of a template's words looked up that stand in place, else 0; there words weigh by their
    IDF, in millionths, so that sums are exact.

    Texts are read and not shuffled; their digests stand for them, and windows are counted in the task that reads a text.
    What reaches the driver is the IDF of the templates' words. A null text counts as empty and has no words; the columns of the input stay inside
    ``row``; repeated rows give equal results; an empty table gives no rows.
    """
    lower = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bare = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    df = pinned(docs.select(F.struct("*").alias("row"), bare.alias("bare")), F.when(F.col("bare") != "", F.concat(F.lit(" "), "bare", F.lit(" "))).otherwise("").alias("norm"), F.sha2(F.col("bare").cast("binary"), 256).alias("digest")).drop("bare")
    words = F.split(F.trim("norm"), " ")

    # pass one: in how many texts each template word stands
    postings = _postings(docs.sparkSession, templates)
    vocabulary = F.array(*map(F.lit, sorted({w for _, need, text in templates for w in f"{' '.join(need)} {text}".split()})))
    total = docs.count()
    seen = df.where("norm <> ''").select(F.explode(F.array_intersect(vocabulary, words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    weight = {r["word"]: math.ceil(math.log((total + 1) / r["n"]) * 1_000_000) for r in seen.collect()}

    # pass two: the rarest words of each template in a text, their places, then the proof
    held = pinned(df.where("norm <> ''").select("norm", "digest"), F.array_intersect(vocabulary, words).alias("held"))
    open_to = F.filter(_ranked(templates, weight), lambda t: F.size(F.array_except(t["must"], "held")) == 0)
    held = pinned(held, F.transform(open_to, lambda t: F.struct(t["template"], F.slice(F.array_intersect(t["ranked"], "held"), 1, top).alias("picked"))).alias("asked"))
    phrases = F.array(*(F.array(*map(F.lit, need)) for _, need, _ in templates))
    proof = lambda t: F.forall(F.get(phrases, t["template"]), lambda p: F.contains("norm", F.concat(F.lit(" "), p, F.lit(" "))))
    held = pinned(held.where(F.size("asked") > 0), F.transform("asked", lambda t: F.struct(t["template"], t["picked"], proof(t).alias("proven"))).alias("lookups")).drop("asked", "held")
    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: F.exists("lookups", lambda t: F.array_contains(t["picked"], x["word"])))
    spots = held.select("digest", "lookups", F.inline(spots))
    met = spots.select("digest", "word", "pos", F.inline("lookups")).where(F.array_contains("picked", F.col("word"))).join(if_small(postings, 1_000_000), ["template", "word"])
    start = F.floor((F.col("pos") - F.col("tpos")) / slack)
    met = met.select("digest", "template", "tpos", "word", "picked", "proven", F.explode(F.array(start, start + 1)).alias("start"))
    windows = met.groupBy("digest", "template", "start").agg(F.collect_set("tpos").alias("places"), F.collect_set("word").alias("placed"), F.first("picked").alias("picked"), F.first("proven").alias("proven"))
    voted = windows.where((F.size("places") >= votes) & F.col("proven"))
    weights = F.create_map(*(F.lit(x) for w in sorted(weight) for x in (w, weight[w]))) if weight else F.expr("cast(map() as map<string,int>)")
    heavy = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, w: a + F.coalesce(F.try_element_at(weights, w), F.lit(0)))
    shares = voted.select("digest", "template", (heavy("placed") / heavy("picked")).alias("share")).groupBy("digest", "template").agg(F.max("share").alias("share"))
    found = staged(shares.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("template", "share"))).alias("found")), "licences")

    places = {p: F.split("norm", f" {p}(?= )", -1) for p in PHRASES}
    made = [F.when(_has(p), F.struct((F.size(x) - 1).alias("n"), _spaces(F.get(x, F.lit(0))).alias("first"), (_spaces(F.col("norm")) - 1 - (_spaces(F.element_at(x, -1)) - 1) - len(p.split())).alias("last"))).alias(f"p{k}") for k, (p, x) in enumerate(places.items())]
    df = pinned(df, *made, F.greatest(_spaces(F.col("norm")) - 1, F.lit(0)).cast("long").alias("n_words"))
    known = df.drop("norm").join(found, "digest", "left")
    column = lambda name: F.array_compact(F.array(*(F.col(f"p{k}.{name}") for k in range(len(PHRASES)))))
    base = F.array_compact(F.array(*(F.when(F.col(f"p{k}").isNotNull(), label) for k, label in enumerate(PHRASES.values()))))
    known = pinned(known, base.alias("base"), F.coalesce("found", F.expr("cast(array() as array<struct<template:int,share:double>>)")).alias("proven"))
    names = F.array(*(F.lit(label) for label, _, _ in templates))
    every = F.concat("base", F.transform("proven", lambda x: F.get(names, x["template"])))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return known.select(
        "row", "n_words", F.aggregate(column("n"), F.lit(0), lambda a, x: a + x).cast("long").alias("n_base"),
        F.array_min(column("first")).cast("long").alias("first_word"), F.array_max(column("last")).cast("long").alias("last_word"),
        joined("base").alias("base_labels"), joined(every).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("proven", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )
