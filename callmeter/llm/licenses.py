"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are sentences (what stands between line ends or a . ! ? ; before a space) and windows of consecutive words over the
whole text, whatever line or sentence ends stand among them, so a notice wrapped over lines is met as one. A template's
window holds WIDTH times as many words as the template, which leaves room for what wraps bring (comment marks, line numbers,
tags). Blocks and templates are sets of words; frequent function words of the templates are left out of both. A block meets
a template if it holds at least CONTAIN of the template's words.

The join finds all of them. Windows are looked for in pieces of twice the longest window that start one longest window
apart: each window lies whole in one of them. Template words are ordered by how many documents of the corpus have them,
rarest first; a sentence or piece that meets a template shares one of the template's first
|T| - ceil(CONTAIN |T|) + 1 words (prefix filter), has at least ceil(CONTAIN |T|) template words (length filter), and has
enough words left after the first shared one (positional filter). What passes is compared whole, pieces by each window.

The templates are a parameter of fixed size, so their words, ranks and prefixes are broadcast. Blocks are looked at only
in documents that hold enough words of some template. Everything here is built-in DataFrame functions.

Defined results: a null text is empty: no words, no labels, score 0; repeated rows each get a row; a null doc_id is kept;
extra columns are ignored. lower() stands for lower-casing A-Z: no other letter that it changes becomes part of a phrase
or of a word boundary.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, with_columns

CONTAIN, WIDTH = 0.8, 2
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in common use, by SPDX identifier. But for the short forms of CC BY and CC BY-NC,
#: none holds CONTAIN of another's words.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words that carry no meaning of a notice.
FUNCTION_WORDS = "a an and any are as by can for in is it may of or that the this to under use with without you".split()
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CANDIDATE = rf"(?:gnu|apache|cc|mit){NOT_WORD}(?:general|license|by)"


def template_words(text: str) -> list[str]:
    kept = [w for w in re.split(NOT_WORD, text.lower()) if w and (w not in FUNCTION_WORDS or text.startswith("Licensed under CC"))]
    return sorted(set(kept) - {"under"})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def base_places(words: Column) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand consecutively."""
    labels = F.lit(None).cast("string")

    def label(word: Column, i: Column) -> Column:
        out = labels
        for phrase, name in PHRASES.items():
            first, *rest = phrase.split()
            hit = word == first
            for k, w in enumerate(rest, 1):
                hit = hit & (F.get(words, i + k) == w)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return F.struct(i.alias("at"), out.alias("label"))

    return F.filter(F.transform(words, label), lambda x: x["label"].isNotNull())


def _pieces(text: Column, longest: int) -> Column:
    """array<array<string>>: the words of each piece of 2 * longest words, one starting at every longest words."""
    cut_up = lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / longest).cast("int")), lambda k: F.slice(words, k * longest + 1, F.lit(2 * longest)))
    # as an element of an array the words are split once, not for each piece
    return F.flatten(F.transform(F.filter(F.array(_words(text)), lambda words: F.size(words) > 0), cut_up))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text);
    score: 1 with a base phrase, else the largest containment of a template that is met, else 0."""
    spark = docs.sparkSession
    sets = [(label, words, ceil(CONTAIN * len(words) - 1e-9), WIDTH * len([w for w in re.split(NOT_WORD, text.lower()) if w])) for label, text in templates if (words := template_words(text))]
    vocabulary = sorted({w for _, words, *_ in sets for w in words})
    least, longest = min(need for _, _, need, _ in sets), max(width for *_, width in sets)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    docs = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("low", low).withColumn("row", F.monotonically_increasing_id())
    docs = docs.withColumn("hits", F.array_intersect(F.split("low", NOT_WORD), _strings(vocabulary)))
    places = F.when(F.col("low").rlike(_CANDIDATE), base_places(_words(F.col("low")))).otherwise(F.array().cast("array<struct<at:int,label:string>>"))
    enough = F.size("hits") >= least
    held = F.array([F.struct(F.lit(need).alias("need"), _strings(words).alias("words")) for _, words, need, _ in sets])
    enough = enough & F.exists(held, lambda t: F.size(F.array_intersect("hits", t["words"])) >= t["need"])
    filled = lambda blocks: F.filter(blocks, lambda b: F.size(F.array_intersect(b, F.col("hits"))) >= least)
    blocks = F.when(enough, filled(F.transform(F.split("low", r"\n|(?<=[.!?;])\s"), lambda b: F.array_intersect(F.split(b, NOT_WORD), F.col("hits")))))
    pieces = F.when(enough, filled(_pieces(F.col("low"), longest)))
    table = cut(docs.select("row", "doc_id", F.regexp_count("low", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long").alias("n_words"), places.alias("places"), "hits", blocks.alias("blocks"), pieces.alias("pieces")), "licenses")

    ranks = {r.token: r["count"] for r in table.select(F.explode("hits").alias("token")).groupBy("token").count().collect()}  # at most the vocabulary
    order = sorted(vocabulary, key=lambda w: (ranks.get(w, 0), w))
    prefixes = [(label, len(words), need, width, w, k, words) for label, words, need, width in sets for k, w in enumerate(sorted(words, key=order.index)[: len(words) - need + 1])]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "label string, size int, need int, width int, token string, at_t int, words array<string>"))

    block = table.select("row", F.explode("blocks").alias("b"), F.lit(False).alias("piece")).unionByName(table.select("row", F.explode("pieces").alias("b"), F.lit(True).alias("piece")))
    ranked = block.withColumn("tokens", F.array_intersect(_strings(order), "b")).select("row", "b", "piece", F.size("tokens").alias("of"), F.posexplode("tokens").alias("at_b", "token"))
    # the bound falls from one shared word to the next, so if one of them passes, the first does
    left = ranked.join(prefix, "token").filter("of >= need and 1 + least(of - at_b - 1, size - at_t - 1) >= need")
    starts = F.sequence(F.lit(1), F.when(F.col("piece"), F.least(F.lit(longest), F.size("b"))).otherwise(1))
    shared = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("b", i, F.when(F.col("piece"), F.col("width")).otherwise(F.size("b"))), F.col("words"))))
    found = left.withColumn("shared", F.array_max(shared)).filter("shared >= need").groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))

    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["at"])
    out = table.select("row", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), base.alias("base")).join(found, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
