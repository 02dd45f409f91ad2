"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are overlapping runs of 2 * SPAN words, one every SPAN words, so each run of up to SPAN words of a text stands
whole in some block, however the text is wrapped; no template has more words. A block's words form a set, as do those of
a template; a block matches where at least ``threshold`` of the template's set is in the block's (containment). All
tokens of templates are ordered by the number of documents that hold them, rarest first. A match needs
alpha = ceil(threshold * |T|) common tokens, so it shares one of the first |T| - alpha + 1 of the template (prefix
filter); a block with fewer than alpha tokens can't match (length filter); nor can one where the tokens up to and after
the shared one don't suffice (positional filter). Candidates are verified on the whole sets, so every match is found and
no other. Only DataFrame functions run, without Python on the executors.

Base phrases are found wherever their words stand consecutively, whatever is between them.

Defined cases: a null text is an empty one, with no words, an empty string of labels and score 0; rows are told apart by
doc_id, null included, and a hash of the text; tokens that equally many documents hold are ordered by name; an empty
table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Words that a template may have at most.
SPAN = 30
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words, seen before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same classes written by what is in them, which the JVM matches about twice as fast.
JVM_WORD, JVM_ANY_CASE = r"[0-9a-z\x{80}-\x{10FFFF}]++", r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases and labels of the scan.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Sentences of the notices of well-known licenses.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial license", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0 1 0 universal public domain dedication"],
    "gpl-2": ["under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3 0",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-3": ["under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "epl-2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "bsl-1": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _phrase(phrase: str) -> str:
    inside = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
    return f"(?<!{inside})" + GAP.join(phrase.split()) + f"(?!{inside})"


def _places(text: Column, phrase: str) -> Column:
    """Word numbers at which the phrase begins."""
    pieces = F.split(text, _phrase(phrase), -1)
    width = len(phrase.split())
    seen = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("places"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.regexp_count(piece, F.lit(JVM_WORD))
        return F.struct((at + width).alias("at"), F.concat(acc["places"], F.array(at)).alias("places"))

    return F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), seen, step, lambda acc: acc["places"])


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, key (a hash of the text), label, block (from 0), containment: every block and template that meet the
    threshold."""
    spark = docs.sparkSession
    if any(len(t.split()) > SPAN for ts in (templates or TEMPLATES).values() for t in ts):
        raise ValueError(f"a template has at most {SPAN} words")
    sets = [(label, i, sorted(set(t.split()))) for label, ts in (templates or TEMPLATES).items() for i, t in enumerate(ts)]
    vocabulary = sorted({t for _, _, tokens in sets for t in tokens})
    words = lambda c: F.regexp_extract_all(_lower(c), F.lit(JVM_WORD), F.lit(0))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))

    held = source.select(F.explode(F.array_intersect(words(F.col("text")), _lits(vocabulary))).alias("token"))
    frequency = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # of the templates' tokens
    order = sorted(vocabulary, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}

    entries, prefixes = [], []
    for k, (label, _, tokens) in enumerate(sets):
        ranks = sorted(rank[t] for t in tokens)
        alpha = math.ceil(threshold * len(ranks) - 1e-9)
        entries.append((k, label, ranks, alpha))
        prefixes += [(ranks[i], k, i) for i in range(len(ranks) - alpha + 1)]
    first = {order[r] for r, _, _ in prefixes}
    template = spark.createDataFrame(entries, "template int, label string, ranks array<int>, alpha int")
    prefix = spark.createDataFrame(prefixes, "rank int, template int, i int")

    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    some = _lits(sorted(first))
    texts = source.select("doc_id", "key", words(F.col("text")).alias("tokens")).where(F.arrays_overlap("tokens", some))
    blocks = F.transform(F.sequence(F.lit(1), F.size("tokens"), F.lit(SPAN)), lambda at: F.array_intersect(F.slice("tokens", at, 2 * SPAN), _lits(vocabulary)))
    blocks = texts.select("doc_id", "key", F.posexplode(blocks).alias("block", "held")).where(F.arrays_overlap("held", some))
    blocks = blocks.select("doc_id", "key", "block", F.array_sort(F.transform("held", lambda t: F.element_at(ranks, t))).alias("own"))
    blocks = blocks.where(F.size("own") >= min(e[3] for e in entries))
    probe = blocks.select("doc_id", "key", "block", "own", F.posexplode("own").alias("j", "rank"))
    found = probe.join(F.broadcast(prefix), "rank").join(F.broadcast(template), "template")
    rest = F.least(F.col("i"), F.col("j")) + 1 + F.least(F.size("ranks") - F.col("i") - 1, F.size("own") - F.col("j") - 1)
    found = found.where((F.size("own") >= F.col("alpha")) & (rest >= F.col("alpha")))
    common = F.size(F.array_intersect("own", "ranks"))
    found = found.select("doc_id", "key", "block", "label", common.alias("common"), "alpha", (common / F.size("ranks")).alias("containment"))
    return found.where("common >= alpha").groupBy("doc_id", "key", "label", "block").agg(F.max("containment").alias("containment"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("key"), F.regexp_count(text, F.lit(JVM_ANY_CASE)).cast("long").alias("n_words"), _lower(text).alias("low"))
    some = F.lit(False)
    for phrase in BASE.values():  # a phrase can only stand where all its words do
        every = F.lit(True)
        for word in sorted(set(phrase.split()), key=len, reverse=True):
            every = every & F.contains("low", F.lit(word))
        some = some | every
    base = base.withColumn("low", F.when(some, F.col("low")).otherwise(F.lit("")))
    base = base.select("doc_id", "key", "n_words", *[F.when(F.col("low") != "", _places(F.col("low"), p)).otherwise(F.array().cast("array<long>")).alias(f"p{k}") for k, p in enumerate(BASE.values())])
    columns = [F.col(f"p{k}") for k in range(len(BASE))]
    every = F.concat(*columns)
    hit = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(columns, BASE, strict=True)]), lambda x: x.isNotNull())
    base = base.select("doc_id", "key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), F.array_sort(hit).alias("base"))

    blocks = matches(docs, threshold, templates).groupBy(F.col("doc_id").alias("id"), F.col("key").alias("id_key")).agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks"))
    out = base.join(blocks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("id_key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
