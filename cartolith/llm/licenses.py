"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import documents_of, lowered

# Phrases and the labels they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences of public license texts (template: label, words).
TEMPLATES = {
    "apache line": ("apache", "Licensed under the Apache License, Version 2.0"),
    "apache notice": ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "bsd conditions": ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "cc by line": ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc by-nc line": ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    "gpl line": ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    "gpl notice": ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "isc permission": ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "mit line": ("mit", "Released under the MIT License"),
    "mit permission": ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "mpl form": ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    "public domain": ("unlicense", "This is free and unencumbered software released into the public domain"),
}
THRESHOLD = 0.8

# Words that name a license (template: words it can't do without, words that make it another one). Most words of a short sentence are
# those of any license sentence, so its share alone says little.
NAMES = {
    "apache line": (("apache",), ()),
    "bsd conditions": (("redistribution", "binary"), ()),
    "cc by line": (("creative", "commons", "attribution"), ("noncommercial", "sharealike", "noderivatives", "noderivs")),
    "cc by-nc line": (("cc", "by", "nc"), ("nd", "sa")),
    "gpl line": (("gnu", "general"), ("lesser", "library", "affero")),
    "gpl notice": (("gnu", "general"), ("lesser", "library", "affero")),
    "mit line": (("mit",), ()),
    "mpl form": (("mozilla",), ()),
    "public domain": (("unencumbered", "domain"), ()),
}

OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"              # what stands between words, after lower-casing A-Z
OTHER_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = "(?<= )(?:" + "|".join(PHRASES) + ")(?= )"


def tokens(template: str) -> list[str]:
    """The distinct words of a template."""
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), template))))


def length(template: str) -> int:
    """The words of a template, repeated ones too."""
    return len(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", template))


def spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def base_columns(text: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base_labels. Words stand between single spaces in `padded`, so a phrase can be cut out of it; no phrase overlaps another."""
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), OTHER, " ")), F.lit(" "))
    p = F.col("padded")
    some = F.greatest(*[F.contains(p, F.lit(f" {x} ")) for x in PHRASES])
    found = F.when(some, F.regexp_extract_all(p, F.lit(PHRASE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = F.when(some, F.split(p, PHRASE, -1))
    labels = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    n_words = F.when(p == "  ", 0).otherwise(spaces(p) - 1).cast("long")
    last = F.element_at("found", -1)
    return {"padded": padded, "found": found, "pieces": pieces, "n_words": n_words, "n_base": F.size("found").cast("long"),
            "first_word": F.when(F.size("found") > 0, spaces(F.element_at("pieces", 1)) - 1),
            "last_word": F.when(F.size("found") > 0, F.col("n_words") - (spaces(F.element_at("pieces", -1)) - 1) - (spaces(last) + 1)),
            "base_labels": F.transform("found", lambda x: F.element_at(labels, x))}


def word_order(base: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the documents first, ties by name; the driver gets at most one count for each template word."""
    words = F.split(F.regexp_replace(lowered(F.col("text")), OTHER, " "), " ")
    rows = base.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count().collect()
    counts = {r.w: r["count"] for r in rows}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks_found(base: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False, names: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = NAMES) -> DataFrame:
    """doc_id, key, block, template, label, containment: all blocks that hold at least `threshold` of a template's distinct words, all the words that name
    it, and none that make it another license.

    Blocks are lines (from 0); with `wrapped` lines of up to 2 n words for a template of n words, and windows over line ends (from -1 down): those of 2 n
    words that begin at every n-th word, so a run of up to n + 1 words lies whole in one of them, and the words of a long line don't add up.

    Words get numbers in the order of their frequency in the whole corpus. A template's prefix is what a block can't miss altogether if it passes:
    its rarest (words - needed + 1) words. Blocks meet templates by an equi-join on prefix words. The length filter asks for enough template words in
    the block, the positional filter for enough after the shared word on both sides; the words themselves are compared last. The template side has
    one row per prefix word, whatever the corpus, and is broadcast.
    """
    spark = base.sparkSession
    sets = {name: (label, tokens(text)) for name, (label, text) in templates.items()}
    naming = {name: names.get(name, ((), ())) for name in sets}
    order = word_order(base, sorted({w for _, ws in sets.values() for w in ws} | {w for both in naming.values() for words in both for w in words}))
    number = {w: i for i, w in enumerate(order)}
    rows, needs = [], {}
    for name, (label, ws) in sets.items():
        own = sorted(number[w] for w in ws)
        need = needs[name] = ceil(threshold * len(own) - 1e-9)
        own_names, others = ([number[w] for w in words] for words in naming[name])
        rows += [(n, name, label, own, i, need, length(templates[name][1]), own_names, others) for i, n in enumerate(own[:len(own) - need + 1])]
    least = min(needs.values(), default=0)
    prefixes = spark.createDataFrame(rows, "word int, template string, label string, own array<int>, own_at int, need int, n int, names array<int>, others array<int>")
    heads = sorted({r[0] for r in rows})
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    line = F.split(F.regexp_replace(lowered(F.col("text")), OTHER_IN_LINE, " "), "\n")
    lines = base.select("doc_id", "key", F.posexplode(line).alias("block", "line"))
    count = F.size(F.array_remove(F.split("line", " "), "")) if wrapped else F.lit(0)
    held = lines.select("doc_id", "key", "block", F.lit(None).cast("int").alias("of"), count.alias("words"), F.array_intersect(F.split("line", " "), F.array(*map(F.lit, order))).alias("held"))
    if wrapped:
        held = held.unionByName(windows(base, [(length(templates[name][1]), needs[name], ws) for name, (_, ws) in sets.items()], order).withColumn("words", F.lit(0)))
    held = held.where(F.size("held") >= least)
    ranked = held.select("doc_id", "key", "block", "of", "words", F.array_sort(F.transform("held", lambda w: F.element_at(numbers, w))).alias("held"))
    shared = ranked.withColumn("word", F.explode(F.array_intersect("held", F.array(*map(F.lit, heads)))))
    met = shared.join(F.broadcast(prefixes), "word").where((F.size("held") >= F.col("need")) & (F.col("words") <= 2 * F.col("n")) & (F.col("of").isNull() | (F.col("of") == F.col("n"))))
    met = met.where((F.size(F.array_except("names", "held")) == 0) & ~F.arrays_overlap("others", "held"))
    after = F.least(F.size("held") - F.array_position("held", F.col("word")).cast("int"), F.size("own") - F.col("own_at") - 1) + 1
    first = met.where(after >= F.col("need")).dropDuplicates(["doc_id", "key", "block", "of", "template"])
    share = F.size(F.array_intersect("held", "own"))
    return first.where(share >= F.col("need")).select("doc_id", "key", "block", "template", "label", (share / F.size("own")).alias("containment"))


def windows(base: DataFrame, templates: list[tuple[int, int, list[str]]], order: list[str]) -> DataFrame:
    """doc_id, key, block, of (the template length they are for) and held of windows over line ends. Templates are (words, needed, distinct words);
    a document gets windows for those only that it holds enough words of as a whole."""
    words = base.select("doc_id", "key", F.split(F.trim(F.regexp_replace(lowered(F.col("text")), OTHER, " ")), " ").alias("words"))
    whole = words.withColumn("whole", F.array_intersect("words", F.array(*map(F.lit, order))))
    enough = [F.when(F.size(F.array_intersect("whole", F.array(*map(F.lit, ws)))) >= need, F.lit(n)) for n, need, ws in templates]
    some = whole.withColumn("of", F.explode_outer(F.array_distinct(F.array_compact(F.array(*enough))))).where("of IS NOT NULL")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / F.col("of")).cast("int") - 2, F.lit(0)))
    cut = F.transform(starts, lambda k: F.array_intersect(F.slice("words", k * F.col("of") + 1, 2 * F.col("of")), F.col("whole")))
    return some.select("doc_id", "key", "of", F.posexplode(cut).alias("at", "held")).select("doc_id", "key", (-1 - F.col("at")).alias("block"), "of", "held")


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", wrapped: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels come from phrases whose words follow each other; labels add those of the templates found. score is the largest containment of a
    template in a block of the document, 0 if none passes; blocks are lines, with `wrapped` also windows over line ends (see blocks_found). Null text counts as empty. Repeated rows are scanned one by one; rows of one id with
    different texts keep apart. Other columns are not read.
    """
    base = documents_of(docs, doc_id, text).withColumn("key", F.xxhash64("text"))
    found = blocks_found(base, templates, threshold, wrapped).groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base
    for name, c in base_columns(F.col("text")).items():
        out = out.withColumn(name, c)
    own = out.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base_labels")
    both = own.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
                       joined(F.concat("base_labels", F.coalesce("more", none))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same by brute force: every line and every window against every template, and phrases by looking at following words."""
    quoted = lambda ws: f"[{', '.join(repr(w) for w in ws)}]::VARCHAR[]"
    values = ", ".join(f"('{label}', {quoted(tokens(text))}, {length(text)}, {quoted(NAMES.get(name, ((), ()))[0])}, {quoted(NAMES.get(name, ((), ()))[1])})" for name, (label, text) in TEMPLATES.items())
    hits = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM w WHERE " + " AND ".join(f"w{k} = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
t AS (SELECT * FROM (VALUES {values}) AS v(label, ws, n, names, others)),
n AS (SELECT doc_id, regexp_extract_all(x, '{word}') AS ws FROM d),
lines AS (SELECT doc_id, regexp_extract_all(line, '{word}') AS ws FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM d)),
blocks AS (SELECT doc_id, label, lines.ws AS block, t.ws, names, others FROM lines, t WHERE len(lines.ws) <= 2 * t.n UNION ALL
    SELECT doc_id, label, list_slice(b, k * n + 1, k * n + 2 * n), ws, names, others FROM (SELECT doc_id, label, n.ws AS b, t.ws, t.n, names, others, unnest(generate_series(0, greatest(ceil(len(n.ws) / t.n)::BIGINT - 2, 0))) AS k FROM n, t)),
shares AS (SELECT doc_id, label, len(list_intersect(list_distinct(block), ws)) / len(ws)::DOUBLE AS share FROM blocks WHERE list_has_all(block, names) AND NOT list_has_any(block, others)),
more AS (SELECT doc_id, label, share FROM shares WHERE share >= {THRESHOLD}),
e AS (SELECT doc_id, unnest(ws) AS w0, generate_subscripts(ws, 1) - 1 AS i FROM n),
w AS (SELECT doc_id, i, w0, lead(w0, 1) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS ({hits}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM more) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM more GROUP BY doc_id)
SELECT n.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM n LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""
