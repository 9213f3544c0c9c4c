"""License scan: phrases by place, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. For a template of n words, repeats counted, a block is a run of ceil(n / THRESHOLD)
consecutive words of a text, at any place and over any line feeds, as a set of words. So a notice is
found however it is wrapped, and words strewn over a text are not one. A template is contained in a block when
at least THRESHOLD of its distinct words are in the block; the score is that share. Templates that share most of
their words are told apart by MARKS: words that the block must hold, and words of a rival that
neither the block nor the REACH words around it may hold. The join finds every such pair:

* One pass reads the texts. It counts words, finds the phrases and keeps the *skeleton* of each
  text: the words that templates or marks know, and a dot for any other word; no other word can be
  shared. Runs of dots longer than any block and its surroundings are cut to that length.
* Words are ordered by how many texts of the corpus hold them, rarest first, over all texts.
* Prefix filter. A block that contains n - k distinct words of a template holds one of its k + 1
  rarest; only around those words are blocks looked at.
* Length filter. Words around the rare one that cannot fill a block are dropped.
* Positional filter. A block begins no farther before the rare word than it is long, and with a word
  of the template; so what stands around bounds what can be shared, before blocks are compared.

The template side is fixed and small, so it is broadcast; blocks never shuffle, only the few
pairs found are grouped, by row.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after folding A-Z. Defined results: null
and empty texts have no words, no labels and score 0; repeated rows are judged alike;
a phrase is counted at every place, also where places overlap; equal shares give all their
labels; an empty table gives an empty one; only the id and the text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.session import store

#: Phrases and labels of the base rule, fixed values.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public license notices, fixed values.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "agpl": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "cc-by-sa": "licensed under a Creative Commons Attribution ShareAlike License",
    "cc-by-nc-sa": "licensed under a Creative Commons Attribution NonCommercial ShareAlike License",
    "cc-by": "This work is licensed under a Creative Commons Attribution International License",
    "cc-by-nc": "licensed under a Creative Commons Attribution NonCommercial License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}
#: Of templates that resemble others: words a block must hold, and words that it and its surroundings must not.
MARKS = {
    "gpl": (["general"], ["lesser", "library", "affero"]),
    "lgpl": (["lesser"], []),
    "agpl": (["affero"], []),
    "cc-by": (["attribution"], ["noncommercial", "sharealike", "noderivatives"]),
    "cc-by-sa": (["sharealike"], ["noncommercial"]),
    "cc-by-nc": (["noncommercial"], ["sharealike", "noderivatives"]),
    "cc-by-nc-sa": (["noncommercial", "sharealike"], []),
}
THRESHOLD = 0.8
#: Words on either side of a block that must not be a rival's mark.
REACH = 8
#: Between words, before folding.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A character for each known word, from here on.
_FIRST_SIGN = 0xE000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _framed(text: Column) -> Column:
    """Every word as `<word>`, in its own case. The frame characters are never part of words."""
    return F.replace(F.concat(F.lit("<"), F.regexp_replace(text, _GAP, "><"), F.lit(">")), F.lit("<>"), F.lit(""))


def _count(text: Column, part: str | Column) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in _UPPER else c for c in text))


def _overlaps_itself(words: list[str]) -> bool:
    return any(words[k:] == words[: len(words) - k] for k in range(1, len(words)))


def _places(framed: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(places, first, last) of a phrase of words; the last two null without a place."""
    words = _words(phrase)
    if _overlaps_itself(words):
        raise ValueError("a phrase that overlaps itself would be counted short")
    part = "".join(f"<{w}>" for w in words)
    n = _count(framed, part)
    first = _count(F.substring_index(framed, part, 1), "<")
    last = n_words - len(words) - _count(F.substring_index(framed, part, -1), "<")
    return n, F.when(n > 0, first), F.when(n > 0, last)


def _template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {name: list(dict.fromkeys(_words(text))) for name, text in templates.items()}


def _known_words(templates: dict[str, str]) -> list[str]:
    """The words of the templates and of their marks."""
    marks = [w for name in templates for side in MARKS.get(name, ()) for w in side]
    return sorted({*marks, *(w for words in _template_words(templates).values() for w in words)})


def _any_of(words: list[str]) -> str:
    """A pattern of the words, by first letter."""
    letters: dict[str, list[str]] = {}
    for w in words:
        letters.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items()) + ")"


def block_words(text: str, threshold: float = THRESHOLD) -> int:
    """Words in a block for a template."""
    return -(-int(round(len(_words(text)) / threshold * 1e6)) // 10**6)


def _widest(templates: dict[str, str], threshold: float) -> int:
    return max(block_words(t, threshold) for t in templates.values()) + REACH


def _skeleton(framed: Column, templates: dict[str, str], threshold: float) -> Column:
    """Of framed words the known ones, folded, and dots."""
    dots = _widest(templates, threshold)
    dotted = F.regexp_replace(framed, f"(?i)<(?!{_any_of(_known_words(templates))}>)[^<>]*>", ".")
    return _fold(F.regexp_replace(dotted, r"\.{%d,}" % dots, "." * dots))


def text_frequencies(rows: DataFrame, templates: dict[str, str]) -> dict[str, int]:
    """For each known word, how many of ``rows(skeleton)`` hold it. As many rows as there are known words come back."""
    held = rows.select(F.explode(F.array_distinct(F.regexp_extract_all("skeleton", F.lit("<([^>]*)>"), F.lit(1)))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in _known_words(templates)}


def template_matches(rows: DataFrame, frequencies: dict[str, int], templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(id, label, share) for every block of ``rows(id, skeleton)`` that contains a template, by the filters above."""
    sign = {w: chr(_FIRST_SIGN + k) for k, w in enumerate(frequencies)}
    order = {w: k for k, (w, _) in enumerate(sorted(frequencies.items(), key=lambda x: (x[1], x[0])))}
    signs = lambda words: [sign[w] for w in words]
    prefixes, facts = [], []
    for name, words in sorted(_template_words(templates).items()):
        words = sorted(words, key=order.__getitem__)
        need = -(-int(round(threshold * len(words) * 1e6)) // 10**6)
        must, never = MARKS.get(name, ([], []))
        facts.append((name, signs(words), need, block_words(templates[name], threshold), signs(must), signs(never)))
        prefixes += [(name, w) for w in words[: len(words) - need + 1]]
    spark = rows.sparkSession
    prefix = F.broadcast(spark.createDataFrame([(name, sign[w]) for name, w in prefixes], "label string, sign string"))
    template = F.broadcast(spark.createDataFrame(facts, "label string, words array<string>, need int, width int, must array<string>, never array<string>"))
    rare = sorted({w for _, w in prefixes})
    signed = reduce(lambda text, w: F.replace(text, F.lit(f"<{w}>"), F.lit(sign[w])), frequencies, F.col("skeleton"))
    texts = rows.where(F.col("skeleton").rlike(f"<{_any_of(rare)}>")).select("id", F.split(signed, "").alias("signs"))
    # the words around each rare one: a word a character, the rare one the (before + 1)-th
    around = _widest(templates, threshold)
    places = F.filter(F.transform("signs", lambda c, k: F.struct(c.alias("sign"), k.alias("k"))), lambda x: x["sign"].isin(signs(rare)))
    near = F.transform(places, lambda x: F.struct(x["sign"].alias("sign"), F.least(x["k"], F.lit(around)).alias("before"), F.slice("signs", F.greatest(x["k"] - around, F.lit(0)) + 1, F.lit(2 * around + 1)).alias("near")))
    pairs = texts.select("id", F.inline(near)).join(prefix, "sign").join(template, "label")
    shared_in = lambda block: F.size(F.array_intersect("words", block))
    low = F.greatest(F.col("before") - F.col("width") + 1, F.lit(0))
    pairs = pairs.where(shared_in(F.slice("near", low + 1, F.col("before") + F.col("width") - low)) >= F.col("need"))
    starts = F.filter(F.sequence(low, F.col("before")), lambda k: F.array_contains("words", F.get("near", k)))
    blocks = pairs.withColumn("start", F.explode(starts)).withColumn("block", F.slice("near", F.col("start") + 1, F.col("width")))
    left = F.greatest(F.col("start") - REACH, F.lit(0))
    surroundings = F.slice("near", left + 1, F.col("start") + F.col("width") + REACH - left)
    marked = (F.size(F.array_intersect("must", "block")) == F.size("must")) & ~F.arrays_overlap("never", surroundings)
    return blocks.where((shared_in(F.col("block")) >= F.col("need")) & marked).select("id", "label", (shared_in(F.col("block")) / F.size("words")).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    doc_id, text = docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("dk"), F.xxhash64(text).alias("rk"), text.alias("text"))

    framed = F.col("framed")
    counted = keyed.select("doc_id", "dk", "rk", _framed(F.col("text")).alias("framed"))
    counted = counted.select("doc_id", "dk", "rk", "framed", _skeleton(framed, templates, threshold).alias("skeleton"))
    # only texts with a phrase in some case are folded
    any_phrase = "(?i)" + "|".join("".join(f"<{w}>" for w in _words(p)) for p in phrases)
    counted = counted.select("doc_id", "dk", "rk", "skeleton", _count(framed, "<").alias("n_words"), F.when(framed.rlike(any_phrase), _fold(framed)).otherwise("").alias("framed"))
    places = {label: _places(framed, F.col("n_words"), phrase) for phrase, label in phrases.items()}
    n = reduce(lambda a, b: a + b, (p[0] for p in places.values()))
    least = F.least(*(p[1] for p in places.values())) if len(places) > 1 else next(iter(places.values()))[1]
    most = F.greatest(*(p[2] for p in places.values())) if len(places) > 1 else next(iter(places.values()))[2]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(p[0] > 0, F.lit(label)) for label, p in places.items())))))
    counted = counted.select("doc_id", "dk", "rk", "skeleton", "n_words", n.alias("n_base"), least.alias("first_word"), most.alias("last_word"), base.alias("base"))
    counted = store(counted)

    rows = counted.select(F.struct("dk", "rk").alias("id"), "skeleton")
    found = template_matches(rows, text_frequencies(rows, templates), templates, threshold)
    added = found.groupBy("id").agg(F.collect_set("label").alias("added"), F.max("share").alias("share")).select("id.dk", "id.rk", "added", "share")

    joined = counted.drop("skeleton").join(added, ["dk", "rk"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("added", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
