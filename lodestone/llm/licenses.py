"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of as many successive words of the text as the template has (counted with repeats),
whatever lines they stand in, so that a wrapped notice is found. A template is found in a block if the block has at
least ``threshold`` of the template's distinct words. Windows are looked at only around the places of a template's
first n - need + 1 words, as below. Template words are ordered by how many documents of the corpus have them, rarest first, ties by name. A
block and a template of n words that share at least need = ceil(threshold * n) words must, by that order,

* have need words each that are in any template (length filter),
* share one of the template's first n - need + 1 words (prefix filter), and
* have enough words left behind the first one they share (positional filter).

What passes is verified by its exact overlap. All of it is one expression per document, without a shuffle of texts;
only the word counts are aggregated, of at most as many words as the templates have.

Null and empty texts have no words and no labels. Every row is judged on its own, so repeated rows, ties and further
columns do no harm. With an empty corpus all words have frequency zero and the order is by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices as they stand in files, by the label that finding one gives.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, SEPARATOR + "+"), "")


def template_words(text: str) -> list[str]:
    cut = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text)
    return [w for w in dict.fromkeys("".join(c.lower() if c.isascii() else c for c in cut).split(" ")) if w]


def template_length(text: str) -> int:
    """The template's words, counted with repeats."""
    return len("".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split())


def whole(alternatives: list[str]) -> str:
    """A pattern for any of the alternatives as whole words, A-Z in either case."""
    return f"(?i)(?<!{WORD})(?:{'|'.join(alternatives)})(?!{WORD})"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, those in the fewest documents first."""
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    found = docs.select(F.explode(F.array_intersect(strings(vocabulary), words(ascii_lower(F.coalesce("text", F.lit("")))))).alias("w"))
    counts = dict(found.groupBy("w").count().collect())  # at most one row for each word of the templates
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def phrase_starts(w: Column, phrases: list[str]) -> Column:
    """Where (word position from 0) any of the phrases starts, once for each phrase and place."""

    def starts(phrase: str) -> Column:
        parts = phrase.split(" ")
        here = lambda i: [F.get(w, i + k) == p for k, p in enumerate(parts)]

        def match(i: Column) -> Column:
            out = here(i)[0]
            for c in here(i)[1:]:
                out &= c
            return F.coalesce(out, F.lit(False))

        return F.filter(F.transform(w, lambda x, i: i), match)

    return F.concat(*[starts(p) for p in phrases])


def template_hits(line: Column, order: list[str], templates: dict[str, str], threshold: float) -> Column:
    """array<struct<label, score>> of the templates found in a line."""
    rank = {w: i for i, w in enumerate(order)}
    held = F.array_intersect(strings(order), words(ascii_lower(line)))  # in the global order

    def hits(b: Column) -> Column:
        found = []
        for label, text in templates.items():
            t = sorted(template_words(text), key=rank.get)
            need = math.ceil(threshold * len(t) - 1e-9)
            prefix = strings(t[: len(t) - need + 1])
            first = F.get(F.array_intersect(prefix, F.slice(b, F.lit(1), F.greatest(F.size(b) - need + 1, F.lit(0)))), 0)
            left = F.least(F.size(b) - F.array_position(b, first), F.lit(len(t)) - F.array_position(strings(t), first))
            possible = (F.size(b) >= need) & first.isNotNull() & (left + 1 >= need)
            overlap = F.size(F.array_intersect(strings(t), b))
            found.append(F.when(possible, F.when(overlap >= need, F.struct(F.lit(label).alias("label"), (overlap / F.lit(float(len(t)))).alias("score")))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.array(held), hits))


def window_hits(body: Column, order: list[str], templates: dict[str, str], threshold: float) -> Column:
    """array<struct<label, score>> of the templates found in windows of the text's words."""
    rank = {w: i for i, w in enumerate(order)}

    def hit(w: Column, label: str, text: str) -> Column:
        t, n = sorted(template_words(text), key=rank.get), template_length(text)
        need = math.ceil(threshold * len(t) - 1e-9)
        prefix = strings(t[: len(t) - need + 1])
        overlap = lambda b: F.size(F.array_intersect(strings(t), b))
        places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(prefix, x), i)), lambda i: i.isNotNull())
        # all that is in any window with the place
        around = F.transform(places, lambda i: F.slice(w, F.greatest(i - n + 2, F.lit(1)), F.least(i, F.lit(n - 1)) + n))
        near = F.filter(around, lambda b: overlap(b) >= need)
        windows = lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.size(b) - n + 1, F.lit(1))), lambda k: F.slice(b, k, n))
        most = F.array_max(F.transform(near, lambda b: F.array_max(F.transform(windows(b), overlap))))
        return F.when(most >= need, F.struct(F.lit(label).alias("label"), (most / F.lit(float(len(t)))).alias("score")))

    def hits(w: Column) -> Column:
        return F.filter(F.array(*[hit(w, label, text) for label, text in templates.items()]), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.array(words(ascii_lower(body))), hits))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, name: str = "license") -> DataFrame:
    """docs' columns and a struct: n_words, n_base (places of phrases), first_word, last_word (their smallest and
    largest start, else null), base_labels, labels (with the templates' too; both distinct, sorted, comma-joined),
    score (the best share of a found template's words in a line or window, 0 to 1)."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    order = word_order(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = set()
    for text in templates.values():
        t = sorted(template_words(text), key=rank.get)
        prefixes.update(t[: len(t) - math.ceil(threshold * len(t) - 1e-9) + 1])
    body = F.coalesce(F.col("text"), F.lit(""))
    any_phrase = whole([(SEPARATOR + "+").join(p.split(" ")) for p in phrases])
    any_prefix = whole(sorted(prefixes))

    places = F.when(body.rlike(any_phrase), F.transform(F.array(words(ascii_lower(body))), lambda w: F.array(*[phrase_starts(w, [p]) for p in phrases]))[0])
    none = F.array().cast("array<struct<label:string,score:double>>")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(any_prefix))
    in_lines = F.flatten(F.transform(lines, lambda x: template_hits(x, order, templates, threshold)))
    found = F.when(body.rlike(any_prefix), F.concat(in_lines, window_hits(body, order, templates, threshold))).otherwise(none)

    def result(v: Column) -> Column:
        starts = F.flatten(v["places"])
        base = F.filter(F.array(*[F.when(F.size(F.get(v["places"], i)) > 0, label) for i, label in enumerate(phrases.values())]), lambda x: x.isNotNull())
        joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
        return F.struct(
            v["n"].cast("long").alias("n_words"),
            F.coalesce(F.when(v["places"].isNotNull(), F.size(starts)), F.lit(0)).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(F.concat(base, F.transform(v["found"], lambda h: h["label"]))).alias("labels"),
            F.coalesce(F.array_max(F.transform(v["found"], lambda h: h["score"])), F.lit(0.0)).alias("score"),
        )

    parts = F.struct(F.size(words(body)).alias("n"), places.alias("places"), found.alias("found"))
    return docs.withColumn(name, F.transform(F.array(parts), result)[0])
