"""Licence scans (operator 10, DataFrame functions only).

Lines and paragraphs of a document are normalised (lower case, runs of anything but
letters and digits to one blank) and compared with the notices of known licences by
the Dice coefficient of their sets of word bigrams.  With b bigrams in the unit and m
in the template, Dice can reach t only if ``t / (2 - t) <= b / m <= (2 - t) / t``:
units that fit no template are not compared, and the others only with the templates
whose size allows it.

A notice inside a larger unit (comment block, running line) is found by word windows:
for each template that no line or paragraph matches, the window of the whole text with
the highest Dice counts, among those of at most ``(2 - t) / t`` times the template's
words.  Such a window starts and ends with a bigram of the template and holds at least
``t / (2 - t)`` of them, so only stretches that dense are compared.

Result: one row per document with its best licence (highest Dice, then the earlier
template; null if none reaches the threshold), that Dice, and all matches in order as
``licence:dice`` joined by commas.

Scale: a projection, no shuffle; the templates are a fixed table of a few notices.
Windows are cut only in texts with one of a few words that every window of the template
must hold one of, one for each dense place of the text, at most 1.5 templates long.

Edge cases: null and empty texts match nothing; units of one word have no bigrams and
match nothing; equal units of a document count once; repeated rows are scanned alike;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm._spans import bound

THRESHOLD = 0.8
#: The customary notices of licences, as public texts have them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this "
                "work."),
    ("proprietary", "All rights reserved."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
)


def template_words(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def least_common(m: int, threshold: float) -> int:
    """Bigrams that a unit must share with a template of m bigrams, whatever its size."""
    return max(1, math.ceil(m * threshold / (2 - threshold) - 1e-9))


def anchor_words(grams: list[str], threshold: float) -> list[str]:
    """Words of which every window that matches holds one: the bigrams without any of
    them are fewer than a match needs.  Long words first, as the rarer ones."""
    rest, out = list(grams), []
    while len(rest) >= least_common(len(grams), threshold):
        words = {w for g in rest for w in g.split()}
        out.append(max(words, key=lambda w: (len(w) >= 6, sum(w in g.split() for g in rest), len(w), w)))
        rest = [g for g in rest if out[-1] not in g.split()]
    return out


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(text: Column) -> Column:
    """Normalised lines and paragraphs (a paragraph ends at a blank line)."""
    lines = F.transform(F.split(text, "\n", -1), normal)
    paragraphs = F.transform(F.split(text, r"\n[\x20\x09-\x0D]*\n", -1), normal)
    return F.array_distinct(F.concat(lines, paragraphs))


def all_bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    return bound(words, lambda w: F.zip_with(
        F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b)))


def unit_bigrams(unit: Column) -> Column:
    return F.array_distinct(all_bigrams(unit))


def best_window(bigrams: Column, template: str, threshold: float) -> Column:
    """The highest Dice of a word window of the text with the template (null if no
    window shares enough bigrams); ``bigrams`` are those of the text in order."""
    grams = template_bigrams(template)
    least, longest = least_common(len(grams), threshold), int((len(template_words(template)) - 1) * (2 - threshold) / threshold + 1e-9)
    known = F.array(*map(F.lit, grams))
    places = F.array_compact(F.transform(bigrams, lambda g, i: F.when(F.array_contains(known, g), i)))

    def dice(first: Column, last: Column) -> Column:
        return bound(F.slice(bigrams, first + 1, last - first + 1), lambda w: (
            2.0 * F.size(F.array_intersect(w, known)) / (F.size(F.array_distinct(w)) + len(grams))))

    def from_places(s: Column) -> Column:
        dense = F.filter(F.sequence(F.lit(1), F.size(s) - least + 1),
                         lambda k: F.element_at(s, k + least - 1) - F.element_at(s, k) < longest)
        return F.array_max(F.transform(dense, lambda k: bound(F.element_at(s, k), lambda first: F.array_max(F.transform(
            F.filter(F.slice(s, k + least - 1, F.lit(longest)), lambda last: last - first < longest),
            lambda last: dice(first, last))))))

    return bound(places, lambda s: F.when(F.size(s) >= least, from_places(s)))


def embedded(text: Column, own: Column, threshold: float, templates: tuple[tuple[str, str], ...]) -> Column:
    """Matches of word windows with the templates that are not among ``own``."""
    def search(low: Column) -> Column:
        todos = []
        for rank, (_, template) in enumerate(templates):
            words = [low.contains(w) for w in anchor_words(template_bigrams(template), threshold)]
            todos.append(reduce(Column.__or__, words) & ~F.array_contains(F.transform(own, lambda x: x["rank"]), F.lit(rank)))
        found = lambda b: F.filter(F.array(*[F.struct(
            F.when(todo, best_window(b, template, threshold)).alias("dice"), F.lit(rank).alias("rank"), F.lit(name).alias("license"))
            for rank, (todo, (name, template)) in enumerate(zip(todos, templates))]), lambda x: x["dice"] >= threshold - 1e-9)
        return F.when(reduce(Column.__or__, todos), bound(all_bigrams(normal(text)), found))

    return bound(F.lower(text), search)


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD,
                  templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, n_matches, matches) of every row of ``docs``."""
    grams = [(name, template_bigrams(text)) for name, text in templates]
    least = min(len(g) for _, g in grams) * threshold / (2 - threshold)
    most = max(len(g) for _, g in grams) * (2 - threshold) / threshold
    shape = "array<struct<dice: double, rank: int, license: string>>"

    def compare(b: Column) -> Column:
        size, found = F.size(b), []
        for rank, (name, gram) in enumerate(grams):
            m = len(gram)
            fits = (size >= m * threshold / (2 - threshold) - 1e-9) & (size <= m * (2 - threshold) / threshold + 1e-9)
            common = F.size(F.array_intersect(b, F.array(*map(F.lit, gram))))
            found.append(F.when(fits, F.struct((2.0 * common / (size + m)).alias("dice"), F.lit(rank).alias("rank"),
                                               F.lit(name).alias("license"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull() & (x["dice"] >= threshold - 1e-9))

    # a unit of w words has at most w - 1 distinct bigrams and at least its distinct words less one
    blanks = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    fitting = F.filter(units(F.coalesce("text", F.lit(""))), lambda u: (blanks(u) >= least - 1e-9) & (
        (blanks(u) <= most + 1e-9) | (F.size(F.array_distinct(F.split(u, " "))) - 1 <= most + 1e-9)))
    own = F.flatten(F.transform(fitting, lambda u: bound(unit_bigrams(u), compare))).cast(shape)
    hits = bound(own, lambda h: F.concat(h, F.coalesce(
        embedded(F.coalesce("text", F.lit("")), h, threshold, templates).cast(shape), F.array().cast(shape))))
    best = F.element_at(F.array_sort(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("d"), h["rank"], h["license"]))), 1)
    ordered = F.sort_array("hits", asc=False)
    return (docs.select("doc_id", hits.alias("hits"))
            .withColumn("best", F.when(F.size("hits") > 0, best))
            .select("doc_id", F.col("best.license").alias("license"), F.round(-F.col("best.d"), 6).alias("dice"),
                    F.size("hits").cast("long").alias("n_matches"),
                    F.array_join(F.transform(ordered, lambda h: F.concat(
                        h["license"], F.lit(":"), F.format_number(h["dice"], 4))), ",").alias("matches")))
