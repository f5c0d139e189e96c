"""Licence scan in DataFrame functions only: Dice coefficient over word bigrams against notice templates.

Units are the lines of a text, its blocks of several lines between lines without a letter or digit of
ASCII (blank ones, bare comment marks), and windows: as many word bigrams as the template has, from
any that is one of the template's (fewer at the end of the text).  A unit is put in lower case, all but
a-z and 0-9 become gaps, and its word bigrams are compared with each template's.  As Dice is at
most 2 * min / (a + b), a template whose number of bigrams is too far from the unit's is never
compared; and as a match shares at least n * t / (2 - t) of a template's n bigrams, it holds one of any
n - n * t / (2 - t) + 1 of them, its anchors, so units and texts without an anchor are left out early.

Windows find notices inside longer sentences.  Titles and short labels (``TITLES``) count as whole
lines or blocks only, as a text may mention a licence without being under it.  Of windows that begin at one word
the best counts, and of those that overlap the ones that no overlapping one beats: larger
coefficient, then earlier template, then earlier place.

Defined cases: null, empty and one-word texts have no bigrams and match nothing; of templates
with equal coefficient the first in the list counts; repeated rows give repeated rows; very
long units are out of every size bound and cost no comparison; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices of common licences, as their authors ask to state them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
)

# Identifiers and how a sentence names the licence.
NAMES = (
    ("MIT", "the MIT License"),
    ("ISC", "the ISC License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("GPL", "the GNU General Public License"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
IDENTIFIERS = tuple(dict.fromkeys(name for name, _ in NAMES))

# Titles that licence texts bear.
HEADINGS = (
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)

NOTICES += tuple((name, f"{verb} under {title}") for name, title in NAMES for verb in ("Licensed", "Released", "Distributed"))
NOTICES += tuple((name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS)
TITLES = (
    *HEADINGS,
    *((name, re.sub("^(?:the|a) ", "", title)) for name, title in NAMES),
    *((name, f"License: {name}") for name in IDENTIFIERS),
)
TEMPLATES = NOTICES + TITLES


def bigrams(text: str) -> list[str]:
    """The different word bigrams of a template, in order."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _once(c, name: str):
    """The value as a column that later expressions read: without a generator between them Spark
    would write it out again inside each lambda, once per template."""
    return F.explode(F.array(c)).alias(name)


def anchors(pairs: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every match holds one: as many as needed, the longest, which are seldom common words."""
    least = math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
    return sorted(pairs, key=lambda b: (-len(b), b))[: len(pairs) - least + 1]


def _literals(items):
    """A constant array, folded by the optimizer; bigrams and words hold no bar."""
    return F.split(F.lit("|".join(items)), r"\|")


def _pairs(words):
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.concat(x, F.lit(" "), y))


def word_pairs(text: str) -> int:
    """How many bigrams a window of the template's length has, repeats counted."""
    return len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split()) - 1


def _table(templates, threshold: float):
    """The templates as one constant: the rank, the licence, n bigrams, w bigrams of a window, and the anchors."""
    rows = []
    for rank, (name, text) in enumerate(templates):
        b = bigrams(text)
        rows.append({"rank": rank, "license": name, "n": len(b), "w": word_pairs(text), "b": b, "anchors": anchors(b, threshold)})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rank: int, license: string, n: int, w: int, b: array<string>, anchors: array<string>>>")


def _words(text):
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _whole_units(docs: DataFrame, text, threshold: float, templates) -> DataFrame:
    table = [bigrams(t) for _, t in templates]
    known = _table(templates, threshold)
    some = _literals(sorted({a for b in table for a in anchors(b, threshold)}))

    def units(parts, kind):
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), x.alias("x")))

    blocks = F.filter(units(F.split(text, r"\n[^A-Za-z0-9]*\n"), "block"), lambda u: F.contains(u["x"], F.lit("\n")))
    src = docs.select("id", F.explode(F.concat(units(F.split(text, "\n"), "line"), blocks)).alias("u"))
    src = src.select("id", "u.kind", "u.unit", _once(_words(F.col("u.x")), "words"))
    a = F.size("words") - 1
    # 2 * min(a, n) / (a + n) >= threshold
    low, high = min(map(len, table)) * threshold / (2 - threshold), max(map(len, table)) * (2 - threshold) / threshold
    src = src.where(a.between(low, high)).withColumn("a", a)
    src = src.select("id", "kind", "unit", "a", _once(_pairs(F.col("words")), "pairs")).where(F.arrays_overlap("pairs", some))
    near = F.filter(known, lambda t: 2 * F.least(t["n"], F.col("a")) >= threshold * (t["n"] + F.col("a")))
    scored = F.transform(
        near,
        lambda t: F.struct(
            (2 * F.size(F.array_intersect(t["b"], F.col("pairs"))) / (t["n"] + F.col("a"))).alias("dice"), (-t["rank"]).alias("rank"), t["license"].alias("license")
        ),
    )
    best = src.select("id", "kind", "unit", F.array_max(scored).alias("t"))
    return best.where(F.col("t.dice") >= threshold).select("id", "kind", "unit", "t.license", "t.dice")


def _windows(docs: DataFrame, text, threshold: float, templates) -> DataFrame:
    table = [bigrams(t) for _, t in templates]
    known = _table(templates, threshold)
    every = sorted({a for b in table for a in anchors(b, threshold)})
    # a word of each anchor, the longer: texts without any need no bigrams
    some = _literals(sorted({max(a.split(), key=len) for a in every}))
    longest = max(word_pairs(t) for _, t in templates) + 1
    src = docs.select("id", _once(_words(text), "words")).where(F.arrays_overlap("words", some))
    src = src.select("id", _once(_pairs(F.col("words")), "pairs")).where(F.arrays_overlap("pairs", _literals(every)))
    pairs, last = F.col("pairs"), F.size("pairs") - 1

    def begins(t):
        """Places of the template's bigrams from which a window reaches an anchor."""
        at = F.filter(F.sequence(F.lit(0), last), lambda i: F.array_contains(t["anchors"], F.get(pairs, i)))
        before = F.transform(
            at, lambda q: F.filter(F.sequence(F.greatest(F.lit(0), q - t["w"] + 1), q), lambda p: F.array_contains(t["b"], F.get(pairs, p)))
        )
        return F.array_distinct(F.flatten(before))

    def window(t, p):
        k = F.least(t["w"], F.size(pairs) - p)
        shared = F.size(F.array_intersect(t["b"], F.slice(pairs, p + 1, k)))
        dice = 2 * shared / (t["n"] + k)
        return F.struct(p.alias("place"), (-dice).alias("low"), t["rank"].alias("rank"), (p + k).alias("end"), t["license"].alias("license"))

    held = F.filter(known, lambda t: F.arrays_overlap(t["anchors"], pairs))
    found = F.transform(held, lambda t: F.filter(F.transform(begins(t), lambda p: window(t, p)), lambda x: x["low"] <= -threshold))
    src = src.select("id", _once(F.array_sort(F.flatten(found)), "found"))
    first = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1)["place"] != x["place"]))
    src = src.select("id", _once(first, "found"))
    goodness = lambda x: F.struct(x["low"], x["rank"], x["place"])

    def beaten(x, i):
        # one window a place, so those that overlap are at most ``longest`` steps away
        around = F.slice("found", F.greatest(F.lit(1), i + 1 - longest), F.lit(2 * longest + 1))
        return F.exists(around, lambda y: (y["place"] <= x["end"]) & (y["end"] >= x["place"]) & (goodness(y) < goodness(x)))

    kept = src.select("id", F.explode(F.filter("found", lambda x, i: ~beaten(x, i))).alias("t"))
    return kept.select("id", F.lit("window").alias("kind"), F.col("t.place").alias("unit"), "t.license", (-F.col("t.low")).alias("dice"))


def license_notices(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, notices=NOTICES, titles=TITLES
) -> DataFrame:
    """(id, kind, unit, license, dice): the best template of every unit that reaches the threshold.

    ``kind`` is line, block or window, ``unit`` its number in the text from 0, of a window the
    number of its first word.  A template's bigrams are a set; a unit's repeated bigrams count in its
    size, and match once.  ``titles`` are compared with whole lines and blocks only.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = F.col("text")
    return _whole_units(docs, text, threshold, (*notices, *titles)).unionByName(_windows(docs, text, threshold, notices))
