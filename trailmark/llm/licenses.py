"""License scans: windows of a text's normalised words compared to license templates by word bigrams.

The whole text is normalised to words, whatever its lines and comment marks. Dice's coefficient over
bigrams reaches d only if enough of a template's m bigrams are there: ceil(m*d/(2-d)) at least, whatever
the window's size, and so one of any m - ceil(m*d/(2-d)) + 1. So many of the rarest ones, the template's
anchors, are looked up in the text, and the template is compared with the window that lays it over an
anchor's place. Bounds of size prune windows that the text's end cuts too short. Texts without a word
that begins an anchor are left at once, and so are those that hold no anchor's two words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices as projects word them, headers of source files, and bodies of short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause body": """
        Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the
        above copyright notice, this list of conditions and the following disclaimer. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """
        Use of this source code is governed by a BSD-style license that can be found in the LICENSE
        file.""",
    "BSD-3-Clause third clause": """
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse
        or promote products derived from this software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC body": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear
        in all copies.""",
    "MIT": "Released under the MIT License.",
    "MIT body": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT.""",
    "MPL-2.0": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.""",
}
MIN_DICE = 0.8


def template_words(text: str) -> list[str]:
    """The normalised words of a template: letters and digits of ASCII, in lower case."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def bigrams(words: list[str]) -> list[str]:
    """Bigrams of words, equal ones numbered."""
    seen: Counter[str] = Counter()
    found = []
    for pair in map(" ".join, zip(words, words[1:])):
        seen[pair] += 1
        found.append(f"{pair} {seen[pair]}")
    return found


def anchors(words: list[str], min_dice: float = MIN_DICE) -> list[tuple[str, int]]:
    """(bigram, place) of the bigrams of which any window that reaches `min_dice` holds one.

    A window of n bigrams shares d * (n + m) / 2 of them at least, and n is at least m * d / (2 - d).
    Bigrams that begin with a long word stand for rare ones.
    """
    pairs = [(f"{a} {b}", i) for i, (a, b) in enumerate(zip(words, words[1:]))]
    needed = len(pairs) - math.ceil(len(pairs) * min_dice / (2 - min_dice)) + 1
    rare = sorted(pairs, key=lambda pair: (-len(pair[0].split()[0]), -len(pair[0]), pair))
    return sorted(rare[:needed], key=lambda pair: pair[1])


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _numbered_bigrams(words: Column) -> Column:
    """As `bigrams`, for a short array of two words at least."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
    )

    def numbered(every: Column) -> Column:
        again = F.transform(
            every,
            lambda pair, i: F.concat_ws(
                " ", pair, F.size(F.filter(F.slice(every, F.lit(1), i + 1), lambda p: p == pair))
            ),
        )
        once = F.transform(every, lambda pair: F.concat_ws(" ", pair, F.lit("1")))
        return F.when(F.size(F.array_distinct(every)) == F.size(every), once).otherwise(again)

    # Bound as a lambda's argument, so that the pairs are made once.
    return F.flatten(F.transform(F.array(pairs), numbered))


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    min_dice: float = MIN_DICE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """License templates found in each text, by Dice's coefficient over word bigrams.

    A text becomes words of ASCII letters and digits in lower case; all else parts words. A bigram
    counts as often as it occurs. Windows have as many words as the template, begin at the text's
    beginning at the earliest and are shorter only at its end; one of n bigrams is compared with a
    template of m if n lies between m*d/(2-d) and m*(2-d)/d.

    Returns, for each row, the id, `n_words`, `n_windows` (windows that an anchor points to) and
    `matches`, an array of (license, dice, word): each template of which a window reaches `min_dice`, by
    name, with the best window, of equal ones the first, and the place of its first word from 0. A null
    or empty text has no words. Rows are independent: repeated ids or rows give as many results, null
    ids are kept, other columns are ignored. Work per row; nothing is shuffled.
    """
    known = {name: template_words(text) for name, text in sorted(templates.items())}
    if not known or min(map(len, known.values())) < 2 or not 0 < min_dice <= 1:
        raise ValueError("templates need two words at least, and min_dice lies in (0, 1]")
    places: dict[str, list[dict[str, int]]] = {}
    for at, words in enumerate(known.values()):
        for pair, offset in anchors(words, min_dice):
            places.setdefault(pair, []).append({"t": at, "o": offset})
    # Constants, which the optimizer folds into literals.
    template = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(len(words) - 1).alias("m"),
                _texts(bigrams(words)).alias("grams"),
            )
            for name, words in known.items()
        ]
    )
    points = [
        F.array(*[F.struct(F.lit(a["t"]).alias("t"), F.lit(a["o"]).alias("o")) for a in found])
        for found in places.values()
    ]
    pairs, pointed = _texts(list(places)), F.array(*points)
    begins = _texts(sorted({pair.split()[0] for pair in places}))

    # Two capitals beyond ASCII have small letters within it: they part words as all such letters do.
    parted = F.replace(F.replace(text_column, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" "))
    small = F.coalesce(F.lower(parted), F.lit(""))
    follow: dict[str, list[str]] = {}
    for pair in places:
        first, second = pair.split()
        follow.setdefault(first, []).append(second)

    def held(word: str) -> Column:
        return F.contains("_small", F.lit(word))

    # Searches of the text stop at the first hit and make no strings, which lists of bigrams would.
    likely = reduce(
        or_, [held(first) & reduce(or_, map(held, seconds)) for first, seconds in follow.items()]
    )

    def windows_from(i: Column) -> Column:
        pair = F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1))
        at = F.when(F.array_contains(begins, F.get("_words", i)), F.array_position(pairs, pair))
        return F.transform(
            F.get(pointed, F.nullif(at, F.lit(0)).cast("int") - 1),
            lambda a: F.struct(a["t"].alias("t"), F.greatest(i - a["o"], F.lit(0)).alias("word")),
        )

    size = F.size("_words")
    found = F.flatten(
        F.filter(
            F.transform(F.sequence(F.lit(0), size - 2), windows_from), lambda w: w.isNotNull()
        )
    )
    none = F.array().cast("array<struct<t:int,word:int>>")
    windows = F.when(
        (size > 1) & F.arrays_overlap("_words", begins) & likely, F.array_sort(F.array_distinct(found))
    ).otherwise(none)

    def scored(window: Column) -> Column:
        sheet = F.get(template, window["t"])
        words = F.slice("_words", window["word"] + 1, sheet["m"] + 1)
        n, m = F.size(words) - 1, sheet["m"]
        # Compared as products, so that a bound is met exactly.
        fits = (n * (2 - min_dice) >= m * min_dice) & (n * min_dice <= m * (2 - min_dice)) & (n > 0)
        both = F.size(F.array_intersect(_numbered_bigrams(words), sheet["grams"]))
        dice = F.when(fits, both * 2.0 / (n + m)).otherwise(F.lit(0.0))
        return F.struct(dice.alias("dice"), (-window["word"]).alias("back"), window["t"].alias("t"))

    words_of = F.array_remove(F.split("_small", "[^a-z0-9]+"), "")
    prepared = (
        docs.select(F.col(id_column).alias("_id"), small.alias("_small"))
        .select("_id", "_small", words_of.alias("_words"))
        .select(
            "_id", F.size("_words").cast("long").alias("n_words"), "_words", windows.alias("_windows")
        )
    )
    reached = F.filter(F.transform("_windows", scored), lambda s: s["dice"] >= min_dice)
    # Bound as a lambda's argument: a column named inside a lambda is computed for each of its calls.
    best = F.flatten(
        F.transform(
            F.array("_reached"),
            lambda every: F.transform(
                F.sequence(F.lit(0), F.lit(len(known) - 1)),
                lambda t: F.array_max(F.filter(every, lambda s: s["t"] == t)),
            ),
        )
    )
    matches = F.transform(
        F.filter(best, lambda s: s.isNotNull()),
        lambda s: F.struct(
            F.get(template, s["t"])["name"].alias("license"),
            s["dice"].alias("dice"),
            (-s["back"]).cast("long").alias("word"),
        ),
    )
    return prepared.select("*", reached.alias("_reached")).select(
        F.col("_id").alias(id_column),
        "n_words",
        F.size("_windows").cast("long").alias("n_windows"),
        matches.alias("matches"),
    )
