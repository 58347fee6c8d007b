"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Text is lower-cased, and every run of other characters than letters, digits and line feeds becomes one blank. Units
are the different lines of a text, the whole text, and passages of the text with line feeds as blanks. With a and b bigrams, repeats counted, a unit and a template have
the Dice coefficient 2 * common / (a + b); it can reach t only if b * t / (2 - t) <= a <= b * (2 - t) / t. So units
that fit no template's bounds are dropped by their number of blanks before they are cut into words, and each other unit
meets only the templates whose bounds it fits.

A template of which no line and not the whole text reaches t is looked for in passages: it counts once, with the best
of them. A passage that reaches t has at least b * t / (2 - t) bigrams of the template; so a text that has none of a set
of more than the other bigrams is passed over, and passages begin and end at bigrams of the template. For templates of
up to EXACT bigrams these are all such passages; for longer ones (whole licence texts) begin and end go in steps of 1 / STEPS
of the template among its bigrams in the text, so a passage inside a longer text that reaches t by less than about that is missed.

All is one projection over the rows: no shuffle, no hot group, and the
templates, a small list given by the caller, are a literal.

DataFrame functions only. Defined cases: null text is empty; a unit of less than two words has no bigram and
meets no template; repeated rows give repeated results; a row without a hit has no result row; other columns are ignored.
"""

from __future__ import annotations

import math
import pkgutil
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Short public notices by which texts name their licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Whole licence texts, in the folder texts; they are met as passages only.
WHOLE = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0"]
EXACT, STEPS = 128, 32


def whole_texts() -> list[tuple[str, str]]:
    return [(name, pkgutil.get_data("taintgrid.llm", f"texts/{name}.txt").decode()) for name in WHOLE]


def normalised(text: Column) -> Column:
    """Lower case, one blank for each run of other characters, line feeds kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def strings(values: list[str]) -> Column:
    """Array literal, folded from one string."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.array().cast("array<string>")


def passage_literal(templates: list[tuple[str, str]], threshold: float) -> tuple[Column, Column]:
    """Array of structs: place and licence of a template, n bigrams, least and most bigrams of the template in a passage
    that can fit, least number of different ones, step, different pairs, those held once, those held more often and how often;
    and pairs of which each text with such a passage has at least one."""
    rows, signs = [], set()
    for at, (name, text) in enumerate(templates):
        words = words_of(text)
        n = len(words) - 1
        pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
        least, most = math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)
        own = 0
        for pair in sorted(pairs, key=lambda p: (-len(p), p)):
            if own > n - least:
                break
            own += pairs[pair]
            signs.add(pair)
        often = sorted(p for p, k in pairs.items() if k > 1)
        rows.append(F.struct(
            F.lit(at).alias("at"), F.lit(name).alias("licence"), F.lit(n).alias("n"), F.lit(least).alias("least"), F.lit(most).alias("most"),
            F.lit(max(1, len(pairs) - (n - least))).alias("different"), F.lit(1 if n <= EXACT else math.ceil(n / STEPS)).alias("step"),
            strings(sorted(pairs)).alias("pairs"), strings(sorted(p for p, k in pairs.items() if k == 1)).alias("once"),
            strings(often).alias("often"), strings([str(pairs[p]) for p in often]).cast("array<int>").alias("times")))
    return F.array(*rows), strings(sorted(signs))


def template_literal(templates: list[tuple[str, str]], threshold: float) -> Column:
    """Array of structs: place and licence of a template, n bigrams, lo and hi (numbers of bigrams that fit), pairs with their counts."""
    rows = []
    for at, (name, text) in enumerate(templates):
        words = words_of(text)
        pairs = Counter(zip(words, words[1:], strict=False))
        n = len(words) - 1
        if n > 0:
            rows.append(F.struct(
                F.lit(at).alias("at"), F.lit(name).alias("licence"), F.lit(n).alias("n"),
                F.lit(n * threshold / (2 - threshold)).alias("lo"), F.lit(n * (2 - threshold) / threshold).alias("hi"),
                F.array(*[F.struct(F.lit(f"{a} {b}").alias("pair"), F.lit(k).alias("k")) for (a, b), k in pairs.items()]).alias("pairs")))
    return F.array(*rows)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice (the best of the row's units and the licence's templates) and hits (pairs of a unit and a
    template that reach the threshold; of passages, one for a template), for each row and licence with a hit."""
    given = [t for t in (TEMPLATES if templates is None else templates) if len(words_of(t[1])) > 1]
    empty = docs.select("doc_id", F.lit("").alias("licence"), F.lit(0.0).alias("dice"), F.lit(0).cast("bigint").alias("hits")).where(F.lit(False))
    if not given:
        return empty
    table = template_literal(given, threshold)
    passages, signs = passage_literal(given + (whole_texts() if templates is None else []), threshold)
    blanks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    fits = lambda size: let(size, lambda n: F.exists(table, lambda t: (n >= t["lo"]) & (n <= t["hi"])))

    def pairs(unit: Column) -> Column:
        return let(F.split(unit, " "), lambda w: F.zip_with(
            F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    def dice(own: Column, t: Column) -> Column:
        common = F.aggregate(t["pairs"], F.lit(0), lambda n, q: n + F.least(q["k"], F.size(F.filter(own, lambda x: x == q["pair"]))))
        return 2.0 * common / (F.size(own) + t["n"])

    def units(lines: Column) -> Column:
        whole = F.aggregate(lines, F.lit(-1), lambda n, x: n + F.when(x == "", 0).otherwise(blanks(x) + 1))
        every = F.when(fits(whole), F.array(F.array_join(F.filter(lines, lambda x: x != ""), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.filter(lines, lambda x: fits(blanks(x)) & (x != "")), every))

    def hits(unit: Column) -> Column:
        return let(pairs(unit), lambda own: F.filter(F.transform(
            F.filter(table, lambda t: (F.size(own) >= t["lo"]) & (F.size(own) <= t["hi"])),
            lambda t: F.struct(t["at"].alias("at"), t["licence"].alias("licence"), dice(own, t).alias("dice"))), lambda h: h["dice"] >= threshold))

    def passage_dice(own: Column, t: Column) -> Column:
        """Best Dice of the template's passages, null without one that can reach the threshold."""
        def measured(unit: Column) -> Column:
            held = let(F.filter(unit, lambda x: F.array_contains(t["often"], x)), lambda m: F.aggregate(
                F.zip_with(t["often"], t["times"], lambda p, k: F.least(k, F.size(F.filter(m, lambda x: x == p)))), F.lit(0), lambda n, k: n + k))
            return 2.0 * (F.size(F.array_intersect(t["once"], unit)) + held) / (F.size(unit) + t["n"])

        def spans(at: Column) -> Column:
            last = F.size(at) - 1

            def ends(i: Column) -> Column:
                low, high = i + t["least"] - 1, F.least(last, i + t["most"] - 1)
                return F.transform(F.filter(
                    F.array_distinct(F.concat(F.sequence(low, high, t["step"]), F.array(high))),
                    lambda j: 2.0 * (j - i + 1) >= threshold * (F.get(at, j) - F.get(at, i) + 1 + t["n"]) - 1e-9),
                    lambda j: F.struct(F.get(at, i).alias("a"), F.get(at, j).alias("b")))

            starts = F.sequence(F.lit(0), last - t["least"] + 1, t["step"])
            return F.when(F.size(at) >= t["least"], F.flatten(F.transform(starts, ends)))

        at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_contains(t["pairs"], F.get(own, i)))
        return let(at, lambda p: F.array_max(F.transform(spans(p), lambda s: measured(F.slice(own, s["a"] + 1, s["b"] - s["a"] + 1)))))

    def with_passages(lines: Column, found: Column) -> Column:
        """The hits, and one for each other template with a passage that reaches the threshold."""
        def more(own: Column) -> Column:
            left = F.filter(passages, lambda t: (F.size(own) >= t["least"]) & ~F.exists(found, lambda h: h["at"] == t["at"])
                            & (F.size(F.array_intersect(t["pairs"], own)) >= t["different"]))
            return F.filter(F.transform(left, lambda t: F.struct(t["at"].alias("at"), t["licence"].alias("licence"), passage_dice(own, t).alias("dice"))), lambda h: h["dice"] >= threshold)

        text = F.array_join(F.filter(lines, lambda x: x != ""), " ")
        return let(pairs(text), lambda own: F.when(F.arrays_overlap(own, signs), F.concat(found, more(own))).otherwise(found))

    def best(found: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(found, lambda h: h["licence"])), lambda name: let(
            F.filter(found, lambda h: h["licence"] == name), lambda own: F.struct(
                name.alias("licence"), F.array_max(F.transform(own, lambda h: h["dice"])).alias("dice"), F.size(own).cast("bigint").alias("hits"))))

    lines = F.transform(F.split(normalised(F.coalesce(F.col("text"), F.lit(""))), "\n"), lambda x: F.trim(x))
    found = let(lines, lambda x: let(let(F.flatten(F.transform(units(x), hits)), lambda h: with_passages(x, h)), best))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.licence", "x.dice", "x.hits")
