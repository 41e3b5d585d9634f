"""License scans: normalised text against licence templates by Dice over word bigrams, in DataFrame operations only.

A unit is a line, a paragraph or the whole text. Its bigrams are compared with a template's only if their numbers could
reach the wanted likeness at all: with ``a`` and ``b`` distinct bigrams, Dice is at most ``2 min(a, b) / (a + b)``. Each
document is scanned where it is read; nothing is shuffled.

:func:`find_notices` looks inside the units: it compares word windows at any place of a text with notices and full texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

LEAST_DICE = 0.8

# The usual wordings of public licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 2-Clause License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

_BREAKS = r"[^\\p{L}\\p{N}]+"  # as written inside a SQL literal


def _bigrams(text: str) -> str:
    """SQL for the distinct word bigrams of an expression."""
    words = f"filter(split(lower({text}), '{_BREAKS}'), w -> w <> '')"
    return f"transform(array({words}), v -> array_distinct(zip_with(slice(v, 1, greatest(size(v) - 1, 0)), slice(v, 2, size(v)), (a, b) -> concat(a, ' ', b))))[0]"


def scan_licenses(
    docs: DataFrame, text: str = "text", least: float = LEAST_DICE, templates: Mapping[str, tuple[str, ...]] = TEMPLATES
) -> DataFrame:
    """``docs`` with ``license_matches`` (an array of license, kind, unit, dice), ``license`` and ``dice`` of the best match.

    ``kind`` is line, paragraph or text and ``unit`` its place from 0. A unit matches the templates whose Dice likeness on
    distinct bigrams of lower-case words is ``least`` or more. Ties of the best go to the first licence by name. Null and
    empty texts and units of fewer than two words match nothing; repeated rows each have theirs; an empty table gives
    no rows. Columns of these names are replaced; all others stay.
    """
    quoted = [
        f"struct('{name}' as license, {_bigrams(chr(39) + part.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39)) + chr(39))} as grams)"
        for name, parts in sorted(templates.items()) for part in parts
    ]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("license_matches", "license", "dice")]).alias("_row")
    kept = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.expr(f"array({', '.join(quoted)})").alias("_templates"))
    # The templates' bigrams are constant; their numbers bound the size of units worth a comparison.
    low, high = least / (2 - least), (2 - least) / least
    units = F.expr(
        r"""concat(
          transform(split(_text, '\\n'), (x, i) -> struct('line' as kind, i as unit, x as body)),
          case when _text rlike '\\n\\s*\\n' then transform(split(_text, '\\n\\s*\\n'), (x, i) -> struct('paragraph' as kind, i as unit, x as body))
               else array() end,
          case when instr(_text, '\n') > 0 then array(struct('text' as kind, 0 as unit, _text as body)) else array() end)"""
    )
    grams = F.expr(f"transform(_units, u -> struct(u.kind as kind, u.unit as unit, {_bigrams('u.body')} as grams))")
    compared = F.expr(
        f"""flatten(transform(_grams, u -> transform(
          filter(_templates, t -> size(u.grams) > 0 and size(u.grams) >= {low} * size(t.grams) and size(u.grams) <= {high} * size(t.grams)),
          t -> struct(u.kind as kind, u.unit as unit, t.license as license,
            2.0D * size(array_intersect(u.grams, t.grams)) / (size(u.grams) + size(t.grams)) as dice))))"""
    )
    matched = (
        kept.withColumn("_units", units).withColumn("_grams", grams)
        .withColumn("license_matches", F.filter(compared, lambda m: m["dice"] >= least))
        .withColumn("_best", F.expr("array_min(transform(license_matches, m -> struct(-m.dice as d, m.license as license)))"))
    )
    return matched.select("_row.*", "license_matches", F.col("_best.license").alias("license"), (-F.col("_best.d")).alias("dice"))


# Further public notices that windows are compared with. The opening of the BSD texts names no version.
NOTICES: dict[str, tuple[str, ...]] = {
    **{name: parts for name, parts in TEMPLATES.items() if name != "BSD-2-Clause"},
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Apache-2.0": (*TEMPLATES["Apache-2.0"], "Released under the Apache License, Version 2.0.", "Apache License, Version 2.0"),
    "BSD": (TEMPLATES["BSD-2-Clause"][0],),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License.", "BSD 2-Clause License"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0": (
        *TEMPLATES["GPL-2.0"], "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (*TEMPLATES["GPL-3.0"], "Licensed under the GNU General Public License, version 3."),
    "ISC": (*TEMPLATES["ISC"], "Released under the ISC License.", "Licensed under the ISC License."),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",),
    "MIT": (*TEMPLATES["MIT"], "Licensed under the MIT License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",),
}


@cache
def full_texts() -> dict[str, str]:
    """The full licence texts beside this module, by licence."""
    return {path.stem: path.read_text(encoding="utf-8") for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _words(text: str) -> list[str]:
    """Lower-case words of a template, which is ASCII; British and American spellings count as one."""
    return [w.replace("licenc", "licens") for w in re.findall(r"[a-z0-9]+", text.lower())]


def _need(grams: int, least: float) -> int:
    """Fewest bigrams a window must share with a template of ``grams`` distinct ones: it has no fewer than it shares."""
    return math.ceil(least * grams / (2 - least) - 1e-9)


def find_notices(
    docs: DataFrame, text: str = "text", least: float = LEAST_DICE,
    notices: Mapping[str, tuple[str, ...]] = NOTICES, texts: Mapping[str, str] | None = None,
) -> DataFrame:
    """``docs`` with ``license_notices`` (an array of license, start, words, dice), ``license`` and ``dice`` of the best.

    A template of ``n`` words is compared with every window of ``n`` words (fewer at the end of the text) that begins
    with one of its bigrams, wherever line breaks fall; ``start`` counts words from 0. Of overlapping windows with
    ``least`` or more, only the one sharing most bigrams stays (then the higher Dice, the licence by name, the earlier
    place), so a whole text wins over a notice quoted in it. ``license`` is that of the notice sharing most. Templates
    that share too few bigrams with the whole text to reach ``least`` anywhere are left out first, without loss.
    """
    parts = [(name, part) for name, group in sorted(notices.items()) for part in group]
    parts += list((full_texts() if texts is None else texts).items())
    made, every = [], set()
    for name, part in parts:
        words = _words(part)
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        if not grams:
            raise ValueError(f"a template of {name} has fewer than two words")
        every.update(grams)
        made.append(f"struct('{name}' as license, {len(words)} as words, {_need(len(grams), least)} as need, split('{'|'.join(grams)}', '[|]') as grams)")
    known = ", ".join(f"'{g}'" for g in sorted(every))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("license_notices", "license", "dice")]).alias("_row")
    in_order = f"""transform(array(filter(split(replace(lower(_text), 'licenc', 'licens'), '{_BREAKS}'), w -> w <> '')),
        v -> zip_with(slice(v, 1, greatest(size(v) - 1, 0)), slice(v, 2, size(v)), (a, b) -> concat(a, ' ', b)))[0]"""
    places = f"filter(transform(_grams, (g, i) -> struct(if(g in ({known}), i, -1) as i, g as g)), p -> p.i >= 0)"
    admitted = f"filter(array({', '.join(made)}), t -> size(_hits) >= t.need and size(array_intersect(t.grams, _hits)) >= t.need)"
    # A start needs its template's bigrams at enough places of the window before distinct ones are counted.
    windows = """flatten(transform(_admitted, t -> transform(
        array(transform(filter(_places, p -> array_contains(t.grams, p.g)), p -> p.i)), at -> transform(
          filter(at, (s, i) -> i + t.need <= size(at) and at[i + t.need - 1] < s + t.words - 1),
          s -> transform(array(array_distinct(slice(_grams, s + 1, t.words - 1))), w -> transform(
            array(size(array_intersect(w, t.grams))), n -> struct(-n as less, -2.0D * n / (size(w) + size(t.grams)) as d,
              t.license as license, s as start, least(t.words, size(_grams) + 1 - s) as words))[0])[0]))[0]))"""
    reached = F.array_sort(F.filter(F.expr(windows), lambda m: -m["d"] >= least))
    apart = """aggregate(_reached, slice(_reached, 1, 0), (a, m) ->
        if(exists(a, o -> o.start < m.start + m.words and m.start < o.start + o.words), a, array_append(a, m)))"""
    notices_of = """array_sort(transform(_apart, m -> struct(m.license as license, m.start as start, m.words as words, -m.d as dice)),
        (a, b) -> a.start - b.start)"""
    found = (
        docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .withColumn("_grams", F.expr(in_order))
        .withColumn("_places", F.expr(places))
        .withColumn("_hits", F.expr("array_distinct(transform(_places, p -> p.g))"))
        .withColumn("_admitted", F.expr(admitted))
        .withColumn("_reached", reached)
        .withColumn("_apart", F.expr(apart))
    )
    best = F.expr("try_element_at(_apart, 1)")
    return found.select("_row.*", F.expr(notices_of).alias("license_notices"), best["license"].alias("license"), (-best["d"]).alias("dice"))
