"""License scan: spans of a text against license templates by the Dice coefficient over word bigrams.

DataFrame functions only, and no shuffle. A span begins and ends with a bigram of the template and is at most as many
words long, wherever it stands: inside a longer line, or over several. Two bounds prune without losing a hit, as spans
at Dice t share at least t / (2 - t) of the template's bigrams: texts that hold none of the words and bigrams that such a
share must touch are passed over, and templates are compared only with spans of an admitted size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# Common license notices, by SPDX-like name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-short": "Licensed under the GNU General Public License v3.0.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-short": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "rights-reserved": "Copyright. All rights reserved.",
    "rights-reserved-short": "All rights reserved.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0-short": "Licensed under the Apache License 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "GPL-2.0-work": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "ISC-short": "Licensed under the ISC License.",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT-project": "This project is released under the MIT License.",
    "MIT-project-licensed": "This project is licensed under the MIT License.",
    "MIT-grant-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-disclaimer": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "MIT-disclaimer": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.',
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ASF-header": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "WTFPL-notice": "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
}
# What licenses are called in a sentence, by SPDX identifier.
CALLED = {
    "MIT": ("the MIT License", "MIT License", "the MIT"), "Apache-2.0": ("the Apache License, Version 2.0", "the Apache 2.0 License", "Apache License 2.0", "Apache 2.0"), "ISC": ("the ISC License", "ISC License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License", "the 2-Clause BSD License"), "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"), "BSD": ("the BSD License", "a BSD-style License", "BSD license"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPLv2", "GPLv2", "GPL-2.0"), "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPLv3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "the LGPLv2.1", "LGPL 2.1"), "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "the LGPLv3", "LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "the AGPLv3", "AGPLv3"), "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "MPL 2.0"), "MPL-1.1": ("the Mozilla Public License 1.1",),
    "EPL-1.0": ("the Eclipse Public License v1.0",), "EPL-2.0": ("the Eclipse Public License v2.0", "the Eclipse Public License 2.0"), "BSL-1.0": ("the Boost Software License 1.0", "the Boost Software License"), "Zlib": ("the zlib License", "the zlib/libpng license"), "Unlicense": ("the Unlicense",), "CC0-1.0": ("CC0", "CC0 1.0", "the CC0 1.0 Universal"),
    "Artistic-2.0": ("the Artistic License 2.0",), "OFL-1.1": ("the SIL Open Font License, Version 1.1",), "EUPL-1.2": ("the EUPL 1.2", "the European Union Public Licence"), "WTFPL": ("the WTFPL",), "PostgreSQL": ("the PostgreSQL License",),
}
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.0": "Generic"}
SPDX = (
    *(i for i in CALLED if i not in ("BSD", "MIT", "Apache-2.0") and "GPL" not in i), *(f"{i}-{k}" for i in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for k in ("only", "or-later")),
    "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MIT-0", "0BSD", "BSD-3-Clause-Clear", "LGPL-2.0-only", "LGPL-2.0-or-later", *(f"CC-{c}-{v}" for c in CC_TERMS for v in ("4.0", "3.0")),
)
DICE = 0.8
#: Ends of a template's name that tell a wording of the same license.
WORDINGS = ("-notice", "-licensed", "-header", "-short", "-work", "-grant", "-grant-full", "-project", "-project-licensed", "-disclaimer", "-only", "-or-later")
#: Words of names that tell nothing.
PLAIN = "by the a license licence version public general foundation software style new open font or later only clear gnu"
#: Templates of so many words are short: what tells them from other licenses is in a few words.
SHORT = 16


def license_of(name: str) -> str:
    """The license that a template is a wording of."""
    out = name.split(" ")[0].removeprefix("SPDX-")
    while any(out.endswith(w) for w in WORDINGS):
        out = next(out[: -len(w)] for w in WORDINGS if out.endswith(w))
    return out


def words_of(text: str) -> list[str]:
    """Words of a template, normalised as normalised() does."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _pack() -> dict[str, str]:
    """TEMPLATES, and by rule: identifiers, names after `under`, and Creative Commons terms and versions."""
    pack = dict(TEMPLATES)
    pack |= {f"SPDX-{i}": f"SPDX-License-Identifier: {i}" for i in SPDX}
    pack |= {f"{i} ({name})": f"under {name}" for i, names in CALLED.items() for name in names}
    for code, long in CC_TERMS.items():
        for v, kind in CC_VERSIONS.items():
            pack |= {f"CC-{code}-{v} (code)": f"CC {code} {v}", f"CC-{code}-{v} (terms)": f"Creative Commons {long} {v} {kind} License", f"CC-{code}-{v} (license)": f"Creative Commons {long} License {v}"}
    seen, out = set(), {}
    for name, text in pack.items():
        if tuple(words_of(text)) not in seen:
            seen.add(tuple(words_of(text)))
            out[name] = text
    return out


def telling(templates: dict[str, str]) -> dict[str, tuple[list[str], list[str]]]:
    """Of each template the words that a span must hold and those that it must not, so that the license is told, too, where
    templates share all else. Only words of names and numbers tell: those of a short template that no other license has, and its first number,
    those that a near template of another license lacks (must), and words, not numbers, that such a template adds (never)."""
    names = {w for text in (*(n for ns in CALLED.values() for n in ns), *CALLED, *SPDX, *CC_TERMS, *CC_TERMS.values()) for w in words_of(text)} - set(PLAIN.split())
    words = {k: {w for w in words_of(v) if w in names or any(c.isdigit() for c in w)} for k, v in templates.items()}
    grams = {k: set(bigrams_of(v)) for k, v in templates.items()}
    others: dict[str, set[str]] = {}  # the licenses that have a word
    for k, own in words.items():
        for w in own:
            others.setdefault(w, set()).add(license_of(k))
    out = {}
    for k in templates:
        must: set[str] = set()
        if len(words_of(templates[k])) <= SHORT:
            numbers = [w for w in words_of(templates[k]) if any(c.isdigit() for c in w)]
            must = {w for w in words[k] if others[w] == {license_of(k)}} | set(numbers[:1])
        never: set[str] = set()
        for b in templates:
            if license_of(b) != license_of(k) and 4 * len(grams[k] & grams[b]) >= len(grams[k]) + len(grams[b]):
                must |= words[k] - words[b]
                never |= {w for w in words[b] - words[k] if w.isalpha()}
        out[k] = sorted(must), sorted(never)
    return out


def needed(templates: dict[str, str], dice: float, long: int = 6) -> list[str]:
    """Words and bigrams of which a text with a hit holds at least one: of each template its longest words of at least
    `long` letters, then its longest bigrams, until a span without any of them would share too few bigrams."""
    chosen: set[str] = set()
    for text in templates.values():
        grams = bigrams_of(text)
        spare = len(grams) - math.ceil(dice / (2 - dice) * len(grams) - 1e-9)
        words = sorted({w for w in words_of(text) if len(w) >= long} - chosen, key=lambda w: (len(w), w))
        rest = sorted(grams, key=lambda g: (len(g), g)) + words
        while sum(g in chosen or not chosen.isdisjoint(g.split()) for g in grams) <= spare:
            chosen.add(rest.pop())
    return sorted(chosen)


PACK = _pack()


def normalised(text: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 is one space. Accented letters are such
    characters too, which only splits words of languages that no template has."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_hits (stretches of overlapping spans at or above `dice` with some template; of the spans that begin at
    one word the best counts), and of the best span its license, score, first_word and n_words (ties: the longer span,
    the smaller name, the earlier span), for every row of docs.

    Null and empty texts have no spans: zero hits, nulls for the best. Templates without a bigram are an error.
    Very long texts are scanned whole. Repeated rows are rows of their own; other columns are ignored. Empty table:
    empty. The templates are literals of the plan: a parameter of bounded size, not data.
    """
    chosen = templates or PACK
    told = telling(chosen)
    sets = {k: bigrams_of(v) for k, v in chosen.items()}
    if any(not s for s in sets.values()):
        raise ValueError("a template needs two words")
    known = sorted({b for s in sets.values() for b in s})
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(len(words_of(chosen[k])) - 1).alias("most"), F.array(*[F.lit(b) for b in s]).alias("grams"), *[F.array(*[F.lit(w) for w in ws]).cast("array<string>").alias(n) for n, ws in zip(("must", "never"), told[k], strict=True)]) for k, s in sorted(sets.items())])

    def pairs(words: Column) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))

    def scored(words: Column, span: Column, t: Column, start: Column) -> Column:
        """The span up to its last bigram of t, if t admits its size and it has the words that tell t's license."""
        last = F.array_max(F.transform(span, lambda g, k: F.when(F.array_contains(t["grams"], g), k + 1)))

        def score(n: Column, own: Column) -> Column:
            size, full = F.size(own), F.size(t["grams"])
            value = F.struct((-2.0 * F.size(F.array_intersect(own, t["grams"])) / (size + full)).alias("minus"), (-n).alias("short"), t["name"].alias("name"), start.alias("start"), (start + n).alias("end"))
            held = F.slice(words, start + 1, n + 1)
            told = (F.size(F.array_intersect(held, t["must"])) == F.size(t["must"])) & ~F.arrays_overlap(held, t["never"])
            return F.when((size >= dice / (2 - dice) * full - 1e-9) & (size <= (2 - dice) / dice * full + 1e-9) & told, value)

        return _let(last, lambda n: _let(F.array_distinct(F.slice(span, 1, n)), lambda own: score(n, own)))

    def best_at(words: Column, grams: Column, start: Column) -> Column:
        some = F.filter(table, lambda t: F.array_contains(t["grams"], F.get(grams, start)))
        return F.array_min(F.filter(F.transform(some, lambda t: scored(words, F.slice(grams, start + 1, t["most"]), t, start)), lambda x: x["minus"] <= -dice))

    def hits(words: Column, grams: Column) -> Column:
        starts = F.filter(F.transform(grams, lambda g, i: F.when(g.isin(known), i)), lambda i: i.isNotNull())
        return F.filter(F.transform(starts, lambda i: best_at(words, grams, i)), lambda x: x.isNotNull())

    may = F.lit(False)
    for w in needed(chosen, dice):
        may = may | F.contains(F.col("plain"), F.lit(w))
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("plain"))
    found = texts.select("doc_id", F.when(may, _let(F.split("plain", " "), lambda w: _let(pairs(w), lambda g: hits(w, g)))).alias("hits"))
    stretch = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    count = F.aggregate("hits", stretch, lambda a, h: F.struct((a["n"] + (h["start"] > a["end"]).cast("long")).alias("n"), F.greatest(a["end"], h["end"]).alias("end")), lambda a: a["n"])
    best = found.select("doc_id", F.coalesce(count, F.lit(0).cast("long")).alias("n_hits"), F.array_min("hits").alias("best"))
    return best.select("doc_id", "n_hits", F.col("best.name").alias("license"), F.round(-F.col("best.minus"), 6).alias("score"), F.col("best.start").cast("long").alias("first_word"), (F.col("best.end") - F.col("best.start") + 1).cast("long").alias("n_words"))


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents."""
    return license_scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    told, listed = telling(PACK), lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"('{k}', {len(words_of(v)) - 1}, {listed(bigrams_of(v))}, {listed(told[k][0])}, {listed(told[k][1])})" for k, v in sorted(PACK.items()))
    return rf"""
WITH t(name, most, grams, must, never) AS (VALUES {rows}),
k AS (SELECT name, unnest(grams) AS b FROM t),
n AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM n),
e AS (SELECT r, unnest(g) AS b, unnest(range(len(g))) AS p FROM g),
s AS (SELECT e.r, e.p, t.name, t.most, len(t.grams) AS size FROM e JOIN k USING (b) JOIN t USING (name)),
o AS (SELECT r, p, name, size, p + unnest(range(most)) AS q FROM s),
x AS (SELECT o.r, o.p, o.name, o.size, o.q, e.b, k.b IS NOT NULL AS known FROM o JOIN e ON e.r = o.r AND e.p = o.q LEFT JOIN k ON k.name = o.name AND k.b = e.b),
m AS (SELECT *, max(CASE WHEN known THEN q END) OVER (PARTITION BY r, p, name) AS last FROM x),
d AS (SELECT r, p, name, any_value(last) AS last, 2.0::DOUBLE * count(DISTINCT CASE WHEN known THEN b END) / (count(DISTINCT b) + any_value(size)) AS dice FROM m WHERE q <= last GROUP BY r, p, name),
h AS (SELECT r, p, name, dice, last + 1 AS ends FROM d JOIN n USING (r) JOIN t USING (name) WHERE dice >= {DICE} AND list_has_all(w[p + 1:last + 2], must) AND NOT list_has_any(w[p + 1:last + 2], never) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY dice DESC, last DESC, name) = 1),
c AS (SELECT *, p > coalesce(max(ends) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS first FROM h),
a AS (SELECT r, count(*) FILTER (first) AS n_hits FROM c GROUP BY r),
best AS (SELECT r, name, dice, p, ends FROM h QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, ends - p DESC, name, p) = 1)
SELECT n.doc_id, coalesce(a.n_hits, 0) AS n_hits, best.name AS license, round(best.dice, 6) AS score, best.p AS first_word, best.ends - best.p + 1 AS n_words
FROM n LEFT JOIN a USING (r) LEFT JOIN best USING (r)
"""


ORACLE = _oracle()
