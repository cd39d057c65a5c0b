"""License scans by Dice similarity to notice templates, with DataFrame functions only.

A text is normalised (A-Z lowered, all but letters, digits and line feeds to a space) and cut into units: its lines, its
paragraphs, the sentences and clauses of its lines and paragraphs, and itself. Templates are short notices, standard headers and whole licenses. A unit is compared with a template by the Dice coefficient of their sets of word pairs. For a coefficient of ``t``
the sizes must lie within t / (2 - t) of each other, so a unit meets only the templates its size allows; most meet none. A unit
counts for its best template. A linked unit lacks few pairs of its template, so it has one of a few long words (the template's ``_cover``);
texts and units without any are passed over before pairs are made, and none is lost.

The opening paragraph of the BSD licenses tells nothing of its kind, and the third condition goes by several wordings: opening and whole text count as BSD-2-Clause where
the text has the second condition but no wording of the third.

Everything happens inside a row: no shuffle, no join, no Python. Templates are literals.

Defined results: null and empty texts have no units and no license. Equal units of a text count once. Ties go to the
first license by name. A unit of fewer than two words has no pairs and matches nothing. Repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

LEAST_DICE = 0.8

# Usual notices of common licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

BSD_OPENING = TEMPLATES[5][1]
# Fixed value: how the third condition of the BSD licenses begins.
BSD_THIRD = "neither the names? of|names? of [a-z0-9 ]{1,200} (?:may|must|shall) not be used"

# Standard headers, next to the notices.
HEADERS: list[tuple[str, str]] = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
MIT_END = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licenses. That of the AGPL is made from the GPL's, whose words it shares but for its name and one section."""
    read = lambda name: (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text()
    gpl, bsd = read("GPL-3"), read("BSD")
    third, end = bsd.index("3. Neither"), bsd.index("THIS SOFTWARE")
    affero = gpl.replace("GNU Affero", "GNU").replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")
    permission = next(t for name, t in TEMPLATES if name == "MIT" and t.startswith("Permission"))
    return (
        ("AGPL-3.0", affero), ("Apache-2.0", read("Apache-2.0")), ("BSD-2-Clause", bsd[:third] + bsd[end:]), ("BSD-3-Clause", bsd), ("GPL-2.0", read("GPL-2")),
        ("GPL-3.0", gpl), ("LGPL-3.0", read("LGPL-3")), ("MIT", f"MIT License {permission} {MIT_END}"), ("MPL-2.0", read("MPL-2.0")))


def _pairs(text: str) -> list[str]:
    words = "".join(c if c in string.ascii_lowercase + string.digits else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes of sets that can reach the coefficient with one of ``size``."""
    fits = [n for n in range(1, 2 * size + 2 + int(2 * size / least)) if 2 * min(n, size) >= least * (n + size)]
    return fits[0], fits[-1]


def _cover(pairs: list[str], low: int, least: float) -> list[str]:
    """Words of a template of which every unit that can match has one: they touch more pairs than such a unit may lack."""
    lacking = len(pairs) - math.ceil(least * (low + len(pairs)) / 2 - 1e-9)
    words, touched = [], set()
    for w in sorted({w for p in pairs for w in p.split()}, key=lambda w: (-len(w), w)):
        if len(touched) > lacking:
            break
        words.append(w)
        touched |= {p for p in pairs if w in p.split()}
    return words


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _normalised(lowered: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9\n]+", " "), " *\n *", "\n")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _units(low: Column, plain: Column) -> Column:
    joined = lambda x: F.trim(F.regexp_replace(x, "\n+", " "))
    words = lambda x: F.regexp_replace(x, "[^a-z0-9]+", " ")
    parts = []
    for within in ("\n", "\n[^a-z0-9\n]*\n\\s*"):
        for marks in (".!?", ".!?:;"):
            parts.append(F.transform(F.split(low, f"[{marks}]+[^a-z0-9\n]*(?:\\s|$)|{within}"), words))
    every = F.concat(F.split(plain, "\n"), F.transform(F.split(plain, "\n\n+"), joined), *parts, F.array(joined(plain)))
    return F.coalesce(F.array_distinct(F.transform(every, lambda u: F.trim(u))), F.array().cast("array<string>"))


def units(text: Column) -> Column:
    """Distinct normalised lines, paragraphs, sentences, clauses and the whole of a text."""
    return _once(_lowered(text), lambda low: _once(_normalised(low), lambda plain: _units(low, plain)))


def license_matches(text: Column, templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> Column:
    """Array of ``license`` and ``dice``, one for each unit of the text that matches a template."""
    opening = "BSD"  # until the text has told which
    every = [*((opening if t == BSD_OPENING else name, t) for name, t in [*TEMPLATES, *HEADERS]), *((opening if name.startswith("BSD") else name, t) for name, t in full_texts())] if templates is None else templates
    known = [(name, _pairs(t)) for name, t in every]
    known = [(name, pairs, *_bounds(len(pairs), least)) for name, pairs in known if pairs]
    if not known:
        raise ValueError("a template of two words or more is needed")
    low = min(k[2] for k in known)
    covers = [_cover(pairs, a, least) for _, pairs, a, _ in known]
    listed = lambda words: F.split(F.lit(",".join(words)), ",")
    literal = F.array(*(F.struct(F.lit(name).alias("license"), listed(pairs).alias("pairs"), listed(c).alias("cover"), F.lit(a).alias("low"), F.lit(b).alias("high")) for (name, pairs, a, b), c in zip(known, covers, strict=True)))
    # A unit of n distinct pairs has more than n words, and at most n + 1 distinct ones; so most units never get their pairs.
    words = F.filter(F.transform(units(text), lambda u: F.split(u, " ")), lambda w: F.size(w) > low)
    words = F.filter(words, lambda w: F.exists(literal, lambda t: (F.size(w) > t["low"]) & F.arrays_overlap(w, t["cover"]) & (F.size(F.array_distinct(w)) <= t["high"] + 1)))
    pairs = F.transform(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))

    def best(p: Column) -> Column:
        near = F.filter(literal, lambda t: F.size(p).between(t["low"], t["high"]))
        rated = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(p, t["pairs"])) / (F.size(p) + F.size(t["pairs"]))).alias("minus"), t["license"].alias("license")))
        return F.array_min(rated)

    found = F.filter(F.transform(pairs, best), lambda m: m["minus"] <= -least)
    if templates is None:
        found = _once(F.regexp_replace(_lowered(text), "[^a-z0-9]+", " "), lambda plain: F.transform(found, lambda m: F.struct(m["minus"], F.when(
            m["license"] != opening, m["license"]).when(plain.contains("redistributions in binary form must reproduce") & ~plain.rlike(BSD_THIRD), "BSD-2-Clause").otherwise("BSD-3-Clause").alias("license"))))
    named = F.transform(found, lambda m: F.struct(m["license"].alias("license"), (-m["minus"]).alias("dice")))
    promising = F.arrays_overlap(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), listed(sorted({w for c in covers for w in c})))
    return F.when(promising, named).otherwise(F.array().cast("array<struct<license: string, dice: double>>"))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """One row per document: key, ``n_units`` that match, ``licenses`` found (by name, comma-joined), ``best_dice`` (0 without)."""
    rows = docs.select(F.col(id_column), license_matches(F.col(text_column), templates, least).alias("m"))
    return rows.select(
        id_column, F.size("m").cast("long").alias("n_units"), F.array_join(F.array_sort(F.array_distinct("m.license")), ",").alias("licenses"),
        F.coalesce(F.array_max("m.dice"), F.lit(0.0)).alias("best_dice"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quoted(name)}, [{', '.join(map(quoted, _pairs(t)))}])" for name, t in TEMPLATES)
    return rf"""
with templates(license, pairs) as (values {values}),
plain as (select row_number() over () as r, doc_id, regexp_replace(regexp_replace(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
          '[^a-z0-9\n]+', ' ', 'g'), ' *\n *', chr(10), 'g') as p from documents),
pieces as (select r, unnest(string_split(p, chr(10))) as u from plain
           union all select r, regexp_replace(unnest(regexp_split_to_array(p, '\n\n+')), '\n+', ' ', 'g') from plain
           union all select r, regexp_replace(p, '\n+', ' ', 'g') from plain),
units as (select distinct r, trim(u) as u from pieces),
words as (select r, u, string_split(u, ' ') as w from units),
pairs as (select r, u, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as b from words where len(w) > 1),
rated as (select r, u, license, 2.0::double * len(list_intersect(b, pairs.pairs_t)) / (len(b) + len(pairs.pairs_t)) as dice
          from (select p.r, p.u, p.b, t.license, t.pairs as pairs_t from pairs p join templates t on 2 * least(len(p.b), len(t.pairs)) >= {LEAST_DICE} * (len(p.b) + len(t.pairs))) as pairs),
best as (select r, u, license, dice from (select *, row_number() over (partition by r, u order by dice desc, license) as k from rated) where k = 1 and dice >= {LEAST_DICE}),
found as (select r, count(*) as n, string_agg(distinct license, ',' order by license) as l, max(dice) as d from best group by r)
select doc_id, coalesce(n, 0)::bigint as n_units, coalesce(l, '') as licenses, coalesce(d, 0.0)::double as best_dice from plain left join found using (r)
"""


@query("op6_license_scan", _sql())
def op6_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    """Licenses of every document."""
    return scan_licenses(table(spark, directory, "documents"))
