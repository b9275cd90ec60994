"""Licence scans in DataFrame expressions only.

A text is normalised (lower case, letters and digits, single spaces) and
compared to licence templates, notices as well as whole texts, by the Dice
coefficient over word bigrams: twice the distinct bigrams in both, by those of
the unit plus those of the template. Units are all windows of as many bigrams
as the template has, over the words of the whole text, so that what stands
around a notice, or how its lines are wrapped, doesn't matter; a text that is
shorter is one unit. A text that has a notice more than once has it reported
as often.

Size bounds prune templates. A coefficient of t needs t / (2 - t) of the
template's distinct bigrams at least, so a text with fewer bigrams, or with
fewer of the template's, never meets its windows. Neither does a window with
fewer of them: starts are taken from the places of the template's bigrams only,
a range for each run of so many of them that fits a window. Before that, texts are let go
that have none of a few telling words (chosen so that too few of a template's
bigrams are left without one), which is a search for plain strings: most texts
are never taken apart. None of this loses a match. Nothing is shuffled or
broadcast: the templates are literals of the plan.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Usual notices and texts of public licences.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
        IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written
        permission."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""),
    ("GPL-warranty", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your
        option) any later version."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""),
    ("MIT-disclaimer", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely"""),
)


def normalised(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


@dataclass
class Template:
    licence: str
    grams: list[str]  # distinct
    size: int  # bigrams, repeats included
    least: int  # distinct bigrams that the threshold needs

    @classmethod
    def of(cls, licence: str, text: str, threshold: float) -> Template:
        words = normalised(text).split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        if not grams:
            raise ValueError(f"{licence}: a template needs two words at least")
        distinct = list(dict.fromkeys(grams))
        return cls(licence, distinct, len(grams), max(1, math.ceil(len(distinct) * threshold / (2 - threshold) - 1e-9)))


def telling_words(templates: list[Template]) -> list[str]:
    """Words of which each text that reaches some template's ``least`` has one.

    For each template words are taken, those taken already first, then the
    longer ones, until fewer than ``least`` of its bigrams are without one.
    """
    taken: list[str] = []
    for t in templates:
        left = [g for g in t.grams if not any(w in g for w in taken)]
        while len(left) >= t.least:
            cover = lambda w: sum(w in g.split() for g in left)  # noqa: B023, E731
            best = max({w for g in left for w in g.split()}, key=lambda w: (min(len(w), 6), cover(w), w))
            taken.append(best)
            left = [g for g in left if best not in g]
    return taken


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with ``licences``: an array of (word, words, licence, dice), sorted.

    ``templates`` are (licence, text) pairs or a mapping. Of a template's
    windows that reach the threshold, those stay that no window which overlaps
    surpasses (of equal ones the first does); then, of different templates'
    windows that overlap, those that no other one surpasses (ties go to the
    template that comes first). word is a window's first word (from 1) and
    words its length. Null and empty texts and texts of one word have none.
    Rows are looked at one by one, so repeats stay; texts of any length are
    taken whole; a column of that name is replaced, all others stay, whatever
    they are called. An empty template set or table finds nothing.
    """
    kind = "array<struct<word:int,words:int,licence:string,dice:double>>"
    pairs = templates.items() if isinstance(templates, dict) else templates
    known = [Template.of(licence, body, threshold) for licence, body in pairs]
    none = F.array().cast(kind)
    if not known:
        return docs.withColumn("licences", none)

    def let(value: Column, body) -> Column:
        """``body`` of a value that is worked out once."""
        return F.transform(F.array(value), body)[0]

    def starts(hits: Column, last: Column, size: Column, least: int) -> Column:
        """The starts, in order, of windows with ``least`` of the places ``hits``; no start comes twice."""
        def upto(i: Column) -> Column:
            low = F.greatest(F.get(hits, i + (least - 1)) - size + 1, F.coalesce(F.get(hits, i - 1) + 1, F.lit(0)), F.lit(0))
            high = F.least(F.get(hits, i), last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(hits) - least), upto))

    def windows(x: Column, nr: int, t: Template) -> Column:
        """A template's windows that reach the threshold and that none of its own that overlaps surpasses."""
        own, none_ = F.array(*map(F.lit, t.grams)), F.array().cast("array<struct<word:int,words:int,licence:string,dice:double,nr:int>>")
        size = F.least(F.lit(t.size), F.size(x["grams"]))
        places = F.filter(F.transform(x["grams"], lambda g, i: F.when(F.array_contains(own, g), i)), lambda i: i.isNotNull())

        def scored(hits: Column) -> Column:
            units = F.transform(starts(hits, F.size(x["grams"]) - size, size, t.least), lambda s: F.struct(
                s.alias("start"), F.array_distinct(F.slice(x["grams"], s + 1, size)).alias("unit")))
            every = F.transform(units, lambda u: F.struct(
                (u["start"] + 1).alias("word"), (size + 1).alias("words"), F.lit(t.licence).alias("licence"),
                (F.size(F.array_intersect(u["unit"], own)) * 2.0 / (F.size(u["unit"]) + len(t.grams))).alias("dice"), F.lit(nr).alias("nr")))
            return F.filter(every, lambda f: f["dice"] >= threshold - 1e-12)

        def first(found: Column) -> Column:
            # in order of starts, and no start twice: those that overlap are near
            near = lambda i: F.slice(found, F.greatest(i + 1 - size, F.lit(1)), 2 * size + 1)
            over = lambda a, b: (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["word"] < a["word"]))
            return F.filter(found, lambda a, i: ~F.exists(near(i), lambda b: (F.abs(a["word"] - b["word"]) <= size) & over(a, b)))

        enough = F.size(F.array_intersect(x["distinct"], own)) >= t.least
        return F.when(enough, let(let(places, scored), first)).otherwise(none_)

    def kept(found: Column) -> Column:
        """Those that no other one surpasses where they are."""
        over = lambda a, b: (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["nr"] < a["nr"]))
        meet = lambda a, b: (a["word"] < b["word"] + b["words"]) & (b["word"] < a["word"] + a["words"])
        return F.filter(found, lambda a: ~F.exists(found, lambda b: meet(a, b) & over(a, b)))

    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.split(F.trim(F.regexp_replace(body, "[^a-z0-9]+", " ")), " ")
    grams = let(words, lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))
    parts = let(grams, lambda g: F.struct(g.alias("grams"), F.array_distinct(g).alias("distinct")))
    found = let(parts, lambda x: F.flatten(F.array(*[windows(x, nr, t) for nr, t in enumerate(known)])))
    listed = F.transform(F.array_sort(let(found, kept)), lambda f: F.struct(f["word"], f["words"], f["licence"], f["dice"]))
    may = reduce(or_, [F.contains(body, F.lit(w)) for w in telling_words(known)])
    return docs.withColumn("licences", F.when(may, listed.cast(kind)).otherwise(none))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL of the query's result, from the templates' texts on."""
    rows = ", ".join(f"({nr}, '{licence}', '{' '.join(body.split()).replace(chr(39), chr(39) * 2)}')" for nr, (licence, body) in enumerate(templates))
    words = lambda x: f"string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t(nr, licence, body) AS (VALUES {rows}),
tg AS (SELECT nr, licence, {grams} AS g FROM (SELECT nr, licence, {words('body')} AS w FROM t)),
tp AS (SELECT nr, licence, len(g) AS m, list_distinct(g) AS b, len(list_distinct(g)) AS d FROM tg),
dg AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents)),
c AS (
  SELECT doc_id, nr FROM (SELECT DISTINCT doc_id, unnest(g) AS x FROM dg) JOIN (SELECT nr, d, unnest(b) AS x FROM tp) USING (x)
  GROUP BY doc_id, nr, d HAVING count(*) >= d * {threshold} / (2 - {threshold}) - 1e-9),
u AS (
  SELECT doc_id, nr, licence, g, b, d, least(m, len(g)) AS n
  FROM c JOIN tp USING (nr) JOIN dg USING (doc_id)),
s AS (
  SELECT doc_id, nr, licence, b, d, n, s, list_distinct(list_slice(g, s + 1, s + n)) AS unit
  FROM (SELECT *, unnest(range(0, len(g) - n + 1)) AS s FROM u)),
f AS (
  SELECT * FROM (SELECT doc_id, nr, licence, s AS a, s + n AS z, 2.0 * len(list_intersect(unit, b)) / (len(unit) + d) AS dice FROM s) WHERE dice >= {threshold} - 1e-12),
k AS (
  SELECT * FROM f x WHERE NOT EXISTS (
    SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.nr = x.nr AND x.a <= y.z AND y.a <= x.z AND (y.dice > x.dice OR y.dice = x.dice AND y.a < x.a))),
best AS (
  SELECT * FROM k x WHERE NOT EXISTS (
    SELECT 1 FROM k y WHERE y.doc_id = x.doc_id AND x.a <= y.z AND y.a <= x.z AND (y.dice > x.dice OR y.dice = x.dice AND y.nr < x.nr)))
SELECT d.doc_id, CAST(count(b.nr) AS BIGINT) AS n_licences,
  coalesce(string_agg((b.a + 1) || ':' || b.licence, ',' ORDER BY b.a, b.z, b.licence), '') AS licences,
  coalesce(round(max(b.dice), 6), 0) AS best_dice
FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY d.doc_id"""
