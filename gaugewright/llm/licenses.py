"""Licence notices: each line of a text, the text as a whole, and passages in it, against templates.

A unit (a line, or the whole text) is normalised to lower-cased words of letters
and digits; its distinct word bigrams are compared to a template's by the Dice
coefficient, 2 * common / (a + b). Two exact bounds come first: a Dice of d needs
sizes within d / (2 - d) of each other, and a template that is reached shares at
least that share of its bigrams, so at least one of any (1 - share) of them plus
one; the words that begin such bigrams (the longest ones, as the rarest) gate the
texts by one regular expression and their units by one array overlap.

Passages find notices that are wrapped over lines, commented, or part of a longer
licence. The same bound gives each template its anchors: bigrams of which a unit that
reaches it has at least one. Wherever an anchor stands in a text's words, a passage
as long as the template is laid so that the anchor stands where it first does in the template
(from the text's first word, if that is earlier), and is scored like a unit. Words
put in or left out shift a passage by as many words against those behind them. All of it is one projection of DataFrame functions
over each row: no shuffle, no Python.

Defined cases: null and empty texts and units of fewer than two words match
nothing; of equal scores the template with more bigrams counts, then the least licence id; repeated rows are scanned each;
very long texts are one row's arrays; extra columns are not read."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DICE_PCT = 80

# Frequent English words, which make poor gates.
COMMON = ("a", "an", "and", "be", "by", "for", "in", "is", "of", "or", "that", "the", "this", "to", "with", "you")

# Licence notices as their authors ask them to be put.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def template_words(text: str) -> list[str]:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).split()


def anchors(text: str, min_pct: int) -> dict[str, int]:
    """Bigrams of which every unit that reaches the template has at least one, with the place of each in it."""
    grams = sorted(template_bigrams(text), key=lambda g: (g.split()[0] in COMMON, -len(g.split()[0]), g))
    need = math.ceil(min_pct / (200 - min_pct) * len(grams) - 1e-9)
    words = template_words(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return {g: pairs.index(g) for g in grams[: len(grams) - need + 1]}


def gate_words(templates: dict[str, str], min_pct: int) -> list[str]:
    """Words of which every unit that reaches a template has at least one."""
    return sorted({g.split()[0] for text in templates.values() for g in anchors(text, min_pct)})


def _normal(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))


def _passages(words: Column, templates: dict[str, str], min_pct: int) -> Column:
    """(dice, size, license) of the passages that reach their template; each passage once."""
    own = {k: anchors(v, min_pct) for k, v in sorted(templates.items())}
    grams = sorted({g for a in own.values() for g in a})
    pair = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))
    starts = sorted({g.split()[0] for g in grams})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(starts) & pair(i).isin(grams), i)), lambda i: i.isNotNull())
    placed: dict[str, list[tuple[int, int]]] = {}
    for n, a in enumerate(own.values()):
        for g, at in a.items():
            placed.setdefault(g, []).append((n, at))
    laid = F.create_map(*(c for g, found in placed.items() for c in (F.lit(g), F.array(*(F.struct(F.lit(n).alias("n"), F.lit(at).alias("at")) for n, at in found)))))
    begin = lambda i: F.transform(F.element_at(laid, pair(i)), lambda x: F.struct(x["n"].alias("n"), F.greatest(i - x["at"], F.lit(0)).alias("s")))
    begins = F.array_distinct(F.flatten(F.transform(places, begin)))
    lengths = F.array(*(F.lit(len(template_words(templates[k]))) for k in own))
    sets = F.array(*(F.array(*map(F.lit, template_bigrams(templates[k]))) for k in own))
    names = F.array(*map(F.lit, own))

    def scored(x: Column) -> Column:
        """Bigrams of a passage beside its template's number."""
        return F.struct(x["n"].alias("n"), _bigrams(F.slice(words, x["s"] + 1, F.get(lengths, x["n"]))).alias("g"))

    def reached(x: Column) -> Column:
        mine = F.get(sets, x["n"])
        common, total = F.size(F.array_intersect(x["g"], mine)), F.size(x["g"]) + F.size(mine)
        return F.when(200 * common >= min_pct * total, F.struct((-(2.0 * common) / total).alias("d"), (-F.size(mine)).alias("m"), F.get(names, x["n"]).alias("l")))

    return F.filter(F.transform(F.transform(begins, scored), reached), lambda h: h.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", templates: dict[str, str] | None = None, min_pct: int = MIN_DICE_PCT) -> DataFrame:
    """doc_id, n_units and n_passages (distinct units, and passages, that reach a template), license and dice of the best: one row for each row of docs."""
    templates = TEMPLATES if templates is None else templates
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gate = F.array(*map(F.lit, gate_words(templates, min_pct)))
    sets = {k: template_bigrams(v) for k, v in templates.items()}

    def best(grams: Column) -> Column:
        """The best template of a unit: (dice, size, license), null if none is reached."""
        n = F.size(grams)
        found = []
        for k, own in sorted(sets.items()):
            b = len(own)
            common = F.size(F.array_intersect(grams, F.array(*map(F.lit, own))))
            near = (n * (200 - min_pct) >= b * min_pct) & (n * min_pct <= b * (200 - min_pct))
            found.append(F.when(near & (200 * common >= min_pct * (n + b)), F.struct((-(2.0 * common) / (n + b)).alias("d"), F.lit(-b).alias("m"), F.lit(k).alias("l"))))
        return found[0] if len(found) == 1 else F.least(*found)

    # each step binds its result, so that nothing is worked out twice
    units = F.transform(F.array_distinct(F.concat(F.split(text, "\n", -1), F.array(text))), _normal)
    gated = F.filter(F.transform(units, lambda u: F.split(u, " ")), lambda w: F.arrays_overlap(w, gate))
    hits = F.filter(F.transform(F.transform(F.array_distinct(gated), _bigrams), best), lambda h: h.isNotNull())
    passages = F.flatten(F.transform(F.array(F.split(_normal(text), " ")), lambda w: _passages(w, templates, min_pct)))
    # a text without a gate word has no unit and no passage with one
    open_ = F.lower(text).rlike("(?:^|[^0-9a-z])(?:" + "|".join(gate_words(templates, min_pct)) + ")(?:[^0-9a-z]|$)")
    x = docs.select(F.col(id_col).alias("doc_id"), F.when(open_, F.struct(hits.alias("u"), passages.alias("p"))).alias("h"))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    x = x.select("doc_id", some("h.u").alias("n_units"), some("h.p").alias("n_passages"), F.array_min(F.concat("h.u", "h.p")).alias("b"))
    return x.select("doc_id", "n_units", "n_passages", F.col("b.l").alias("license"), F.round(-F.col("b.d"), 6).alias("dice"))


def scan_sql(templates: dict[str, str] | None = None, min_pct: int = MIN_DICE_PCT) -> str:
    """The same in DuckDB's SQL."""
    templates = TEMPLATES if templates is None else templates
    quoted = lambda grams: "[" + ", ".join("'" + g + "'" for g in grams) + "]"
    rows = ", ".join(f"('{k}', {quoted(template_bigrams(v))}, {len(template_words(v))})" for k, v in sorted(templates.items()))
    laid = ", ".join(f"('{k}', '{g}', {at})" for k, v in sorted(templates.items()) for g, at in anchors(v, min_pct).items())
    return rf"""
WITH templates(license, own, n) AS (VALUES {rows}),
anchors(license, gram, place) AS (VALUES {laid}),
units AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS u
          FROM (SELECT doc_id, unnest(list_append(string_split(coalesce(text, ''), chr(10)), coalesce(text, ''))) AS u FROM documents)),
grams AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
          FROM (SELECT doc_id, u, string_split(u, ' ') AS w FROM units)),
scored AS (SELECT doc_id, u, license, len(own) AS size, len(list_intersect(g, own)) AS common, len(g) + len(own) AS total
           FROM grams JOIN templates ON len(g) * {200 - min_pct} >= len(own) * {min_pct} AND len(g) * {min_pct} <= len(own) * {200 - min_pct}),
whole AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM whole)),
laid AS (SELECT DISTINCT doc_id, license, greatest(i - 1 - place, 0) AS s FROM pairs JOIN anchors USING (gram)),
passages AS (SELECT doc_id, license, s, own, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS g
             FROM (SELECT l.doc_id, license, s, own, w[s + 1 : s + n] AS v FROM laid l JOIN whole USING (doc_id) JOIN templates USING (license))),
hits AS (SELECT doc_id, u, NULL AS s, license, size, 2.0::DOUBLE * common / total AS dice FROM scored WHERE 200 * common >= {min_pct} * total AND common > 0
         UNION ALL
         SELECT doc_id, NULL, license || ' ' || s, license, len(own), 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own))
         FROM passages WHERE 200 * len(list_intersect(g, own)) >= {min_pct} * (len(g) + len(own))),
best AS (SELECT doc_id, count(DISTINCT u) AS n_units, count(s) AS n_passages, arg_min(license, (-dice, -size, license)) AS license, max(dice) AS dice FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_passages, 0)::BIGINT AS n_passages, license, round(dice, 6) AS dice FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id"""
