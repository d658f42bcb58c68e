"""Licence scan: Dice coefficient of word bigrams between a text's units and licence templates.

Native: one projection of DataFrame functions, without shuffle, join or Python.
Text is normalised to lower-case ASCII words; its units are the whole text, its
paragraphs and its lines.  A unit is compared with a template only if it can
reach the threshold t:

* sizes: with |A| and |B| distinct bigrams, Dice >= t needs
  t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|;
* words: at most m of a template's bigrams may be missing, so a unit must hold
  one of a few words whose bigrams are more than m.

Notices inside longer lines, or wrapped over several, are found by windows: runs
of words of a template's admissible sizes that begin and end with one of its
bigrams (others score less than a part of theirs does).  Lines and paragraphs
that match are searched by themselves, for other names than their own; what lies
between them is searched as one run of words.  Of overlapping windows the best
counts (then the longest, then the unit's own name, then the first).  Texts without any of the
bigrams of which a match needs one are left out.

Defined cases: null and empty text match nothing (dice 0.0); a unit of fewer
than two words has no bigrams; of equal scores the first name in order wins;
null ids and repeated rows are scanned like others; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents

THRESHOLD = 0.8

#: Public licence notices and short licence texts, each with an SPDX-like name.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_BSD = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ',
    '3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ',
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)

#: Whole licence texts, without the line that names the holder.
TEXTS: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause", "".join(_BSD)),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if c in _UPPER else c for c in text)).split()


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The sizes that a set can have whose Dice coefficient with one of size n reaches the threshold; both ends a little wide."""
    return int(threshold / (2 - threshold) * n), int((2 - threshold) / threshold * n) + 1


def telling_words(bigrams: set[str], threshold: float) -> set[str]:
    """Words of which every unit that reaches the threshold holds at least one: long ones first."""
    may_miss = int(len(bigrams) - threshold / (2 - threshold) * len(bigrams) + 1e-9)
    chosen, covered = set(), set()
    for w in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        own = {b for b in bigrams if w in b.split()}
        if not own <= covered:
            chosen.add(w)
            covered |= own
        if len(covered) > may_miss:
            break
    return chosen


def telling_bigrams(bigrams: set[str], threshold: float) -> set[str]:
    """Bigrams of which every window that reaches the threshold holds at least one: more than may be missing, of few long words."""
    may_miss = int(len(bigrams) - threshold / (2 - threshold) * len(bigrams) + 1e-9)
    chosen: set[str] = set()
    while len(chosen) <= may_miss:
        left = [b.split() for b in bigrams - chosen]
        words = {w for b in left for w in b}
        word = max(words, key=lambda w: (len(w) >= 6, sum(w in b for b in left), len(w), w))
        chosen |= {" ".join(b) for b in left if word in b}
    return chosen


def parts_of(bigrams: set[str]) -> set[str]:
    """Strings of which each of the bigrams holds one: long words, else the bigram."""
    out, left = set(), set(bigrams)
    while left:
        words = {w for b in left for w in b.split() if len(w) >= 6}
        part = max(words, key=lambda w: (sum(w in b for b in left), w)) if words else min(left)
        out.add(part)
        left = {b for b in left if part not in b}
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), windows: bool = False) -> DataFrame:
    """Units, and with ``windows`` also windows of words, against the templates.  The columns ``keep`` and, per row: n_words, license (best match or null), dice (its score, 0.0 without match), n_units (units and windows that match), licenses (their best names, sorted and joined by commas)."""
    sets = [(name, sorted(bigrams_of(t))) for name, t in templates]
    telling = sorted(set().union(*(telling_words(set(b), threshold) for _, b in sets)))
    needed = sorted(set().union(*(telling_bigrams(set(b), threshold) for _, b in sets)))
    known = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(b).alias("grams"), *(F.lit(x).alias(k) for k, x in zip(("low", "high"), size_bounds(len(b), threshold), strict=True))) for n, b in sets))

    def best_of(found: Column) -> Column:
        better = lambda a, b: (b["dice"] > a["dice"]) | ((b["dice"] == a["dice"]) & (b["name"] < a["name"]))
        found = F.transform(found, lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))
        return F.reduce(found, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")), lambda a, b: F.when(better(a, b), b).otherwise(a))

    def clean(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, "[ \n]+", " "))

    def grams(unit: Column) -> Column:
        words = F.split(unit, " ")
        return F.array_distinct(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))

    def scores(own: Column) -> Column:
        own = F.filter(own, lambda g: g.isNotNull())

        def score(t: Column) -> Column:
            n, m = F.size(own), F.size(t["grams"])
            dice = F.lit(2.0) * F.size(F.array_intersect(own, t["grams"])) / (n + m)
            return F.struct(F.when((n >= t["low"]) & (n <= t["high"]), dice).otherwise(F.lit(0.0)).alias("dice"), t["name"].alias("name"))

        return best_of(F.filter(F.transform(known, score), lambda s: s["dice"] >= threshold))

    def bound(value: Column, body) -> Column:
        """body of the value, which is worked out once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def distinct(found: Column) -> Column:
        """By strings, of which Spark keeps a hash set; structs would be compared all with all."""
        texts = F.array_distinct(F.transform(found, lambda x: F.concat_ws("\n", x["name"], x["dice"].cast("string"), x["unit"])))
        return F.transform(F.transform(texts, lambda t: F.split(t, "\n")), lambda p: F.struct(F.get(p, F.lit(1)).cast("double").alias("dice"), F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(2)).alias("unit")))

    def holds_any(strings) -> Column:
        return reduce(or_, (F.contains("__whole", F.lit(x)) for x in sorted(strings)))

    def with_names(found: Column, body) -> Column:
        """body of a function that gives the name of a unit that matches, null for others: a short list is read through, a long one searched by halves."""

        def of_sorted(known_units: Column) -> Column:
            def name_of(unit: Column) -> Column:
                step = lambda low, width: F.when(F.get(known_units, low + width)["unit"] <= unit, low + width).otherwise(low)  # noqa: E731  null beyond the last
                near = F.get(known_units, F.reduce(F.lit([1 << k for k in reversed(range(24))]), F.lit(0), step))
                few = F.get(F.filter(known_units, lambda x: x["unit"] == unit), F.lit(0))["name"]
                return F.when(F.size(known_units) <= 16, few).when(near["unit"] == unit, near["name"])

            return body(name_of)

        return bound(F.array_sort(F.transform(found, lambda x: F.struct(x["unit"].alias("unit"), x["name"].alias("name")))), of_sorted)

    def segments(norm: Column, whole: Column, name_of) -> Column:
        """Runs of words to search: (text, key, names), the names being those of the matching units around it."""
        around_all = F.struct(F.array_compact(F.array(name_of(whole))).alias("names"))

        def lines(paragraph: Column, outer: Column) -> Column:
            def of_paragraph(p: Column) -> Column:
                def item(text: Column) -> Column:
                    def named(m: Column) -> Column:
                        key = F.when(m["name"].isNotNull(), text).when(p["name"].isNotNull(), p["text"]).otherwise(F.lit(""))
                        return F.struct(text.alias("text"), key.alias("key"), F.concat(F.array_compact(F.array(m["name"], p["name"])), outer["names"]).alias("names"))

                    return bound(F.struct(name_of(text).alias("name")), named)

                return F.transform(F.transform(F.split(paragraph, "\n"), lambda line: F.trim(line)), item)

            return bound(clean(paragraph), lambda own: bound(F.struct(own.alias("text"), name_of(own).alias("name")), of_paragraph))

        def runs(items: Column) -> Column:
            """Neighbours with one key as one run."""
            starts = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | (F.get(items, i)["key"] != F.get(items, i - 1)["key"]))

            def run(first: Column, after: Column) -> Column:
                texts = F.transform(F.slice(items, first + 1, F.coalesce(after, F.size(items)) - first), lambda x: x["text"])
                return F.struct(F.array_join(texts, " ").alias("text"), F.get(items, first)["key"].alias("key"), F.get(items, first)["names"].alias("names"))

            return F.when(F.size(items) > 0, bound(starts, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), run)))

        items = bound(around_all, lambda outer: F.flatten(F.transform(F.split(norm, "\n *(?:\n *)+"), lambda p: lines(p, outer))))
        return bound(F.filter(items, lambda x: x["text"] != ""), runs)

    def reaching(own: Column, t: Column, names: Column) -> Column:
        """The windows that reach the threshold, as structs that sort by score, length, and whether the name is another than the unit's."""
        size = F.size(t["grams"])

        def of_start(i: Column, some: Column, hit: Column) -> Column:
            def step(a: Column, k: Column) -> Column:
                fresh = (F.array_position(some, F.get(some, k)) == k + 1).cast("int")
                n, both = a["n"] + fresh, a["both"] + F.when(F.get(hit, k), fresh).otherwise(0)
                dice = F.lit(2.0) * both / (n + size)
                one = F.struct((-dice).alias("minus"), (-1 - k).alias("less"), (~F.array_contains(names, t["name"])).alias("other"), t["name"].alias("name"), i.alias("start"))
                return F.struct(n.alias("n"), both.alias("both"), F.when(F.get(hit, k) & (dice >= threshold), F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

            none = F.lit([]).cast("array<struct<minus:double,less:int,other:boolean,name:string,start:int>>")
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("both"), none.alias("out"))
            enough = F.size(F.filter(hit, lambda x: x)) >= t["low"]
            return F.when(enough, F.reduce(F.sequence(F.lit(0), F.size(some) - 1), start, step)["out"]).otherwise(none)

        def of_hits(hits: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(hits, i))
            cut = lambda x, i: F.slice(x, i + 1, t["high"])
            return F.flatten(F.transform(starts, lambda i: bound(cut(own, i), lambda some: bound(cut(hits, i), lambda hit: of_start(i, some, hit)))))

        return bound(F.transform(own, lambda g: F.array_contains(t["grams"], g)), of_hits)

    def best_windows(segment: Column) -> Column:
        """(dice, name, unit) of a segment's best windows that don't overlap."""

        def of_words(words: Column) -> Column:
            return bound(F.filter(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))), lambda g: g.isNotNull()), lambda own: of_grams(words, own))

        def of_grams(words: Column, own: Column) -> Column:
            likely = F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], own)) >= F.greatest(t["low"], F.lit(1)))
            found = F.flatten(F.transform(likely, lambda t: reaching(own, t, segment["names"])))
            by_place = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("at"), (x["start"] - x["less"]).alias("upto"), x.alias("window"))))
            chosen = bound(by_place, lambda places: bound(heads(places), lambda first: F.flatten(F.zip_with(first, F.slice(first, 2, F.size(first)), lambda a, b: best_apart(F.slice(places, a + 1, F.coalesce(b, F.size(places)) - a))))))
            chosen = F.filter(chosen, lambda x: x["other"])
            return F.transform(chosen, lambda x: F.struct((-x["minus"]).alias("dice"), x["name"].alias("name"), F.array_join(F.slice(words, x["start"] + 1, 1 - x["less"]), " ").alias("unit")))

        def heads(places: Column) -> Column:
            """Where windows begin that none before reaches: clusters of overlapping ones are searched each by itself."""
            start = F.struct(F.lit(-1).alias("upto"), F.lit(0).alias("n"), F.lit([]).cast("array<int>").alias("first"))
            more = lambda a, x: F.struct(F.greatest(a["upto"], x["upto"]).alias("upto"), (a["n"] + 1).alias("n"), F.when(x["at"] > a["upto"], F.concat(a["first"], F.array(a["n"]))).otherwise(a["first"]).alias("first"))
            return F.reduce(places, start, more)["first"]

        def best_apart(cluster: Column) -> Column:
            """Of overlapping windows the best."""
            apart = lambda a, b: (a["start"] - a["less"] <= b["start"] - 1) | (b["start"] - b["less"] <= a["start"] - 1)  # noqa: E731  windows of words
            ordered = F.array_sort(F.transform(cluster, lambda x: x["window"]))
            return bound(ordered, lambda found: F.reduce(found, F.slice(found, 1, 0), lambda done, x: F.when(F.exists(done, lambda y: ~apart(x, y)), done).otherwise(F.concat(done, F.array(x)))))

        return bound(F.split(segment["text"], " "), of_words)

    rows = docs.select(*keep, F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z0-9\n]+", " ")).alias("__norm"))
    rows = rows.withColumn("__whole", clean(F.col("__norm")))
    rows = rows.withColumn("__may", holds_any(parts_of(set(needed))) & holds_any(needed))
    units = F.array_distinct(F.concat(F.array("__whole"), F.transform(F.split("__norm", "\n *(?:\n *)+"), clean), F.transform(F.split("__norm", "\n"), lambda line: F.trim(line))))
    rows = rows.select(
        *keep,
        F.when(F.col("__whole") == "", 0).otherwise(F.length("__whole") - F.length(F.replace(F.col("__whole"), F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("n_words"),
        # a unit that matches holds one of the bigrams needed, and most texts hold none
        F.when(F.col("__may"), F.filter(units, lambda u: F.arrays_overlap(F.split(u, " "), F.lit(telling)))).otherwise(F.lit([]).cast("array<string>")).alias("__units"),
        *([F.when(F.col("__may"), F.struct("__norm", "__whole")).alias("__search")] if windows else []),
    )
    rows = rows.withColumn("__grams", F.transform("__units", grams))
    rows = rows.withColumn("__found", F.filter(F.zip_with(F.transform("__grams", scores), "__units", lambda s, u: F.struct(s["dice"].alias("dice"), s["name"].alias("name"), u.alias("unit"))), lambda s: s["dice"] > 0))
    if windows:
        search, found = F.col("__search"), F.col("__found")
        inner = F.flatten(F.transform(with_names(found, lambda name_of: segments(search["__norm"], search["__whole"], name_of)), best_windows))
        rows = rows.withColumn("__found", F.when(search.isNotNull(), distinct(F.concat(found, F.coalesce(inner, F.slice(found, 1, 0))))).otherwise(found))
    rows = rows.withColumn("__best", best_of(F.col("__found")))
    return rows.select(
        *keep,
        "n_words",
        F.col("__best.name").alias("license"),
        F.col("__best.dice").alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("__found", lambda s: s["name"]))), ",").alias("licenses"),
        F.size("__found").cast("bigint").alias("n_units"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), TEMPLATES + TEXTS, windows=True)


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, [{', '.join(quoted(g) for g in sorted(bigrams_of(t)))}])" for n, t in TEMPLATES + TEXTS)
    return rf"""
WITH templates(name, grams) AS (VALUES {values}),
n AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\n]+', ' ', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, trim(regexp_replace(norm, '[ \n]+', ' ', 'g')) AS whole FROM n),
u AS (SELECT doc_id, unnest(list_distinct(list_concat([whole],
        list_transform(regexp_split_to_array(norm, '\n *(\n *)+'), lambda x: trim(regexp_replace(x, '[ \n]+', ' ', 'g'))),
        list_transform(string_split(norm, chr(10)), lambda x: trim(x))))) AS unit FROM w),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(string_split(unit, ' '))), lambda i: string_split(unit, ' ')[i] || ' ' || string_split(unit, ' ')[i + 1])) AS own
      FROM u),
s AS (SELECT doc_id, unit, name, CAST(2 AS DOUBLE) * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM g, templates WHERE len(list_intersect(own, grams)) > 0),
m AS (SELECT doc_id, unit, name, dice FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, name) = 1),
f AS (SELECT doc_id, count(*) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS dice FROM m GROUP BY doc_id),
b AS (SELECT m.doc_id, min(m.name) AS license FROM m JOIN f ON m.doc_id = f.doc_id AND m.dice = f.dice GROUP BY m.doc_id)
SELECT w.doc_id, CAST(CASE WHEN whole = '' THEN 0 ELSE length(whole) - length(replace(whole, ' ', '')) + 1 END AS BIGINT) AS n_words,
       license, coalesce(f.dice, 0.0) AS dice, coalesce(f.licenses, '') AS licenses, coalesce(f.n_units, 0) AS n_units
FROM w LEFT JOIN f ON w.doc_id = f.doc_id LEFT JOIN b ON w.doc_id = b.doc_id
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _oracle()}
