"""License scans: word bigrams of normalised text compared with templates by the Dice coefficient, with DataFrame operations only.

Units are the lines of a text, its paragraphs (parted by blank lines, where of several lines) and the whole text
(where of several paragraphs). Normalised: A-Z lower-cased, runs of other characters than a-z and 0-9 one blank.
Dice = 2 * shared / (bigrams of the unit + bigrams of the template), over distinct bigrams; a match has at least
``least``. A unit of a bigrams can only match templates of b bigrams with 2 * min(a, b) >= least * (a + b): these size
bounds prune templates, and units that are too short or too long for all.

Where a licence is named inside a longer line, or wrapped over lines among others, no unit is near it. So runs of words of
a text (any start and end) are units too, called windows: unit_no is the first word's place in the text, unit_bigrams the
run's bigrams, a template's repeated ones counted once. Of overlapping windows of one template the best stays (ties: first,
shorter), of overlapping ones of several the best (ties: first in code point order), and only for licences that no
line, paragraph or whole text of that row gives. ``oracle`` knows lines, paragraphs and texts only; tests hold windows against brute force.

The templates are a fixed list, so their bigram table has a proven size and may be broadcast. Units meet templates by
an equality join on bigrams, never all against all, and counts are pre-aggregated before the shuffle.

Before that, units without any of the templates' rarer words are left out: a match must share more than a third of a
template's bigrams, so of any large enough set of them it shares one, and holds both its words.

Defined results: null, empty and one-word texts match nothing; long texts are read whole; repeated rows of one id give
their matches once a row; equal coefficients go to the template first in code point order; an empty table gives no
rows; other columns take no part.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAST = 0.8
#: Notices and short texts of widely used licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Released under the BSD 3-Clause License.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-notice": "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    "CC0-short": "Released under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
}
#: Whole texts of short licences, and the titles that full texts of long ones begin with.
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT-grant"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": TEMPLATES["ISC-grant"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "MPL-1.1-title": "MOZILLA PUBLIC LICENSE Version 1.1",
    "CC0-1.0-title": "Creative Commons Legal Code CC0 1.0 Universal",
}
for _name, _title in {
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
}.items():
    TEMPLATES[f"{_name}-title"] = _title
#: Creative Commons, short and long wordings of each form and version.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _form, _long in _CC.items():
    for _v, _kind in _CC_VERSIONS.items():
        _name = f"CC-{_form}-{_v}"
        TEMPLATES[f"{_name}-short"] = f"Licensed under CC {_form} {_v}."
        TEMPLATES[f"{_name}-short-2"] = f"This work is licensed under CC {_form} {_v}."
        TEMPLATES.setdefault(f"{_name}-notice", f"This work is licensed under a Creative Commons {_long} {_v} {_kind} License.")
        TEMPLATES[f"{_name}-notice-2"] = f"Licensed under the Creative Commons {_long} {_v} {_kind} License."
        TEMPLATES[f"{_name}-title"] = f"Creative Commons {_long} {_v} {_kind} Public License"
#: Words of everyday texts: a look for them would pass nearly every text.
COMMON = set("a all an and any are as at be by can do for from have if in is it may new no not of on one or other out public shall that the then this to under use was whether will with without work works you your".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams_of(text: str) -> list[str]:
    w = re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def needed_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which every match of any template holds at least one."""
    out = set()
    for text in templates.values():
        grams = bigrams_of(text)
        # shared >= least / (2 - least) * grams, so of any len - shared + 1 of them one is shared, with both its words
        ratio = Fraction(str(least))
        shared = math.ceil(len(grams) * ratio / (2 - ratio))
        left, want, met = set(grams), len(grams) - shared + 1, 0
        words = {w for g in grams for w in g.split()}
        while met < want and left:
            holds = {w: [g for g in left if w in g.split()] for w in words}
            # words already looked for cost nothing; then rare words of many bigrams, and the longest
            best = max((w for w in words if holds[w]), key=lambda w: (w in out, w not in COMMON and not w.isdigit(), len(w) > 3, len(holds[w]), len(w), w))
            met += len(holds[best])
            left -= set(holds[best])
            out.add(best)
    return sorted(out)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, unit_no, license, shared, unit_bigrams, dice): the best template of every unit that matches one, and windows."""
    spark = docs.sparkSession
    table = [(name, g) for name, text in sorted(templates.items()) for g in bigrams_of(text)]
    sizes = [len(bigrams_of(t)) for t in templates.values()]
    low, high = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    forms = spark.createDataFrame([(n, g, len(bigrams_of(templates[n]))) for n, g in table], "license string, gram string, b int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.split(text, "\n")
    paragraphs = F.split(text, "\n[\x20\t\r]*\n\\s*")
    unit = lambda kind, all_, take: F.transform(all_, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("unit_no"), x.alias("body"), take(x).alias("take")))
    always = lambda x: F.lit(True)
    units = F.concat(
        unit("line", plain, always),
        unit("paragraph", paragraphs, lambda x: F.instr(x, "\n") > 0),
        unit("text", F.array(text), lambda x: F.size(paragraphs) > 1),
    )
    # A word has a letter at least and longest templates have ``high`` bigrams, but blanks and marks are free: only words can bound a unit.
    needed = needed_words(templates, least)
    # One look at each text for any of those words as a whole word; the letters that may start one come first, as most places fail there.
    heads = "".join(sorted({w[0] for w in needed}))
    some = docs.filter(F.col(text_col).rlike(f"(?i)(?<![a-z0-9])(?=[{heads}])(?:{'|'.join(needed)})(?![a-z0-9])"))
    # Row numbers part repeated rows within one plan only; windows meet lines by id and text.
    whose = F.struct(F.col(id_col).alias("own"), F.xxhash64(F.col(text_col)).alias("key"))
    rows = some.select(whose.alias("id"), F.monotonically_increasing_id().alias("row"), F.explode(units).alias("u")).filter("u.take")
    words = F.split(normalise(F.col("u.body")), " ")
    rows = rows.select("id", "row", "u.unit", "u.unit_no", words.alias("words"))
    rows = rows.filter(F.arrays_overlap("words", F.array(*map(F.lit, needed))))
    grams = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    rows = rows.filter(F.size("words") > 1).withColumn("grams", grams).withColumn("a", F.size("grams")).filter(F.col("a").between(low, high))
    met = rows.select("id", "row", "unit", "unit_no", "a", F.explode("grams").alias("gram")).join(F.broadcast(forms), "gram").filter(2 * F.least("a", "b") >= least * (F.col("a") + F.col("b")))
    counted = met.groupBy("id", "row", "unit", "unit_no", "license", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    scored = counted.withColumn("dice", 2.0 * F.col("shared") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= least)
    best = scored.groupBy("id", "row", "unit", "unit_no", F.col("a").alias("unit_bigrams")).agg(F.min(F.struct((-F.col("dice")).alias("less"), "license", "shared")).alias("m"))
    best = best.select("id", "row", "unit", "unit_no", F.col("m.license").alias("license"), F.col("m.shared").alias("shared"), "unit_bigrams", (-F.col("m.less")).alias("dice"))
    seen = best.select(F.col("id").alias("seen_id"), F.col("license").alias("seen_license")).distinct()
    inside = windows(some.select(whose.alias("id"), F.monotonically_increasing_id().alias("row"), F.split(normalise(F.col(text_col)), " ").alias("words")), templates, least)
    inside = inside.join(seen, F.col("id").eqNullSafe(F.col("seen_id")) & (F.col("license") == F.col("seen_license")), "left_anti")
    return best.unionByName(inside).select(F.col("id.own").alias(id_col), "unit", "unit_no", "license", "shared", "unit_bigrams", "dice")


def windows(texts: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """(id, row, unit, unit_no, license, shared, unit_bigrams, dice) of the runs of words that match; texts: (id, row, words)."""
    table = [(name, g, i, len(bigrams_of(t))) for name, t in sorted(templates.items()) for i, g in enumerate(bigrams_of(t))]
    forms = texts.sparkSession.createDataFrame(table, "license string, gram string, g int, b int")
    grams = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    hits = texts.filter(F.size("words") > 1).select("id", "row", F.posexplode(grams).alias("pos", "gram")).join(F.broadcast(forms), "gram")
    # a window of a bigrams has least * (a + b) <= 2 * shared and shared <= a, b
    few, most = F.col("b") * (least / (2 - least)) - 1e-9, F.floor(F.col("b") * ((2 - least) / least) + 1e-9).cast("int")
    met = hits.groupBy("id", "row", "license", "b").agg(F.sort_array(F.collect_list(F.struct("pos", "g"))).alias("hits"))
    met = met.filter(F.size(F.array_distinct("hits.g")) >= few)
    starts = met.select("id", "row", "license", "b", F.expr("transform(hits, (h, i) -> slice(hits, i + 1, 4 * b))").alias("runs"), most.alias("most"), few.alias("few"))
    starts = starts.select("id", "row", "license", "b", "most", "few", F.explode("runs").alias("run"))
    # repeated bigrams of the template count once, so a run of many of them may be longer than ``most``
    starts = starts.withColumn("run", F.expr("filter(run, (x, i) -> x.pos - run[0].pos - i < most)")).filter(F.size(F.array_distinct("run.g")) >= F.col("few"))
    ends = starts.select("id", "row", "license", "b", F.expr("transform(run, (x, i) -> named_struct('first', run[0].pos, 'last', x.pos, 'n', i + 1, 'shared', size(array_distinct(slice(run.g, 1, i + 1)))))").alias("ends"))
    at = ends.select("id", "row", "license", "b", F.explode("ends").alias("e")).select("id", "row", "license", "b", "e.*")
    at = at.withColumn("a", F.col("last") - F.col("first") + 1 - F.col("n") + F.col("shared")).withColumn("dice", 2.0 * F.col("shared") / (F.col("a") + F.col("b"))).filter(F.col("dice") >= least)
    # islands of overlapping windows (a window of a bigrams has a + 1 words)
    before = Window.partitionBy("row", "license").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("first") <= F.max("last").over(before) + 1, 0).otherwise(1)
    at = at.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(Window.partitionBy("row", "license").orderBy("first", "last")))
    one = at.groupBy("id", "row", "license", "island").agg(F.min(F.struct((-F.col("dice")).alias("less"), "first", "last", "shared", "a")).alias("m"))
    found = one.groupBy("id", "row").agg(F.collect_list(F.struct("m.less", "license", "m.first", "m.last", "m.shared", "m.a")).alias("found"))
    kept = F.expr("filter(found, x -> NOT exists(found, y -> (y.less < x.less OR (y.less = x.less AND y.license < x.license)) AND y.first <= x.last + 1 AND x.first <= y.last + 1))")
    kept = found.select("id", "row", F.explode(kept).alias("x"))
    return kept.select("id", "row", F.lit("window").alias("unit"), F.col("x.first").alias("unit_no"), F.col("x.license").alias("license"), F.col("x.shared").cast("bigint").alias("shared"), F.col("x.a").alias("unit_bigrams"), (-F.col("x.less")).alias("dice"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """DuckDB SQL for ``matches`` over documents: every unit against every template."""
    values = ", ".join(f"('{n}', '{g}', {len(bigrams_of(t))})" for n, t in sorted(templates.items()) for g in bigrams_of(t))
    return f"""
WITH forms(license, gram, b) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, row, text, regexp_split_to_array(text, '\\n[\\x20\\t\\r]*\\n\\s*') AS ps, string_split(text, chr(10)) AS ls FROM d),
u AS (
  SELECT doc_id, row, 'line' AS unit, unnest(range(len(ls))) AS unit_no, unnest(ls) AS body FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, row, 'paragraph', unnest(range(len(ps))), unnest(ps) AS body FROM p) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, row, 'text', 0, text FROM p WHERE len(ps) > 1
),
w AS (SELECT doc_id, row, unit, unit_no, string_split(trim(regexp_replace(translate(body, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM u),
g AS (SELECT doc_id, row, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
e AS (SELECT doc_id, row, unit, unit_no, len(grams) AS a, unnest(grams) AS gram FROM g),
c AS (SELECT doc_id, row, unit, unit_no, license, a, b, count(*) AS shared FROM e JOIN forms USING (gram) GROUP BY ALL),
s AS (SELECT *, 2.0::DOUBLE * shared / (a + b) AS dice FROM c WHERE 2.0::DOUBLE * shared / (a + b) >= {least})
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license, shared, CAST(a AS INTEGER) AS unit_bigrams, dice FROM s
QUALIFY row_number() OVER (PARTITION BY row, unit, unit_no ORDER BY dice DESC, license) = 1
"""
