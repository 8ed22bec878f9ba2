"""License scans: Dice coefficient over word bigrams between text units and licence templates.

Units of a text are its lines, its paragraphs (parted by blank lines) and the whole of it. Unit and template are
normalised alike: lower case, everything but letters and digits a separator. A Dice coefficient of t or more needs
sizes within a factor of (2 - t) / t, so a unit is only compared with the templates that its number of bigrams
allows. All of it happens in the row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import table

MIN_DICE = 0.8
#: Templates go into the plan as a constant, so their number has a bound.
MAX_TEMPLATES = 2_000

#: Wording of public licences and of the notices that point to them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-2-Clause conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Unlicense dedication": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _compatible(n: int, min_dice: float) -> range:
    """The numbers of bigrams that a unit may have to reach ``min_dice`` with a template of ``n``."""
    return range(max(1, ceil(n * min_dice / (2 - min_dice) - 1e-9)), floor(n * (2 - min_dice) / min_dice + 1e-9) + 1)


def _normal(text: Column) -> Column:
    """Lower case; line feeds stay, all other runs that are no letters or digits become one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_dice: float = MIN_DICE, text: str = "text") -> DataFrame:
    """Adds n_units (units that match), licenses (names of the templates they match, sorted), best_license and
    best_dice (of ties the first by name); columns of these names are replaced.

    A null or empty text and one of fewer than two words have no unit: 0, an empty list and nulls. Equal lines
    count once each. Units of any length are compared whole."""
    grams = {name: _bigrams(t) for name, t in sorted(templates.items())}
    if len(grams) > MAX_TEMPLATES:
        raise ValueError(f"{len(grams)} templates; there may be {MAX_TEMPLATES}")
    ranges = {name: _compatible(len(g), min_dice) for name, g in grams.items() if g}
    fewest, most = min((r.start for r in ranges.values()), default=1), max((r.stop - 1 for r in ranges.values()), default=0)
    docs = docs.drop("n_units", "licenses", "best_license", "best_dice", "__n", "__u", "__g", "__m")
    rows = docs.withColumn("__n", _normal(F.coalesce(F.col(text), F.lit(""))))
    whole = F.array(F.regexp_replace("__n", "\n", " "))
    paragraphs = F.when(F.col("__n").contains("\n"), F.transform(F.split("__n", r"\n[ \n]*\n"), lambda x: F.regexp_replace(x, "\n", " "))).otherwise(F.array().cast("array<string>"))
    lines = F.when(F.col("__n").contains("\n"), F.split("__n", "\n")).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__u", F.transform(F.concat(whole, paragraphs, lines), lambda x: F.split(F.trim(x), " +")))
    # The words of a unit bound its bigrams from above only; repeated ones leave fewer.
    rows = rows.withColumn("__u", F.filter("__u", lambda w: F.size(w) > fewest))
    rows = rows.withColumn("__g", F.transform("__u", lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))))
    if ranges:
        known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(r.start).alias("low"), F.lit(r.stop - 1).alias("high"), F.array(*map(F.lit, grams[name])).alias("g")) for name, r in ranges.items()])
        rows = rows.withColumn("__g", F.filter("__g", lambda g: (F.size(g) >= fewest) & (F.size(g) <= most)))
        dice = lambda g, t: 2.0 * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + F.size(t["g"]))
        fits = lambda g: F.filter(known, lambda t: F.size(g).between(t["low"], t["high"]))
        rows = rows.withColumn("__m", F.transform("__g", lambda g: F.transform(fits(g), lambda t: F.struct((-dice(g, t)).alias("neg"), t["name"].alias("name")))))
        rows = rows.withColumn("__m", F.filter(F.transform("__m", lambda ms: F.filter(ms, lambda m: m["neg"] <= -min_dice)), lambda ms: F.size(ms) > 0))
    else:
        rows = rows.withColumn("__m", F.array().cast("array<array<struct<neg:double,name:string>>>"))
    flat = F.flatten("__m")
    return (
        rows.withColumn("n_units", F.size("__m"))
        .withColumn("licenses", F.array_sort(F.array_distinct(F.transform(flat, lambda m: m["name"]))))
        .withColumn("best_license", F.array_min(flat)["name"])
        .withColumn("best_dice", -F.array_min(flat)["neg"])
        .drop("__n", "__u", "__g", "__m")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its units, licenses joined by ``;`` in order of name, the best one and its coefficient to
    six digits. A null or empty text, or one without two words, has 0 units, an empty text of licenses and nulls; of
    ties the first name is the best; repeated rows each have their row, an empty table none. Texts of any length are
    read whole."""
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_units", F.array_join("licenses", ";").alias("licenses"), "best_license", F.round("best_dice", 6).alias("best_dice"))


def _sql() -> str:
    values = ", ".join("('" + name.replace("'", "''") + "', '" + " ".join(re.findall(r"[^\W_]+", t.lower())).replace("'", "''") + "')" for name, t in sorted(TEMPLATES.items()))
    return rf"""
WITH t(name, body) AS (VALUES {values}),
tw AS (SELECT name, string_split(body, ' ') AS w FROM t),
tg AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS n FROM documents),
u AS (
  SELECT r, unnest(list_concat([replace(n, chr(10), ' ')],
    CASE WHEN contains(n, chr(10)) THEN list_concat(list_transform(regexp_split_to_array(n, '\n[ \n]*\n'), lambda x: replace(x, chr(10), ' ')), string_split(n, chr(10))) ELSE [] END)) AS unit
  FROM d
),
w AS (SELECT r, row_number() OVER () AS k, regexp_split_to_array(trim(unit), ' +') AS w FROM u),
g AS (SELECT r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
m AS (
  SELECT r, k, name, 2.0::DOUBLE * len(list_intersect(g.g, tg.g)) / (len(g.g) + len(tg.g)) AS dice
  FROM g JOIN tg ON len(g.g) BETWEEN len(tg.g) * {MIN_DICE} / (2 - {MIN_DICE}) - 1e-9 AND len(tg.g) * (2 - {MIN_DICE}) / {MIN_DICE} + 1e-9
),
h AS (SELECT * FROM m WHERE dice >= {MIN_DICE}),
a AS (SELECT r, count(DISTINCT k)::INT AS n_units, array_to_string(list_sort(list_distinct(list(name))), ';') AS licenses, arg_min(name, (-dice, name)) AS best_license, round(max(dice), 6) AS best_dice FROM h GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::INT AS n_units, coalesce(licenses, '') AS licenses, best_license, best_dice FROM d LEFT JOIN a USING (r)
"""


OP9_SQL = _sql()
