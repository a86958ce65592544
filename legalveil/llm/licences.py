"""Licence scans, with DataFrame operations only.

Units of a text (the whole, its paragraphs, its lines) are normalised to lower-case words and
compared with licence templates by the Dice coefficient over word bigrams. A template is a
candidate for a unit only if the unit's size lies within the bounds that the least Dice allows;
texts that lack every anchor word cannot reach it for any template and are not cut into units.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LEAST_DICE = 0.85

# Names and usual wording of public licence notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-line-2": "This project is licensed under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words too usual to be anchors while others will do.
USUAL = frozenset("above also and any copy file from have notice other that the this under use with work you your".split())


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(templates: dict[str, str], least: float) -> list[str]:
    """Strings of which every unit that reaches ``least`` with any template holds one.

    Such a unit shares at least b * least / (2 - least) of a template's b bigrams; once the bigrams
    with an anchor in them number more than those that may be missing, one must be shared. Chosen
    greedily: whole words or their first six letters, long ones first, by how many templates they help."""
    needs = {k: (g, len(g) - math.ceil(len(g) * least / (2 - least) - 1e-9)) for k, t in templates.items() if (g := _bigrams(t))}
    words = {w for t in templates.values() for w in _words(t)}
    chosen: list[str] = []
    helps = lambda x, g: any(x in w for w in g.split())
    while open_ := {k: [x for x in g if not any(helps(c, x) for c in chosen)] for k, (g, missing) in needs.items() if sum(any(helps(c, x) for c in chosen) for x in g) <= missing}:
        gain = {x: sum(helps(x, y) for g in open_.values() for y in g) for x in words | {w[:6] for w in words}}
        chosen.append(max(sorted(x for x in gain if gain[x]), key=lambda x: (len(x) >= 4 and x not in USUAL, gain[x], -len(x))))
    return chosen


def word_bigrams(text: Column) -> Column:
    """Distinct bigrams of lower-case ASCII letter and digit runs."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def template_table(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    rows = [(k, g, len(g), len(g) * least / (2 - least), len(g) * (2 - least) / least) for k, t in templates.items() if (g := _bigrams(t))]
    lit = [F.struct(F.lit(k).alias("licence"), F.array(*map(F.lit, g)).alias("grams"), F.lit(n).alias("n_template"), F.lit(a).alias("least"), F.lit(b).alias("most")) for k, g, n, a, b in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*lit)))


def scan_licences(docs: DataFrame, *, id_col="doc_id", text_col="text", templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """Every (doc_id, licence) reached: doc_id, licence, dice (the best of the text's units),
    n_units (distinct units that reach it), whole (whether the whole text does).

    Templates number a few dozen, which bounds what is broadcast: they are joined by size, so that
    each unit meets only templates within its bounds. Null and empty texts match nothing; repeated
    rows give the rows of each id once."""
    templates = TEMPLATES if templates is None else templates
    if not any(map(_bigrams, templates.values())):
        raise ValueError("no template has a word bigram")
    spark = docs.sparkSession
    found = anchors(templates, least)
    # lower() is bound once: within an OR it would be run for each anchor
    anchored = lambda c: F.exists(F.array(F.lower(c)), lambda low: reduce(lambda a, b: a | b, (low.contains(x) for x in found)))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(anchored("text"))
    paragraphs = F.split("text", r"\n[\x20\x09-\x0D]*\n")
    units = F.array_distinct(F.concat(F.array("text"), paragraphs, F.split("text", "\n")))
    u = d.select("doc_id", "text", F.explode(units).alias("unit"))
    u = u.select("doc_id", (F.col("unit") == F.col("text")).alias("whole"), "unit").filter(anchored("unit"))
    t = template_table(spark, templates, least)
    sizes = t.select(F.explode(F.sequence(F.ceil("least").cast("int"), F.floor("most").cast("int"))).alias("n"), "licence", "grams", "n_template")
    longest = max((len(_bigrams(x)) for x in templates.values()), default=0) * (2 - least) / least
    u = u.withColumn("g", word_bigrams(F.col("unit"))).drop("unit").withColumn("n", F.size("g")).filter((F.col("n") > 0) & (F.col("n") <= longest))
    shared = F.size(F.array_intersect("g", "grams"))
    m = u.join(F.broadcast(sizes), "n").withColumn("dice", 2.0 * shared / (F.col("n") + F.col("n_template"))).filter(F.col("dice") >= least)
    return m.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count("*").cast("long").alias("n_units"), F.max("whole").alias("whole"))


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(read(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{g}'" for g in _bigrams(t))) for k, t in TEMPLATES.items())
    return rf"""
WITH t(licence, grams) AS (VALUES {rows}),
u AS (SELECT DISTINCT doc_id, text, unnest(list_concat([text], list_concat(string_split_regex(text, '\n[\x20\x09-\x0D]*\n'), string_split(text, chr(10))))) AS unit FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unit = text AS whole, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM u),
g AS (SELECT doc_id, whole, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
m AS (SELECT doc_id, whole, licence, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM g JOIN t ON len(g) BETWEEN len(grams) * {LEAST_DICE} / (2 - {LEAST_DICE}) AND len(grams) * (2 - {LEAST_DICE}) / {LEAST_DICE})
SELECT doc_id, licence, max(dice) AS dice, count(*) AS n_units, bool_or(whole) AS whole FROM m WHERE dice >= {LEAST_DICE} GROUP BY doc_id, licence
"""


OP2_SQL = _sql()
