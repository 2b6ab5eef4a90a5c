"""Licence scan of a file tree.

Headers and licence files are compared with licence templates by TF-IDF cosine.
Of every text the lines that hold a telling term count, each alone, and blocks of
``LENGTHS`` lines that begin where a run of telling lines begins or up to ``BEFORE``
lines earlier, so a notice may be wrapped and stand behind comment signs. Equal
blocks of all files are one unit, found once. Document frequencies are counted
over the words of all files; units, frequencies and templates are sparse tables
that are joined on the term and summed by unit and template.

A unit's licence is that of the most similar template, if the score reaches
``THRESHOLD`` and the best template of another licence stays ``MARGIN`` behind: the
first sentence of a BSD notice, say, which two licences share, names none. An SPDX
line counts before all blocks. Licence files then give their licence to the
directories below: distinct directories are joined with their ancestors and the
nearest one wins. Only DataFrame functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .shared import named, stored, without

# Titles, notices and headers by which files name their licence.
_GPL_WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                 "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.")
_BSD_TWO = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
            "documentation and/or other materials provided with the distribution.")
_BSD_THREE = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission.")
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def _gnu() -> list[tuple[str, str]]:
    """Title, notice and program header of each GNU licence and version."""
    out = []
    for name, kind, version, date in (
            ("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"), ("LGPL-2.1", "Lesser ", "2.1", "February 1999"),
            ("LGPL-3.0", "Lesser ", "3", "29 June 2007"), ("AGPL-3.0", "Affero ", "3", "19 November 2007")):
        header = (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as "
                  f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
        out += [(name, f"GNU {kind}General Public License Version {version}, {date}"), (name, f"GNU {kind}General Public License, version {version}"),
                (name, f"This work is licensed under the GNU {kind}General Public License, version {version}."),
                (name, header), (name, f"{header} {_GPL_WARRANTY.format(kind)}")]
    return out


def _creative() -> list[tuple[str, str]]:
    """Notices of the Creative Commons licences, version 4.0."""
    out = []
    for code, kind in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                       ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        out += [(f"CC-{code}-4.0", f"Licensed under CC {code} 4.0."), (f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {kind} 4.0 International License."),
                (f"CC-{code}-4.0", f"Creative Commons {kind} 4.0 International Public License")]
    return out


TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", f"{_MIT_GRANT}."),
    ("MIT", f"{_MIT_GRANT} (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD_TWO),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THREE),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
                "can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *_gnu(),
    *_creative(),
]

THRESHOLD, MARGIN = 0.8, 0.01
LENGTHS = (2, 3, 5, 8, 13, 21)  # lines of a block, besides single lines
BEFORE = 2  # lines in front of a telling line where a block may begin; also the gap within a run
#: a line that holds one of these words is telling
TELLING = ("licen[cs]e[ds]?", "copyright", "permission", "redistributions?", "warranty", "gnu", "unencumbered", "mozilla", "creative commons")
TELLING_LINE = "(^|[^0-9a-z])(" + "|".join(TELLING) + ")([^0-9a-z]|$)"
SPDX = r"SPDX-License-Identifier:[\x20\x09]*([0-9A-Za-z.+-]+)"
SPLIT, BREAKS = "[^0-9a-z]+", "[\n\r]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ["own_license", "own_score", "license", "license_dir"]


def terms(text: str) -> list[str]:
    return [t for t in re.split(SPLIT, text.lower()) if t]


def _lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWERED)


def _terms(c: Column) -> Column:
    return F.filter(F.split(c, SPLIT), lambda t: t != "")


def blocks_of(text: Column) -> Column:
    """Blocks of a lowered text, as sorted words in one string, each block once."""
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(text, BREAKS)), _blocks), 1))


def _blocks(lines: Column) -> Column:
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(TELLING_LINE), i)), lambda i: i.isNotNull())

    def cut(at):
        begins = F.filter(at, lambda p, j: (j == 0) | (p - F.get(at, j - 1) > BEFORE))
        single = F.transform(at, lambda p: F.get(lines, p))
        starts = F.array_distinct(F.flatten(F.transform(begins, lambda p: F.array(*[F.greatest(p - k, F.lit(0)) for k in range(BEFORE + 1)]))))
        several = F.flatten(F.transform(starts, lambda p: F.array(*[F.array_join(F.slice(lines, p + 1, n), " ") for n in LENGTHS])))
        return F.transform(F.concat(single, several), lambda b: F.array_join(F.sort_array(_terms(b)), " "))

    return F.element_at(F.transform(F.array(at), cut), 1)


def _weighted(bags: DataFrame, key: str, counts: DataFrame, n_files: Column) -> DataFrame:
    """(key, term, weight): tf times idf, of bags (key, term, tf)."""
    idf = F.log((n_files + 1) / (F.coalesce("files", F.lit(0)) + 1)) + 1.0
    return bags.join(counts, "term", "left").select(key, "term", (F.col("tf") * idf).alias("weight"))


def block_licenses(blocks: DataFrame, words: DataFrame, n_files: Column, threshold: float, margin: float, templates) -> DataFrame:
    """(unit, license, score) of the blocks that name a licence.

    blocks: (unit, block), a row each. words: (term, files), in how many files each
    word stands. Only a block's unit goes along with its words."""
    spark = blocks.sparkSession
    bags = lambda rows, key: rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    given = bags(spark.createDataFrame([(k, t) for k, (_, text) in enumerate(templates) for t in terms(text)], "k int, term string"), "k")
    unit_terms = stored(bags(blocks.select("unit", F.explode(F.split("block", " ")).alias("term")), "unit"), "license-units")
    used = unit_terms.select("term").unionByName(given.select("term")).distinct()
    counts = stored(words.join(used, "term", "left_semi"), "license-words")
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    units = stored(_weighted(unit_terms, "unit", counts, n_files), "license-weights")
    norms = units.groupBy("unit").agg(length.alias("norm"))
    models = _weighted(given, "k", counts, n_files).withColumnRenamed("weight", "by")
    lengths = models.groupBy("k").agg(F.sqrt(F.sum(F.col("by") * F.col("by"))).alias("length"))
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(templates)], "k int, name string")
    dots = units.join(models, "term").groupBy("unit", "k").agg(F.sum(F.col("weight") * F.col("by")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm") / F.col("length"), 6)
    scores = dots.join(norms, "unit").join(lengths, "k").join(names, "k").groupBy("unit", "name").agg(F.max(score).alias("score"))
    # a licence's best and the best of the others: two rows of a block's few
    ranked = scores.groupBy("unit").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "name")), asc=False), 1, 2).alias("best"))
    first, rival = F.col("best")[0], F.coalesce(F.get("best", F.lit(1))["score"], F.lit(0.0))
    clear = (first["score"] >= threshold) & (F.round(first["score"] - rival, 6) >= margin)
    return ranked.filter(clear).select("unit", first["name"].alias("license"), first["score"].alias("score"))


def scan_files(files: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, margin: float = MARGIN, templates=None) -> DataFrame:
    """(row, license, score) with the files as structs in ``row``, null where a file
    names no licence: its SPDX line's id with score 1, else its best block's (of
    equal scores the name later in the alphabet). Null and empty texts have none.

    Texts with blocks are few; they are known by their digest, so copies are cut once."""
    templates = TEMPLATES if templates is None else templates
    low = _lowered(F.coalesce(named(text_col).cast("string"), F.lit("")))
    spdx = F.nullif(F.regexp_extract(F.coalesce(named(text_col).cast("string"), F.lit("")), SPDX, 1), F.lit(""))
    rest = [c for c in files.columns if c != text_col]
    rows = files.select(F.struct(*(map(named, rest) if rest else [F.lit(0)])).alias("row"), spdx.alias("spdx"), low.alias("low"))
    telling = F.col("low").rlike(TELLING_LINE)
    words = rows.select(F.explode(F.array_distinct(_terms(F.col("low")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("files"))
    texts = rows.filter(telling).select(F.md5("low").alias("digest"), "low").groupBy("digest").agg(F.first("low").alias("low"))
    cut = texts.select("digest", F.explode(blocks_of(F.col("low"))).alias("block")).filter("block <> ''")
    found = stored(cut.withColumn("unit", F.md5("block")), "license-blocks")
    blocks = found.groupBy("unit").agg(F.first("block").alias("block"))  # equal blocks are one
    n_files = rows.select(F.count(F.lit(1))).scalar()
    of = block_licenses(blocks, words, n_files, threshold, margin, templates)
    own = stored(found.select("digest", "unit").join(of, "unit").groupBy("digest").agg(F.max(F.struct("score", "license")).alias("own")), "license-own")
    keyed = rows.select("row", "spdx", F.when(telling, F.md5("low")).alias("key"))
    out = keyed.join(own, F.col("key") == F.col("digest"), "left")
    return out.select("row", F.coalesce("spdx", "own.license").alias("own_license"),
                      F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.col("own.score")).alias("own_score"))


def scan_tree(files: DataFrame, path_col: str = "path", text_col: str = "text", licence_name: str = r"(?i)^(licen[cs]e|copying)(\..*)?$",
              threshold: float = THRESHOLD, templates=None, keep: list[str] | None = None) -> DataFrame:
    """files (columns ``keep``, default all but the text) with own_license,
    own_score, license and license_dir.

    A file's own licence counts first (``scan_files``); without one it takes the licence of the
    nearest directory at or above its own that holds a licence file with a
    notice (in one directory the best score, then the first name and path).
    ``license_dir`` is that directory, null if the licence is its own.

    Nulls: a null path is a file of its own that inherits nothing. Repeated
    rows each get the same result. An empty table gives no rows. Input columns
    called like a result column are replaced; others may have any name.
    """
    keep = [c for c in (keep or files.columns) if c != text_col and c.lower() not in COLUMNS]
    # inside, columns have names of their own, whatever the input's are called
    own = files.select(F.struct(*(map(named, keep) if keep else [F.lit(0)])).alias("kept"), named(path_col).alias("path"), named(text_col).alias("text"))
    path = F.col("row.path")
    scanned = stored(scan_files(own, "text", threshold, MARGIN, templates).select(
        F.col("row.kept").alias("kept"), F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"),
        "own_license", "own_score"), "license-files")
    given = (
        scanned.filter(F.col("own_license").isNotNull() & F.col("name").rlike(licence_name) & F.col("dir").isNotNull())
        .groupBy(F.col("dir").alias("up")).agg(F.min(F.struct((-F.col("own_score")).alias("order"), F.col("own_license").alias("given"))).alias("best"))
        .select("up", F.col("best.given").alias("given"))
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inherited = (
        scanned.select("dir").filter("dir IS NOT NULL").distinct()
        .withColumn("up", F.explode(F.array_distinct(above))).join(given, "up")
        .groupBy("dir").agg(F.max(F.struct(F.length("up").alias("deep"), F.col("up"), F.col("given"))).alias("near"))
        .select(F.col("dir").alias("at"), F.col("near.up").alias("up"), F.col("near.given").alias("given"))
    )
    out = scanned.join(inherited, F.col("dir") == F.col("at"), "left")
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("up")).alias("license_dir"))
