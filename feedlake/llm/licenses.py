"""License scans: notices matched to templates by TF-IDF cosine, then inherited from the nearest ancestor directory.

A unit of a text is a line, or a block of lines between blank lines. Units and templates are vectors of word counts times
inverse template frequency; a word that no template has weighs most, so that a notice lost in other prose stays far from
all templates. A unit whose cosine to a template reaches ``LEAST_COSINE`` and that names one of ``STEMS`` states that
template's license; a file's own license is that of its best unit. A file flagged as notice speaks for its directory. A
file without a license of its own takes the one of the nearest directory above it for which some notice speaks; among
several, the license of most notices, then the first by name.

All steps are projections, aggregates and equi-joins. The templates are a fixed table and are broadcast. Only texts that
name a stem are cut into units (that is part of the rule, so nothing is lost), and directories, not files, look for their
ancestors.

Null and empty texts state nothing. A null path has no directory. Repeated rows give repeated rows; rows with the same
path are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.common import Scratch

LEAST_COSINE = 0.7
WORD = "[a-z0-9]+"
#: Every notice names one of these.
STEMS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "all rights reserved")
#: Usual wordings of notices, none with an apostrophe (the SQL form quotes with it).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright (c) All rights reserved."),
    ("proprietary", "Copyright Inc. All rights reserved."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved."),
    # Titles and paragraphs of licence files: a unit is a paragraph, so each stands by itself.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "ISC License"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]


def template_words(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(word, idf)`` of the template words, and ``(license, template, word, share)`` with vectors of length one."""
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, license string, body string")
    counts = rows.select("template", "license", F.explode(F.regexp_extract_all(F.lower("body"), F.lit(WORD), 0)).alias("word")).groupBy(
        "template", "license", "word").agg(F.count("*").alias("n"))
    idf = counts.groupBy("word").agg((F.log(F.lit(1.0 + len(TEMPLATES)) / (1 + F.count("*"))) + 1).alias("idf"))
    weights = counts.join(F.broadcast(idf), "word").withColumn("w", F.col("n") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, weights.join(F.broadcast(norms), "template").select("template", "license", "word", (F.col("w") / F.col("norm")).alias("share"))


def _names_stem(text: Column) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        found = found | F.contains(low, F.lit(stem))
    return found


def own_licenses(files: DataFrame, scratch: Scratch) -> DataFrame:
    """``(path, h, own_license, similarity)`` of the texts in ``files (path, text, h)`` that state a license."""
    spark = files.sparkSession
    idf, templates = template_words(spark)
    lines = F.split("text", "\n")
    blocks = F.split("text", "\n[ \t\r]*\n")
    units = files.filter(_names_stem(F.col("text"))).select("path", "h", F.explode(F.array_distinct(F.concat(lines, blocks))).alias("unit")).filter(
        _names_stem(F.col("unit"))).select("path", "h", "unit").distinct().select(
        "path", "h", F.xxhash64("unit").alias("u"), F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(WORD), 0)).alias("word"))
    # Stored: lengths and products both read it, and the texts are scanned once.
    counts = scratch.store(units.groupBy("path", "h", "u", "word").agg(F.count("*").alias("n")), "counts")
    rarest = F.lit(1.0 + len(TEMPLATES))
    weights = counts.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.log(rarest) + 1))
    # One row for each unit and template; the words without a template add to the length only.
    known = weights.join(F.broadcast(templates), "word", "left")
    norms = weights.groupBy("path", "h", "u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = known.filter("template IS NOT NULL").groupBy("path", "h", "u", "template", "license").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    same = [dots[c].eqNullSafe(norms[c]) for c in ("path", "h", "u")]
    scored = dots.join(norms, same).select(dots["path"], dots["h"], "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = F.max(F.struct("similarity", "license"))
    own = scored.filter(F.col("similarity") >= LEAST_COSINE).groupBy("path", "h").agg(best.alias("b")).select(
        "path", "h", F.col("b.license").alias("own_license"), F.col("b.similarity").alias("similarity"))
    own = scratch.store(own, "own")
    scratch.drop("counts")
    return own


def _parent(path: Column) -> Column:
    """The directory of a path; empty for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_licenses(files: DataFrame) -> DataFrame:
    """Own and inherited license of every row of ``files (doc_id, path, text, notice)``.

    ``notice`` says whether a file that states a license speaks for its directory. ``levels`` counts the directories
    from the file's own (0) up to the one whose license it takes.
    """
    keyed = files.select("doc_id", "path", "text", F.coalesce("notice", F.lit(False)).alias("notice"), F.xxhash64("text").alias("h"))
    scratch = Scratch(files.sparkSession, "licenses")
    own = own_licenses(keyed.select("path", "text", "h"), scratch)
    rows = keyed.drop("text")
    mine = scratch.store(rows.join(own, rows["path"].eqNullSafe(own["path"]) & rows["h"].eqNullSafe(own["h"]), "left").select(
        "doc_id", rows["path"], "notice", "own_license", "similarity", _parent(rows["path"]).alias("dir")), "files")
    votes = mine.filter("notice AND own_license IS NOT NULL AND dir IS NOT NULL").groupBy("dir", "own_license").agg(F.count("*").alias("n"))
    spoken = votes.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("n"), F.col("own_license"))).alias("license"))
    # Each directory and those above it, by the number of steps up; the root is the empty path.
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = mine.select("dir").filter("dir IS NOT NULL").distinct().select(
        "dir", F.explode(F.sequence(F.lit(0), depth)).alias("levels")).select(
        "dir", "levels", F.array_join(F.slice(F.split("dir", "/"), 1, depth - F.col("levels")), "/").alias("up"))
    nearest = above.join(spoken.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.min(F.struct("levels", "license", "up")).alias("near")).select("dir", "near.*")
    return mine.join(nearest, "dir", "left").select(
        "doc_id", "path", "own_license", "similarity", F.coalesce("own_license", "license").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("up")).alias("from_dir"),
        F.when(F.col("own_license").isNull(), F.col("levels")).alias("levels"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree by source, language and thousand; a third of them stand at each level.

    These tables have no file names, so every document that states a license counts as notice of its directory.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    k = F.pmod(F.col("doc_id"), F.lit(3))
    folder = F.when(k == 0, F.concat_ws("/", "source")).when(k == 1, F.concat_ws("/", "source", "lang")).otherwise(
        F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string")))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text", F.lit(True).alias("notice"))


def _sql() -> str:
    stems = " OR ".join("contains(lower({0}), '%s')" % s for s in STEMS)
    values = ", ".join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(TEMPLATES))
    total = len(TEMPLATES)
    return f"""
WITH files AS (
  SELECT doc_id, text, row_number() OVER () AS r,
    concat_ws('/', CASE ((doc_id % 3) + 3) % 3 WHEN 0 THEN concat_ws('/', source) WHEN 1 THEN concat_ws('/', source, lang)
      ELSE concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR)) END,
      coalesce(CAST(doc_id AS VARCHAR), 'none')) AS path
  FROM documents),
templates(template, license, body) AS (VALUES {values}),
twords AS (
  SELECT template, license, word, count(*) AS n
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(body), '{WORD}')) AS word FROM templates) GROUP BY ALL),
idf AS (SELECT word, ln({1.0 + total} / (1 + count(*))) + 1 AS idf FROM twords GROUP BY word),
tnorm AS (SELECT template, sqrt(sum((n * idf) * (n * idf))) AS norm FROM twords JOIN idf USING (word) GROUP BY template),
shares AS (SELECT template, license, word, n * idf / norm AS share FROM twords JOIN idf USING (word) JOIN tnorm USING (template)),
units AS (
  SELECT DISTINCT r, unit FROM (
    SELECT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'))) AS unit
    FROM files WHERE {stems.format("text")}) WHERE {stems.format("unit")}),
words AS (
  SELECT r, unit, word, count(*) AS n
  FROM (SELECT r, unit, unnest(regexp_extract_all(lower(unit), '{WORD}')) AS word FROM units) GROUP BY ALL),
weights AS (SELECT r, unit, word, n * coalesce(idf, ln({1.0 + total}) + 1) AS w FROM words LEFT JOIN idf USING (word)),
norms AS (SELECT r, unit, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL),
dots AS (SELECT r, unit, template, license, sum(w * share) AS dot FROM weights JOIN shares USING (word) GROUP BY ALL),
scored AS (SELECT r, license, round(dot / norm, 6) AS similarity FROM dots JOIN norms USING (r, unit)),
best AS (
  SELECT r, license AS own_license, similarity FROM scored WHERE similarity >= {LEAST_COSINE}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY similarity DESC, license DESC) = 1),
mine AS (
  SELECT doc_id, path, own_license, similarity, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files LEFT JOIN best USING (r)),
spoken AS (
  SELECT dir, own_license AS license FROM mine WHERE own_license IS NOT NULL GROUP BY dir, own_license
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, own_license) = 1),
dirs AS (SELECT DISTINCT dir, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS depth FROM mine),
above AS (
  SELECT dir, levels, array_to_string(string_split(dir, '/')[1:depth - levels], '/') AS up
  FROM (SELECT dir, depth, unnest(range(0, depth + 1)) AS levels FROM dirs)),
nearest AS (
  SELECT a.dir, levels, license, up FROM above a JOIN spoken s ON a.up = s.dir
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY levels) = 1)
SELECT doc_id, path, own_license, similarity, coalesce(own_license, license) AS license,
  CASE WHEN own_license IS NULL THEN up END AS from_dir, CAST(CASE WHEN own_license IS NULL THEN levels END AS INTEGER) AS levels
FROM mine LEFT JOIN nearest USING (dir)"""


ORACLE_SQL = _sql()
