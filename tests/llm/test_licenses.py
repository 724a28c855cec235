from pyspark.sql import functions as F

import corpus
from feedlake.llm import licenses as lic

FILES = "doc_id long, path string, text string, notice boolean"


def run(spark, rows):
    got = lic.file_licenses(spark.createDataFrame(rows, FILES)).collect()
    return sorted(((r.doc_id, r.own_license, r.license, r.from_dir, r.levels) for r in got), key=str)


def test_own_and_inherited(spark):
    mit, apache, gpl = "Released under the MIT License.", "x\nlicensed under the apache license, version 2.0\ny", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", mit, True), (2, "a/b/c/x.py", "nothing", False), (3, "a/b/LICENSE", apache, True), (4, "a/b/y.py", "code", False),
        (5, "z/q.py", "code", False), (6, "a/own.py", gpl, False), (7, "top.txt", "code", False), (8, None, mit, True), (9, None, "code", False),
        (10, "k/1", apache, True), (11, "k/2", mit, True), (12, "k/3", mit, None), (13, "k/4", None, None), (14, "a/b/c/x.py", gpl, False),
    ]
    assert run(spark, rows) == sorted([
        (1, "MIT", "MIT", None, None), (2, None, "Apache-2.0", "a/b", 1), (3, "Apache-2.0", "Apache-2.0", None, None),
        (4, None, "Apache-2.0", "a/b", 0), (5, None, None, None, None), (6, "GPL-3.0", "GPL-3.0", None, None), (7, None, None, None, None),
        (8, "MIT", "MIT", None, None), (9, None, None, None, None), (10, "Apache-2.0", "Apache-2.0", None, None), (11, "MIT", "MIT", None, None),
        (12, "MIT", "MIT", None, None), (13, None, "Apache-2.0", "k", 0), (14, "GPL-3.0", "GPL-3.0", None, None)], key=str)


def test_root_notice_and_repeated_rows(spark):
    rows = [(1, "LICENSE", "Released under the MIT License.", True), (1, "LICENSE", "Released under the MIT License.", True), (2, "d/e/f", "x", False)]
    assert run(spark, rows) == [(1, "MIT", "MIT", None, None), (1, "MIT", "MIT", None, None), (2, None, "MIT", "", 2)]


def test_every_template_matches_itself_and_prose_matches_none(spark):
    rows = [(i, f"{i}/f", text.upper(), False) for i, (_, text) in enumerate(lic.TEMPLATES)]
    rows += [(100, "p/f", "the licence was granted to the fishing boat and its crew last year", False),
             (101, "q/f", "Released under the MIT License. " + "and much more prose follows here " * 5, False)]
    got = {r.doc_id: (r.own_license, r.similarity) for r in lic.file_licenses(spark.createDataFrame(rows, FILES)).collect()}
    assert all(got[i] == (k, 1.0) for i, (k, _) in enumerate(lic.TEMPLATES))
    assert got[100] == got[101] == (None, None)


def test_odd_documents(spark):
    docs, _ = corpus.clashing(spark)
    got = lic.file_licenses(lic.document_paths(docs))
    assert got.count() == len(corpus.ODD) and got.filter("license IS NOT NULL").count() == 0
    assert lic.file_licenses(lic.document_paths(docs.filter(F.lit(False)))).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2020 Jane Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
#: Expected licenses written by hand, apart from the template table.
SHAPES = [
    ("proprietary", "All rights reserved."), ("proprietary", "Copyright 2020 Foo Inc. All rights reserved."),
    ("MIT", MIT_FILE), ("MIT", " ".join(MIT_FILE.split("\n\n")[2].split())), ("MIT", "MIT License"), ("MIT", "# License: MIT"),
    ("ISC", "Licensed under the ISC License."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-2.0", "   GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nCopyright (C) 1989, 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0 */"), ("LGPL-2.1", "GNU Lesser General Public License\nVersion 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "// SPDX-License-Identifier: BSD-2-Clause"), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]


def test_each_shape_states_its_own_license(spark):
    rows = [(i, f"{i}/f", text, False) for i, (_, text) in enumerate(SHAPES)]
    rows += [(100, "p/f", "Released under the Foo License.", False), (101, "q/f", "SPDX-License-Identifier: Zlib", False)]
    got = {r.doc_id: r.own_license for r in lic.file_licenses(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(SHAPES)} | {100: None, 101: None}
