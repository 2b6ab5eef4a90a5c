"""Licence scans: texts that are not the templates, a plain TF-IDF, odd inputs."""

import math
import re
from collections import Counter

from tillroll.llm import licenses

PROSE = ["the sea was calm and the boat went on", "a license to drive is needed", "permission of the owner is required here", "2 of 3 versions were public",
         "general remarks on software and terms", "free of charge, with or without sugar"] * 3
CASES = {
    "GPL-3.0": "# foo.py\n# Copyright (C) 2020 A. Person\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General "
               "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n",
    "GPL-2.0": " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
               " * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version.\n",
    "LGPL-3.0": "some words\nGNU Lesser General Public License, version 3\nmore words",
    "LGPL-2.1": "      GNU LESSER GENERAL PUBLIC LICENSE\n      Version 2.1, February 1999\n",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
                    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n"
                    "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
                    "   and/or other materials provided with the distribution.\n",
    "Apache-2.0": "      Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS",
    "MIT": "Copyright 2019 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the \"Software\"), to deal in\n"
           "the Software without restriction, including without limitation the rights to\nuse, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of\n"
           "the Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:\n",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Zlib": "// SPDX-License-Identifier: Zlib\n// Released under the MIT License.",
    None: "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
}


def plain(texts):
    """(license, score) of each text by the definitions, without Spark."""
    words = [re.findall("[0-9a-z]+", t.lower()) for t in texts]
    df = Counter(w for ws in words for w in set(ws))

    def vector(bag):
        return {w: n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in Counter(bag).items()}

    models = [(name, vector(licenses.terms(t))) for name, t in licenses.TEMPLATES]
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for t in texts:
        lines = re.split("[\n\r]+", t.lower())
        at = [i for i, x in enumerate(lines) if re.search(licenses.TELLING_LINE, x)]
        begins = [p for k, p in enumerate(at) if k == 0 or p - at[k - 1] > licenses.BEFORE]
        blocks = [lines[p] for p in at] + [" ".join(lines[max(p - b, 0):][:n]) for p in begins for b in range(licenses.BEFORE + 1) for n in licenses.LENGTHS]
        found = []
        for b in {tuple(sorted(re.findall("[0-9a-z]+", b))) for b in blocks} - {()}:
            v, best = vector(b), {}
            for name, m in models:
                s = round(sum(x * v.get(w, 0) for w, x in m.items()) / length(v) / length(m), 6)
                best[name] = max(best.get(name, 0), s)
            top = sorted(((s, n) for n, s in best.items()), reverse=True)
            if top[0][0] >= licenses.THRESHOLD and round(top[0][0] - top[1][0], 6) >= licenses.MARGIN:
                found.append(top[0])
        spdx = re.search(licenses.SPDX, t)
        best = max(found, default=(None, None))
        out.append((spdx[1], 1.0) if spdx else (best[1], best[0]))
    return out


def test_texts_that_are_not_the_templates(spark):
    texts = list(CASES.values()) + PROSE
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {r["row"]["id"]: (r["own_license"], r["own_score"]) for r in licenses.scan_files(df).collect()}
    want = plain(texts)
    assert [got[i][0] for i in range(len(CASES))] == list(CASES)
    for i, (name, score) in enumerate(want):
        assert got[i][0] == name and (score is None) == (got[i][1] is None) and (score is None or abs(got[i][1] - score) <= 2e-6)


def test_long_texts_ties_repeats_and_clashing_names(spark):
    notice, long = "Released under the MIT License.", "word " * 200_000 + "\nLicensed under CC BY-NC 4.0."
    names = "path string, text string, kept string, row string, own_license string, low string, spdx string, digest string, block string, dir string, `odd.name` int"
    rows = [("r/LICENSE", notice), ("r/LICENSE", notice), ("r/COPYING", "Licensed under the Apache License, Version 2.0."), ("r/a/b", None), ("r/a/b", ""), ("r/x", long),
            (None, notice)] + [(f"q/{i}", p) for i, p in enumerate(PROSE)]
    df = spark.createDataFrame([(p, t, "k", "r", "old", "l", "s", "d", "b", "i", 7) for p, t in rows], names)
    out = licenses.scan_tree(df)
    assert out.columns == ["path", "kept", "row", "low", "spdx", "digest", "block", "dir", "odd.name", "own_license", "own_score", "license", "license_dir"]
    got = sorted((str(r["path"]), r["license"], r["license_dir"], r["dir"]) for r in out.collect() if not str(r["path"]).startswith("q/"))
    # two licence files of equal score in one directory: the first name holds below
    assert got == [("None", "MIT", None, "i"), ("r/COPYING", "Apache-2.0", None, "i"), ("r/LICENSE", "MIT", None, "i"), ("r/LICENSE", "MIT", None, "i"),
                   ("r/a/b", "Apache-2.0", "r", "i"), ("r/a/b", "Apache-2.0", "r", "i"), ("r/x", "CC-BY-NC-4.0", None, "i")]
    assert licenses.scan_tree(df.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([("a/LICENSE", CASES["MIT"])], "path string, text string")
    plan = licenses.scan_tree(df)._jdf.queryExecution().toString() + licenses.scan_files(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
