"""Sentence sequences, gaps and nesting."""

from curbline.llm import license_rules as R

MIT = [R.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")]


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, license_ids string")
    return {r["doc_id"]: r for r in R.op3(spark, docs).collect()}


def test_rules(spark):
    texts = [
        None, "", "no licence at all. Just text.",
        "Intro.\n" + ".\n".join(MIT).upper() + ".\nEnd.",
        ". ".join(MIT[:3]) + ".",
        MIT[0] + ". One. " + MIT[1] + ". " + MIT[2] + ".",
        MIT[0] + ". One. Two. " + MIT[1] + ". " + MIT[2] + ".",
        MIT[1] + ". " + MIT[0] + ". " + MIT[2] + ".",
        'Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.',
        "a b. " * 20_000 + "Licensed under CC BY-NC 4.0.",
    ]
    got = run(spark, texts)
    assert [got[i]["n_matches"] for i in range(len(texts))] == [0, 0, 0, 1, 1, 1, 0, 0, 3, 1]
    assert got[3]["matches"] == "mit-text:1:4" and got[3]["n_known_sentences"] == 4
    assert got[4]["matches"] == "mit-text-short:0:2"
    assert got[5]["matches"] == "mit-text-short:0:3"
    assert got[8]["licenses"] == "Apache-2.0,CC-BY-NC-4.0,MIT"
    assert got[9]["matches"] == "cc-by-nc-4.0-line:20000:20000"


def test_repeats_and_empty_table(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id bigint, text string")
    assert [r["licenses"] for r in R.op3(spark, docs).collect()] == ["MIT"] * 3
    assert R.op3(spark, docs.where("false")).collect() == []


def test_anchors_are_in_every_sentence():
    hints = R.anchors(R.SENTENCES)
    assert all(any(h in s for h in hints) for s in R.SENTENCES.values())
    assert {s for _, _, seq in R.RULES for s in seq} <= set(R.SENTENCES)


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = R.op3(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_matches_in_long_texts_against_plain_loops(spark):
    import random

    draw = random.Random(5)
    names = list(R.SENTENCES)
    for trial in range(3):
        ids = [draw.choice(["mit-grant", "mit-notice", "mit-as-is", "mit-liability", "apache-line", "apache-use", None]) for _ in range(120)]
        text = ".\n".join(R.SENTENCES[i] if i else "unknown" for i in ids)
        known = [(k, i) for k, i in enumerate(ids) if i]
        found = []
        for order, (name, _, seq) in enumerate(R.RULES):
            for s in range(len(known) - len(seq) + 1):
                part = known[s : s + len(seq)]
                if tuple(p[1] for p in part) == seq and all(b[0] - a[0] <= R.MAX_GAP + 1 for a, b in zip(part, part[1:])):
                    found.append((part[0][0], part[-1][0], order, name))
        keep = [
            x for x in sorted(found)
            if not any(y[0] <= x[0] and y[1] >= x[1] and (y[1] - y[0] > x[1] - x[0] or y[2] < x[2]) for y in found)
        ]
        got = run(spark, [text])[0]["matches"]
        assert got == ",".join(f"{n}:{a}:{b}" for a, b, _, n in keep), names


MIT_TEXT = '''MIT License

Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD_TEXT = '''Copyright (c) 2020, A. Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
'''
GPL_TEXT = '''    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
'''
APACHE_TEXT = '''Copyright 2020 A. Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''


def test_standard_notices_wrapped_over_lines(spark):
    texts = [MIT_TEXT, BSD_TEXT, GPL_TEXT, GPL_TEXT.replace("software;", "software:").replace("Foundation; either version 2", "Foundation, either version 3"), APACHE_TEXT]
    want = ["mit-text", "bsd-3-clause-text", "gpl-2.0-or-later-notice", "gpl-3.0-or-later-notice", "apache-2.0-notice"]
    known = [4, 4, 3, 3, 4]
    marks = [lambda t, m=m: "".join(m + line for line in t.splitlines(True)) for m in ("", "# ", "// ", " * ", "dnl ")]
    forms = [*marks, lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split()), lambda t: "\n".join(t.split())]
    for k, form in enumerate(forms):
        got = run(spark, [form(t) for t in texts])
        rules = [[m.split(":")[0] for m in got[i]["matches"].split(",")] for i in range(len(texts))]
        if k < 6:
            assert [got[i]["n_known_sentences"] for i in range(len(texts))] == known, k
            assert rules == [[w] for w in want], k
        else:  # no line left before the first sentence of those that follow a heading without a stop
            assert rules[2:4] == [[w] for w in want[2:4]], k
    assert run(spark, [MIT_TEXT])[0]["matches"] == "mit-text:5:22"


def test_wrapped_lines_count_as_one_unknown_sentence(spark):
    grant, notice, as_is = MIT[:3]
    one, two = "First words\nand the rest of it.", "First words.\n\nAnd the rest\nof it."
    texts = [f"{grant}:\n\n{x}\n\n(1) {notice}.\n2) {as_is}." for x in (one, two, "1.\n\n*\n\n" + one)]
    got = run(spark, texts)
    assert [got[i]["licenses"] for i in range(3)] == ["MIT", "", "MIT"]
    flat = run(spark, [". ".join(["conditions are met: 1", "2"]).join(["", ""]), BSD_TEXT[BSD_TEXT.index("Redistribution"):].replace("\n", " ")])
    assert flat[0]["n_matches"] == 0 and flat[1]["licenses"] == "BSD-3-Clause"


def test_named_licences_in_every_phrase(spark):
    import re

    spoken = {
        "This project is licensed under the Mozilla Public License v2.0.": "MPL-2.0",
        "# SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
        "Distributed under the\n * ISC License.": "ISC",
        "Released under the Eclipse Public License, version 2.0.": "EPL-2.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "We licensed under the table.": "",
    }
    got = run(spark, list(spoken))
    assert [got[i]["licenses"] for i in range(len(spoken))] == list(spoken.values())
    every = [(licence, s) for licence in R.NAMES for s in R.LINES[f"line-{licence}"]]
    got = run(spark, [s.capitalize() + "." for _, s in every])
    assert [got[i]["licenses"] for i in range(len(every))] == [licence for licence, _ in every]
    assert len(R.NAMES) > 60 and not re.search("[^a-z0-9 ]", " ".join(R.NAMES.values()))


def test_sql_agrees_on_wrapped_marked_and_broken_notices(spark):
    import random

    import duckdb

    draw = random.Random(12)
    notices = [MIT_TEXT, BSD_TEXT, GPL_TEXT, APACHE_TEXT, "Licensed under the MIT License.", "SPDX-License-Identifier: Zlib", "An unknown sentence here;"]
    texts = [None, "", *notices]
    for _ in range(250):
        lines = "\n".join(draw.choices(notices, k=draw.randrange(1, 4))).split("\n")
        mark = draw.choice(["", "# ", "// ", " * ", "dnl ", "rem ", "a) ", "1. "])
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(lines))
            lines[k] = draw.choice(["", "iv)", "See: (b)", "remark one.", lines[k] + " more words", lines[k][: len(lines[k]) // 2], "Licensed under the"])
        texts.append(draw.choice(["\n", "\r\n", " \n", " "]).join(mark + line for line in lines))
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in R.op3(spark, frame).collect())
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert got == sorted(con.execute(R.sql()).fetchall())
    assert sum(r[2] for r in got) > 200
