from pyspark.sql import functions as F

from chronoweave.llm import licenses

FILES = [
    ("r/LICENSE", "MIT License\nReleased under the MIT License."), ("r/a.py", "x = 1"), ("r/b/c.py", "# Licensed under the Apache License, Version 2.0.\ny"),
    ("r/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/b/d/e/f.py", "z"), ("r/b/d/e/f.py", "z"),
    ("top.txt", "no licence talk, only the word license once"), ("q/x.py", None), (None, "Released under the MIT License."), ("", ""), ("r/b", "file, not directory"),
    ("r2/x.py", "prefix of another name"), ("q/LONG.txt", "word " * 50000 + "\nAll rights reserved."),
]


def scanned(spark, files):
    rows = [(i, p, t, "clash") for i, (p, t) in enumerate(files)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "id int, path string, text string, licence string")).collect()
    assert len(got) == len(files)
    return {r["id"]: (r["origin"], r["licence"], r["licence_dir"]) for r in got}


def test_own_inherited_and_none(spark):
    seen = scanned(spark, FILES)
    assert seen[0] == ("own", "MIT", None) and seen[1] == ("inherited", "MIT", "r")
    assert seen[2] == ("own", "Apache-2.0", None) and seen[3] == ("own", "GPL-3.0", None)
    assert seen[4] == seen[5] == ("inherited", "GPL-3.0", "r/b")
    assert seen[6] == seen[7] == seen[9] == seen[11] == ("none", None, None)
    assert seen[8] == ("own", "MIT", None) and seen[10] == ("inherited", "MIT", "r") and seen[12] == ("own", "Proprietary", None)


def wrapped(text, mark="", width=70):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines, line = [*lines, line], ""
        line = f"{line} {word}".strip()
    return "\n".join(f"{mark}{x}" for x in [*lines, line])


def whole(*paragraphs):
    notice = "Copyright (c) 2020, Jane Doe and others\nAll rights reserved."
    return "\n\n".join([notice, *[wrapped(p) for p in paragraphs]]) + "\n"


GPL3 = licenses._GNU_TERMS.format(what="program", kind="", version="3")
GPL3_REST = licenses._GNU_REST.format(what="program", kind="", version="3")


def test_whole_files_decide_before_a_reservation_of_rights(spark):
    files = [
        ("mit/LICENSE", "MIT License\n\n" + whole(licenses._MIT_GRANT, licenses._MIT_REST)),
        ("bsd3/LICENSE", whole(licenses._BSD_TWO, licenses._BSD_THIRD, licenses._BSD_DISCLAIMER[:300])),
        ("bsd2/LICENSE.txt", whole(licenses._BSD_TWO, licenses._BSD_DISCLAIMER)),
        ("isc/LICENSE", whole(licenses._ISC_GRANT, licenses._ISC_REST)),
        ("apache/LICENSE", "          Apache License\n      Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n" + "   terms and conditions for use\n" * 400),
        ("gpl/COPYING", "      GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n" + "preamble of the whole text\n" * 500),
        ("none/LICENSE", "Copyright 2020\nAll rights reserved."), ("bsd3/src/deep/x.c", "int x;"), ("long/LICENSE", "word " * 200_000 + "\n\n" + licenses._MIT_GRANT),
    ]
    want = ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Apache-2.0", "GPL-3.0", "Proprietary", "BSD-3-Clause", "MIT"]
    seen = scanned(spark, files)
    assert [seen[i][1] for i in range(len(files))] == want
    assert seen[7] == ("inherited", "BSD-3-Clause", "bsd3")


def test_headers_wrapped_behind_comment_marks(spark):
    mit = licenses._MIT_GRANT
    files = [
        ("a.py", "#!/usr/bin/env python\n# Copyright 2020 Jane Doe\n#\n" + wrapped(GPL3, "# ") + "\n#\n" + wrapped(GPL3_REST, "# ") + "\n\nimport os\n"),
        ("b.c", "/*\n" + wrapped(licenses._BSD_TWO + licenses._BSD_DISCLAIMER, " ") + "\n */\nint x;\n"),
        ("c.js", "// Copyright 2021\r\n//\r\n" + wrapped(licenses._APACHE_HEADER, "// ").replace("\n", "\r\n") + "\r\nlet x;"),
        ("d.java", "/**\n" + wrapped(mit, " * ") + "\n */\nclass X {}"),
        ("e.html", "<!-- " + licenses.TEMPLATES[-1][1] + " -->\n<p>x</p>"),
        ("f.md", "A long page about many other things that has, near the end of one of its lines, this. Licensed under CC BY-SA 4.0. And goes on with more."),
        ("g.py", "x = 1  # the license of a driver, copyright law and the public domain\n" * 2000),
    ]
    seen = scanned(spark, files)
    assert [seen[i][1] for i in range(len(files))] == ["GPL-3.0", "BSD-2-Clause", "Apache-2.0", "MIT", "Unlicense", "CC-BY-SA-4.0", None]


def test_every_template_names_itself(spark):
    texts = spark.createDataFrame([(t,) for _, t in licenses.TEMPLATES], "statement string")
    got = {r["sid"]: r for r in licenses.score_statements(texts.withColumn("sid", F.col("statement"))).collect()}
    for name, text in licenses.TEMPLATES:
        assert got[text]["licence"] == name and got[text]["cosine"] == 1


def test_ties_go_to_the_lesser_name(spark):
    text = spark.createDataFrame([("x", "one licence text")], "sid string, statement string")
    both = [("b", "one licence text"), ("a", "one licence text"), (licenses.RESERVED, "one licence text")]
    assert [(r["licence"], r["cosine"]) for r in licenses.score_statements(text, both).collect()] == [("a", 1.0)]


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
