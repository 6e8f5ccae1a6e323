"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.

Statements of a file are its header (the leading comment as a whole) and, for a
licence file, the whole text; besides these its parts: lines, paragraphs joined
across their lines, and sentences of such paragraphs, each with a cue.  Comment
marks are stripped.  Equal statements are scored once, so a notice in a third
of all files costs one row.  A statement is a sparse vector of tf * idf over its
words, idf counted over all distinct statements and the templates; the template
with the highest cosine names the licence.  The whole decides before the parts,
and a mere reservation of rights only where nothing else reaches the bound.  A
file without a statement of its own inherits from the nearest directory above
it, its own included, that holds a licence file.

Joins and aggregations only.  Templates are a short list in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage, scratch_path

MIN_COSINE = 0.6
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|public domain|spdx|permission is hereby|permission to use|redistribution and use"
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e|^copying|^notice"
# Comment marks before and behind a line, and what ends a sentence.
COMMENT = r"^(?:/\*+|\*+/|\*+|//+|#+|--+|;+|<!--)"
COMMENT_END = r"(?:\*/|-->)$"
SENTENCE_END = r"([.!?;]) +"
# Says less than any licence: counts only where nothing else is found.
RESERVED = "Proprietary"

# Conditions and disclaimers that several licences share.
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
)
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GNU_TERMS = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
)
_GNU_REST = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {kind}General Public License for more details. "
    "You should have received a copy of the GNU {kind}General Public License along with this {what}. If not, see https://www.gnu.org/licenses/."
)


def _gnu(licence: str, what: str, kind: str, version: str) -> list[tuple[str, str]]:
    """The usual header of a GNU licence as a whole, and its first paragraph."""
    parts = {"what": what, "kind": kind, "version": version}
    return [(licence, (_GNU_TERMS + _GNU_REST).format(**parts)), (licence, _GNU_TERMS.format(**parts))]


# The usual notices of common licences, by SPDX name.
TEMPLATES = [
    *_gnu("AGPL-3.0", "program", "Affero ", "3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD_TWO + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_TWO + _BSD_THIRD + _BSD_DISCLAIMER),
    *_gnu("GPL-2.0", "program", "", "2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    *_gnu("GPL-3.0", "program", "", "3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC_GRANT + _ISC_REST),
    ("ISC", _ISC_GRANT),
    *_gnu("LGPL-3.0", "library", "Lesser ", "3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MIT", _MIT_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def directory(path: Column) -> Column:
    """Everything before the last slash; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def _said(path: Column, text: Column) -> Column:
    """Statements of a file as (part, statement); part is false for the header and a whole licence file."""
    trimmed = F.transform(F.split(F.translate(text, "\t\r", "  "), "\n"), lambda x: F.trim(x))
    bare = F.transform(trimmed, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, COMMENT, ""), COMMENT_END, "")))
    blocks = F.transform(F.split(F.array_join(bare, "\n"), "\n\n+"), lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))
    blocks = F.filter(blocks, lambda b: b.rlike(CUE))
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, SENTENCE_END, "$1\n"), "\n")))
    parts = F.concat(F.filter(F.concat(bare, sentences), lambda x: x.rlike(CUE)), blocks)
    code = F.array_position(F.transform(trimmed, lambda x: (x != "") & ~x.rlike(COMMENT)), True)
    opens = F.ltrim(F.array_join(trimmed, " ")).rlike(r"^(?:/\*|<!--)")
    closed = F.when(opens, F.array_position(F.transform(trimmed, lambda x: x.contains("*/") | x.contains("-->")), True)).otherwise(0)
    header = F.slice(bare, F.lit(1), F.greatest(F.when(code > 0, code - 1).otherwise(F.size(bare)), closed).cast("int"))
    whole = F.when(file_name(path).rlike(LICENCE_FILE), bare).otherwise(header)
    whole = F.array_join(F.filter(whole, lambda x: x != ""), " ")
    wholes = F.when(whole.rlike(CUE), F.array(whole)).otherwise(F.array().cast("array<string>"))
    marked = F.concat(
        F.transform(wholes, lambda x: F.struct(F.lit(False).alias("part"), x.alias("statement"))),
        F.transform(F.array_distinct(parts), lambda x: F.struct(F.lit(True).alias("part"), x.alias("statement"))),
    )
    return F.when(text.rlike(CUE), marked)


def score_statements(statements: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(sid, licence, cosine) of the best template at or above `min_cosine`.

    `statements` has distinct sids; the texts meet no shuffle, only
    their words under the sid do.  A mere reservation comes after every other
    licence, ties go to the lesser name.  Cosines are rounded to six digits.
    No statements give no rows.
    """
    spark = statements.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, text string")
    words = statements.select("sid", F.explode(_terms(F.col("statement"))).alias("term")).groupBy("sid", "term").agg(F.count(F.lit(1)).alias("tf"))
    path = scratch_path(spark, "licence-words")
    words.write.parquet(path)
    words = spark.read.parquet(path)
    of_template = known.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = words.select("term").unionByName(of_template.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = words.select("sid").distinct().count() + len(templates)
    idf = df.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weighed = words.join(idf, "term").select("sid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    template = cut_lineage(of_template.join(idf, "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("v")))
    norms = template.groupBy("template", "licence").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("tn"))
    # one pass for all sums: the statement's own square beside its products with the templates
    by_term = template.groupBy("term").agg(F.collect_list(F.struct("template", "v")).alias("of"))
    own = F.array(F.struct(F.lit(-1).alias("template"), F.col("w").alias("v")))
    summed = weighed.join(F.broadcast(by_term), "term", "left").select(
        "sid", "w", F.inline(F.concat(own, F.coalesce("of", F.array().cast("array<struct<template:int,v:double>>"))))
    )
    summed = summed.groupBy("sid", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    square = F.max(F.when(F.col("template") == -1, F.col("dot"))).alias("square")
    dots = summed.groupBy("sid").agg(square, F.collect_list(F.struct("template", "dot")).alias("dots"))  # one entry per template
    cosines = dots.select("sid", F.sqrt("square").alias("sn"), F.inline("dots")).join(F.broadcast(norms), "template")
    cosines = cosines.select("sid", "licence", F.round(F.col("dot") / (F.col("sn") * F.col("tn")), 6).alias("cosine"))
    return _best_of(cosines.filter(F.col("cosine") >= min_cosine), "sid", F.lit(False))


def _best_of(rows: DataFrame, key: str, part: Column) -> DataFrame:
    last = (F.col("licence") == RESERVED).alias("last")
    best = F.min(F.struct(last, part.alias("part"), (-F.col("cosine")).alias("c"), "licence")).alias("b")
    return rows.groupBy(key).agg(best).select(key, F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, min_cosine: float = MIN_COSINE
) -> DataFrame:
    """`files` without `text`, plus licence, cosine, origin and licence_dir.

    origin is own (a statement of the file), inherited (of a licence file in
    licence_dir, the nearest directory from the file's own upwards) or none.
    Null and empty texts have no statements.  A null path has no directory and
    inherits nothing.  Equal paths stay separate rows.  Several licence files of
    a directory count as one: the best statement of all, ties to the lesser
    name.  Texts are read whole, of any length; an empty table gives an empty
    one.  Columns of `files` named like the added ones are replaced.
    """
    at, whole = F.col(path), F.coalesce(F.col(text), F.lit(""))
    rows = files.withColumns({"_row": F.monotonically_increasing_id(), "_said": _said(F.coalesce(at, F.lit("")), whole), "_dir": directory(at)})
    rows = cut_lineage(rows.drop(text, "licence", "cosine", "origin", "licence_dir"))
    said = rows.filter(F.col("_said").isNotNull()).select("_row", "_dir", at.alias("_path"), F.inline("_said"))
    said = said.withColumn("sid", F.unhex(F.md5("statement")))
    scored = cut_lineage(score_statements(said.select("sid", "statement").dropDuplicates(["sid"]), templates, min_cosine))
    found = said.drop("statement").join(scored, "sid")
    own = _best_of(found, "_row", F.col("part")).select("_row", F.col("licence").alias("_own"), F.col("cosine").alias("_own_cosine"))
    in_licence_file = F.col("_path").isNotNull() & file_name(F.col("_path")).rlike(LICENCE_FILE)
    of_dir = cut_lineage(_best_of(found.filter(in_licence_file), "_dir", F.col("part")))
    # every directory once, with all that are above it
    steps = F.split("_dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))
    dirs = rows.filter(F.col("_dir").isNotNull()).select("_dir").distinct().select("_dir", F.explode(F.array_distinct(above)).alias("_up"))
    nearest = F.max(F.struct(F.length("_up").alias("n"), F.col("_up").alias("dir"), F.col("licence").alias("l"), F.col("cosine").alias("c"))).alias("b")
    inherited = dirs.join(of_dir.withColumnRenamed("_dir", "_up"), "_up").groupBy("_dir").agg(nearest)
    inherited = inherited.select("_dir", F.col("b.dir").alias("_from"), F.col("b.l").alias("_theirs"), F.col("b.c").alias("_their_cosine"))
    out = rows.join(own, "_row", "left").join(inherited, "_dir", "left")
    has, gets = F.col("_own").isNotNull(), F.col("_theirs").isNotNull()
    return out.withColumns(
        {
            "licence": F.coalesce("_own", "_theirs"),
            "cosine": F.coalesce("_own_cosine", "_their_cosine"),
            "origin": F.when(has, F.lit("own")).when(gets, F.lit("inherited")).otherwise(F.lit("none")),
            "licence_dir": F.when(~has & gets, F.col("_from")),
        }
    ).drop("_row", "_said", "_dir", "_own", "_own_cosine", "_from", "_theirs", "_their_cosine")
