"""License scans with DataFrame functions alone.

Whole files, paragraphs, lines and sentences are compared with license templates, notices and full texts, by the cosine of
sparse TF-IDF vectors, the weights being those of the template collection. Files without a license of their own take that of
the nearest ancestor directory with a license file, by joins on paths.
"""

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, lower_ascii, own_names, row_key

#: Short notices of public licenses, one or more for each SPDX name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

_AS_IS_MIT = (
    'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_GRANT_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:")
_TERMS_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.")
_THIRD_BSD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
    "the License for the specific language governing permissions and limitations under the License.")
_FREE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_NO_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_RECEIVED = "You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_OPENING = "GNU {1} Version {2}, {3} Copyright (C) {4} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = (("GPL-2.0", "program", "General Public License", "2", "June 1991", "1989, 1991"), ("GPL-3.0", "program", "General Public License", "3", "29 June 2007", "2007"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1", "February 1999", "1991, 1999"), ("LGPL-3.0", "library", "Lesser General Public License", "3", "29 June 2007", "2007"),
        ("AGPL-3.0", "program", "Affero General Public License", "3", "19 November 2007", "2007"))
# Full texts, standard notices and openings of public licenses.
TEMPLATES += (
    ("MIT", f"MIT License {_GRANT_MIT} {_AS_IS_MIT}"),
    ("MIT", _GRANT_MIT),
    ("BSD-2-Clause", f"BSD 2-Clause License {_TERMS_BSD} {_AS_IS_BSD}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_TERMS_BSD} {_THIRD_BSD} {_AS_IS_BSD}"),
    ("BSD-3-Clause", _THIRD_BSD),
    ("ISC", f"ISC License {_GRANT_ISC} {_AS_IS_ISC}"),
    ("ISC", _GRANT_ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    *[(name, _FREE.format(*of)) for name, *of in _GNU],
    *[(name, " ".join((_FREE, _NO_WARRANTY, _RECEIVED)).format(*of)) for name, *of in _GNU],
    *[(name, _OPENING.format(*of)) for name, *of in _GNU],
)
#: A text or a part of one is compared only if it has one of these, as every template has.
MARKERS = ("licens", "licenc", "copyright", "permission", "public domain", "gnu ", "cc by", "cc0")
#: A tag that names a license by itself, and names of license files.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"
FILE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|unlicense)([._-][^/]*)?$"

#: A term is a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str) -> list[str]:
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def weights(templates) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Smoothed idf of each template term, idf of all other terms, and each template's unit vector."""
    bags = [(name, Counter(terms(text))) for name, text in templates]
    df = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = []
    for name, bag in bags:
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        vectors.append((name, {t: n * idf[t] / norm for t, n in bag.items()}))
    return idf, math.log(1 + len(bags)) + 1, vectors


def _best(spark: SparkSession, units: DataFrame, keys: list[str], templates, threshold: float) -> DataFrame:
    """(keys, license, score) of units (keys, body) that reach the threshold with a template; ties go to the first name."""
    idf, other, vectors = weights(templates)
    # a row for each template term: as many as the templates have words, whatever is scanned
    cols = [f"w_{k}" for k in range(len(vectors))]
    lookup = spark.createDataFrame([(t, idf[t], *(v.get(t, 0.0) for _, v in vectors)) for t in sorted(idf)], "term string, idf double, " + ", ".join(f"{c} double" for c in cols))
    words = units.select(*keys, F.explode(F.regexp_extract_all(lower_ascii(F.col("body")), F.lit(TERM), 0)).alias("term"))
    tf = words.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    tf = tf.join(F.broadcast(lookup), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    sums = [F.coalesce(F.sum(F.col(c) * F.col("x")), F.lit(0.0)).alias(f"dot_{k}") for k, c in enumerate(cols)]
    scored = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *sums)
    names = [name for name, _ in vectors]
    options = F.array(*[F.struct((F.col(f"dot_{k}") / F.col("norm")).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("license")) for k, name in enumerate(names)])
    best = scored.select(*keys, F.array_max(options).alias("best"))
    return best.where(F.col("best.score") >= threshold).select(*keys, F.col("best.license").alias("license"), F.round("best.score", 6).alias("score"))


def has_marker(c):
    low = lower_ascii(c)
    out = low.contains(MARKERS[0])
    for m in MARKERS[1:]:
        out = out | low.contains(m)
    return out


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """files with license, license_score, license_basis and license_dir.

    Compared are the whole text, its paragraphs (between blank lines), lines and sentences (ended by a full stop or semicolon
    and a blank), those only that have one of MARKERS. basis is `file` if the whole text reaches the threshold with a template,
    or if the path has a license file's name and a part does (long texts are known by their opening or a paragraph). It is
    `header` if only a part reaches it, or an SPDX tag names the license, with score 1. It is `inherited` if the nearest ancestor
    directory with a license file gives it, else null. Of several parts the best counts, then tags, paragraphs, lines and
    sentences in this order, the first of them, and of equal templates the first. Of several license files in a directory the
    best counts, then the first name. Null and empty texts have no license of their own; a null path inherits nothing.
    Repeated rows get equal results; an empty table gives none. Columns of files named like the results are replaced.
    """
    spark = files.sparkSession
    row, dir_, h_license, h_score, w_license, w_score, n_dir, n_license = own_names(files, "row_key", "parent_dir", "h_license", "h_score", "w_license", "w_score", "n_dir", "n_license")
    text, path = F.col(f"`{text_col}`").cast("string"), F.col(f"`{path_col}`").cast("string")
    key = row_key(path, text)
    parent = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))
    # repeated rows would add up: one of each
    some = files.select(key.alias("row"), text.alias("body"), F.coalesce(path.rlike(FILE_NAME), F.lit(False)).alias("named")).where(F.col("body").isNotNull() & has_marker(F.col("body")))
    some = checkpointed(some.groupBy("row").agg(F.first("body").alias("body"), F.first("named").alias("named")))
    cuts = {0: F.array("body"), 2: F.split("body", r"\n[ \t\r]*\n"), 3: F.split("body", "\n"), 4: F.split("body", r"[.;][ \t]+|\n")}
    numbered = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x.alias("body"))
    parts = F.flatten(F.array(*[F.transform(c, numbered(kind)) for kind, c in cuts.items()]))
    units = some.select("row", F.inline(F.filter(parts, lambda x: has_marker(x["body"]))))
    scored = checkpointed(_best(spark, units, ["row", "kind", "at"], templates, threshold))
    tags = some.select("row", F.regexp_extract("body", TAG, 1).alias("license")).where("license <> ''").select("row", F.lit(1).alias("kind"), F.lit(0).alias("at"), "license", F.lit(1.0).alias("score"))
    order = F.struct("score", (-F.col("kind")).alias("k"), (-F.col("at")).alias("a"))
    best = lambda df: df.groupBy("row").agg(F.max_by(F.struct("license", "score"), order).alias("b")).select("row", "b.license", "b.score")
    part = best(scored.where("kind > 0").union(tags.select(*scored.columns))).join(some.select("row", "named"), "row")
    whole = scored.where("kind = 0").select("row", F.lit(0).alias("t"), "license", "score").union(part.where("named").select("row", F.lit(1).alias("t"), "license", "score"))
    whole = whole.groupBy("row").agg(F.min_by(F.struct("license", "score"), "t").alias("w")).select("row", F.col("w.license").alias(w_license), F.col("w.score").alias(w_score))
    header = checkpointed(part.where("NOT named").select("row", F.col("license").alias(h_license), F.col("score").alias(h_score)))
    whole = checkpointed(whole)
    narrow = files.select(key.alias("row"), parent.alias("dir"))
    dirs = narrow.join(whole, "row").where("dir IS NOT NULL").groupBy("dir").agg(F.max_by(w_license, F.struct(w_score, F.transform(F.split(w_license, ""), lambda c: -F.ascii(c)))).alias("d_license"))
    # each directory's ancestors, itself included, joined with those that have a license file; the longest is the nearest
    steps = F.split("dir", "/")
    chain = narrow.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("up"))
    near = chain.join(dirs.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "d_license")).alias("near")).select(F.col("dir").alias(dir_), F.col("near.up").alias(n_dir), F.col("near.d_license").alias(n_license))
    own = header.join(whole, "row", "full").withColumnRenamed("row", row)
    keep = [c for c in files.columns if c.lower() not in ("license", "license_score", "license_basis", "license_dir")]
    out = files.withColumn(row, key).withColumn(dir_, parent).join(own, row, "left").join(near, dir_, "left")
    file, head = F.col(w_license).isNotNull(), F.col(h_license).isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(w_license, h_license, n_license).alias("license"),
        F.coalesce(w_score, h_score).alias("license_score"),
        F.when(file, "file").when(head, "header").when(F.col(n_license).isNotNull(), "inherited").alias("license_basis"),
        F.when(~file & ~head, F.col(n_dir)).alias("license_dir"))
