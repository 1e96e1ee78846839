"""License scan: Dice coefficient over word bigrams between passages and license templates.

A passage is a line, a paragraph (set off by blank lines) or the whole text. Passages and templates are
normalised alike: lower case, words of ASCII letters and digits, one blank between. A passage matches a
template if twice the number of shared distinct bigrams, over the sum of both numbers, is at least the
threshold. Sets of sizes a and b can reach t only if a lies between b * t / (2 - t) and b * (2 - t) / t,
so a template is compared only with passages of such sizes; bigrams are made only of passages whose number of distinct
words leaves them a size that some template can meet.

Everything happens inside a row: no shuffle, no Python on the executors. A passage is compared with a
fixed number of templates.

Defined results: null, empty and single-word passages match nothing. Of a text's matches the best score
wins, ties by the smaller license name. Repeated rows are judged each; a null doc_id stays null. Texts are read whole, of any
length that fits a Spark value. Columns other than doc_id and text are not read. An empty table gives no rows.

The templates are short licenses in full, and the openings and recommended notices of longer ones; the full texts of
the longer ones (GPL, Apache, MPL and others) are not among them. A notice wrapped over several lines is found where blank
lines set it off or where it is the whole text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# fixed values: short licenses and the notices that the licenses themselves recommend
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def bigrams(text: str) -> list[str]:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of sets that can reach the threshold with a set of n; wider by a rounding error."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return int(low - 1e-9) + (low - 1e-9 > int(low - 1e-9)), int(high + 1e-9)


def _words(passage: Column) -> Column:
    return F.filter(F.split(F.lower(passage), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row per document: doc_id, license, score (both null without a match) and n_passages, how many
    of its distinct passages match a template."""
    known = sorted((name, bigrams(t)) for name, texts in (templates or TEMPLATES).items() for t in texts)
    known = [(name, g, *bounds(len(g), threshold)) for name, g in known if g]
    least, most = min((low for *_, low, _ in known), default=1), max((high for *_, high in known), default=0)
    text = F.coalesce("text", F.lit(""))
    passages = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n\\s*\n"), F.array(text)))
    long = F.filter(passages, lambda p: F.length(p) >= 2 * least + 1)  # so many bigrams need so many characters

    def best(g: Column) -> Column:
        n = F.size(g)
        scores = []
        for name, own, low, high in known:
            score = 2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, own)))) / (n + len(own))
            scores.append(F.when(n.between(low, high), F.struct((-score).alias("s"), F.lit(name).alias("name"))))
        return F.array_min(F.array(*scores))

    # a passage of d distinct words has d - 1 distinct bigrams at least
    near = F.filter(F.transform(long, _words), lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most))
    found = F.filter(F.transform(F.transform(near, _grams), best), lambda b: b["s"] <= -threshold)
    if not known:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n_passages"))
    top = F.array_min("found")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")).select("doc_id", top["name"].alias("license"), (-top["s"]).alias("score"), F.size("found").cast("long").alias("n_passages"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql(threshold: float = 0.8) -> str:
    """The same scan as joins of exploded bigrams; of the size bounds only that of the largest template."""
    most = max(bounds(len(bigrams(t)), threshold)[1] for texts in TEMPLATES.values() for t in texts)
    rows = ",".join("({}, {}, '{}')".format(k, "'" + n.replace("'", "''") + "'", t.replace("'", "''")) for k, (n, t) in enumerate((n, t) for n, texts in TEMPLATES.items() for t in texts))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t0(k, name, x) AS (VALUES {rows}),
t AS (SELECT k, name, {grams} AS g FROM (SELECT k, name, {words.format('x')} AS w FROM t0)),
p AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) FROM documents UNION ALL SELECT doc_id, text FROM documents)),
g AS (SELECT doc_id, x, {grams} AS g FROM (SELECT doc_id, x, {words.format('x')} AS w FROM p) WHERE len(w) > 1),

n AS (SELECT doc_id, x, len(g) AS a, unnest(g) AS b FROM g WHERE len(g) <= {most}),
tn AS (SELECT k, name, len(g) AS c, unnest(g) AS b FROM t),
s AS (SELECT doc_id, x, name, 2.0::DOUBLE * count(*) / (a + c) AS score FROM n JOIN tn USING (b) GROUP BY doc_id, x, k, name, a, c),
m AS (SELECT doc_id, x, max(score) AS top, arg_min(name, (-score, name)) AS name FROM s WHERE score >= {threshold} GROUP BY doc_id, x)
SELECT d.doc_id, r.license, r.score, CAST(coalesce(r.n, 0) AS BIGINT) AS n_passages
FROM documents d LEFT JOIN (SELECT doc_id, arg_min(name, (-top, name)) AS license, max(top) AS score, count(*) AS n FROM m GROUP BY doc_id) r USING (doc_id)
"""
