"""Licence scans by the Dice coefficient over word bigrams. DataFrame operations only.

Words are runs of a-z and 0-9 once A-Z are lower-cased; everything else parts words, so how a notice is wrapped, indented or commented out
doesn't matter. A unit is a run of a text's lines; lines without words are passed over, and count for nothing. A unit matches a template when
200 * common distinct bigrams >= PERCENT * (those of the unit + those of the template). Units are, for a template of n words: each single line, and
from each line on the fewest lines that have n words (or all that are left), and the same without the last of them; and each n words in a row that begin with one of the template's bigrams. So a notice
is met whether it stands in one line, is wrapped, lies within a longer line or a larger block, or is the whole text.

Sizes bound what can match: of a template's m bigrams at least low(m) are in any unit that does. A text is only looked into for templates of which it
has so many of the longest bigrams that this is possible; these are met by a broadcast join of hashes, whose size is that of the templates, which is checked.
Matches that overlap a better one of their licence (by Dice, then fewer lines, then the earlier) are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import column

PERCENT = 80
#: Bytes of all templates' bigrams together.
MOST_TEMPLATE_BYTES = 4 << 20
#: Lines whose units are looked at together.
LINES = 256
#: Short notices of well-known licences, and the full texts of the shorter ones.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"), "")


def _pairs(words: str) -> str:
    """Consecutive words as fields 0 and 1, an SQL expression; fewer than two words have none."""
    n = f"greatest(size({words}) - 1, 0)"
    return f"arrays_zip(slice({words}, 1, {n}), slice({words}, 2, {n}))"


def least_common(size: int, percent: int) -> int:
    """How many of a template's bigrams a unit that matches has at least: Dice = 2 k / (n + size) and k <= n."""
    return -(-percent * size // (200 - percent))


def _templates(templates: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """(template, license, words, m, g), g the hashes of its m bigrams; (h, template, need): the bigrams to look for first, and how many of them there must be; and the longest template's words."""
    spark = templates.sparkSession
    words = templates.select("license", _words(F.coalesce(column("text").cast("string"), F.lit(""))).alias("w")).where("size(w) > 1").distinct()
    # before any template comes to the driver; this bounds their number too
    size = f"aggregate(array_distinct(transform({_pairs('w')}, x -> concat(x.`0`, ' ', x.`1`))), 0L, (m, v) -> m + char_length(v))"
    if (words.agg(F.sum(F.expr(size))).first()[0] or 0) > MOST_TEMPLATE_BYTES:
        raise ValueError("too many templates for one broadcast")
    found = words.selectExpr("license", "size(w) AS n_words", f"array_sort(array_distinct(transform({_pairs('w')}, x -> named_struct('size', -length(x.`0`) - length(x.`1`), 'h', xxhash64(x.`0`, x.`1`))))) AS g").collect()
    rows, first = [], []
    for i, r in enumerate(sorted(found, key=lambda r: (str(r["license"]), r["n_words"], r["g"]))):
        m = len(r["g"])
        rows.append((i, r["license"], r["n_words"], m, [x["h"] for x in r["g"]]))
        # of a template's c longest bigrams a matching unit lacks no more than it may lack of all; longer ones are rarer
        spare = m - least_common(m, percent)
        c = min(m, 2 * spare + 1)
        first += [(x["h"], i, c - spare) for x in r["g"][:c]]
    return spark.createDataFrame(rows, "template int, license string, words int, m int, g array<long>"), spark.createDataFrame(first, "h long, template int, need int"), max((r[2] for r in rows), default=2)


def scan(documents: DataFrame, templates: DataFrame, *, text: str = "text", doc: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, matches for each row of documents: an array of (license, line, n_lines, dice), dice in whole percent, sorted; empty without any.

    templates: license and text; several may have one license. line is the place of the unit's first line in the text, from 0, and n_lines
    counts its lines with words. Templates and units of fewer than two words match nothing. Null and empty texts have no matches; a very long text is
    scanned whole, LINES lines at a time with as many after them as a template may reach, so what a task holds follows the text and not its lines times the templates; rows equal in doc_id and text get
    equal results; no documents, no rows; other columns are not read.
    """
    known, first, longest = _templates(templates, percent)
    texts = documents.select(column(doc).alias("doc_id"), F.xxhash64(column(text)).alias("t"), column(text).cast("string").alias("text"))
    met = texts.where("text is not null").select("doc_id", "t", _words(F.col("text")).alias("w")).where("size(w) > 1").selectExpr("doc_id", "t", f"inline({_pairs('w')})")
    met = met.selectExpr("doc_id", "t", "xxhash64(`0`, `1`) AS h").join(F.broadcast(first), "h")
    likely = met.groupBy("doc_id", "t", "template", "need").agg(F.size(F.collect_set("h")).alias("k")).where("k >= need")
    likely = likely.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list("template").alias("templates"))
    some = texts.join(likely, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "text", "templates")  # of equal rows, the units meet below
    units = _units(some, known, longest, percent)
    best = units.groupBy("doc_id", "t", "license", "a", "z", "line").agg(F.max("dice").alias("dice"))
    # in each line the best of those that hold it; what is the best in all of its lines stays
    order = F.struct("dice", (F.col("a") - F.col("z")).alias("size"), (-F.col("a")).alias("first"), "line")
    on = best.select("doc_id", "t", "license", F.explode(F.sequence("a", "z")).alias("at"), order.alias("o")).groupBy("doc_id", "t", "license", "at").agg(F.max("o").alias("o"))
    kept = on.groupBy("doc_id", "t", "license", "o").agg(F.count("*").alias("n")).where("n = 1 - o.size")
    found = kept.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("license", "o.line", F.col("n").cast("int").alias("n_lines"), "o.dice"))).alias("matches")).withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    empty = F.array().cast("array<struct<license:string,line:int,n_lines:int,dice:bigint>>")
    return texts.select("doc_id", "t").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left").select("doc_id", F.coalesce("matches", empty).alias("matches"))


def _units(some: DataFrame, known: DataFrame, longest: int, percent: int) -> DataFrame:
    """(doc_id, t, license, a, z, line, dice) of the units of texts that match one of their templates; a and z: first and last line among those with words."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    rows = some.select("doc_id", "t", "templates", lines.alias("lines")).where("size(lines) > 0")
    # LINES lines that units begin at, and `longest` more: enough words for any template, or all that are left
    cut = f"explode(transform(sequence(0, size(lines) - 1, {LINES}), c -> named_struct('c', c, 'lines', slice(lines, c + 1, {LINES + longest})))) AS x"
    rows = rows.selectExpr("doc_id", "t", "templates", cut).selectExpr("doc_id", "t", "templates", "x.c", "x.lines")
    rows = rows.selectExpr("doc_id", "t", "templates", "c", "transform(lines, x -> x.line) AS line", "flatten(transform(lines, x -> x.w)) AS w", "flatten(transform(lines, (x, i) -> array_repeat(i, size(x.w)))) AS of")
    # each line's first word, and one beyond the last line's end; and each line's own bigrams' number
    rows = rows.selectExpr("doc_id", "t", "templates", "c", "line", "of", f"transform({_pairs('w')}, x -> xxhash64(x.`0`, x.`1`)) AS h", "concat(filter(sequence(0, size(of) - 1), p -> p = 0 OR get(of, p) <> get(of, p - 1)), array(size(of))) AS start")
    bigrams = lambda a, z: f"array_distinct(slice(h, {a} + 1, greatest({z} - {a} - 1, 0)))"
    rows = rows.selectExpr("*", f"transform(line, (x, a) -> size({bigrams('get(start, a)', 'get(start, a + 1)')})) AS own")
    # a template only where the lines have enough of its bigrams for some unit
    rows = rows.selectExpr("*", "explode(templates) AS template").drop("templates").join(F.broadcast(known), "template").where(f"{200 - percent} * size(array_intersect(h, g)) >= {percent} * m")
    rows = rows.selectExpr("*", f"transform(slice(line, 1, {LINES}), (x, a) -> get(of, least(get(start, a) + words, size(of)) - 1)) AS until")
    pieces = "array_distinct(array(named_struct('a', a, 'z', a), named_struct('a', a, 'z', z), named_struct('a', a, 'z', greatest(a, z - 1))))"
    runs = f"transform(flatten(transform(until, (z, a) -> {pieces})), x -> named_struct('a', x.a, 'z', x.z, 'from', get(start, x.a), 'to', get(start, x.z + 1)))"
    # a line with more bigrams than a unit may have is in none
    runs = f"filter({runs}, x -> {percent} * m <= {200 - percent} * (x.to - x.from - 1) AND {percent} * get(own, x.z) <= {200 - percent} * m)"
    within = f"filter(sequence(0, greatest(size(h) - 1, 0)), p -> p + words <= size(of) AND get(of, p) < {LINES} AND array_contains(g, get(h, p)))"
    within = f"transform({within}, p -> named_struct('a', get(of, p), 'z', get(of, p + words - 1), 'from', p, 'to', p + words))"
    sized = f"transform(concat({runs}, {within}), x -> named_struct('a', x.a, 'z', x.z, 'own', {bigrams('x.from', 'x.to')}))"
    counted = f"transform({sized}, x -> named_struct('a', x.a, 'z', x.z, 'n', size(x.own), 'k', size(array_intersect(x.own, g))))"
    rows = rows.selectExpr("doc_id", "t", "license", "m", "c", "line", f"explode(filter({counted}, x -> 200 * x.k >= {percent} * (x.n + m))) AS u")
    return rows.selectExpr("doc_id", "t", "license", "c + u.a AS a", "c + u.z AS z", "get(line, u.a) AS line", "CAST((200 * u.k) div (u.n + m) AS BIGINT) AS dice")


def notices(spark) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")
