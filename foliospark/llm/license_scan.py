"""License scans by diagonal voting over rolling word k-gram hashes, on DataFrame functions only.

Every rolling hash of two words of a text (for the base phrases) and of five (for the license templates) is joined to
the places of that gram in phrases and templates; a match votes for the diagonal (place in the text minus place in the
template). Votes are summed by diagonal, diagonals a word or two apart are merged (an inserted or missing word shifts the
rest of a template), and a merged span is verified: enough grams of it, dense enough. Of verified spans that overlap, the
one of most grams stands: a notice of the Affero license holds most of the general one, and is not it. A 64-bit hash
stands for its gram; a phrase needs all of its grams in a row, and a span several.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliospark.llm.common import NOT_WORD_RUN, keyed, let, lower_ascii

#: Phrases whose every exact place counts, and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Public license texts, and the notices by which works refer to licenses.
TEMPLATES = (
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
        STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
        "zlib",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
        "unlicense",
    ),
    (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
        "apache",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program.""",
        "gpl",
    ),
    (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public
        License for more details. You should have received a copy of the GNU Affero General Public License along with this
        program.""",
        "agpl",
    ),
    (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
        License for more details.""",
        "lgpl",
    ),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "mpl",
    ),
    ("This work is licensed under the GNU General Public License", "gpl"),
    ("Licensed under the Mozilla Public License", "mpl"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
)
#: Words of a gram, words that a span may gain or lose inside, grams that it needs (or all of a shorter template), and the
#: share of its places that must be grams of the template.
K_BASE, K, SLACK, GRAMS, DENSITY = 2, 5, 2, 4, 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD_RUN), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD_RUN, text.lower()) if w]


def phrases(base=BASE_PHRASES, templates=TEMPLATES) -> list[tuple[int, bool, str, int, list[str]]]:
    """(number, exact, label, words of a gram, words) of each phrase and template."""
    every = [(True, K_BASE, *p) for p in base] + [(False, K, *t) for t in templates]
    out = [(n, exact, label, k, template_words(text)) for n, (exact, k, text, label) in enumerate(every)]
    if short := [w for _, _, _, k, w in out if len(w) < k]:
        raise ValueError(f"too few words: {short}")
    return out


def _two(words: Column) -> Column:
    """Rolling hashes of two words."""
    at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))


def _five(words: Column, two: Column) -> Column:
    """Rolling hashes of five words, of two hashes of two and a word each."""
    at = F.when(F.size(words) > 4, F.sequence(F.lit(0), F.size(words) - 5)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(two, i), F.get(two, i + 2), F.get(words, i + 4)))


def _places(spark, base, templates) -> DataFrame:
    """(template, t_place, k, gram_hash, exact, label, n_grams): as long as the templates themselves, which are code.

    Template -1 is the row that each document has of its own.
    """
    rows = [(-1, True, "", 0, 1, 0, [])]
    for n, exact, label, k, words in phrases(base, templates):
        total = len(words) - k + 1
        rows += [(n, exact, label, k, total, i, words[i : i + k]) for i in range(total)]
    kind = "template int, exact boolean, label string, k int, n_grams int, t_place int, words array<string>"
    made = spark.createDataFrame(rows, kind)
    two = F.xxhash64(F.get("words", F.lit(0)), F.get("words", F.lit(1)))
    five = F.xxhash64(two, F.xxhash64(F.get("words", F.lit(2)), F.get("words", F.lit(3))), F.get("words", F.lit(4)))
    hashed = F.when(F.col("k") == K_BASE, two).when(F.col("k") == K, five).otherwise(F.lit(0).cast("long"))
    return made.withColumn("gram_hash", hashed).drop("words")


def _found(docs: DataFrame, base, templates, slack: int, grams: int, density: float) -> DataFrame:
    """doc_id, text_hash, n_words, n_rows (input rows of the document), spans (verified, the overlapped ones left out)."""
    made = keyed(docs).select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    # A document's own row (hash 0 of 0 words) comes first, then its grams of two, then those of five.
    every = let(_two(F.col("words")), lambda two: F.concat(F.array(F.lit(0).cast("long")), two, _five(F.col("words"), two)))
    rolling = made.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode(every).alias("at", "gram_hash"))
    k = F.when(F.col("at") == 0, 0).when(F.col("at") < F.col("n_words"), K_BASE).otherwise(K)
    place = F.when(F.col("at") == 0, 0).when(F.col("at") < F.col("n_words"), F.col("at") - 1).otherwise(F.col("at") - F.col("n_words"))
    rolling = rolling.select("doc_id", "text_hash", "n_words", "gram_hash", k.alias("k"), place.alias("place"))
    # The templates are constants of this module or an argument in code: a bounded broadcast.
    votes = rolling.join(F.broadcast(_places(docs.sparkSession, base, templates)), ["gram_hash", "k"])
    # One shuffle: by document and template. The sums by diagonal and the windows below both keep that dealing.
    key = ["doc_id", "text_hash", "n_words", "template", "exact", "label", "n_grams", "k"]
    diagonals = (
        votes.withColumn("diagonal", F.col("place") - F.col("t_place")).repartition(*(F.col(c) for c in key)).groupBy(*key, "diagonal")
        .agg(F.collect_set("t_place").alias("t_places"), F.count("*").alias("n_rows"))
    )
    near = W.Window.partitionBy(*key).orderBy("diagonal")
    gap = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(0))
    apart = F.when(F.col("exact"), F.lit(True)).otherwise(gap > slack)
    islands = diagonals.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(near))
    merged = islands.groupBy(*key, "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("t_places")))).alias("n_found"),
        F.min(F.col("diagonal") + F.array_min("t_places")).cast("long").alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("t_places") + F.col("k") - 1).cast("long").alias("last_word"),
        F.max("n_rows").alias("n_rows"),
    )
    dense = F.col("n_found") >= density * (F.col("last_word") - F.col("first_word") - F.col("k") + 2)
    verified = F.when(F.col("exact"), F.col("n_found") == F.col("n_grams")).otherwise(
        (F.col("n_found") >= F.least(F.lit(grams), F.col("n_grams"))) & dense
    )
    span = F.struct(
        "exact", "n_found", (F.col("n_found") / F.col("n_grams")).alias("coverage"), "template", "label", "first_word", "last_word"
    )
    own = F.col("template") < 0
    per_doc = merged.filter(own | verified).groupBy("doc_id", "text_hash", "n_words").agg(
        F.max(F.when(own, F.col("n_rows"))).alias("n_rows"), F.collect_list(F.when(~own, span)).alias("spans")
    )

    def beaten(s: Column) -> Column:
        return F.exists(
            F.col("spans"),
            lambda t: ~t["exact"] & (t["first_word"] <= s["last_word"]) & (s["first_word"] <= t["last_word"])
            & (
                (t["n_found"] > s["n_found"])
                | (t["n_found"] == s["n_found"]) & ((t["coverage"] > s["coverage"]) | (t["coverage"] == s["coverage"]) & (t["template"] < s["template"]))
            ),
        )

    return per_doc.withColumn("spans", F.filter("spans", lambda s: s["exact"] | ~beaten(s)))


def spans(
    docs: DataFrame,
    base: tuple[tuple[str, str], ...] = BASE_PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    slack: int = SLACK,
    grams: int = GRAMS,
    density: float = DENSITY,
) -> DataFrame:
    """Verified spans: doc_id, text_hash, label, exact, first_word, last_word, n_found, coverage (of the template's grams).

    ``exact`` spans are the places of base phrases, one row each. Others hold ``grams`` grams of a template (or all of a
    shorter one) on diagonals up to ``slack`` apart, ``density`` of their places at least, and no overlapping span holds
    more. Null and empty texts, texts of one word and empty tables have no spans; repeated rows of a document have theirs
    once. A text of any length is exploded as a stream, never held as rows.
    """
    found = _found(docs, base, templates, slack, grams, density)
    return found.select("doc_id", "text_hash", F.explode("spans").alias("s")).select(
        "doc_id", "text_hash", *(F.col(f"s.{c}").alias(c) for c in ("label", "exact", "first_word", "last_word", "n_found", "coverage"))
    )


def scan(
    docs: DataFrame,
    base: tuple[tuple[str, str], ...] = BASE_PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    slack: int = SLACK,
    grams: int = GRAMS,
    density: float = DENSITY,
) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest coverage of a span (1 with a base phrase), 0 without one. Documents without spans have n_base
    0, null first_word and last_word and empty label lists; repeated rows each have their row. The texts are read once:
    documents without any gram of a template come through by the row of their own.
    """
    found = _found(docs, base, templates, slack, grams, density)
    exact = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(exact, lambda s: s["first_word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda s: s["label"]))), ",")
    score = F.array_max(F.transform("spans", lambda s: s["coverage"]))
    made = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(exact).alias("base_labels"),
        labels(F.col("spans")).alias("labels"), F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"), "n_rows",
    )
    return made.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("row", "n_rows")
