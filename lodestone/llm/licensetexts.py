"""License texts: an exact set-similarity join of word windows with whole notices, in order.

A template's tokens are its shingles, ``width`` words in a row, so the order of words counts; its own tokens are those that no
other template has, which keep versions and variants apart. A window is as many places of the text as the template
has shingles, and a quarter more. A template is found where a window has at least ``threshold`` of its tokens and of its own ones;
line breaks, comment signs and punctuation between words do not matter. Its score is the smaller of both shares, at best.

Tokens are ordered by how many documents of the corpus have them, rarest first, ties by hash. A window and a template of
n tokens that share at least need = ceil(threshold * n) tokens share one of the template's first n - need + 1 (prefix
filter), lie in a text with need of the template's tokens (length filter), and have need of them within the window's
reach of the shared one (positional filter). Only what passes is opened window by window. All of it is one expression for each
document, without a shuffle of texts; only the documents' counts of template tokens are aggregated.

Null and empty texts have no words and no labels. Every row is judged on its own, so repeated rows, ties and further
columns do no harm. Tokens are 64-bit hashes of whole words. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column_of
from .licenses import words

# Notices as their licenses give them.
NOTICES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.""",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "lgpl-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published
        by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
        deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
        above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "mit-line": "Released under the MIT License",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
        the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely.""",
}


def plain_words(text: str) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def text_shingles(text: str, width: int) -> list[str]:
    """The distinct shingles in order; of fewer words, all of them as one."""
    w = plain_words(text)
    return list(dict.fromkeys(" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))) if w else []


def window_length(n: int) -> int:
    return n + n // 4


def own_shingles(notices: dict[str, str], width: int) -> dict[str, list[str]]:
    """Of each template the shingles that no other has; all of them if there is none."""
    sets = {label: text_shingles(text, width) for label, text in notices.items()}
    out = {}
    for label, s in sets.items():
        others = {x for k, t in sets.items() if k != label for x in t}
        out[label] = [x for x in s if x not in others] or s
    return out


def shingle_hashes(spark: SparkSession, shingles: list[str]) -> dict[str, int]:
    """Of each shingle the hash that it has in texts; a row for each of the templates' shingles."""
    rows = column_of(spark, "s", shingles)
    return dict(rows.select("s", _hash([F.get(F.split("s", " "), k) for k in range(max((s.count(" ") for s in shingles), default=0) + 1)])).collect())


def _hash(parts: list[Column]) -> Column:
    """Nulls, past the end of a short text, are skipped."""
    return F.xxhash64(*parts)


def places(text: Column, width: int) -> Column:
    """array<bigint>, the hash of the shingle at each place."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: _hash([F.get(w, i + k) for k in range(width)])))

    return F.get(F.transform(F.array(words(ascii_lower(F.coalesce(text, F.lit(""))))), of), 0)


def scan_texts(docs: DataFrame, notices: dict[str, str] | None = None, threshold: float = 0.8, width: int = 3, name: str = "license_texts") -> DataFrame:
    """docs' columns and a struct: labels (sorted, comma-joined, empty if none) and score (the best one's, 0 to 1)."""
    spark, notices = docs.sparkSession, NOTICES if notices is None else notices
    sets, own = {label: text_shingles(t, width) for label, t in notices.items()}, own_shingles(notices, width)
    hashes = shingle_hashes(spark, sorted({s for x in sets.values() for s in x}))
    vocabulary = sorted(set(hashes.values()))
    h = places(F.col("text"), width)
    known = F.filter(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))), lambda p: p["h"].isin(*vocabulary)) if vocabulary else F.array().cast("array<struct<h:bigint,at:int>>")
    found = docs.select(F.explode(F.array_distinct(F.filter(h, lambda x: x.isin(*vocabulary)))).alias("h")) if vocabulary else docs.select(F.lit(0).cast("long").alias("h")).limit(0)
    counts = dict(found.groupBy("h").count().collect())  # at most a row for each shingle of the templates

    def hit(p: Column, label: str) -> Column:
        """Null, or the label with its score, of the places of known tokens."""
        mine = sorted({hashes[s] for s in sets[label]}, key=lambda x: (counts.get(x, 0), x))
        special = sorted({hashes[s] for s in own[label]})
        n, reach = len(mine), window_length(len(mine))
        need, need_own = (math.ceil(threshold * k - 1e-9) for k in (n, len(special)))
        prefix = mine[: n - need + 1]

        def best(q: Column) -> Column:
            near = lambda i, back: F.filter(q, lambda x: (x["at"] < i + reach) & (x["at"] >= (i - reach + 1 if back else i)))
            tokens = lambda a: F.array_distinct(F.transform(a, lambda x: x["h"]))
            # starts within reach of a prefix token that has enough around it
            rare = F.filter(q, lambda x: x["h"].isin(*prefix))
            rare = F.filter(rare, lambda x: F.size(tokens(near(x["at"], True))) >= need)
            starts = F.filter(q, lambda s: F.exists(rare, lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + reach)))

            def score(s: Column) -> Column:
                both = F.transform(F.array(tokens(near(s["at"], False))), lambda t: F.struct(F.size(t).alias("a"), F.size(F.filter(t, lambda x: x.isin(*special))).alias("o")))[0]
                fits = F.transform(F.array(both), lambda b: F.when((b["a"] >= need) & (b["o"] >= need_own), F.least(b["a"] / F.lit(float(n)), b["o"] / F.lit(float(len(special))))))
                return fits[0]

            return F.array_max(F.transform(starts, score))

        enough = lambda q: F.size(F.array_distinct(F.transform(q, lambda x: x["h"]))) >= need
        scored = F.transform(F.array(F.filter(p, lambda x: x["h"].isin(*mine))), lambda q: F.when(enough(q), best(q)))[0]
        return F.transform(F.array(scored), lambda s: F.when(s.isNotNull(), F.struct(F.lit(label).alias("label"), s.alias("score"))))[0]

    def result(p: Column) -> Column:
        hits = F.filter(F.array(*[hit(p, label) for label in sorted(sets) if sets[label]]), lambda x: x.isNotNull())
        joined = lambda a: F.struct(F.array_join(F.transform(a, lambda x: x["label"]), ",").alias("labels"), F.coalesce(F.array_max(F.transform(a, lambda x: x["score"])), F.lit(0.0)).alias("score"))
        none = F.struct(F.lit("").alias("labels"), F.lit(0.0).alias("score"))
        return F.when(F.size(p) > 0, F.transform(F.array(hits), joined)[0]).otherwise(none)

    nothing = F.struct(F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return docs.withColumn(name, F.transform(F.array(known), result)[0] if any(sets.values()) else nothing)


def texts_sql(notices: dict[str, str] | None = None, threshold: float = 0.8, width: int = 3) -> str:
    """The same in DuckDB, window by window, without filters."""
    notices = NOTICES if notices is None else notices
    own = own_shingles(notices, width)
    tokens = ", ".join(f"('{label}', '{s}', {str(s in own[label]).lower()})" for label, text in notices.items() for s in text_shingles(text, width))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
        WITH t(label, s, own) AS (VALUES {tokens}),
        sizes AS (SELECT label, count(*) AS n, count(*) FILTER (own) AS n_own FROM t GROUP BY label),
        w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE generate_series(1, greatest(len(w) - {width - 1}, 1)) END) AS pos, w FROM w),
        hits AS (SELECT doc_id, label, pos, s, own FROM (SELECT doc_id, pos, array_to_string(w[pos:pos + {width - 1}], ' ') AS s FROM p) JOIN t USING (s)),
        windows AS (
            SELECT a.doc_id, a.label, a.pos, count(DISTINCT b.s) AS c, count(DISTINCT b.s) FILTER (b.own) AS o FROM (SELECT DISTINCT doc_id, label, pos FROM hits) a
            JOIN sizes USING (label) JOIN hits b ON a.doc_id = b.doc_id AND a.label = b.label AND b.pos >= a.pos AND b.pos < a.pos + n + n // 4 GROUP BY ALL
        ),
        found AS (
            SELECT doc_id, label, max(least(c / n, o / n_own)) AS score FROM windows JOIN sizes USING (label)
            WHERE c >= {threshold} * n - 1e-9 AND o >= {threshold} * n_own - 1e-9 GROUP BY ALL
        )
        SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0)::DOUBLE AS score FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""
