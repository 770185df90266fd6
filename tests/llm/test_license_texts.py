"""License texts in order: wrapped, commented and varied notices, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import licensetexts as X

from . import messy

MIT = " ".join(X.NOTICES["mit"].split())
GPL2, GPL3, LESSER = (" ".join(X.NOTICES[k].split()) for k in ("gpl-2.0-or-later", "gpl-3.0-or-later", "lgpl-2.1-or-later"))


def brute(text, notices, threshold=0.8, width=3):
    w = X.plain_words(text or "")
    at = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    own, out = X.own_shingles(notices, width), {}
    for label, notice in notices.items():
        mine, special = set(X.text_shingles(notice, width)), set(own[label])
        for k in range(len(at)):
            held = set(at[k : k + X.window_length(len(mine))])
            a, o = len(held & mine) / max(len(mine), 1), len(held & special) / max(len(special), 1)
            if mine and a >= threshold - 1e-9 and o >= threshold - 1e-9:
                out[label] = max(out.get(label, 0), min(a, o))
    return ",".join(sorted(out)), max(out.values(), default=0.0)


def wrapped(text, n=60, mark="# "):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > n:
            lines.append(line)
            line = ""
        line += w + " "
    return "\n".join(mark + x for x in [*lines, line])


CASES = {
    "mit": wrapped(MIT), "mit,zlib": wrapped(MIT, 40, " * ") + "\n\n" + X.NOTICES["zlib"], "gpl-2.0-or-later": wrapped(GPL2, 30, "// "), "gpl-3.0-or-later": GPL3.upper(), "lgpl-2.1-or-later": LESSER,
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.", "cc-by-4.0": "words before\nLicensed under CC BY\n4.0, and after", "cc-by-sa-4.0": "licensed under cc by-sa 4.0", "mit-line": "Released under the MIT License.",
    "apache-2.0,apache-2.0-line": "x " + wrapped(X.NOTICES["apache-2.0"]), "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
}
NONE = [
    "It was released under the license of the city council.", "He was released from jail under the terms of a license that the court had signed",
    "Licensed under CC BY 3.0", " ".join(reversed(MIT.split())), "GNU Lesser General Public License version 2", "", None, "mit", "a b",
]


def test_notices(spark):
    texts = [*CASES.values(), *NONE, *[t for _, t in messy.TEXTS]]
    docs = messy.documents(spark, list(enumerate(texts)))
    got = X.scan_texts(docs)
    assert got.columns == [*docs.columns, "license_texts"]
    rows = {r.doc_id: r.license_texts for r in got.collect()}
    for k, (label, text) in enumerate(CASES.items()):
        assert rows[k].labels == label, text
    for k in range(len(CASES), len(CASES) + len(NONE)):
        assert (rows[k].labels, rows[k].score) == ("", 0.0), texts[k]
    for k, t in enumerate(texts):
        labels, score = brute(t, X.NOTICES)
        assert rows[k].labels == labels and abs(rows[k].score - score) < 1e-9, t
    assert X.scan_texts(docs.limit(0)).count() == 0 and {r.labels for r in X.scan_texts(docs, {}).select(F.col("license_texts.labels").alias("labels")).collect()} == {""}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_random_windows(spark, threshold):
    rng = random.Random(5)
    notices = {f"n{k}": " ".join(rng.choice("abcdefg") for _ in range(n)) for k, n in enumerate((1, 2, 3, 4, 7, 12, 20))} | {"same": "a b c d", "again": "a b c d", "none": "..."}
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(150)] + [f"{a} x {b}" for a in notices.values() for b in notices.values()]
    rows = X.scan_texts(messy.documents(spark, list(enumerate(texts))), notices, threshold).select("doc_id", "license_texts.*").collect()
    for r in rows:
        labels, score = brute(texts[r.doc_id], notices, threshold)
        assert r.labels == labels and abs(r.score - score) < 1e-9, texts[r.doc_id]
