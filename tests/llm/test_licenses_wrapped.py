"""Notices that are wrapped over lines."""

from __future__ import annotations

from lodestone.llm import licenses

from . import messy

MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided"
TEXTS = [
    (1, MPL),
    (2, messy.BASE + "\n" + BSD + "\n" + messy.BASE),
    (3, "\n".join(licenses.TEMPLATES["gpl-3.0"].split())),
    (4, "Licensed\n\n" + messy.BASE + "\nunder CC\n" + messy.BASE + "\nBY 4.0"),  # too far apart
    (5, MPL.replace("\n", " ")),
    (6, "of the\n" * 40 + MPL + "\nthe terms" * 40),
    (7, ""),
    (8, None),
    (9, "mit"),
]


def brute(text):
    w, found = messy.plain_words(text), {}
    for label, template in licenses.TEMPLATES.items():
        t, n = set(licenses.template_words(template)), len(messy.plain_words(template))
        blocks = [messy.plain_words(x) for x in (text or "").split("\n")] + [w[k : k + n] for k in range(max(len(w) - n, 0) + 1)]
        best = max(len(t & set(b)) for b in blocks)
        if best >= 0.8 * len(t) - 1e-9:
            found[label] = best / len(t)
    return found


def test_wrapped_notices(spark):
    texts = TEXTS + [(100 + k, t) for k, (_, t) in enumerate(messy.TEXTS)]
    rows = {r.doc_id: r.license for r in licenses.scan(messy.documents(spark, texts)).collect()}
    assert rows[1].labels == "mpl-2.0" == rows[5].labels and rows[1].score == 1.0
    assert rows[2].labels == "bsd" and rows[2].score == 1.0
    assert "gpl-3.0" in rows[3].labels and rows[4].labels == ""
    for i, t in texts:
        found = brute(t)
        base = set(rows[i].base_labels.split(",")) - {""}
        assert (rows[i].labels, rows[i].score) == (",".join(sorted(base | set(found))), max(found.values(), default=0.0)), i
