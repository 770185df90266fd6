"""Line dedup with lines of fewer words than a shingle."""

from __future__ import annotations

from lodestone.llm import linededup

from . import messy

TEXTS = [
    (100, "all rights reserved.\nmenu\n\n" + messy.BASE),
    (101, "All  Rights\treserved.\nmenu\nMenu bar\n\nall rights reserved. now\none two three"),
    (102, "menu\nbar menu\nmenu bar\n \nmenu"),
]


def brute(texts):
    earlier, out = [], {}
    for i, t in sorted({x for x in texts if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        kept = []
        for line in t.split("\n"):
            s = messy.shingles(messy.space_words(line))
            if not any(messy.similar(s, e) for e in earlier):
                kept.append(line)
            earlier.append(s)
        out[(i, t)] = "\n".join(kept)
    return out


def test_short_lines(spark):
    for texts in (TEXTS, TEXTS + messy.TEXTS):
        want = brute(texts)
        got = linededup.dedup_lines(messy.documents(spark, texts), short=True).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(want.get((i, t)))) for i, t in texts)
    assert want[(101, TEXTS[1][1])] == "Menu bar\n\nall rights reserved. now" and want[(102, TEXTS[2][1])] == "bar menu\n "
