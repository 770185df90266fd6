"""Documents with all that may come: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, ids string, shard int, slot string, bucket string, host int, judged int, license int, "
    "gone_id int, leak_id int, _id int, _tie string, _lines string, sig string, token string, n int, at int, tie int, number int, kept boolean, base_failed int"
)
WIDTH = SCHEMA.count(",") + 1


def prose(seed: int, n: int) -> str:
    words, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        words.append("abcdefghijklmnopqrstuvwxyz"[x % 26] + "aeiou"[x // 26 % 5] + "rstln"[x // 130 % 5] + str(x // 650 % 97))
    return " ".join(words)


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
BRIDGE = NEAR.replace(BASE.split()[20], "other", 1)
LONG = "\n".join(prose(100 + k, 400) for k in range(60))
PASSAGE = prose(9, 60)

TEXTS: list[tuple[int | None, str | None]] = [
    (0, BASE),
    (1, NEAR),
    (2, BRIDGE),
    (3, BASE.upper()),
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one two three"),
    (8, "One two THREE"),
    (9, "one two three four"),
    (10, LONG),
    (11, "intro words here\n" + PASSAGE + "\nmore text of this one"),
    (12, "another start\n" + PASSAGE + "\n" + PASSAGE.upper() + "\nand its end"),
    (13, "x" * 5000),
    (14, "é Ünïcode ▁mark 日本語 <|endoftext|> \u00a0 \u2028 end\u0000null"),
    (15, "a  b   c\td\r\ne"),
    (16, prose(5, 80)),
    (16, prose(5, 80)),
    (16, prose(6, 80)),
    (None, prose(7, 70)),
    (None, prose(7, 70)),
    (-3, prose(8, 90)),
    (1 << 62, prose(8, 90) + " tail"),
    (17, "word " * 300),
    (18, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nthe GNU  General-Public license mit license"),
    (19, "\n\nline\n\n"),
]


def documents(spark, texts=None):
    rows = [(i, t, None if k % 3 else "en", "s", None) + (None,) * (WIDTH - 5) for k, (i, t) in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(words: list[str], short: bool = True) -> frozenset:
    if len(words) >= 5:
        return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words and short else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def cells(rows) -> list:
    """Rows as comparable lists, in order."""
    plain = lambda v: "null" if v is None else round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted([plain(v) for v in r] for r in rows)
