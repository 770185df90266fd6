"""Content by tag paths: against a scorer over whole path strings, deep and hostile pages, names and parts."""

from __future__ import annotations

import math
import random
import re
import time

import pytest

from lodestone.llm import htmltext

from . import messy
from .test_html import PARA, TEXT

LAST = "A closing word, at last. It ends the article, as such things do."


def tree(rng: random.Random, depth: int = 0) -> list:
    """A random element: [tag, class, children], a child a text or an element, no two texts side by side."""
    children = []
    for _ in range(rng.randint(1, 5) if depth < 4 else 1):
        if depth < 4 and rng.random() < 0.5 or children and isinstance(children[-1], str):
            children.append(tree(rng, depth + 1))
        else:
            words = messy.prose(rng.randint(1, 10_000), rng.choice((1, 2, 5, 30))).split()
            children.append(" ".join(w + rng.choice(("", "", ",", ".")) for w in words))
    return [rng.choice(("div", "section", "span", "b")), rng.choice(("", "x", "y z")), children]


def markup(e: list) -> str:
    inner = "".join(c if isinstance(c, str) else markup(c) for c in e[2])
    return f"<{e[0]}{f' class={chr(34)}{e[1]}{chr(34)}' if e[1] else ''}>{inner}</{e[0]}>"


def with_paths(e: list, above: str = "") -> list[tuple[str, str]]:
    path = f"{above}/{e[0]}.{e[1]}" if e[1] else f"{above}/{e[0]}"
    return [x for c in e[2] for x in ([(path, c)] if isinstance(c, str) else with_paths(c, path))]


@pytest.mark.parametrize("seed", range(30))
def test_scores_are_those_of_path_strings(seed):
    e = tree(random.Random(seed), depth=-1)
    page, want = htmltext.Page(markup(e)), with_paths(e)
    got = [(page.path[el], t) for el, _, t in page.texts]
    assert [t for _, t in got] == [t for _, t in want] and len({p for p, _ in want}) == len({p for p, _ in got}) == len(set(zip([p for p, _ in want], [p for p, _ in got], strict=True)))
    by_path = {}
    for p, t in want:
        by_path.setdefault(p, []).append(t)
    raw = [sum(map(len, by_path[p])) / len(by_path[p]) * (sum(len(re.findall("[.,]", t)) for t in by_path[p]) / len(by_path[p]) + 0.1) for p, _ in want]
    scores = []
    for k in range(len(raw)):
        near = [(raw[j], math.exp(-((j - k) ** 2) / 2)) for j in (k - 1, k, k + 1) if 0 <= j < len(raw)]
        scores.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    mean = sum(scores) / len(scores)
    least = 0.5 * math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores))
    found = set(htmltext.content_nodes(got))
    assert all((k in found) == (x >= least) for k, x in enumerate(scores) if abs(x - least) > 1e-9)


def test_names_that_only_begin_like_a_notice():
    for name in ("social-science", "related-work", "share-prices", "search-history", "notice-period", "commented", "skip-rope"):
        assert htmltext.main_text(f"<article>{PARA}<div class='{name}'><p>{LAST}</p></div></article>") == f"{TEXT}\n{LAST}", name
    for name in ("social", "social-links", "related-posts", "share-buttons", "comment-list", "post-comments", "newsletter-box", "adSlot", "site_nav", "cookie-notice"):
        assert htmltext.main_text(f"<article>{PARA}<div class='{name}'><p>{LAST}</p></div></article>") == TEXT, name


def test_a_doubtful_name_around_the_article():
    assert htmltext.main_text(f"<body><div class=notice>{PARA * 3}</div><div class=comments>{PARA}</div></body>") == "\n".join([TEXT] * 3)


def test_a_last_paragraph_in_a_second_div():
    menu = "<div><a>one</a> <a>two</a> <a>three</a></div>"
    page = f"<body>{menu}<div>{PARA * 20}</div><div><p>{LAST}</p></div>{menu}</body>"
    assert htmltext.main_text(page) == "\n".join([TEXT] * 20 + [LAST])


def test_the_marked_element_with_most_text():
    teaser = "<article><h2>Other</h2></article>"
    assert htmltext.main_text(f"<main><article><h1>T</h1>{PARA * 3}</article></main>{teaser}") == "\n".join(["T"] + [TEXT] * 3)
    assert htmltext.main_text(f"<article>{PARA}</article><div>{PARA * 9}</div>") == TEXT


@pytest.mark.parametrize("source", ["<b>" * 200_000, "<div>" * 200_000, "<b><p>x" * 60_000, "<a " * 300_000, "<a '" * 300_000, "<!" * 300_000, "<p>x, y." + "<i>" * 100_000 + "</p>" * 100_000, "<ul><li>" * 60_000, "<!--" * 100_000])
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    got = htmltext.main_text(source + " end.</b>")
    assert time.process_time() - start < 8 and len(got) < 1_000_000


def test_a_form_around_the_page():
    page = f"<body><form id=aspnetForm><div class=menu><a>m</a></div><div>{PARA * 3}<form>x</form></div></form></body>"
    assert htmltext.main_text(page).startswith("\n".join([TEXT] * 3))
    assert htmltext.main_text(f"<form><input><label>Name</label> Send your name, please.</form><div>{PARA * 5}</div>") == "\n".join([TEXT] * 5)


def test_without_marks_sections_beyond_the_content_go():
    page = f"<body><div><a>one</a> <a>two</a></div><div>menu</div><h1>Title</h1><div>{PARA * 6}</div><div>8 May</div><div>{PARA * 6}</div><div>imprint</div></body>"
    assert htmltext.main_text(page) == "\n".join(["Title"] + [TEXT] * 6 + ["8 May"] + [TEXT] * 6)
    assert htmltext.main_text(f"<body><div>{PARA * 6}<ul><li>i<li>j</ul></div></body>").endswith("i\nj")
