"""Main text of web pages by tag-path ratios.

Every text node has a tag path, root to leaf, of tag names with their classes. Per path the lengths and punctuation
marks of all its text nodes are summed and divided by the number of nodes: article prose stands in few paths with
long, punctuated nodes, menus in paths with many short ones. Both ratios are fused by their product, smoothed over
neighbouring nodes by a Gaussian, and the nodes whose score reaches the share ``threshold`` of the scores' standard deviation are
content. The article is the smallest element that holds all content nodes; where the page marks an article or main
element, only the content in the one with most text counts, and the innermost one around that content is taken. All blocks of the
article are given, however short; without such a mark, a part of the element that has no content node is left out if it
consists of links for the most part, and a section before or after all content if no path in it passes by itself.

What is no article by its markup is left out first: menus, headers and footers of the site, sidebars, notices, adverts,
forms, comments and hidden elements. A class, id or role counts by its last word that is no mere container word, so
``ad-box`` is an advert, but ``social-science`` is no share button. Where such a name is of a kind that articles may have, too
(``notice``, ``related``), an element that holds most of the page's text is not left out; nor is a form around the page.

Null and empty pages give an empty text. Each row is worked on alone; columns other than the html are kept as they
are, except one named like the output, which is replaced. Unclosed and misnested tags are handled as browsers do,
roughly; a cut-off tag at the end is dropped. Time and memory grow in proportion to the page, however deep tags nest.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Element names of HTML.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body dd dt head html li option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = frozenset("article aside body div footer form header html li main nav section table td th ul ol dl".split())

#: What is no article: by tag, and by the last telling word of a name in class, id or role.
APART = frozenset("nav footer aside button select dialog menu head input label fieldset search".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments contentinfo consent cookie cookies disqus footer gdpr menu menus nav navbar navigation pagination replies sidebar sidebars".split()
)
DOUBTFUL_WORDS = frozenset(
    "banner banners dropdown modal newsletter notice notices popup promo promos promotion promotions related respond search share sharing signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar widget widgets".split()
)
#: Elements that hold the whole page on some sites, and a few fields on most.
DOUBTFUL = frozenset(["form"])
SITE_WORDS = frozenset("header masthead topbar".split())
#: Words that only say that something is contained.
CONTAINER_WORDS = frozenset(
    "area articles bar block body box button buttons card cards column container content form group holder icon icons inner item items link links list main media outer overlay panel post posts row section slot stories text unit us widget widgets wrap wrapper zone".split()
)
#: Elements that part a page.
SECTIONS = frozenset("div section center address".split())
#: Elements of running text, which hold no article.
INLINE = frozenset("p b i em strong span a h1 h2 h3 h4 h5 h6 font u small li".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(text)}


def telling_words(names: str) -> set[str]:
    """Of each name the last word that is no container word, lower-cased."""
    out = set()
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        while len(words) > 1 and words[-1] in CONTAINER_WORDS:
            words.pop()
        out.update(words[-1:])
    return out


class Page:
    """The text nodes of a page, in order. Element 0 is the root; a child has a higher number than its parent."""

    def __init__(self, source: str):
        self.parent, self.name, self.path = [-1], [""], [0]
        self.apart, self.doubt, self.marked, self.linked = [False], [0], [0], [False]
        """By element: whether it is left out; the outermost doubtful element around it; the innermost article or main
        element around it; whether it is in a link."""
        self.paths: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self.stack = [0]
        self.places: dict[str, list[int]] = {}
        """By name the places of open elements in the stack."""
        at, end, last = 0, len(source), source.rfind(">")
        while at < end:
            m = TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
            if m is None:
                cut = re.compile(r"<[a-zA-Z/!]").search(source, at)  # a tag that never ends
                self._text(source[at : cut.start()] if cut else source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self._close(name)
            else:
                rest = m[3] if m[2] else m[6]
                if name in RAW:
                    if not rest.endswith("/"):
                        over = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                        at = over.end() if over else end
                else:
                    self._open(name, rest)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self.stack[-1], self.block, text))

    def _pop(self, names: frozenset | set, scope: frozenset) -> None:
        """Closes the innermost open element of these names and all in it, unless one of the scope is further in."""
        top = lambda group: max((at[-1] for n in group if (at := self.places.get(n))), default=0)
        k = top(names)
        if k and k >= top(scope):
            for e in self.stack[k:]:
                self.places[self.name[e]].pop()
            del self.stack[k:]

    def _open(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self.block += 1
            if name in CLOSES_P:
                self._pop({"p"}, SCOPE)
            if name in SAME:
                self._pop(SAME[name], frozenset(("ul", "ol", "dl", "table", "select", "article", "body")))
        if name in VOID:
            if name == "br":
                self._text(" ")
            return
        top, e = self.stack[-1], len(self.parent)
        inside = self.marked[top] > 0
        key, apart, doubt = name, self.apart[top] or name in APART or name == "header" and not inside, self.doubt[top]
        if not doubt and name in DOUBTFUL:
            doubt = e
        if rest and "=" in rest or "hidden" in rest:
            a = _attributes(rest)
            key = f"{name}.{a['class']}" if "class" in a else name
            if name not in ("html", "body", "article", "main"):
                words = telling_words(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}")
                apart = apart or not words.isdisjoint(APART_WORDS) or not inside and not words.isdisjoint(SITE_WORDS)
                if not doubt and not words.isdisjoint(DOUBTFUL_WORDS):
                    doubt = e
            apart = apart or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        self.parent.append(top), self.name.append(name), self.apart.append(apart), self.doubt.append(doubt)
        self.path.append(self.paths.setdefault((self.path[top], key), len(self.paths) + 1))
        self.marked.append(e if name in ("article", "main") else self.marked[top])
        self.linked.append(self.linked[top] or name == "a")
        if not rest.endswith("/") or name in BLOCK:
            self.places.setdefault(name, []).append(len(self.stack))
            self.stack.append(e)

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
            self._pop({name}, frozenset())
        else:
            self._pop({name}, SCOPE | {"p"})

    def sums(self, weights: list[tuple[int, int]]) -> list[int]:
        """By element, the weights in it, given as (element, weight)."""
        out = [0] * len(self.parent)
        for e, w in weights:
            out[e] += w
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def below(self, element: int) -> list[int]:
        """By element: -1 outside the given one, else the child of it that it is in (the element itself for itself)."""
        out = [-1] * len(self.parent)
        out[element] = element
        for e in range(element + 1, len(out)):
            p = self.parent[e]
            out[e] = e if p == element else out[p]
        return out

    def plain(self) -> list[tuple[int, int, str]]:
        """The text nodes that are not left out by their markup, character references decoded."""
        nodes = [(e, b, _html.unescape(t)) for e, b, t in self.texts if not self.apart[e]]
        weights = self.sums([(e, len(t.strip())) for e, _, t in nodes])
        # a doubtful element with most of the text is the article
        return [(e, b, t) for e, b, t in nodes if not (d := self.doubt[e]) or 3 * weights[d] > 2 * weights[0]]


def path_scores(nodes: list[tuple[int, str]], width: int = 1, sigma: float = 1.0) -> list[float]:
    """A smoothed score for each (path, text): mean length of the path's nodes times their mean count of marks."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, text in nodes:
        length[path] = length.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    fused = [length[p] / count[p] * (marks[p] / count[p] + 0.1) for p, _ in nodes]
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-width, width + 1)]
    out = []
    for i in range(len(fused)):
        total = norm = 0.0
        for d, w in zip(range(-width, width + 1), weights, strict=True):
            if 0 <= i + d < len(fused):
                total, norm = total + w * fused[i + d], norm + w
        out.append(total / norm)
    return out


def content_nodes(nodes: list[tuple[int, str]], threshold: float = 0.5, width: int = 1) -> list[int]:
    """The numbers of the (path, text) whose score, smoothed over ``width`` neighbours, reaches the threshold."""
    scores = path_scores(nodes)
    mean = sum(scores) / len(scores)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return [k for k, s in enumerate(scores if width == 1 else path_scores(nodes, width)) if s >= threshold * deviation]


def main_text(source: str | None, threshold: float = 0.5) -> str:
    """The article's blocks, white space inside them made one space, joined by a line feed."""
    if not source:
        return ""
    page = Page(source)
    plain = page.plain()
    nodes = [(e, t) for e, _, t in plain if not t.isspace()]
    if not nodes:
        return ""
    content = [nodes[k][0] for k in content_nodes([(page.path[e], t.strip()) for e, t in nodes], threshold)]
    lengths = page.sums([(e, len(t)) for e, t in nodes])
    # the article or main element with most text, of equal ones the outermost
    best = max((e for e in range(len(page.name)) if page.name[e] in ("article", "main") and lengths[e]), key=lambda e: (lengths[e], -e), default=0)
    where = page.below(best)
    content = [e for e in content if where[e] >= 0] or [e for e, _ in nodes if where[e] >= 0]
    content = [e for e in content if not page.linked[e]] or content  # smoothing reaches over to a menu's ends
    held = page.sums([(e, 1) for e in content])
    chosen = max(e for e, n in enumerate(held) if n == held[0])  # elements are numbered as they open, so the last is the smallest
    while page.name[chosen] in INLINE:
        chosen = page.parent[chosen]
    chosen = page.marked[chosen] or chosen
    part = page.below(chosen)
    links = page.sums([(e, len(t)) for e, t in nodes if page.linked[e]])
    if not best:  # nodes that are content by their own paths, not by their neighbours'
        own = {nodes[k][0] for k in content_nodes([(page.path[e], t.strip()) for e, t in nodes], threshold, 0)} or set(content)
        numbers = [b for e, b, _ in plain if e in own]
        first, last, anchored = min(numbers), max(numbers), page.sums([(e, 1) for e in own])
    blocks: dict[int, list[str]] = {}
    for e, b, t in plain:
        k = part[e]
        part_of = not best and k != chosen and page.name[k] not in INLINE
        menu = part_of and (not held[k] and 2 * links[k] > lengths[k] or page.name[k] in SECTIONS and not anchored[k] and not first <= b <= last)
        if k >= 0 and not menu:
            blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """pages' columns but the html, and the main text."""
    small_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (html, output)]
    schema = T.StructType([*kept, T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(x) for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(texts, pa.string())], names=[*[f.name for f in kept], output])

    return pages.select(*[f.name for f in kept], html).mapInArrow(run, schema)
