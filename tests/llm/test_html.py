from __future__ import annotations

import html
import re

import pytest

from lodestone.llm import htmltext, queries

PARA = "<p>Some text, with marks. And more of it, as it goes on and on.</p>"
TEXT = "Some text, with marks. And more of it, as it goes on and on."


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("plain words", "plain words"),
        (f"<article><h1>T</h1>{PARA}<p>a &amp; b&nbsp;c &lt;d&gt;\n  e</p></article>", f"T\n{TEXT}\na & b c <d> e"),
        (f"<body><header>Site</header><nav><a>m</a></nav><article>{PARA}</article><aside>s</aside><footer>f</footer>", TEXT),
        (f"<article>{PARA}<div class='ad-box'>buy</div><section id=comments>{PARA}</section><form>x</form><p>End</p></article>", f"{TEXT}\nEnd"),
        (f"<article>{PARA}<script>var a='</p>';</script><style>p{{}}</style><!-- c --><p hidden>h</p><p style='display: none'>h</p><p>x</p></article>", f"{TEXT}\nx"),
        ("<article><h1>T</h1><p><b>One, two.<br><p>Three, four.</p><p>five</article>", "T\nOne, two.\nThree, four.\nfive"),
        (f"<div class=wrap><div class=menu><ul><li>a<li>b</ul></div><div id=body><h2>H</h2>{PARA}<ul><li>i<li>j</ul></div></div>", f"H\n{TEXT}\ni\nj"),
        (f"<div class='cookie-notice'>{PARA}</div><main>{PARA}<header><h1>x</h1></header></main>", f"{TEXT}\nx"),
        (f"<article>{PARA}<p>cut &am</p><p title=\"a > b\">q</p", TEXT + "\ncut &am\nq"),
        (f"<article>{PARA}<p>wo<b>rd</b>s</p><pre> a\n b </pre></article>", TEXT + "\nwords\na b"),
    ],
)
def test_pages(source, want):
    assert htmltext.main_text(source) == want


def test_long_page_takes_linear_time():
    source = "<article>" + "<p>word, word. <b>x</b></p>" * 20_000 + "<" * 1000 + "</article>"
    assert htmltext.main_text(source).count("\n") >= 19_999


def test_query(spark, sf):
    rows = {r.page_id: r for r in queries.op7_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " " if x == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_columns(spark):
    pages = spark.createDataFrame([(1, "<article><p>a</p></article>", "old", 5), (None, None, None, None)], "page_id long, html string, text string, n int")
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "n", "text"] and sorted(tuple(r) for r in got.na.fill(0).collect()) == [(0, 0, ""), (1, 5, "a")]
    assert htmltext.extract(pages.limit(0)).count() == 0
