"""Content beside the element that holds nearly all of it."""

from __future__ import annotations

from lodestone.llm import htmltext

from .test_html import PARA, TEXT

LEAD = "A lead, in short. It stands beside, as leads do."


def test_content_beside_the_body_stays():
    body = f"<div id=body>{PARA * 20}</div>"
    menu = "<div class=menu><ul><li>a<li>b</ul></div>"
    want = "\n".join([LEAD] + [TEXT] * 20)
    assert htmltext.main_text(f"<body>{menu}<div class=lead><p>{LEAD}</p></div>{body}</body>") == want
    assert htmltext.main_text(f"<body>{menu}{body}<div class=end><p>{LEAD}</p></div></body>") == "\n".join([TEXT] * 20 + [LEAD])
    assert htmltext.main_text(f"<body>{menu}<div><p>{LEAD}</p></div><article>{PARA * 20}</article></body>") == "\n".join([TEXT] * 20)
