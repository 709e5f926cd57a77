"""The scan, not a landmark, decides a page's region."""

from __future__ import annotations

from readloom.llm import html_extract as H


def test_a_teaser_article_does_not_hide_the_body():
    body = "".join(f"<p>{'word ' * 40}{k}.</p>" for k in range(6))
    want = [" ".join(f"{'word ' * 40}{k}.".split()) for k in range(6)]
    for page in (
        f"<body><article><p>short card here</p></article><div>{body}</div></body>",
        f"<body><main><article><p>short card here</p></article><div>{body}</div></main></body>",
        f"<body><section>{body}</section><article><p>short card here</p></article></body>",
    ):
        got = H.extract(page).split("\n\n")
        assert [x for x in got if x != "short card here"] == want
