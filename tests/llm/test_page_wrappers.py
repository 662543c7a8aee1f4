"""Wrappers whose class words only mention what is not content."""

import pytest

from sensorgrid.llm import html_text

STORY = "A paragraph of some length that tells a story about something. " * 3


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>", "<div class='content no-comments'>",
    "<div class='page with-nav'>", "<section id='search-results'>",
])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrapper_keeps_its_article(wrapper, inner):
    close = "</section>" if "section" in wrapper else "</div>"
    page = (
        f"<body>{wrapper}<ul><li><a href=/>Menu</a></ul><{inner}><p>1 {STORY}</p><p>2 {STORY}"
        f"<span class='ad'>Buy</span></p></{inner}><div class='sidebar'><p>{STORY}</p></div>"
        f"{close}</body>"
    )
    assert html_text.main_text(page) == f"1 {STORY}".strip() + "\n\n" + f"2 {STORY}".strip()


def test_teasers_beside_an_article_stay_out():
    page = (
        f"<article><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></article>"
        f"<div class='related'><article><p>{STORY}</p></article></div>"
    )
    assert html_text.main_text(page) == "\n\n".join([STORY.strip()] * 3)
