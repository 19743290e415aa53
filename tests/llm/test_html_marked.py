"""Names that hold a word of an aside, and wrappers that hold the whole page, don't drop the article."""

import pytest

from tallychain.llm import html

TEXT = "The first sentence of the text is here, in full length. A second one follows it and ends the matter."
NAV = "<nav><a href=/>Home</a></nav>"
COMMENTS = "<div class='comments'>" + "<p>A reader says that this is all wrong, and goes on and on about it for long.</p>" * 5 + "</div>"


@pytest.mark.parametrize("name", ["content-area with-sidebar", "layout has-sidebar", "post-body no-sidebar", "post type-post category-social", "hentry comments-closed", "post category-search", "promo"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_do_not_drop_the_article(name, tag):
    assert html.main_text(f"{NAV}<{tag} class='{name}'><p>{TEXT}</p></{tag}><footer>Foot words of no use here.</footer>") == TEXT


def test_a_page_in_one_form():
    assert html.main_text(f"<body><form id=aspnetForm>{NAV}<div><p>{TEXT}</p></div></form>") == TEXT


def test_entry_header_keeps_the_headline():
    assert html.main_text(f"<div class=entry><div class='entry-header'><h1>The head line</h1></div><p>{TEXT}</p></div>") == f"The head line {TEXT}"


@pytest.mark.parametrize("page", [f"<article><p>{TEXT}</p></article>{COMMENTS}", f"<div class=content><p>{TEXT}</p></div>{COMMENTS}", f"<div class='content has-sidebar'><p>{TEXT}</p>{COMMENTS}</div>"])
def test_long_comments_stay_out(page):
    assert html.main_text(page) == TEXT


def test_an_ad_beside_an_article_without_sentences():
    assert html.main_text("<div class=ad>The ad has the only sentence here.</div><article><h1>A head line</h1><p>A head line<br></article>") == "A head line A head line"


def test_formulas_stay_in_the_sentence():
    page = "<article><p>The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='application/x-tex'>E=m</annotation></math> in all of the cases here.</p></article>"
    assert html.main_text(page) == "The energy is E=m in all of the cases here."
