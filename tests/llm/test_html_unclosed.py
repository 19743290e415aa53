"""Markup that never ends: read once, dropped as browsers do, with the same blocks before it."""

import time

import pytest

from tallychain.llm import html

TEXT = "<p>Some text that is here.</p>"


def least_time(page):
    times = []
    for _ in range(2):
        began = time.process_time()
        found = html.parsed(page)
        times.append(time.process_time() - began)
    return min(times), [b.text for b in found.out]


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='x", "<!--", "<![CDATA[", "<![foo", "<?", "</a ", '<a href=x"', "<svg ", "<!--a--!", "x<a", "<a b=\"'", "</", "<a/", "<a\n="])
def test_a_megabyte_is_read_in_proportion(piece):
    short, long = 125_000 // len(piece), 1_000_000 // len(piece)
    least_time(TEXT + piece * 100)
    (a, _), (b, texts) = least_time(TEXT + piece * short), least_time(TEXT + piece * long)
    assert b < 24 * max(a, 0.02) and texts[0] == "Some text that is here."


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<![foo[x]]><p>Hello there.</p>", ["Hello there."]), ("<![>a", ["a"]), ("<!-->b", ["b"]), ("<!--x--!>b", ["b"]), ("<!doctype html><p>c", ["c"]), ('<a href="x>y">d</a>', ["d"]),
        ('<p class=a"b>e</p>', ["e"]), ('<P ID=1 CLASS="z"/>f', ["f"]), ("g<!-- never", ["g"]), ("h<a href='never", ["h"]), ("1 < 2 <3 & i", ["1 < 2 <3 & i"]), ("j</a", ["j"]), ("<p title='&lt;'>k</p>", ["k"]),
    ],
)
def test_odd_markup(page, texts):
    assert [b.text for b in html.parsed(page).out] == texts


def test_attributes_are_read_as_before():
    p = html.Blocks()
    seen = []
    p.handle_starttag = lambda tag, attrs: seen.append((tag, attrs))
    p.feed("<DIV Class=\"a b\" id='c' hidden data-x = y&amp;z title=\"&lt;\" empty=''><br/>")
    assert seen == [("div", [("class", "a b"), ("id", "c"), ("hidden", ""), ("data-x", "y&z"), ("title", "<"), ("empty", "")]), ("br", [])]
