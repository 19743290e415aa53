"""The minimum cut decides on text, links and structure: pages without names or with plain elements only, blocks that it relabels, deep pages."""

import os
import re
import time
import tracemalloc

import pytest

from tallychain.llm import html

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SENTENCES = ["The first sentence of the text is here, in its full length.", "Short", "Another sentence follows, and it goes on for a good while longer.", "And so it ends, as all things do in time."]
PAGE = "<body><div><ul>" + "<li><a href=/x>Home</a></li>" * 5 + "</ul></div><div>Buy our goods at once.</div><div><h1>The head line</h1>" + "".join(f"<p>{s}</p>" for s in SENTENCES) + "</div><div>&copy; a company, all rights reserved</div></body>"


def stripped(page):
    return re.sub(r" (class|id|role)=(\"[^\"]*\"|\S+?(?=[\s>]))", "", page)


def f1(found, want):
    a, b = set(found.split()), set(want.split())
    return 2 * len(a & b) / max(1, len(a) + len(b))


def test_plain_elements_alone():
    assert html.main_text(PAGE) == "The head line " + " ".join(SENTENCES)


def test_the_cut_relabels_for_the_better():
    p = html.parsed(PAGE)
    kept = html.labels(p)
    changed = [b.text for b, k in zip(p.out, kept) if (b.cost > 0) != k]
    assert changed == ["Short"] and kept[[b.text for b in p.out].index("Short")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_names_are_not_needed(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    want = [html.main_text(re.search(r"<article>.*</article>", h, re.S)[0]) for h in pages]
    assert [html.main_text(h) for h in pages] == want
    assert sum(html.main_text(stripped(h)) == w for h, w in zip(pages, want)) >= 0.98 * len(pages)
    plain = [re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", stripped(h)) for h in pages]
    assert sum(f1(html.main_text(h), w) for h, w in zip(plain, want)) >= 0.95 * len(pages)
    better = worse = 0
    for h, w in zip(plain, want):
        p = html.parsed(h)
        blocks = {b.text for b in html.parsed(f"<article>{w}</article>").out}
        for b, k in zip(p.out, html.labels(p)):
            if (b.cost > 0) != k:
                good = b.text in w or b.text in blocks
                better, worse = better + (k == good), worse + (k != good)
    assert better >= worse


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "The text that stays is here, in full length.", lambda n: "<div>a " * n, lambda n: "<div class=ad>Some words in a sentence. " * n, lambda n: "<b>" * n + "<p>x</i>" * n, lambda n: "<p>One sentence of some words. " * n,
], ids=["deep", "deep with text", "deep and marked", "unmatched ends", "wide"])
def test_time_and_memory_follow_the_page(make):
    spent = []
    for n in (12_500, 100_000):
        page = make(n)
        began = time.process_time()
        html.main_text(page)
        spent.append(time.process_time() - began)
    assert spent[1] < 24 * max(spent[0], 0.05)  # 8 where it is linear, 64 where it is quadratic
    tracemalloc.start()
    html.main_text(make(20_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20


def test_an_empty_table_and_repeated_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", PAGE, "t", "n")] * 2 + [(None, None, None, None, None)]
    found = sorted((r.page_id or 0, r.n_chars) for r in html.extract(spark.createDataFrame(rows, schema)).collect())
    assert found == [(0, 0)] + [(1, len(html.main_text(PAGE)))] * 2
