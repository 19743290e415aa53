"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches

#: Elements without text of their own, elements that end a block of text, and elements that never close.
SILENT = {"script", "style", "noscript", "template", "head", "iframe", "object", "svg", "annotation", "annotation-xml", "canvas", "audio", "video", "map", "datalist"}
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul textarea button".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose open sibling ends where another begins, up to the element that holds them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "menu", "dl", "table", "tbody", "thead", "tfoot", "select", "div", "article", "section", "main", "body", "blockquote", "aside", "nav", "form", "footer", "header", "td", "th", "li"}
#: Words of class, id and role that mark what is not the article, and what is.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|bread-?crumbs?|comments?|disqus|respon(?:d|ses)|footer|header|masthead|cookies?|consent|notices?|alert|popup|modal|share|social|related|recommend\w*|widget|newsletter|subscribe|pagination|pager|login|search|toolbar|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
#: Class names that hold a word of ASIDE and say something else: what a layout has or lacks, a post's category, its state, its own header.
NEUTRAL = re.compile(r"(?:has|with|no|without|is|category|tag|type|format|status|hide|hides|show|shows)[_-].*|.*[_-](?:closed|open|opened|enabled|disabled|on|off)|(?:entry|post|article|story)[_-]?header", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body-?text|article-?body|post-?body)(?:$|[\s_-])", re.I)
OUTER = {"nav", "footer", "aside", "form", "menu", "button", "select", "textarea", "dialog", "header", "search"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: HTML's white space and no other, with the no-break space that pages use for it.
SPACE = re.compile("[\t\n\x0b\x0c\r \xa0]+")
#: A start tag up to its end, by HTML's rules for quotes, and its attributes. No part gives back what it has taken, so that a tag is read once; a quote
#: that nothing closes is part of a name, and the tag ends with the next '>'.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
TAG = re.compile(rf"<([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)>")
NAME_VALUE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+""")
COMMENT_END = re.compile("--!?>")
#: What ends a sentence.
ENDS = ".!?:;\"'”»…"
#: Elements that hold one run of text; what holds them is the container whose share of the page's text counts.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption summary caption legend address center".split())
#: Calibrated by hand on made-up pages, in units of log-odds: a hidden element, one that is no article by its tag, a header, a header inside an
#: article, an element whose name says that it is no article, or a form; the article's own tag, and a name that says article.
UNSEEN, OUT, HEAD, OWN_HEAD, FINE, TAGGED, NAMED = -9.0, -2.5, -1.5, -0.5, -4.0, 2.0, 1.0
#: A block's words count half a bit each time they double from 8; sentence ends, links, rights reserved, the headline, text before it; a
#: container with all of a page's text counts SHARE more than one with none, and the one around it by AROUND of that.
SHORTEST, LONGEST, SENTENCE, OPEN_END, LINKED, RIGHTS, HEADLINE, EARLY, SHARE, EVEN, AROUND = -1.0, 1.5, 0.3, -0.4, -3.0, -2.0, 1.0, -0.7, 2.0, -0.9, 0.6
#: Smoothness in thousandths: NEARNESS over the cube of the steps between two blocks in the tree of elements, one step at least.
NEARNESS = 7200


@dataclass
class Block:
    text: str
    element: int
    tag: str
    linked: int
    early: bool
    cost: float = 0.0

    @property
    def plain(self) -> int:
        """Characters of text that is not mostly links."""
        return len(self.text) if self.linked <= 0.6 * len(self.text) else 0


class Blocks(HTMLParser):
    """The text blocks of a page, and its elements as a tree of parent numbers; element 0 is the page. Every step looks only at the ends of
    lists, so that time and memory are in proportion to the page, however deep it is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.tags = [0], [0], [""]
        #: Of each element: log-odds that it and those around it bring, whether it is marked, whether it lies in the article by tag or name.
        self.gain, self.marked, self.good = [0.0], [False], [False]
        self.open: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.blocks_open = [0]
        self.silent, self.links, self.mains, self.headed = 0, 0, 0, False
        self.parts: list[str] = []
        self.linked = 0
        self.out: list[Block] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            element = self.open[-1] if self.open else 0
            tag = self.tags[self.blocks_open[-1]]
            self.headed = self.headed or tag == "h1"
            self.out.append(Block(text, element, tag, self.linked, not self.headed))
        self.parts, self.linked = [], 0

    def weight(self, tag: str, attrs: dict[str, str]) -> tuple[float, bool, bool]:
        """What an element adds to the log-odds, whether it is marked, whether it says that it is the article."""
        if tag in ("html", "body"):
            return 0, False, False
        named = " ".join(attrs.get(k) or "" for k in ("class", "id", "role"))
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or ""):
            return UNSEEN, False, False
        if tag == "header" and self.mains:
            return OWN_HEAD, False, False
        if tag in OUTER and tag != "form":
            return HEAD if tag == "header" else OUT, False, False
        if tag in ("article", "main"):
            return (0, False, True) if self.mains else (TAGGED, False, True)
        good = bool(MAIN.search(named)) and not self.mains
        marked = tag == "form" or any(ASIDE.search(x) for x in named.split() if not NEUTRAL.fullmatch(x))
        return NAMED if good else 0, marked, good

    def last(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    # Markup that the page's end cuts off is dropped, as browsers do, so nothing is read again and again for its end.

    def parse_starttag(self, i: int) -> int:
        m = TAG.match(self.rawdata, i)
        if m is None:
            return len(self.rawdata)
        tag, attrs = m[1].lower(), []
        for name, value in NAME_VALUE.findall(m[2]):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            attrs.append((name.lower(), unescape(value[1:-1] if quoted else value)))
        if m[0].endswith("/>"):
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return m.end()

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self.rawdata.find(">", i + 2) >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: bool = True) -> int:
        m = COMMENT_END.search(self.rawdata, i + 2)
        return m.end() if m else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_pi = parse_html_declaration

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        closes = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else None)
        if closes:
            n = self.last(closes)
            if n >= 0 and n >= (self.holders[-1] if self.holders else -1):
                self.pop(n)
        up = self.open[-1] if self.open else 0
        gain, marked, good = self.weight(tag, dict(attrs))
        me = len(self.parent)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.tags.append(tag)
        self.gain.append(self.gain[up] + gain)
        self.marked.append(marked)
        self.good.append(self.good[up] or good)
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in HOLDERS:
            self.holders.append(len(self.open))
        if tag in BLOCKS:
            self.blocks_open.append(me)
        self.open.append(me)
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.mains += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math") and self.open and self.tags[self.open[-1]] == tag:
            self.pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.at.get(tag):
            self.pop(self.at[tag][-1])

    def pop(self, n: int) -> None:
        """Close the n-th open element and all in it."""
        while len(self.open) > n:
            tag = self.tags[self.open.pop()]
            self.at[tag].pop()
            if tag in HOLDERS:
                self.holders.pop()
            if tag in BLOCKS:
                self.blocks_open.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.mains -= tag in ("article", "main")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0

    def within(self, own: list[int]) -> list[int]:
        """For each element the sum over it and all in it of own."""
        total = list(own)
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return total

    def steps(self, a: int, b: int) -> int:
        """Steps from one element to another over the tree. Over all neighbours in a page these are as many as walking it takes."""
        n = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n


def parsed(html: str | None) -> Blocks:
    """A page's blocks, with their costs."""
    p = Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    n = len(p.parent)
    sentences, named, plain = [0] * n, [0] * n, [0] * n
    for b in p.out:
        seen = p.gain[b.element] > OUT / 2
        if b.text.count(" ") >= 4 and b.text[-1] in ENDS and seen:
            sentences[b.element] += b.plain
        if p.good[b.element]:
            named[b.element] += b.plain
        plain[b.element] += b.plain if seen else 0
    held, held_named, share = p.within(sentences), p.within(named), p.within(plain)
    # an element marked by its name pays for that, unless it has four fifths of the sentences and nothing outside it stands where the page says
    # that its article is
    fined = [False] * n
    fine = [0.0] * n
    for e in range(1, n):
        up = p.parent[e]
        own = p.marked[e] and not (held[e] and 5 * held[e] >= 4 * held[0] and held_named[e] == held_named[0])
        fined[e] = fined[up] or own
        fine[e] = fine[up] + (FINE if own else 0)
    outer = [0] * n  # the element's container: itself, or what holds it if it is a leaf or stands in one's text
    for e in range(1, n):
        outer[e] = outer[p.parent[e]] if p.tags[e] not in BLOCKS or p.tags[e] in LEAVES else e
    for b in p.out:
        c = outer[b.element]
        part = share[c] / (share[0] or 1)
        above = p.parent[c]
        wide = AROUND * share[above] / (share[0] or 1) if above and p.tags[above] not in ("html", "body") else 0
        gain = p.gain[b.element]
        b.cost = (min(gain, 0) if fined[b.element] else gain) + fine[b.element] + words_cost(b) + SHARE * max(part, wide) + EVEN + (EARLY if b.early and p.headed else 0)
    return p


def words_cost(b: Block) -> float:
    """Log-odds that a block is content by its own text: its length, end, links and words."""
    cost = max(SHORTEST, min(LONGEST, 0.5 * math.log2((b.text.count(" ") + 1) / 8)))
    cost += SENTENCE if b.text[-1] in ENDS else OPEN_END
    cost += LINKED * min(1.0, b.linked / len(b.text))
    cost += RIGHTS if "©" in b.text else RIGHTS / 2 if "all rights reserved" in b.text.lower() else 0
    return cost + (HEADLINE if b.tag == "h1" else 0)


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels that cost least. A node labelled True pays -cost where its cost is negative, False pays cost where it is positive; an
    edge (a, b, w) costs w where its ends differ. The least cut of a flow network by blocking flows (Dinic); True is the source's side."""
    n = len(costs)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            arc(source, i, c, 0)
        elif c < 0:
            arc(i, sink, -c, 0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            u = todo.popleft()
            for e in heads[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
            while at[u] < len(heads[u]):
                e = heads[u][at[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(heads[u]):
                path.append(heads[u][at[u]])
                u = to[heads[u][at[u]]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                at[u] += 1
            else:
                break


def smoothness(p: Blocks) -> list[tuple[int, int, int]]:
    """Edges between blocks: neighbours in the page, and each with the last block before it that the same container holds, by their steps."""
    edges, last = [], {}
    for i, b in enumerate(p.out):
        if i:
            edges.append((i - 1, i, NEARNESS // max(1, p.steps(p.out[i - 1].element, b.element)) ** 3))
        above = p.parent[b.element]
        if above in last and last[above] < i - 1:
            edges.append((last[above], i, NEARNESS // 27))
        last[above] = i
    return edges


def labels(p: Blocks) -> list[bool]:
    """Which blocks the least cut puts on the side of the content."""
    return minimum_cut([round(1000 * b.cost) for b in p.out], smoothness(p))


def main_text(html: str | None) -> str:
    """The blocks that the least cut puts on the side of the content, in page order, joined by spaces."""
    p = parsed(html)
    return " ".join(b.text for b, k in zip(p.out, labels(p)) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages. A null or empty page, or one without content, has an empty text. Repeated
    rows give repeated results; only these three columns are read. Pages of any length and depth are parsed whole, in time and memory
    in proportion to them, markup that never ends included; the cut takes longer the more blocks pull both ways. Of labellings that cost the same the one with the fewest blocks is taken; an empty table gives an empty table."""
    bounded_batches(pages.sparkSession, 500)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
