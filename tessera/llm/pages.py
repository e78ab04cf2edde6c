"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page becomes a row of words and tags. A word is worth so much, a tag costs so much, and words in links or in boxes such
as menus, adverts or reader comments count against a region; the weights are log-odds learnt from the labelled pages
below. One linear scan finds the best contiguous region. If an article or main element holds the start of that region,
the region is widened to all of it, so that a box amid the text doesn't cut the text off. What is put out are the blocks
of the region outside of boxes.

A run of tokens that cost never costs more than CROSSING words are worth, so two stretches of text that are each worth more
stay one region whatever stands between them, a long list of links for example.

Elements are boxes by their kind (nav, footer, ...), by the attribute `hidden`, or by a word in their class, id or role. No name
is sure, however: what holds a main element or the page's only top heading is no box. Names of boxes that stand amid the
text (comments, share bars, adverts) are taken at their word as long as the page has text outside of all such boxes, a quarter of
that in the largest; where it hasn't, the largest holds the text, and the question is put again for the boxes within it. Comments
are never taken for the text of a page with a heading outside of such boxes. If such a name is only a part of a name with words
that no layout uses ("social-policy"), it counts as long as the element has at most a quarter of the remaining words. Words that
layouts also use for the text's own parts (header, sidebar, widget and the like) count outside of articles only, and for
elements with at most half of the words. Names of negated, optional or labelled parts ("has-sidebar", "ad-free", "tag-advertising")
say nothing. Headings are never boxes, nor is an article's own header.

Nulls and edges: a null page is empty; no text gives the empty string; unclosed comments, scripts and tags end with the
page; a bare `<` is text; a null id or url is kept. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never shown, elements that are boxes, and elements without content.
HIDDEN = frozenset("head script style noscript template svg math object iframe canvas audio video map".split())
BOXES = frozenset("nav aside footer dialog button select textarea option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block; a line break is white space within one.
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre "
    "table caption thead tbody tfoot tr td th figure figcaption address hr details summary form fieldset center".split()
)
#: Elements that the same element, or one of the given ones, ends where it has no end tag.
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
RAW = {name: re.compile(f"</{name}", re.I | re.A) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
#: Words in a class, id or role that name a box, those of them that name what readers write, and those that do in doubt only.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond "
    "share sharing social related recommended newsletter".split()
)
READERS = frozenset("comment comments commentlist disqus respond".split())
DOUBTED_NAMES = frozenset(
    "promo promotion banner notice popup modal overlay sidebar side aside widget widgets footer header masthead toolbar reply replies "
    "discussion subscribe subscription signup login search copyright complementary contentinfo alert skip hidden".split()
)
#: Beside a name, these say that something has, lacks or is about such a part.
ABOUT = frozenset("has have no not with without hide show free open closed enabled disabled tag category cat topic hentry".split())
#: Words that layouts put beside a box's name.
PLAIN = frozenset(
    "area bar block body bottom box btn button buttons card center col column container content count cta desktop el element first form group icon icons id info inner item items "
    "left link links list main mobile module outer panel post posts primary right row section slot small main sub text title top top wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are boxes unless they hold most of the page; some sites wrap all of it in a form.
DOUBTED = frozenset("form fieldset menu".split())
#: What makes a box: nothing, its kind, a name, a name of what readers write, a name among other words, a doubted name or kind.
NONE, SURE, NAMED, READER, PARTLY, DOUBT = range(6)
#: Words' worth that a run of costs may cost at most.
CROSSING = 20
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_NAME_PART = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_TAG_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")

#: Labelled pages; the main text stands between the two marks.
MARK, UNMARK = "<!--main-->", "<!--/main-->"
LABELLED = (
    '<html><head><title>A b</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">All news</a></li></ul></nav><div class="ad">Buy now for less</div>'
    "<!--main--><article><h1>The long rain</h1><p>It rained for nine days and the river rose over its banks, which nobody in the town had seen before.<p>On the tenth day the water "
    "went back and left the streets under a layer of fine grey mud.</p></article><!--/main--><footer>&copy; The paper</footer></body></html>",
    '<body><header><a href="/">Site</a><form><input name=q><button>Search</button></form></header><div id="content"><!--main--><h2>Bread</h2><p>Mix flour, water and salt, and let '
    "the dough rest in a cool place until the next morning.</p><ul><li>Fold it twice before it goes into the oven.</li><li>Bake it for forty minutes on a hot stone.</li></ul>"
    '<!--/main--></div><div class="comments"><p>Great!</p><p>Worked for me</p></div><aside><a href="/x">More recipes</a> <a href="/y">Pies</a></aside></body>',
    '<div class="menu"><a href="1">One</a> | <a href="2">Two</a> | <a href="3">Three</a></div><table><tr><td><!--main--><p>The committee met on Monday and heard four speakers on the state of '
    "the roads in the north of the county.</p><blockquote>We can't wait for another winter, said the first of them.</blockquote><p>A vote was put off.</p><!--/main--></td></tr></table>"
    '<div class="footer"><a href="c">Contact</a> <a href="i">Imprint</a></div>',
    '<body><div class="cookie-notice">We use cookies <button>OK</button></div><main><!--main--><h1>Owls</h1><section><p>An owl hears a mouse under a foot of snow and turns its head to '
    "find the place.</p></section><section><p>It flies without a sound because the edges of its feathers are soft.</p></section><!--/main--></main>"
    '<div class="related"><h3>Read on</h3><a href="/h">Hawks</a><a href="/k">Kites</a></div></body>',
    '<body><div id="top"><a href="/">Harbour news</a> <a href="/w">Weather</a> <a href="/s">Sport</a></div><div class="page no-sidebar"><!--main--><h1>A ferry for the islands</h1><p>The council has ordered '
    'a <a href="/f">ferry</a> that runs on <b>batteries</b> and carries forty cars.</p><p>It is to sail from the spring of next year, four times a day.</p><table><tr><th>Length</th><td>sixty metres</td></tr></table><!--/main-->'
    '<ul class="share"><li><a href="/1">Post</a></li><li><a href="/2">Mail</a></li></ul><div id="comments"><div><p>At last, we have waited for so long</p><p>Who is going to pay for it?</p></div></div></div></body>',
    '<body><div class="top-nav"><a href="/">Blog</a> <a href="/all">All posts</a></div><div class="post category-cookies tag-advertising comments-open"><!--main--><h2>Why I left the trade</h2><p>For ten years I sold '
    'space on other people&#39;s pages, and I was good at it.</p><div class="social-policy"><p>What the money did to the pages is another story, and a longer one.</p></div><!--/main--><div class="share-buttons"><a href="/1">Share</a></div></div>'
    '<ol class="commentlist"><li>So true</li><li>Good luck with the <a href="/bees">bees</a></li></ol><div aria-hidden="false" class="footer-links"><a href="/i">Imprint</a></div></body>',
)


class _Page:
    """Tokens of a page: (kind, text, block, boxed); kind is "word", "link" or a tag's name."""

    def __init__(self, source: str):
        self.source = source
        self.tokens: list[tuple[str, str, int, bool]] = []
        self.marks: list[int] = []
        self.areas: list[list[int]] = []  # first and last token of article and main elements outside of boxes
        self.block = 0
        self._raw: list[tuple[str, str, int, int]] = []  # tokens with the innermost box they stand in, or -1
        self._boxes: list[list] = []  # kind, enclosing box or -1, number of top headings, whether it holds a main element
        self._spans: list[list[int]] = []  # areas, with the box they stand in
        self._scan()
        self._decide()

    def _decide(self) -> None:
        """Which boxes are boxes; then tokens and areas."""
        n = len(self._boxes)
        kinds, around = [b[0] for b in self._boxes], [b[1] for b in self._boxes]
        sure = [False] * n  # whether the box, or one around it, is one without doubt
        for k in range(n):
            sure[k] = kinds[k] == SURE or (around[k] >= 0 and sure[around[k]])
        own, linked, heads, free_heads, tops = [0] * n, [0] * n, [0] * n, 0, 0  # words of each box itself
        free = 0  # words outside of boxes
        total = 0
        for kind, text, _, box in self._raw:
            if box >= 0 and sure[box]:
                continue
            if kind in ("word", "link"):
                size = len(text.split())
                total += size
                if box < 0:
                    free += size * (kind == "word")
                else:
                    own[box] += size * (kind == "word")
                    linked[box] += size * (kind == "link")
            elif kind in ("h1", "h2", "h3"):
                if box < 0:
                    free_heads += 1
                    tops += kind == "h1"
                else:
                    heads[box] += 1
        boxed = [kinds[k] == SURE for k in range(n)]
        kept = [kinds[k] in (NAMED, READER, PARTLY, DOUBT) and (self._boxes[k][3] or (self._boxes[k][2] and not tops)) for k in range(n)]
        self._decide_named(boxed, kept, own, heads, free, free_heads)
        # What boxes are left is decided by their share of the words outside of the boxes found by now.
        inside = [own[k] + linked[k] for k in range(n)]
        gone = list(boxed)
        for k in range(n):
            gone[k] = boxed[k] or (around[k] >= 0 and gone[around[k]])
        for k in reversed(range(n)):
            if gone[k]:
                total -= own[k] + linked[k]
                inside[k] = 0
            elif around[k] >= 0:
                inside[around[k]] += inside[k]
        for k in range(n):
            if not boxed[k] and not kept[k]:
                boxed[k] = (kinds[k] == PARTLY and 4 * inside[k] <= total) or (kinds[k] == DOUBT and 2 * inside[k] <= total)
            boxed[k] = boxed[k] or (around[k] >= 0 and boxed[around[k]])
        self.tokens = [(kind, text, block, box >= 0 and boxed[box]) for kind, text, block, box in self._raw]
        self.areas = [[a, b] for a, b, box in self._spans if box < 0 or not boxed[box]]

    def _decide_named(self, boxed: list[bool], kept: list[bool], own: list[int], heads: list[int], text: int, headings: int) -> None:
        """Marks the boxes that go by their name; text and headings: the words and headings outside of all elements with names."""
        n = len(boxed)
        named = [self._boxes[k][0] in (NAMED, READER) and not kept[k] for k in range(n)]
        outer, inside, within = [-1] * n, list(own), list(heads)  # the nearest such element around or at each; words and headings in it
        children: dict[int, list[int]] = {}
        for k in range(n):
            up = self._boxes[k][1]
            outer[k] = k if named[k] else outer[up] if up >= 0 else -1
            if named[k]:
                children.setdefault(outer[up] if up >= 0 else -1, []).append(k)
            elif outer[k] < 0 and not boxed[k]:
                text, headings = text + own[k], headings + heads[k]
        loose, loose_heads = [0] * n, [0] * n  # of each such element, without those in it
        for k in reversed(range(n)):
            up = self._boxes[k][1]
            if outer[k] >= 0:
                loose[outer[k]] += own[k]
                loose_heads[outer[k]] += heads[k]
            if up >= 0:
                inside[up] += inside[k]
                within[up] += within[k]
        left = [(-inside[k], k) for k in children.get(-1, ())]
        heapq.heapify(left)
        readers = []
        while left:
            size, k = heapq.heappop(left)
            if self._boxes[k][0] == READER and (headings or text * 4 >= -size):
                readers.append(k)
                continue
            if text * 4 >= -size:
                left.append((size, k))
                break
            kept[k] = True
            text, headings = text + loose[k], headings + loose_heads[k]
            for c in children.get(k, ()):
                heapq.heappush(left, (-inside[c], c))
        for k in [*readers, *(k for _, k in left)]:
            boxed[k] = True

    def _scan(self) -> None:
        s, at, stack = self.source, 0, []  # stack: (name, number of its box or -1, index of its area or -1)
        open_links, box = 0, -1
        names: Counter = Counter()
        text: list[str] = []
        endless: set[str] = set()  # raw elements that have no end tag any more

        def flush() -> None:
            if text:
                kind = "link" if open_links else "word"
                self._raw.append((kind, "".join(text), self.block, box))
                text.clear()

        def pop() -> str:
            nonlocal open_links, box
            name, own, area = stack.pop()
            names[name] -= 1
            open_links -= name == "a"
            if own >= 0:
                box = self._boxes[own][1]
            if area >= 0:
                self._spans[area][1] = len(self._raw)
            if name in BLOCKS:
                self.block += 1
            return name

        while at < len(s):
            begin = s.find("<", at)
            if begin < 0:
                text.append(s[at:])
                break
            if begin > at:
                text.append(s[at:begin])
            if s.startswith("<!--", begin):
                if s.startswith((MARK, UNMARK), begin):
                    flush()
                    self.marks.append(len(self._raw))
                end = s.find("-->", begin + 4)
                at = len(s) if end < 0 else end + 3
                continue
            match = _TAG_NAME.match(s, begin + 1)
            if not match:
                if s[begin + 1 : begin + 2] in ("!", "?"):
                    end = s.find(">", begin)
                    at = len(s) if end < 0 else end + 1
                else:
                    text.append("<")
                    at = begin + 1
                continue
            end = self._tag_end(match.end())
            if end < 0:
                break  # the page ends within a tag
            name, closing, inside = match[1].lower(), s[begin + 1] == "/", s[match.end() : end]
            at = end + 1
            if name in BLOCKS or name in ("a", "br"):
                if name == "br":
                    text.append(" ")
                else:
                    flush()
            if closing:
                if names[name]:
                    flush()
                    while pop() != name:
                        pass
                elif name in BLOCKS:
                    self.block += 1
            elif name in VOID:
                if name == "hr":
                    self.block += 1
            else:
                while stack and name in CLOSES.get(stack[-1][0], ()):
                    flush()
                    pop()
                own = -1
                if kind := self._box_kind(name, inside, names):
                    flush()
                    own = len(self._boxes)
                    self._boxes.append([kind, box, 0, False])
                    box = own
                if name in ("h1", "main"):
                    up = box
                    while up >= 0:
                        self._boxes[up][2 if name == "h1" else 3] += 1
                        up = self._boxes[up][1]
                area = -1
                if name in ("article", "main"):
                    area = len(self._spans)
                    self._spans.append([len(self._raw), len(s), box])
                if name in BLOCKS:
                    self.block += 1
                if not inside.endswith("/") or name not in ("svg", "math"):
                    stack.append((name, own, area))
                    names[name] += 1
                    open_links += name == "a"
                elif own >= 0:
                    box = self._boxes[own][1]
                if name in RAW:
                    close = None if name in endless else RAW[name].search(s, at)
                    if not close:
                        endless.add(name)
                        if name in ("script", "style"):
                            at = len(s)
                        continue
                    if name not in ("script", "style"):
                        text.append(s[at : close.start()])
                    at = close.start()
            if name in BLOCKS:
                self._raw.append((name, "", self.block, box))
        flush()
        while stack:
            pop()

    def _tag_end(self, at: int) -> int:
        """Where the `>` of a tag stands, outside of quoted values; -1 if the page ends first."""
        s = self.source
        end = s.find(">", at)
        while end >= 0:
            quote = min((p for p in (s.find('="', at, end), s.find("='", at, end)) if p >= 0), default=-1)
            if quote < 0:
                return end
            close = s.find(s[quote + 1], quote + 2)
            if close < 0:
                return end
            at = close + 1
            if close > end:
                end = s.find(">", at)
        return -1

    @staticmethod
    def _box_kind(name: str, inside: str, names: Counter) -> int:
        if name in HIDDEN or name in BOXES:
            return SURE
        if name in DOUBTED:
            return DOUBT
        article = names["article"]
        if name in ("html", "body", "article", "main") or name in HEADINGS:
            return NONE
        if name == "header":
            return NONE if article or names["main"] else DOUBT
        if not inside:
            return NONE
        kind = NONE
        for m in _ATTRIBUTE.finditer(inside):
            attribute, value = m[1].lower(), (m[2] or "").strip("\"'")
            if attribute == "hidden" or (attribute == "style" and _UNSHOWN.search(value)):
                return SURE
            if attribute == "aria-hidden" and value.lower() == "true":
                kind = kind or DOUBT
            if attribute not in ("class", "id", "role"):
                continue
            for token in value.split():
                parts = {x.lower() for x in _NAME_PART.split(token)}
                if not ABOUT.isdisjoint(parts):
                    continue
                if names_found := NAMES & parts:
                    if any(x and not x.isdigit() for x in parts - NAMES - DOUBTED_NAMES - PLAIN):
                        found = PARTLY
                    else:
                        found = NAMED if READERS.isdisjoint(names_found) else READER
                elif not article and not DOUBTED_NAMES.isdisjoint(parts):
                    found = DOUBT
                else:
                    continue
                kind = found if kind == NONE else min(kind, found)
        return kind


def _units(page: _Page) -> list[tuple[str, int]]:
    """Kind of each token and how often it counts."""
    return [(("boxed" if boxed else kind), len(text.split()) if kind in ("word", "link") else 1) for kind, text, _, boxed in page.tokens]


@lru_cache(1)
def weights() -> dict[str, float]:
    """Log-odds of each kind of token inside against outside the main text of LABELLED; words gain, all else costs."""
    inside, outside = Counter(), Counter()
    for source in LABELLED:
        page = _Page(source)
        first, last = page.marks[:2]
        for k, (kind, n) in enumerate(_units(page)):
            (inside if first <= k < last else outside)[kind] += n
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / (total_in + 1) * (total_out + 1) / (outside[k] + 0.5)) for k in {*inside, *outside}}
    return {k: max(v, 0.5) if k == "word" else min(v, -0.1) for k, v in odds.items()}


def bounded(values: list[float], most: float) -> list[float]:
    """values, but each run of negative ones, if it sums up to less than -most, as parts of -most."""
    out, k = list(values), 0
    while k < len(out):
        end, cost = k, 0.0
        while end < len(out) and out[end] < 0:
            cost -= out[end]
            end += 1
        if cost > most:
            out[k:end] = [v * most / cost for v in out[k:end]]
        k = max(end, k + 1)
    return out


def best(values: list[float]) -> tuple[int, int]:
    """First place of the run of values with the largest sum and the one after its last; (0, 0) if no sum is above 0."""
    top = total = 0.0
    first = start = last = 0
    for k, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > top:
            top, first, last = total, start, k + 1
    return first, last


def region(page: _Page) -> tuple[int, int]:
    """First token of the best region and the one after its last; (0, 0) if nothing scores."""
    value = weights()
    first, last = best(bounded([value.get(kind, -0.5) * n for kind, n in _units(page)], CROSSING * value["word"]))
    for a, b in page.areas:
        if last and a < last and first < b:
            first, last = min(first, a), max(last, b)
    return first, last


def main_text(source: str | None) -> str:
    page = _Page(source or "")
    first, last = region(page)
    blocks: dict[int, list[str]] = {}
    for kind, text, block, boxed in page.tokens[first:last]:
        if kind in ("word", "link") and not boxed:
            blocks.setdefault(block, []).append(text)
    cleaned = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(b for b in cleaned if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
