"""HTML extraction by tree scoring.

A page is read into blocks: runs of text between block elements, each with the
node that owns it and the share of it that is link text. A block passes points
for its length and commas to the containers above it, in full to the nearest
and less to those further up; a container's points are discounted by its link
density. The page itself is a container too, and of equal ones the outermost
wins, so a page without <html> or <body> loses nothing. The best container is
kept, widened to the article or main element around it (markup that names the
article says more than a score inside it), and so are sibling articles, and
siblings that score a fifth as much or are plain paragraphs. Where no article
or main element is around it, all other text of the page that is no aside and
no list of links is kept too: headings, short blocks, lists and tables.
Menus, headers (but for their headings), footers, sidebars, notices, adverts,
forms, comments of readers, scripts and styles give no blocks, wherever they
stand: what an element is, or a name that says only that, decides. A name that
may mean something else (related-work, market-share, responses) is a doubt, and
the content decides: an element with links, controls or little text goes, any other
stays, and so does every doubtful part of a sentence, a list or a table.

Defined cases: a null, empty or text-free page gives an empty text, and so does
one of links alone outside of article and main; unclosed
and crossed tags are closed as browsers do, and a page that breaks off ends
there; nothing is cut from long pages, depth costs no recursion, and end tags
that match nothing open cost no walk; equal rows give equal texts; an empty table gives no rows. Only the html column is read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>?""", re.S)
NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their points go to what is around them.
LEAVES = HEADINGS | frozenset("p pre li dd dt td th tr figcaption summary blockquote center address".split())
CELLS = frozenset("td th".split())
#: What a page may be without; such a container is judged by its parts.
OUTERMOST = frozenset("#page html body".split())
NOT_TEXT = frozenset("nav footer aside form head menu dialog button fieldset option".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
KEPT_TAGS = frozenset("html body article main".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note status".split())
#: In a class or id these raise a doubt; they decide if they are its head word (the sure ones), or if all its words are
#: of this kind.
DOUBTFUL = re.compile(
    r"(?:ad|ads|adv|advert\w*|sponsor\w*|promo|promos|promot\w*|cookies?|consent|gdpr|disqus|newsletter\w*|subscri\w*|related|recommend\w*|breadcrumbs?|sharing|share|shares|socials?"
    r"|comments?|commenters?|commentlist|replies|responses)\Z")
SURE = re.compile(r"(?:ad|ads|advert|adverts|advertis\w+|sponsor\w*|promo|promos|promoted|cookies?|gdpr|disqus|newsletter\w*|subscribe|breadcrumbs?|comments?|commenters?|commentlist)\Z")
#: As its head word they decide too.
WEAK = re.compile(
    r"(?:banner\w*|nav\w*|menu\w*|sidebar\w*|footer\w*|header\w*|masthead|notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay|signup|login|pagination|pager"
    r"|widget\w*|toolbar|searchbox|search|copyright|disclaimer|paywall|teaser\w*|trending|popular)\Z"
)
#: Words that only hold another; and those that begin a remark on the layout.
HOLDERS = frozenset("container wrapper wrap box block inner outer area section list item items content body text col column row top bottom left right main slot zone unit panel".split())
#: Words that go with those of menus, adverts and comments.
COMPANY = frozenset(
    "button buttons link links icon icons bar form label message post posts article articles story stories news now more us you your also like this here close toggle site page blog "
    "global primary secondary sticky fixed floating media network networks tools google user users reader readers visitor visitors count policy preferences settings".split()
)
REMARKS = frozenset("has with no without is show hide".split())
#: Text with this share of links, or more, is a menu where no article or main element is around the best container.
LINKS = 0.5
#: A doubtful element goes with this share of links or more, or with fewer characters.
DOUBTFUL_LINKS, DOUBTFUL_CHARS = 0.3, 80
CONTROLS = frozenset("input button select textarea form".split())
#: What an opening tag closes, up to the given bounds.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
BOUNDS = frozenset("html body table td th ul ol dl select button article section div main aside nav header footer form".split())


STAYS, DOUBT, GOES = range(3)


def _aside(tag: str, attrs: str) -> int:
    """Whether an element is outside of the article by what it is or says."""
    if tag in NOT_TEXT:
        return GOES
    if not attrs or attrs.isspace():
        return STAYS
    names: list[list[str]] = []
    for m in NAMES.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return GOES
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return GOES
        if name == "role" and value.lower() in NOT_ROLES:
            return GOES
        if name in ("class", "id"):
            names += [[x.lower() for x in WORDS.findall(v)] for v in value.split()]
    if tag in ("html", "body", "main"):
        return STAYS
    named = max((_named(n) for n in names if n and n[0] not in REMARKS), default=STAYS)
    # An article element is only what readers wrote, or a doubt to its neighbours.
    return named if tag not in KEPT_TAGS or any(x in ("comment", "comments") for n in names for x in n[-1:]) else STAYS


def _named(words: list[str]) -> int:
    words = [x for x in words if not x.isdigit()]
    doubt = any(DOUBTFUL.match(x) for x in words)
    own = [x for x in words if x not in HOLDERS]
    if doubt and len(own) > 1 and all(DOUBTFUL.match(x) or WEAK.match(x) or x in COMPANY for x in own):
        return GOES
    while len(words) > 1 and (words[-1] in HOLDERS):
        words = words[:-1]
    if words and (WEAK.match(words[-1]) or SURE.match(words[-1])):
        return GOES
    return DOUBT if doubt else STAYS


class _Page:
    """Nodes as parallel lists, parents first; blocks in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.out, self.head, self.doubt, self.controls = [-1], ["#page"], [False], [False], [False], [0]
        self.other: set[int] = set()  # article elements with the name of an aside
        self.blocks: list[tuple[str, int, int]] = []  # text, link characters, owner
        self.home = [0]  # the node that owns text standing directly in each node
        self.stack = [0]
        self.opened: Counter[str] = Counter()  # open block elements by tag
        self.inline: list[Counter[str]] = [Counter()]  # open inline elements by tag, for each open block
        self.run: list[str] = []
        self.linked = self.links = 0
        self.owner = 0
        at, low = 0, None
        while at < len(source):
            m = TOKEN.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.close(tag)
                continue
            if tag in CONTROLS:
                self.controls[self.stack[-1]] += 1
            if tag in RAW:
                low = low if low is not None else source.lower()
                if len(low) != len(source):  # letters whose lower case is longer
                    low = "".join(c.lower() if c < "\x80" else c for c in source)
                end = low.find(f"</{tag}", at)
                if not m[0].endswith("/>") or tag != "svg":
                    at = len(source) if end < 0 else end
                continue
            self.open(tag, m[3], m[0].endswith("/>"))
        self.flush()

    def text(self, s: str) -> None:
        s = html.unescape(s) if "&" in s else s
        self.run.append(s)
        if self.links:
            self.linked += len(s)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((text, min(self.linked, len(text)), self.owner))
            self.run, self.linked = [], 0

    def open(self, tag: str, attrs: str, empty: bool) -> None:
        if tag == "br" or tag in CELLS:
            self.run.append(" ")
        if self.tag[self.stack[-1]] == "head" and tag not in IN_HEAD:
            self.close("head")
        if tag in BLOCK:
            self.flush()
            if tag not in ("html", "body"):
                self.up_to(("p",), BOUNDS | {"li", "dd"})
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self.pop()
        if tag in CLOSES:
            self.up_to(CLOSES[tag], BOUNDS - CELLS if tag in CELLS or tag == "tr" else BOUNDS)
        if tag in VOID:
            return
        top = self.stack[-1]
        self.parent.append(top)
        self.tag.append(tag)
        said, block = _aside(tag, attrs), tag in BLOCK or tag in CELLS
        self.out.append(self.out[top] or said == GOES)
        self.doubt.append(said == DOUBT and block)
        self.controls.append(0)
        self.head.append(self.head[top] or tag == "header")
        node = len(self.tag) - 1
        self.home.append(node if block or self.out[-1] else self.home[top])
        if tag == "article" and _aside("section", attrs):
            self.other.add(node)
        self.stack.append(node)
        self.links += tag == "a"
        if block:
            self.opened[tag] += 1
            self.inline.append(Counter())
            self.owner = node
        else:
            self.inline[-1][tag] += 1
            if self.out[-1] != self.out[top]:  # an inline advert is a block of its own
                self.flush()
                self.owner = node

    def up_to(self, tags: tuple[str, ...], bounds: frozenset[str]) -> None:
        """Close the nearest of the tags that is open within the bounds."""
        if not any(self.opened[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[i]]
            if own in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if own in bounds:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        # Inline ends don't close blocks.
        if not (self.opened if tag in BLOCK or tag in CELLS else self.inline[-1])[tag]:
            return
        while self.tag[self.stack[-1]] != tag:
            self.pop()
        self.pop()

    def pop(self) -> None:
        node = self.stack.pop()
        tag = self.tag[node]
        self.links -= tag == "a"
        if tag in BLOCK or tag in CELLS:
            self.opened[tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        if tag in BLOCK or tag in CELLS or self.owner == node:
            if tag not in CELLS:
                self.flush()
            else:
                self.run.append(" ")
            self.owner = self.home[self.stack[-1]]


def _sums(page: _Page, values: list[int]) -> list[int]:
    """Of each node, with all below it."""
    for i in range(len(values) - 1, 0, -1):
        values[page.parent[i]] += values[i]
    return values


def _settle(page: _Page) -> None:
    """What is doubtful by name goes by its content."""
    if not any(page.doubt):
        return
    chars, linked = [0] * len(page.tag), [0] * len(page.tag)
    for text, links, owner in page.blocks:
        if not page.out[owner]:
            chars[owner] += len(text)
            linked[owner] += links
    chars, linked, controls = (_sums(page, x) for x in (chars, linked, page.controls))
    for i, doubt in enumerate(page.doubt):
        if doubt:
            part = page.tag[i] in LEAVES or page.tag[i] in ("tr", "tbody", "thead", "tfoot")
            page.out[i] |= linked[i] > 0 and linked[i] >= DOUBTFUL_LINKS * chars[i] or not part and (controls[i] > 0 or chars[i] < DOUBTFUL_CHARS)
        page.out[i] |= i > 0 and page.out[page.parent[i]]


def main_text(source: str | None) -> str:
    page = _Page(source or "")
    _settle(page)
    n = len(page.tag)
    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    blocks = [b for b in page.blocks if not page.out[b[2]] and (not page.head[b[2]] or page.tag[b[2]] in HEADINGS)]
    for text, links, owner in blocks:
        chars[owner] += len(text)
        linked[owner] += links
        gain = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - links / len(text))
        node, level = page.parent[owner] if page.tag[owner] in LEAVES else owner, 0
        while node >= 0 and level < 5:
            points[node] += gain / (1, 2, 6, 9, 12)[level]
            node, level = page.parent[node], level + 1
    chars, linked = _sums(page, chars), _sums(page, linked)
    score = [p * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i, p in enumerate(points)]
    if not blocks:
        return ""
    best = max(range(n), key=lambda i: (score[i], -i))
    node, enclosed = best, False
    while node > 0:
        if page.tag[node] in ("article", "main"):
            best, enclosed = node, True
            if page.tag[node] == "article":
                break
        node = page.parent[node]
    kept = [False] * n
    around = [False] * n  # the nodes around the best one, where nothing says what the article is
    whole = page.tag[best] in OUTERMOST
    node = -1 if enclosed else best if whole else page.parent[best]
    while node >= 0:
        around[node], node = True, page.parent[node]
    for i in range(n):
        near = page.parent[i] == page.parent[best] and page.tag[best] != "body" and best > 0
        plain = near and page.tag[i] in ("p", "pre", "blockquote") and chars[i] > 80 and linked[i] < 0.25 * chars[i]
        part = near and page.tag[i] == page.tag[best] == "article" and i not in page.other
        beside = i > 0 and not around[i] and around[page.parent[i]] and i not in page.other and linked[i] < LINKS * chars[i]
        kept[i] = (i == best and not around[i]) or (i > 0 and kept[page.parent[i]]) or plain or part or beside or (near and score[i] > 0 and score[i] >= 0.2 * score[best])
    return "\n\n".join(text for text, links, owner in blocks if kept[owner] or around[owner] and links < LINKS * len(text))


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """pages with the column name added (or replaced): the main text of each page."""
    run = F.pandas_udf(lambda s: pd.Series([main_text(x) for x in s], dtype=object), "string")
    return pages.withColumn(name, run(F.col(source)))
