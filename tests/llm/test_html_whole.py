"""Pages whose article is not one article element."""

import random
from html.parser import HTMLParser

import pytest

from graphweave.llm import html

BODY = "".join(f"<p>Sentence {i}, which is long enough, has commas, and tells the reader of this page something more.</p>" for i in range(12))


def test_parts_beside_the_body_stay():
    page = f"""<html><body><nav><a href=x>Home</a></nav><div class=post><h1>The title</h1><p>By Ann</p><div class=story>{BODY}</div>
<h2>Figures</h2><table><tr><td>one</td><td>1</td></tr></table><ul><li>short item</li></ul><section><p>The end.</p></section></div>
<div><a href=a>Other page</a> <a href=b>Yet another</a></div><aside>Side</aside><div class=related><p>See also</p></div><footer>Foot</footer></body></html>"""
    got = html.main_text(page)
    assert got.startswith("The title\n\nBy Ann\n\nSentence 0")
    for x in ("Sentence 11", "Figures", "one", "short item", "The end."):
        assert x in got
    for x in ("Home", "Other page", "Yet another", "Side", "See also", "Foot"):
        assert x not in got


def test_text_of_an_outer_container_stays():
    got = html.main_text(f"<body><h1>Title</h1>Loose words<div><div>{BODY}</div></div><p>Short close.</p><div><ul><li><a href=x>link one</a><li><a href=y>link two</a></ul></div></body>")
    assert got.startswith("Title\n\nLoose words\n\nSentence 0") and got.endswith("Short close.")


def test_sibling_articles_stay():
    page = f"<body><div><article><h1>One</h1>{BODY}</article><article><p>Part two.</p></article><article class=sponsored><p>Buy</p></article></div></body>"
    got = html.main_text(page)
    assert got.startswith("One") and got.endswith("Part two.")


LONG = "Here are three hundred characters of plain text, with commas, that belong to the article and hold neither a link nor a form, so that no name should take them away. " * 2
MEANT = [
    "market-share", "informed-consent", "related-work", "social-history", "socialism", "promotion-rules", "cookie-recipes", "subscription-terms", "sharing-economy", "recommendations", "adv",
    "responses", "comments-on-the-text", "shareholders", "replies", "share-price", "advances", "adverse-effects", "socialStudies", "ad-hoc-analysis", "cookie_recipes",
]


@pytest.mark.parametrize("name", MEANT)
def test_names_that_mean_something_else_keep_text(name):
    """Inside the best container, beside it, and as a page's only container; as class and as id."""
    for attr in ("class", "id"):
        own = f"<div {attr}='{name}'><p>{LONG}</p></div>"
        for page in (f"<body><article>{BODY}{own}</article></body>", f"<body><div>{BODY}{own}</div></body>", f"<body><div>{BODY}</div>{own}</body>", f"<body>{own}</body>"):
            assert LONG.strip() in html.main_text(page), page[:200]


@pytest.mark.parametrize("name", MEANT)
def test_no_name_cuts_a_sentence(name):
    got = html.main_text(f"<body><article>{BODY}<p>It costs <span class='{name}'>42 dollars</span> in <b id={name}>all</b> shops.</p></article></body>")
    assert got.endswith("It costs 42 dollars in all shops.")


@pytest.mark.parametrize("name", [
    "ad", "ads", "advert", "advertisement", "google-ad", "ad-slot", "ad-300", "sponsored", "sponsored-content", "sponsor-message", "promo", "cookie-consent", "cookie-notice", "cookies", "newsletter",
    "newsletter-signup", "subscribe-form", "share-buttons", "social-share", "social-links", "related-posts", "related-articles", "recommended-stories", "breadcrumbs", "comments", "comment", "comment-list",
    "user-comments", "article-comments", "commentList", "disqus-comments", "sidebar", "site-footer", "nav-menu", "masthead", "popup",
])
def test_names_of_adverts_menus_and_comments_still_go(name):
    for page in (f"<body><article>{BODY}<div class='{name}'><p>{LONG}</p></div></article></body>", f"<body><div>{BODY}</div><section id='{name}'>{LONG}</section></body>"):
        assert "three hundred" not in html.main_text(page)


@pytest.mark.parametrize("name", ["related", "share", "social", "recommendations", "responses", "market-share", "consent"])
def test_doubtful_elements_go_by_their_content(name):
    links = "".join(f"<a href={i}>An interesting story, number {i}, to read</a> " for i in range(6))
    for inner in (links, "See also", f"<p>{LONG}</p><input name=q><button>Go</button>", f"<ul><li>{links}</ul>"):
        got = html.main_text(f"<body><article>{BODY}<div class={name}>{inner}</div></article></body>")
        assert got.endswith("something more.") and "three hundred" not in got and "See also" not in got
    table = f"<table><tr class={name}><td class={name}>42 %</td><td>2020</td></tr></table><ul><li class={name}>short item</li></ul>"
    assert html.main_text(f"<body><article>{BODY}{table}</article></body>").endswith("42 % 2020\n\nshort item")


class Reader(HTMLParser):
    """A second reader of well-formed pages: the text of each paragraph and the names above it."""

    def __init__(self, page):
        super().__init__()
        self.above, self.found, self.words = [], [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.above.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag == "p":
            self.found.append((" ".join("".join(self.words).split()), [n for _, n in self.above]))
            self.words = []
        self.above.pop()

    def handle_data(self, data):
        if any(t == "p" for t, _ in self.above):
            self.words.append(data)


@pytest.mark.parametrize("seed", range(20))
def test_pages_read_twice(seed):
    """Random trees of named elements: exactly the paragraphs under no advert, menu or comment stay, in order."""
    r = random.Random(seed)
    count = iter(range(10_000))
    gone = ("ad", "comments", "sidebar", "share-buttons")

    def node(depth):
        if depth > 3 or r.random() < 0.4:
            inline = r.choice(("", f" <span class='{r.choice(MEANT)}'>and more</span>", " &amp; <b>so on</b>"))
            return f"<p class='{r.choice(MEANT)}'>Paragraph {next(count)}, {LONG}{inline}.</p>"
        name = r.choice([*gone, *MEANT[:6], "x"])
        return f"<{(t := r.choice(('div', 'section')))} class=\"{name}\">{''.join(node(depth + 1) for _ in range(r.randrange(1, 4)))}</{t}>"

    page = f"<html><body><article>{BODY}{''.join(node(0) for _ in range(6))}</article></body></html>"
    want = [t for t, names in Reader(page).found if not any(n in gone for n in names)]
    assert html.main_text(page).split("\n\n") == want
