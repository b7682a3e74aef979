"""HTML extraction against a plain recursive scorer that is given the tree itself, not its markup."""

import random
import time

import pytest

from graphweave.llm import html

BREAKS = {"p", "li", "ul", "h2", "div", "section", "blockquote", "article", "body", "nav", "#page"}
LEAVES = {"p", "li", "h2", "blockquote"}


def element(tag, *parts, **attrs):
    return {"tag": tag, "parts": list(parts), "attrs": attrs}


class Generator:
    """Random pages: the tree, and markup that leaves out what HTML lets one leave out."""

    def __init__(self, seed):
        self.r = random.Random(seed)
        self.n = 0

    def words(self, most):
        self.n += 1
        return f"t{self.n} " + " ".join(self.r.choice(("ant", "bee,", "cow", "dog,", "elk")) for _ in range(self.r.randrange(most)))

    def inline(self, most):
        parts = [self.words(most)]
        if self.r.random() < 0.3:
            parts.append(element(self.r.choice(("b", "span", "a")), self.words(6)))
            if self.r.random() < 0.5:
                parts.append(self.words(5))
        return parts

    def block(self, depth):
        kind = self.r.choice(("p", "p", "p", "h2", "ul", "div", "section", "blockquote", "nav", "links"))
        if depth > 3 and kind in ("div", "section"):
            kind = "p"
        if kind in ("p", "blockquote"):
            return element(kind, *self.inline(60))
        if kind == "h2":
            return element("h2", self.words(5))
        if kind == "ul":
            return element("ul", *[element("li", *self.inline(8)) for _ in range(self.r.randrange(1, 4))])
        if kind == "links":
            return element("ul", *[element("li", element("a", self.words(4))) for _ in range(self.r.randrange(1, 4))])
        if kind == "nav":
            return element("nav", element("p", self.words(8)))
        own = [self.words(9)] if self.r.random() < 0.2 else []
        return element(kind, *own, *[self.block(depth + 1) for _ in range(self.r.randrange(1, 5))])

    def page(self):
        blocks = [self.block(0) for _ in range(self.r.randrange(1, 7))]
        shape = self.r.choice(("bare", "body", "article", "two"))
        if shape == "bare":
            return element("#page", *blocks)
        if shape == "body":
            return element("#page", element("body", *blocks))
        if shape == "article":
            return element("#page", element("body", element("nav", element("p", self.words(5))), element("article", *blocks)))
        return element("#page", element("div", element("article", *blocks), element("article", element("p", self.words(9)))))

    def markup(self, node, last=True):
        if isinstance(node, str):
            return node
        tag = node["tag"]
        parts = node["parts"]
        inner = "".join(self.markup(x, i + 1 == len(parts)) for i, x in enumerate(parts))
        if tag == "#page":
            return self.r.choice(("", "<!DOCTYPE html>\n", "<!-- a page -->")) + inner
        if tag == "body" and self.r.random() < 0.5:
            return f"<html><head><title>no</title></head><body>{inner}"
        # p and li end where the next block begins; a stray inline end, or an inline element left open at the end of a block, changes nothing.
        end = f"</{tag}>" if tag not in ("p", "li") or last or self.r.random() < 0.5 else ""
        if tag in LEAVES and tag != "h2" and self.r.random() < 0.2:
            inner += "</i>"
        if tag in ("b", "span") and last and self.r.random() < 0.4:
            end = ""
        return f"<{tag}>{inner}{end}"


def blocks_of(node, path, linked, out):
    """Runs of text between block borders: [path of the owner, text, characters of links]."""
    path = [*path, node]
    if node["tag"] in BREAKS:
        out.append([path, "", 0])
    for part in node["parts"]:
        if isinstance(part, str):
            out[-1][1] += part
            out[-1][2] += len(part) if linked else 0
        else:
            blocks_of(part, path, linked or part["tag"] == "a", out)
            if part["tag"] in BREAKS:
                out.append([path, "", 0])
    return out


def brute_text(page):
    got = []
    for path, text, links in blocks_of(page, [], False, []):
        text = " ".join(text.split())
        if text and not any(x["tag"] == "nav" for x in path):
            while path[-1]["tag"] not in BREAKS:
                path = path[:-1]
            got.append((path, text, min(links, len(text))))
    if not got:
        return ""
    under = lambda node: [b for b in got if any(x is node for x in b[0])]
    chars = lambda node: sum(len(t) for _, t, _ in under(node))
    links = lambda node: sum(n for _, _, n in under(node))

    def points(node):
        total = 0.0
        for path, text, n in got:
            ups = path[::-1][1:] if path[-1]["tag"] in LEAVES else path[::-1]
            level = next((i for i, x in enumerate(ups) if x is node), None)
            if level is not None and level < 5:
                total += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - n / len(text)) / (1, 2, 6, 9, 12)[level]
        return total * (1 - links(node) / chars(node)) if chars(node) else 0.0

    order, parent = [], {}

    def walk(node, above):
        order.append(node)
        parent[id(node)] = above
        for x in node["parts"]:
            if not isinstance(x, str):
                walk(x, node)

    walk(page, None)
    best = order[0]
    for node in order:
        if points(node) > points(best) + 1e-9:
            best = node
    top = points(best)
    line = [best]
    while parent[id(line[-1])]:
        line.append(parent[id(line[-1])])
    article = next((x for x in line if x["tag"] == "article"), None)
    best = article or best
    around = [] if article else [x for x in line if x is not best or best["tag"] in ("#page", "body")]
    siblings = parent[id(best)]["parts"] if parent[id(best)] and best["tag"] != "body" else []
    score = points(best) if article else top

    def kept(node):
        inside = [x for x in around if x is node]
        if node is best and not inside:
            return True
        above = parent[id(node)]
        if above is not None and kept(above):
            return True
        if any(x is node for x in siblings):
            plain = node["tag"] in ("p", "blockquote") and chars(node) > 80 and links(node) < 0.25 * chars(node)
            if plain or node["tag"] == best["tag"] == "article" or points(node) > 0 and points(node) >= 0.2 * score:
                return True
        beside = above is not None and any(x is above for x in around) and not inside
        return beside and links(node) < 0.5 * chars(node)

    return "\n\n".join(t for path, t, n in got if kept(path[-1]) or any(x is path[-1] for x in around) and n < 0.5 * len(t))


@pytest.mark.parametrize("seed", range(8))
def test_pages_equal_the_recursive_scorer(seed):
    for i in range(60):
        g = Generator(1000 * seed + i)
        page = g.page()
        source = g.markup(page)
        assert html.main_text(source) == brute_text(page), source


def test_pages_without_html_or_body():
    assert html.main_text("<p>First</p><p>Second</p>") == "First\n\nSecond"
    assert html.main_text("<!doctype html><title>t</title><h1>Head</h1><p>One</p><p>Two</p>") == "Head\n\nOne\n\nTwo"
    assert html.main_text("<p>I saw <b>x</b>y</p>") == "I saw xy"


@pytest.mark.parametrize("page", ["<p>a" + "<span>x</b>" * 20_000, "<div>" + "<span>" * 20_000 + "<p>t</p>" * 20_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000 + "end", "<blockquote>" * 20_000 + "<p>a" * 20_000])
def test_unmatched_tags_cost_no_walk(page):
    began = time.perf_counter()
    assert html.main_text(page)
    assert time.perf_counter() - began < 2
