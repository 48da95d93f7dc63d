"""Elements of pages by selectors, against a tree walk; deep and broken markup."""

import random
import time
from html.parser import HTMLParser

import pytest

from tarifa.sources import landed
from tarifa.sources.markup import _HIDDEN, _VOID, Page, Selectors

SELECTORS = ("a", "li", ".x", ".y", "[k]", "b.x", "li a", "ul .x", "ul li .y", "[k] b.x", "script")


class Tree(HTMLParser):
    """The plain way: a list of elements with parents, and every selector tried on every element."""

    def __init__(self, html):
        super().__init__()
        self.nodes, self.at, self.pending, self.texts = [], None, "", []
        self.feed(html)
        self.close()
        self.cut()

    def cut(self):
        if self.pending.strip():
            self.texts.append((self.at, self.pending.strip()))
        self.pending = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.nodes.append((tag, dict(attrs), self.at))
        if tag not in _VOID:
            self.at = len(self.nodes) - 1

    def above(self, n):
        while n is not None:
            yield n
            n = self.nodes[n][2]

    def handle_endtag(self, tag):
        self.cut()
        found = next((n for n in self.above(self.at) if self.nodes[n][0] == tag), None)
        if found is not None:
            self.at = self.nodes[found][2]

    def handle_comment(self, data):
        self.cut()

    def handle_data(self, data):
        if self.at is None or self.nodes[self.at][0] not in _HIDDEN:
            self.pending += data

    def fits(self, n, selector):
        *outer, inner = selector.split(" ")
        tag, attrs, parent = self.nodes[n]
        need, _, name = inner.partition(".")
        own = inner[1:-1] in attrs if inner[0] == "[" else (not need or need == tag) and (not name or name in (attrs.get("class") or "").split())
        return own and (not outer or any(self.fits(m, " ".join(outer)) for m in self.above(parent)))

    def text(self, n):
        return "".join(t for at, t in self.texts if n in self.above(at))


def pages(seed, n):
    r = random.Random(seed)
    part = lambda: r.choice(["<ul>", "</ul>", "<li>", "</li>", "<a class='x'>", "</a>", "<b class='x y' k=1>", "<b class=x>", "</b>", "<p k>", "</p>", "<img k class=y>", "<br/>", "text", " two words ", "&amp;", "<!-- c -->", "<script>if (a<b) </script>", "<", "<style>p</style>", "<div class='y x y'>", "</div>", "</zz>"])
    return ["".join(part() for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_elements_are_those_of_a_tree_walk():
    for html in pages(3, 400):
        page, tree = Page(html, Selectors(SELECTORS)), Tree(html)
        for selector in SELECTORS:
            found = [n for n in range(len(tree.nodes)) if tree.fits(n, selector)]
            assert page.hits.get(selector, []) == found, (html, selector)
            for n in found:
                assert page.text(n) == tree.text(n), html
                inside = [m for m in range(len(tree.nodes)) if m != n and n in tree.above(m) and tree.fits(m, "li a")]
                assert page.inside(n, "li a") == (inside[0] if inside else None)
        outer = [n for n in range(len(tree.nodes)) if tree.fits(n, "li") and not any(tree.fits(m, "li") for m in tree.above(tree.nodes[n][2]))]
        assert page.all(["li"]) == outer


@pytest.mark.parametrize("html", ["<li class=product-item>" * 100_000, "<div>" * 50_000 + "</span>" * 50_000, "<ul><li>" * 50_000 + "x", "<" * 20_000, None, ""])
def test_deep_and_broken_pages_take_time_in_proportion(html):
    began = time.time()
    landed.signed_in_cards(html)
    if html is None or not html.startswith("<li class"):
        landed.cards(html)
    assert time.time() - began < 20


def test_cards_of_deep_pages_and_by_platform(spark):
    deep = "<li>" * 10_000 + "".join(f'<div class="product-card"><h3>n{i}</h3><i class="price">{i}</i></div>' for i in range(5))
    both = "".join(f'<div class="product-card"><h3>shopify {i}</h3><b class="product-card__title">salla {i}</b><i class="price">9</i><del>{i}</del><img class="product-card__image"><p class="product-image"><img data-src="d{i}"></p></div>' for i in range(3))
    frame = spark.createDataFrame([(1, deep, None), (2, both, "ZID"), (3, both, None), (4, None, "salla")], "page_id long, html string, platform string")
    got = [tuple(r) for r in landed.page_cards(frame).orderBy("page_id", "name").collect()]
    assert [g[:3] for g in got if g[0] == 1] == [(1, f"n{i}", float(i)) for i in range(5)]
    assert [g[1] for g in got if g[0] == 2] == [f"shopify {i}" for i in range(3)] and [g[1] for g in got if g[0] == 3] == [f"salla {i}" for i in range(3)]
    assert {(g[3], g[4], g[5]) for g in got if g[0] == 3} == {(9.0, None, f"d{i}") for i in range(3)}
    assert not [g for g in got if g[0] == 4]
