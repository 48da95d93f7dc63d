"""Elements of HTML pages by selectors: one pass over the tokens with a stack of what is open, for all selectors at once.

No tree is built and nothing recurses. A selector is a tag, .class, [attribute] or tag.class, or several of these in a row, each inside the one
before. What isn't closed ends with what holds it; an end tag of nothing that is open is passed over. Each token costs the depth that it closes,
and each element the selectors that its tag, classes and attributes name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text isn't shown.
_HIDDEN = frozenset(("script", "style"))


class Selectors:
    """Selectors prepared for a pass: by what an element must name, and what must be open around it."""

    def __init__(self, selectors: Iterable[str]):
        self.by_name: dict[tuple[str, str], list[tuple[str, str, str]]] = defaultdict(list)
        for selector in dict.fromkeys(selectors):
            self._add(selector)

    def _add(self, selector: str) -> None:
        outer, _, inner = selector.rpartition(" ")
        tag, _, name = inner.partition(".")
        key, tag = (("[", inner[1:-1]), "") if inner[0] == "[" else (((".", name), tag) if name else (("", tag), ""))
        if (selector, tag, outer) not in self.by_name[key]:
            self.by_name[key].append((selector, tag, outer))
            if outer:
                self._add(outer)


class Page(HTMLParser):
    """What selectors find on a page: elements are numbered as they open."""

    def __init__(self, html: str | None, selectors: Selectors):
        super().__init__()
        self.selectors = selectors
        self.hits: dict[str, list[int]] = defaultdict(list)
        self.attrs: dict[int, dict[str, str | None]] = {}
        self.ends: list[int] = []  # of each element, the number of the first one after it
        self.texts: list[str] = []
        self.spans: list[list[int]] = []  # of each element, its texts' places
        self._stack: list[tuple[int, str, list[str]]] = []
        self._open, self._around, self._pending = Counter(), Counter(), []
        self.feed(html or "")
        self.close()
        self._flush()
        while self._stack:
            self._pop()

    def _flush(self) -> None:
        text = "".join(self._pending).strip()
        self._pending.clear()
        if text:
            self.texts.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        own, number, by_name, found = dict(attrs), len(self.ends), self.selectors.by_name, []
        names = [("", tag), *((".", c) for c in dict.fromkeys((own.get("class") or "").split())), *(("[", a) for a in own)]
        for name in names:
            for selector, need, outer in by_name.get(name, ()):
                if (not need or need == tag) and (not outer or self._around[outer]):
                    found.append(selector)
                    self.hits[selector].append(number)
        if found:
            self.attrs[number] = own
        self.ends.append(number + 1)
        self.spans.append([len(self.texts), len(self.texts)])
        if tag not in _VOID:
            self._stack.append((number, tag, found))
            self._open[tag] += 1
            self._around.update(found)

    def _pop(self) -> str:
        number, tag, found = self._stack.pop()
        self.ends[number] = len(self.ends)
        self.spans[number][1] = len(self.texts)
        self._open[tag] -= 1
        self._around.subtract(found)
        return tag

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if self._open[tag] > 0:
            while self._pop() != tag:
                pass

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_data(self, data: str) -> None:
        if self._stack and self._stack[-1][1] in _HIDDEN:
            number = self._stack[-1][0]
            if number in self.attrs:  # a script that was asked for
                self.attrs[number]["#"] = (self.attrs[number].get("#") or "") + data
        else:
            self._pending.append(data)

    def inside(self, number: int, selector: str) -> int | None:
        """The first element inside one that the selector finds."""
        found = self.hits.get(selector, ())
        at = bisect_right(found, number)
        return found[at] if at < len(found) and found[at] < self.ends[number] else None

    def first(self, number: int, selectors: Iterable[str]) -> int | None:
        """What the first selector that finds anything inside an element finds first."""
        return next((n for s in selectors if (n := self.inside(number, s)) is not None), None)

    def text(self, number: int | None) -> str:
        """An element's texts, each stripped, in the order of the page; none for no element."""
        return "" if number is None else "".join(self.texts[slice(*self.spans[number])])

    def attribute(self, number: int, selectors: Iterable[str], names: Iterable[str]) -> str:
        """The first attribute with a value, by selector and name, of what the selectors find first inside an element."""
        for selector in selectors:
            found = self.inside(number, selector)
            if found is not None:
                for name in names:
                    if value := self.attrs[found].get(name):
                        return value
        return ""

    def all(self, selectors: Iterable[str]) -> list[int]:
        """All that any of the selectors find, but for what is inside another of them."""
        out, end = [], 0
        for n in sorted({n for s in selectors for n in self.hits.get(s, ())}):
            if n >= end:
                out.append(n)
                end = self.ends[n]
        return out
