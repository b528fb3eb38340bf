"""A small, tolerant HTML tree over the standard parser: enough to find elements and read their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
#: An opening tag ends an open element of these names, within the scope of its nearest listed container.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
} | dict.fromkeys("p div ul ol table section article header footer nav main aside h1 h2 h3 h4 form address".split(), ({"p"}, {"div", "section", "article", "body", "td", "li"}))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        """Text below, without that of scripts, styles and templates."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in SILENT:
                stack += reversed(c.children)

    def text(self, between: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return between.join(s for s in parts if s)

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def all(self, *tags: str, **attrs) -> list[Node]:
        """Elements below of one of the names (any, if none is given) that have the attributes; True: with any value."""
        wanted = [(k.replace("_", "-"), v) for k, v in attrs.items()]
        return [n for n in self.walk() if (not tags or n.tag in tags) and all(k in n.attrs if v is True else (n.attrs.get(k) or "") == v for k, v in wanted)]

    def first(self, *tags: str, **attrs) -> Node | None:
        return next(iter(self.all(*tags, **attrs)), None)

    def with_class(self, pattern: str, *tags: str) -> list[Node]:
        """Elements below with a class attribute that the pattern finds, in either case."""
        return [n for n in self.walk() if (not tags or n.tag in tags) and n.attrs.get("class") and re.search(pattern, n.attrs["class"], re.IGNORECASE)]

    def select(self, selector: str) -> list[Node]:
        """Elements below that fit one of the comma-separated chains of tag, .class and [attribute] steps."""
        chains = [[_step(s) for s in chain.split()] for chain in selector.split(",")]
        return [n for n in self.walk() if any(_fits(n, chain, self) for chain in chains)]


def _step(text: str) -> tuple[str, list[str], list[str]]:
    return re.match(r"[a-zA-Z0-9]*", text)[0], re.findall(r"\.([\w-]+)", text), re.findall(r"\[([\w-]+)\]", text)


def _fits(n: Node, chain: list, root: Node) -> bool:
    tag, classes, attrs = chain[-1]
    if (tag and n.tag != tag) or any(c not in n.classes() for c in classes) or any(a not in n.attrs for a in attrs):
        return False
    if len(chain) == 1:
        return True
    up = n.parent
    while up is not None and up is not root.parent:
        if _fits(up, chain[:-1], root):
            return True
        up = up.parent
    return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, within = ENDS.get(tag, (set(), set()))
        n = self.at
        while n.parent is not None and n.tag not in within:
            if n.tag in ends:
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
