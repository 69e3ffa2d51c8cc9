"""A small, forgiving reader of HTML: block nodes, their attribute words and their texts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Possessive, so a tag that never ends is scanned once; the second pattern does not look at quotes.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
BLIND_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# Fixed values of the HTML standard and of common page vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img input object canvas svg g text tspan path audio video picture output meter progress "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics annotation".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY = {
    "li": frozenset(["li"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
}
LIMITS = frozenset("table ul ol dl div section article main body html td th form aside nav header footer".split())
WORDS = {
    "main": "article content post entry story main maintext bodytext articlebody".split(),
    "menu": "nav menu breadcrumb pager pagination toc navigation navbar sitemap skip".split(),
    "head": "header masthead banner logo branding topbar".split(),
    "foot": "footer foot copyright colophon bottom legal".split(),
    "side": "sidebar side aside widget rail complementary".split(),
    "notice": "cookie consent notice gdpr alert modal popup dialog privacy overlay banner toast".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle dfp advertorial".split(),
    "form": "form search login subscribe newsletter signup contact register".split(),
    "comment": "comment comments commentlist disqus reply respond replies discussion reviews thread".split(),
    "social": "share sharing social related recommend recommended tags follow trending".split(),
}
GROUPS = tuple(WORDS)


@lru_cache(maxsize=20_000)
def attribute_groups(text: str) -> frozenset[str]:
    """Which word groups the class, id and role of a tag belong to."""
    values = " ".join(ATTRIBUTE.findall(text))
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", values).lower()))
    return frozenset(g for g, known in WORDS.items() if any(w in words or w + "s" in words for w in known))


@dataclass
class Page:
    """Block nodes in page order; a parent comes before its children. Node 0 is the page itself."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])
    link_chars: list[int] = field(default_factory=lambda: [0])
    inline_tags: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.attributes.append(attributes)
        self.text.append("")
        self.link_chars.append(0)
        self.inline_tags.append(0)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """Blocks of a page. Text that stands beside block children becomes a block ``#text`` of its own.

    Only scripts, styles, titles and text areas are skipped up to their end tag; every other element is a node. A page
    takes time in proportion to its length, whatever its tags and quotes look like.
    """
    page = Page()
    stack: list[tuple[str, int]] = [("#page", 0)]  # open tags; inline ones share their block's node
    opened: dict[str, int] = {}
    pieces: list[str] = []
    links = tags = 0
    at = 0

    def flush() -> None:
        """End the current run of text: it is the content of a new anonymous block."""
        nonlocal links, tags
        joined = " ".join("".join(pieces).split())
        pieces.clear()
        if joined:
            node = page.add("#text", stack[-1][1], "")
            page.text[node], page.link_chars[node], page.inline_tags[node] = joined, min(links, len(joined)), tags
        links = tags = 0

    def words(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text)
            pieces.append(text)
            if opened.get("a"):
                links += len(text)

    def pop(name: str) -> None:
        while len(stack) > 1:
            top, _ = stack.pop()
            opened[top] -= 1
            if top == name:
                return

    def within(names: frozenset[str], limits: frozenset[str]) -> str | None:
        """The innermost open tag of ``names`` that no limit separates from here."""
        if not any(opened.get(n) for n in names):
            return None
        for top, _ in reversed(stack):
            if top in names:
                return top
            if top in limits:
                return None
        return None

    # Scanned forwards only: each step ends at a place that is never looked at again.
    last, tag = source.rfind(">"), TAG
    while (begin := source.find("<", at)) >= 0:
        follow = source[begin + 1 : begin + 2]
        if follow in ("!", "?"):
            words(source[at:begin])
            comment = source.startswith("<!--", begin)
            end = source.find("-->", begin + 4) if comment else source.find(">", begin)
            at = len(source) if end < 0 else end + (3 if comment else 1)
            continue
        if begin > last:
            break
        m = tag.match(source, begin)
        if m is None and tag is TAG and BLIND_TAG.match(source, begin):
            # A quote that never ends: from here on quotes mean nothing.
            tag = BLIND_TAG
            m = tag.match(source, begin)
        if m is None:
            words(source[at : begin + 1])
            at = begin + 1
            continue
        words(source[at:begin])
        at = m.end()
        name = m[2]
        name = name.lower()
        block = name not in INLINE
        if m[1]:
            if name == "br":
                pieces.append(" ")
            elif opened.get(name):
                if block:
                    flush()
                pop(name)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = RAW_END[name].search(source, at)
                at = end.end() if end else len(source)
            continue
        if name in VOID or m[3].endswith("/") and name not in ("p", "div"):
            if name in ("br", "hr"):
                pieces.append(" ")
            continue
        if not block:
            tags += 1
            stack.append((name, stack[-1][1]))
            opened[name] = opened.get(name, 0) + 1
            continue
        flush()
        if name in CLOSES_P and (found := within(frozenset(["p"]), LIMITS)):
            pop(found)
        if name in CLOSED_BY and (found := within(CLOSED_BY[name], LIMITS - CLOSED_BY[name])):
            pop(found)
        stack.append((name, page.add(name, stack[-1][1], m[3])))
        opened[name] = opened.get(name, 0) + 1
    words(source[at:])
    flush()
    return page
