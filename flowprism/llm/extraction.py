"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Each block node gets features of its subtree (text and link density, words, punctuation), its tag and
attribute words, those of its ancestors, its depth and its siblings. Boosted trees score whether a node holds
main text. Decoding picks the labels with the largest total score under one rule: below a rejected node
nothing is kept. So ancestors and descendants never contradict each other.

The trees are fitted on a bounded sample of the pages themselves (``max_pages`` with the smallest hash of the
id, each at most ``MAX_TRAINING_CHARS`` long). Pages that mark their article or main element label their own
nodes; their paragraphs are also put into layouts with other markup (sidebars, notices, forms, comments,
adverts), whose labels are known, so that the trees do not rest on one site's tags. Where no sampled page
marks its article, the layouts use the sample's longest blocks.

Pages are extracted one by one inside tasks, whole, without a shuffle. Null html gives the empty text;
broken markup is read as far as it goes, very long pages whole and in time that grows with their length; repeated rows give equal rows; a page without main text gives "".
"""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowprism.llm import boosting
from flowprism.llm.dom import GROUPS, Page, attribute_groups, parse

MAX_PAGES = 200
MAX_TRAINING_CHARS = 40_000
PAGES_PER_BATCH = 64

TAGS = ("article", "main", "section", "p", "div", "ul", "ol", "li", "table", "td", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "#text")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTSIDE_TAGS = frozenset("nav footer aside form dialog button select datalist option noscript template iframe".split())
BASE = (
    "depth", "children", "place", "siblings", "chars", "link_density", "words", "word_length", "stops", "commas", "inline", "blocks",
    "chars_per_block", "share", "before", "same_tag", "sibling_chars", "list_share", "heading", "heading_before", "in_article", "in_outside", "sign",
)
FEATURES = (*BASE, *(f"tag_{t}" for t in TAGS), *(f"own_{g}" for g in GROUPS), *(f"above_{g}" for g in GROUPS))


def node_features(page: Page) -> np.ndarray:
    """Nodes x FEATURES."""
    n = len(page.tag)
    own_chars = np.array([len(t) for t in page.text], np.float64)
    counts = np.array(
        [(len(t.split()), t.count(".") + t.count("!") + t.count("?"), t.count(","), 1.0) if t else (0.0, 0.0, 0.0, 0.0) for t in page.text], np.float64
    ).reshape(n, 4)
    table = np.column_stack([own_chars, np.array(page.link_chars, np.float64), np.array(page.inline_tags, np.float64), counts, [t == "li" for t in page.tag]]).astype(np.float64)
    parent = page.parent
    total = table.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    children = np.zeros(n)
    place = np.zeros(n)
    before = np.zeros(n)
    seen = 0.0
    same: dict[tuple[int, str], int] = {}
    last_child: dict[int, int] = {}
    heading_before = np.zeros(n)
    above: list[frozenset] = [frozenset()] * n
    own: list[frozenset] = [frozenset()] * n
    article, outside = np.zeros(n), np.zeros(n)
    for i in range(n):
        tag, p = page.tag[i], parent[i]
        own[i] = attribute_groups(page.attributes[i]) if page.attributes[i] else frozenset()
        before[i] = seen
        seen += own_chars[i]
        if p < 0:
            continue
        place[i] = children[p]
        children[p] += 1
        same[p, tag] = same.get((p, tag), 0) + 1
        left = last_child.get(p)
        heading_before[i] = left is not None and page.tag[left] in HEADINGS
        last_child[p] = i
        above[i] = above[p] | own[p] if own[p] else above[p]
        article[i] = article[p] or page.tag[p] in ("article", "main")
        outside[i] = outside[p] or page.tag[p] in OUTSIDE_TAGS
    up = np.maximum(np.array(parent), 0)
    chars, link, inline, words, stops, commas, blocks, items = total.T
    whole = max(chars[0], 1.0)
    siblings = children[up]
    columns = [
        np.array(page.depth), children, place, siblings, np.log1p(chars), link / np.maximum(chars, 1), np.log1p(words), chars / np.maximum(words, 1),
        stops / np.maximum(words, 1), commas / np.maximum(words, 1), inline / np.maximum(words, 1), np.log1p(blocks), np.log1p(chars / np.maximum(blocks, 1)),
        chars / whole, before / whole, np.array([same.get((parent[i], page.tag[i]), 1) for i in range(n)]) / np.maximum(siblings, 1),
        np.log1p(chars[up] / np.maximum(siblings, 1)), items / np.maximum(blocks, 1), np.array([t in HEADINGS for t in page.tag]), heading_before, article, outside,
        np.array(["©" in t for t in page.text]),
    ]
    flags = [[page.tag[i] == t for i in range(n)] for t in TAGS] + [[g in own[i] for i in range(n)] for g in GROUPS] + [[g in above[i] for i in range(n)] for g in GROUPS]
    return np.column_stack([*columns, *(np.array(f) for f in flags)]).astype(np.float64)


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """The best labels under which nothing below a rejected node is kept; one pass up, one down."""
    n = len(page.tag)
    weight = np.log1p(np.array([len(t) for t in page.text], np.float64)) + 0.5
    gain = (weight * np.clip(logit, -8, 8)).tolist()
    keep, drop = gain[:], [-g for g in gain]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    label = np.zeros(n, bool)
    for i in range(n):
        p = page.parent[i]
        label[i] = keep[i] > drop[i] if p < 0 else label[p] and keep[i] > drop[i]
    return label


def main_text(page: Page, label: np.ndarray) -> str:
    return " ".join(t for t, kept in zip(page.text, label, strict=True) if t and kept)


def own_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article: text inside it and outside any part that is none of it."""
    n = len(page.tag)
    inside, bad = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(1, n):
        p = page.parent[i]
        groups = attribute_groups(page.attributes[i]) if page.attributes[i] else frozenset()
        inside[i] = inside[p] or page.tag[i] in ("article", "main")
        bad[i] = bad[p] or page.tag[i] in OUTSIDE_TAGS or bool(groups - {"main"})
    if not inside.any():
        return None
    return _upward(page, inside & ~bad & np.array([bool(t) for t in page.text]))


def _upward(page: Page, label: np.ndarray) -> np.ndarray:
    """A node is positive when its subtree holds main text."""
    label = label.copy()
    for i in range(len(label) - 1, 0, -1):
        label[page.parent[i]] |= label[i]
    return label


#: Markup in which the layouts wrap each kind of part: opening and closing tags.
WRAPS = {
    "body": ["article", "main", 'div class="content"', 'div id="main-content"', 'section class="post-body"', 'div class="entry-content"', 'div role="main"', "div", 'td class="story"'],
    "menu": ["nav", 'ul class="menu"', 'div id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"', "ul"],
    "head": ["header", 'div class="site-header"', 'div id="masthead"', 'div class="top-bar logo"'],
    "side": ["aside", 'div class="sidebar"', 'div id="right-rail"', 'section class="widget"', 'div class="related-posts"', 'div class="social-share"'],
    "notice": ['div class="cookie-notice"', 'div id="consent-banner"', 'section role="dialog"', 'div class="alert"', 'div class="gdpr-popup"'],
    "advert": ['div class="ad"', 'div class="advertisement"', 'div id="sponsored"', 'div class="promo-box"', 'ins class="adsbygoogle"'],
    "form": ["form", 'form class="newsletter"', 'div class="search-box"', 'div id="login"'],
    "comment": ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div id="disqus_thread"', 'div class="reader-replies"'],
    "foot": ["footer", 'div class="footer"', 'div id="colophon"', 'div class="legal copyright"'],
}


def layout(rng: np.random.Generator, main: list[str], other: list[str], short: list[str]) -> str:
    """A page around some main blocks. Main blocks carry ``data-main``, which no feature reads."""

    def wrap(kind: str, inner: str) -> str:
        tag = WRAPS[kind][rng.integers(len(WRAPS[kind]))]
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    pick = lambda texts, low, high: [texts[rng.integers(len(texts))] for _ in range(rng.integers(low, high + 1))]
    quote = lambda texts: [html.escape(t, quote=False) for t in texts]
    links = lambda: "<ul>" + "".join(f'<li><a href="#">{t[:24]}</a></li>' for t in quote(pick(short, 3, 8))) + "</ul>"
    prose = lambda texts: "".join(f"<p>{t}</p>" for t in quote(texts))
    blocks = quote(main)
    head = f"<h1 data-main>{blocks[0][:80]}</h1>" if rng.random() < 0.7 else ""
    body = []
    for i, text in enumerate(blocks):
        kind = rng.random()
        name = "p" if kind < 0.8 else "blockquote" if kind < 0.86 else "li" if kind < 0.92 else "h2" if len(text) < 120 else "div"
        body.append(f"<{name} data-main>{text}</{name}>")
        if i and rng.random() < 0.12:
            inner = rng.choice(["advert", "side", "notice", "form"])
            body.append(wrap(str(inner), prose(pick(other, 1, 1)) if rng.random() < 0.5 else links()))
    say = lambda: prose(pick(other, 1, 5)) if rng.random() < 0.7 else "".join(f"<li><b>{t[:12]}</b><p>{t}</p></li>" for t in quote(pick(other, 2, 5)))
    parts = [wrap("body", head + "".join(body))]
    around = [("head", lambda: prose(pick(short, 1, 2))), ("menu", links), ("notice", lambda: prose(pick(short + other, 1, 2)) + "<button>OK</button>"), ("advert", lambda: prose(pick(other, 1, 1)))]
    parts = [wrap(k, f()) for k, f in around if rng.random() < 0.6] + parts
    after = [("advert", lambda: html.escape(pick(other, 1, 1)[0])), ("comment", say), ("side", links), ("side", lambda: prose(pick(other, 1, 3))), ("form", lambda: prose(pick(short, 1, 2)) + "<input>"), ("foot", lambda: html.escape(pick(short, 1, 1)[0]))]
    parts += [wrap(k, f()) for k, f in after if rng.random() < 0.6]
    inner = "".join(parts)
    if rng.random() < 0.4:
        inner = f'<div class="{rng.choice(["page", "wrapper", "container", "layout"])}">{inner}</div>'
    return f"<html><head><title>{blocks[0][:40]}</title></head><body>{inner}</body></html>"


def layout_labels(page: Page) -> np.ndarray:
    marked = np.zeros(len(page.tag), bool)
    for i in range(1, len(marked)):
        marked[i] = "data-main" in page.attributes[i] or marked[page.parent[i]]
    return _upward(page, marked & np.array([bool(t) for t in page.text]))


def fit_pages(sources: list[str], layouts: int = 3, seed: int = 5) -> boosting.Trees:
    """Trees from sampled pages and layouts around their paragraphs."""
    rng = np.random.default_rng(seed)
    pages = [parse(s) for s in sources]
    mains, others, shorts, x, y, w = [], [], ["Home", "About us", "Contact", "All rights reserved"], [], [], []
    filler = ["We use cookies on this site.", "Sign up for our letter today, it is free."]

    def learn(page: Page, label: np.ndarray) -> None:
        x.append(node_features(page))
        y.append(label)
        w.append(np.log1p(np.array([len(t) for t in page.text])) + 0.5)

    for page in pages:
        label = own_labels(page)
        if label is None:
            label = np.array([len(t) > 200 for t in page.text])
        else:
            learn(page, label)
        text = [t for t, good in zip(page.text, label, strict=True) if t and good]
        if text:
            mains.append(text[:40])
        shorts += [t for t, good in zip(page.text, label, strict=True) if t and not good and len(t) < 120][:6]
    # Comments and adverts read like other pages' prose.
    others = [t for text in mains for t in text[1:6]] + filler
    for text in mains:
        for _ in range(layouts):
            size = int(rng.integers(1, len(text) + 1))
            page = parse(layout(rng, text[:size], others, shorts))
            learn(page, layout_labels(page))
    if not x:
        page = parse(layout(rng, ["A first paragraph, of some words.", "A second one."], filler, shorts))
        learn(page, layout_labels(page))
    return boosting.fit(np.concatenate(x), np.concatenate(y).astype(np.float64), np.concatenate(w))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> boosting.Trees:
    fits = pages.where(F.col("html").isNotNull() & (F.octet_length("html") <= MAX_TRAINING_CHARS)).select("page_id")
    chosen = fits.distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages)
    rows = pages.join(F.broadcast(chosen), "page_id").where(F.octet_length("html") <= MAX_TRAINING_CHARS).select("page_id", "html")
    found = sorted(rows.limit(2 * max_pages).collect())
    return fit_pages([r["html"] for r in found])


def extract_page(source: str, trees: boosting.Trees) -> str:
    page = parse(source)
    return main_text(page, decode(page, trees.logit(node_features(page))))


def extract(pages: DataFrame, trees: boosting.Trees) -> DataFrame:
    """``pages`` with the column ``text``; other columns pass through, ``html`` leaves."""
    kept = [c for c in pages.columns if c not in ("html", "text")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string"])

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a in range(0, batch.num_rows, PAGES_PER_BATCH):
                rows = batch.slice(a, PAGES_PER_BATCH)
                read = [parse(source.as_py() or "") for source in rows.column(len(kept))]
                x = [node_features(page) for page in read]
                logits = np.split(trees.logit(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1])
                texts = [main_text(page, decode(page, s)) for page, s in zip(read, logits, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), pa.array(texts, pa.string())], names=[*kept, "text"])

    return pages.select(*kept, F.col("html").cast("string").alias("html")).mapInArrow(batches, schema)
