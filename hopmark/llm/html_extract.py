"""HTML extraction: flat text blocks classified by a decision tree (operator 3).

A page is cut into flat blocks at its block-level tags. A block is described by its words and link density, those of its
neighbours, and what its open elements say. A small labelled table trains the tree (training_table()); blocks that it calls
content are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopmark.llm.common import bounded_batches, tidy

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

#: Elements whose contents are no text of the page.
SKIPPED = frozenset("script style noscript template svg iframe object canvas audio video select option textarea button head title datalist annotation".split())
#: Inline elements, which do not cut a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br input picture source math mi mo mn ms mtext mrow msup msub mfrac msqrt semantics".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that mark what surrounds an article.
AROUND = frozenset("nav footer aside form header menu dialog".split())
#: Words that mark it in a class, id or role: as the whole name or its last word (top-menu), or as the first before a HOLDER (ad-box).
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disclaimer disqus footer form header masthead menu menubar modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget alert adsbygoogle login".split()
)
#: Words that only say that something is held.
HOLDERS = frozenset("area bar block box body buttons col column container content group holder icons inner item items link links list panel posts section slot strip thread unit wrap wrapper".split())
#: Elements that hold an article, and names as whole that do.
WITHIN = frozenset("article main".split())
WITHIN_NAMES = frozenset("main articlebody".split())
#: A name that begins so says what an element has beside it; one that begins so and ends in header is the article's own.
BESIDE = ("has", "with", "no", "without")
OWN_HEADER = frozenset("article content entry page post section story".split())
_PARTS = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "around", "within")


def surrounds(name: str) -> bool:
    """Whether a name of a class, id or role says that its element surrounds the article."""
    parts = [x.lower() for x in _PARTS.split(name) if x]
    if not parts or len(parts) > 1 and (parts[0] in BESIDE or parts[-1] in ("header", "banner") and parts[0] in OWN_HEADER):
        return False
    return parts[-1] in AROUND_NAMES or parts[0] in AROUND_NAMES and all(x in HOLDERS or x in AROUND_NAMES for x in parts[1:])


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes by name in lower case; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    around: bool
    within: bool


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, around, within
    parts: list[str] = []
    linked: list[str] = []
    link = -1  # open elements where the open link began, or -1

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                around, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append(Block(text, len(text.split()), len(html.unescape("".join(linked)).split()), around, within))
            parts.clear()
            linked.clear()

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            parts.append(page[at:stop])
            if link >= 0:
                linked.append(page[at:stop])
        if tag is None:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:  # end tag
            if name == "a":
                link = -1
                linked.append(" ")
            if name not in INLINE:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if len(stack) < link:  # the element that the link is in has ended
                    link = -1
            continue
        attributes = attributes_of(tag[3]) if tag[3] else {}
        hidden = bool(attributes) and is_hidden(attributes)
        if name in SKIPPED or hidden and name not in VOID:
            if name not in INLINE:
                flush()
            if not (name == "svg" and re.search(r"(?:^|[\s\"'])/$", tag[3])):
                at = _after(page, at, name)
            continue
        if name == "a":
            link = len(stack) if "href" in attributes else -1
        if name == "br" or name == "hr":
            parts.append(" ")
        if name in INLINE and name != "label":
            continue
        flush()
        if name in VOID or name == "label":
            continue
        outer = stack[-1] if stack else ("", False, False)
        names = [x for k in ("class", "id", "role") for x in attributes.get(k, "").split()] if attributes else []
        own = name in AROUND and not (name == "header" and outer[2]) or name not in ("html", "body", "article", "main") and any(map(surrounds, names))
        stack.append((name, outer[1] or own, outer[2] or name in WITHIN or any(x.lower() in WITHIN_NAMES for x in [*names, attributes.get("itemprop", "")])))
        if name in ("p", "li") and len(stack) > 1 and stack[-2][0] == name:  # the end tag was left out
            del stack[-2]
    flush()
    return out


def _after(page: str, at: int, name: str) -> int:
    """The place after the end tag that closes an element opened before `at`, nested ones of its name included."""
    depth = 1
    nests = name not in ("script", "style", "textarea", "title", "noscript", "iframe")
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else nests
        if not depth:
            return m.end()
    return len(page)


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; where there is no neighbour, its values are 0."""
    own = np.array([(b.words, b.linked / b.words if b.words else 0.0) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    flags = np.array([(b.around, b.within) for b in found], float).reshape(-1, 2)
    return np.column_stack([own, before[: len(own)], after[: len(own)], flags])


class Tree(NamedTuple):
    """A node: rows with feature <= threshold go left. A leaf has feature -1 and its class in `content`."""

    feature: int
    threshold: float
    left: Tree | None
    right: Tree | None
    content: bool

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.content)
        out, low = np.empty(len(x), bool), x[:, self.feature] <= self.threshold
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A tree by the Gini index; among equal cuts, the first feature and the lowest threshold."""
    best = (float(y.mean() * (1 - y.mean())) - 1e-9, -1, 0.0)
    if depth and 0 < y.sum() < len(y):
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) >= least:
                    score = sum(s.mean() * float(y[s].mean() * (1 - y[s].mean())) for s in (low, ~low))
                    if score < best[0] - 1e-12:
                        best = (score, f, float(t))
    _, f, t = best
    if f < 0:
        return Tree(-1, 0.0, None, None, bool(y.mean() > 0.5))
    low = x[:, f] <= t
    return Tree(f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least), False)


_PROSE = "the tide came in before noon and the boats lay quiet along the wall while the crew ate bread and talked of rain "
_LINK = '<a href="/x">{}</a>'


def _plain(tag: str, *texts: str, linked: bool = False) -> str:
    return "".join(f"<{tag}>{_LINK.format(t) if linked else t}</{tag}>" for t in texts)


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Small pages whose blocks carry a label in a leading + (content) or - (not): features and labels.

    Most pages have no element and no name that says what a block is, so their words, links and neighbours decide; the others
    teach what the two marks are worth."""
    long, mid, short = f"+{_PROSE * 3}", f"+{_PROSE}", "+It rained all night."
    story = _plain("p", long, mid, short, mid, long, short, short, mid)
    titled = _plain("h1", "+Rain again today") + story
    lists = _plain("p", mid) + "<ul>" + _plain("li", "+bread", "+rope", "+a lamp and oil") + "</ul>" + _plain("p", mid)
    cited = _plain("p", mid) + f"<p>+{_PROSE}{_LINK.format('see the old charts of the bay')}</p>" + _plain("p", long)
    source = _plain("p", mid) + _plain("p", "+the harbour chart of the old bay", linked=True) + _plain("p", mid)
    bar = _plain("div", "-Home", "-News of the day", "-Sport", "-About us and contact", linked=True)
    items = "<ul>" + _plain("li", "-start", "-shop", "-help and advice", linked=True) + "</ul>"
    crossed = "<div>" + " | ".join(_LINK.format(w) for w in ("-one", "two", "three", "four")) + "</div>"
    blocks_of_links = "".join(f'<a href="/y"><div>-{w}</div></a>' for w in ("older posts", "newer posts", "the whole site from a to z"))
    cards = "".join(_plain("h3", f"-{w}", linked=True) + _plain("p", "-3 min") for w in ("A boat is sold", "More rain to come", "Bread at noon"))
    tail = _plain("p", "-Terms", "-Imprint", linked=True) + _plain("p", "-All rights reserved.")
    nav, foot = f"<nav>{items}</nav>", f"<footer>{_plain('p', f'-&copy; The Harbour. {_PROSE * 2}')}</footer>"
    side = "<aside>" + _plain("h3", "-More to read") + _plain("p", f"-{_PROSE * 3}", f"-{_PROSE * 2}") + "</aside>"
    named = f"<div class='widget'>{_plain('p', f'-{_PROSE * 4}', '-Well said.')}</div>"
    rows = [
        bar + titled + tail,
        bar + crossed + story + cards + tail,
        items + _plain("div", long, short, mid, long) + items,
        crossed + titled + lists + blocks_of_links,
        blocks_of_links + _plain("h1", "+A") + cited + bar,
        cards + titled + cited + cards + tail,
        bar + lists + story + crossed,
        bar + items + source + story + blocks_of_links + tail,
        items + _plain("p", mid, mid) + tail,
        crossed + _plain("h2", "+At night in the bay") + _plain("p", short, long) + _plain("h2", "+Later") + _plain("p", short, short, mid) + bar,
        nav + f"<article>{titled}{source}</article>" + foot,
        nav + f"<article>{_plain('p', short)}{named}{lists}{foot}</article>" + side,
        bar + f"<main>{_plain('p', short, short)}{_plain('p', '+the bay', '+the old wall', linked=True)}</main>" + named + cards,
        nav + named + f"<article>{_plain('p', '+the harbour', '+a chart', linked=True)}</article>" + foot,
        "<article><p>+cut off</p></article>" + bar,
        nav + titled + side + foot,
        nav + f"<article>{_plain('h1', '+A')}{_plain('p', '+Rain.')}</article>" + foot,
        nav + f"<article>{_plain('p', '+Rain.', '+Wind and rain.')}</article>" + nav,
        nav + f"<article>{_plain('h1', '+The old wall')}{_plain('p', '+It rained.')}</article>" + foot,
        bar + f"<article>{_plain('h1', '+Two boats')}{_plain('h2', '+At the wall')}{_plain('p', mid)}</article>" + foot,
        cards + f"<article>{_plain('h1', '+A new day')}{_plain('p', '+So it was.')}{_plain('p', '+see the chart', linked=True)}</article>" + cards,
        nav + f"<main>{_plain('h1', '+Boats')}{_plain('p', '+None.')}</main>" + bar,
        _plain("li", "-a", linked=True) + _plain("p", "+Rain.") + _plain("p", "-tide", linked=True),
        _plain("li", "-b", "-c", linked=True) + _plain("p", "+Wind.") + _plain("p", "-sea", linked=True),
        crossed + _plain("h1", "+Boats") + _plain("div", mid, short, long) + bar,
        bar + crossed + _plain("h1", "+Bread and wine") + _plain("div", long, short, mid) + crossed,
        items + _plain("h1", "+Rope") + _plain("div", mid, short, long, mid) + bar,
        _plain("p", "+Rain."),
        _plain("p", short, mid),
        bar + _plain("p", long, "+It rained at " + _LINK.format("the wall") + " all night.", mid, "+The " + _LINK.format("old chart of the bay") + " shows where the wall once stood.", short, long) + tail,
        items + _plain("h1", "+Boats") + _plain("p", "+They left " + _LINK.format("the harbour") + " before noon.", long, "+See " + _LINK.format("the chart") + " of the bay for more.", mid) + cards,
    ]
    x, y = [], []
    for page in rows:
        found = blocks(page)
        x.append(features([b._replace(text=b.text[1:]) for b in found]))
        y += [b.text[0] == "+" for b in found]
    return np.concatenate(x), np.array(y)


def trained() -> Tree:
    return grow(*training_table())


def extract(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return " ".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text of the whole page), n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one space. Null, empty and textless pages give the empty text; unclosed tags, comments and scripts reach to the end
    of the page. One row for each row of the input, without a shuffle; the tree is trained once, on the driver.
    """
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, tree) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(df.sparkSession)
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
