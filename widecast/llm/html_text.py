"""Main text of web pages by scoring the element tree.

Paragraphs pass points for length and commas to the elements around them; an element's points are
discounted by its share of link text; the best container and those of its siblings that belong to the
text are kept. Parts that are never text (scripts, menus, forms ...) are left out beforehand.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from widecast.llm.common import pieces, small_batches, texts_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
LEFT_OUT = frozenset(
    "head nav header footer aside form button select option optgroup datalist fieldset dialog menu noscript template svg math canvas "
    "object applet audio video map".split()
) | RAW
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd figcaption caption address summary".split())
HOLDS_TEXT = frozenset("article main body html".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
IMPLIED_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner comment comments disqus respond replies "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup "
    "modal overlay share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager "
    "toolbar skip copyright".split()
)
ONLY_SAID = frozenset("with has no without is hide show".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_boilerplate(tag: str, attributes: str) -> bool:
    """Whether an element is never part of the text, by its name, class, id, role or being hidden."""
    if tag in LEFT_OUT:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return True
    if found.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or parts[0] in ONLY_SAID or tag in HOLDS_TEXT and not parts[-1].startswith("comment"):
            continue
        if parts[0] in BOILERPLATE or parts[-1] in BOILERPLATE:
            return True
    return False


#: A paragraph passes points to so many ancestors, the nth of them an nth.
REACH = 64


class Page:
    """Elements (parent, tag, left out) and, in page order, the blocks of text between block tags."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.out = [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.links: dict[int, int] = {}  # links that begin right inside an element
        self.at, self.link_depth, self.parts, self.link_size = 0, 0, [], 0
        self.standing: Counter[str] = Counter()  # open elements by tag
        place, lowered = 0, None
        while True:
            m = MARKUP.search(html, place)
            self.add(html[place : m.start()] if m else html[place:])
            if not m:
                break
            place = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
                continue
            unseen = tag in ("script", "style")  # stands inside a block without ending it
            if not unseen:
                self.open(tag, m[3] or m[6] or "")
            if tag in RAW:
                lowered = html.lower() if lowered is None else lowered
                if len(lowered) != len(html):  # a letter whose lower case is longer
                    lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
                end = lowered.find(f"</{tag}", place)
                place = len(html) if end < 0 else end
                if unseen and end >= 0:
                    place = html.find(">", end) + 1 or len(html)
        self.flush()

    def add(self, text: str) -> None:
        if text and not self.out[self.at]:
            text = unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.link_depth:
                self.link_size += len(text.strip())

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.at, text, min(self.link_size, len(text))))
        self.parts, self.link_size = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in INLINE and not (tag not in VOID and is_boilerplate(tag, attributes)):
            if tag == "a":
                self.link_depth = 1
                self.links[self.at] = self.links.get(self.at, 0) + 1
            elif tag == "br":
                self.add(" ")
            return
        self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_within({"p"}, {"article", "section", "div", "td", "th", "li", "body", "table"})
        if tag in IMPLIED_END:
            self.close_within(*IMPLIED_END[tag])
        if tag in ("body", "main", "article"):  # a head or menu that nobody closed ends here
            while self.at and self.out[self.at] and self.tag[self.at] in ("head", "title"):
                self.rise(self.parent[self.at])
        self.parent.append(self.at)
        self.standing[tag] += 1
        self.tag.append(tag)
        self.out.append(self.out[self.at] or is_boilerplate(tag, attributes))
        self.at = len(self.tag) - 1

    def rise(self, element: int) -> None:
        """Close all elements inside ``element``."""
        while self.at != element:
            self.standing[self.tag[self.at]] -= 1
            self.at = self.parent[self.at]

    def close_within(self, ends: set[str], fences: set[str]) -> None:
        if not any(self.standing[e] for e in ends):
            return
        i = self.at
        while i and self.tag[i] not in fences:
            if self.tag[i] in ends:
                self.rise(self.parent[i])
                return
            i = self.parent[i]

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if self.standing[tag]:
            self.flush()
            while self.tag[self.at] != tag:
                self.rise(self.parent[self.at])
            self.rise(self.parent[self.at])
            self.link_depth = 0
        elif tag not in INLINE:
            self.flush()

    def main_text(self) -> str:
        """The text of the best container and its siblings, one line for each block."""
        n = len(self.tag)
        passed, size, linked, links = [0.0] * n, [0] * n, [0] * n, [self.links.get(i, 0) for i in range(n)]
        for i, text, in_links in self.blocks:
            # A paragraph's points are its element's parent's to pass on.
            holder = self.parent[i] if self.tag[i] in LEAVES and i else i
            passed[holder] += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text))
            size[i] += len(text)
            linked[i] += in_links
        for i in range(n - 1, 0, -1):  # parents come first
            above = self.parent[i]
            size[above] += size[i]
            linked[above] += linked[i]
            links[above] += links[i]
        points = [0.0] * n
        for i, own in enumerate(passed):
            share = 1
            while own and i >= 0 and share <= REACH:
                points[i] += own / share
                i, share = self.parent[i], share + 1
        if not self.blocks:
            return ""
        score = [p * (1 - (linked[i] / size[i] if size[i] else 0)) for i, p in enumerate(points)]
        best = max(range(n), key=lambda i: (score[i], -i))
        i = best
        while i > 0:  # a text inside a marked article or main part is the whole of it
            if self.tag[i] in ("article", "main"):
                best = i
                break
            i = self.parent[i]
        kept = {best}
        above = self.parent[best]
        if above >= 0:
            inner = self.tag[above] not in ("", "html", "body")
            for i in range(n):
                if self.parent[i] == above and i != best and size[i]:
                    light = linked[i] < 0.5 * size[i]
                    if score[i] >= 0.2 * score[best] or inner and light or self.tag[i] in LEAVES and light and (size[i] >= 80 or self.tag[i] in ("h1", "h2")):
                        kept.add(i)
        for i in range(1, n):  # parents come first
            if self.parent[i] in kept and i not in kept and not (self.tag[i] in ("ul", "ol") and size[i] and linked[i] >= 0.8 * size[i] and links[i] >= 3):
                kept.add(i)
        return "\n".join(text for i, text, _ in self.blocks if i in kept)


def main_text(html: str) -> str:
    return Page(html).main_text()


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text``, ``n_chars``: main text of every page from its whole HTML.

    Null and empty pages, and pages without text outside of boilerplate, give an empty text. Broken
    markup is read as browsers do: missing ends are implied, unknown ones skipped, a cut tag is no text.
    One pass without a shuffle; repeated rows give repeated results.
    """
    small_batches(pages.sparkSession)
    own = "html_to_read"
    ready = pages.select(*[F.col(c) for c in keep], F.col(html).cast("string").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own):
            texts = [main_text(h) for h in texts_of(batch, own)]
            rest = batch.drop_columns([own])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest.schema.names, "text", "n_chars"])

    schema = ready.drop(own).withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("bigint")}).schema
    return ready.mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
