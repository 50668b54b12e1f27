"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from math import e, log

from pyspark.sql import DataFrame

from lumenshelf.llm.common import map_rows

#: Comments, declarations and tags. Where the rest of the page lacks the quote that ends an attribute, the tag ends at the next ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article main section div td body html".split())
CLOSES_P = BLOCK - {"body", "html", "head", "title", "option", "optgroup"}
#: An opening tag that ends an open element of these kinds, up to a border.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDER = frozenset("table ul ol dl div article section main body html select blockquote td th".split())

#: Elements that never hold the article, wherever they stand, and those that do not outside of it.
NOISE_TAGS = frozenset("head nav footer aside form button select input menu dialog object embed applet canvas audio video map annotation annotation-xml".split()) | RAW
NOISE_OUTSIDE = frozenset({"header"})
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class and id names that stand for noise, those that do outside of an article only, and those
#: that say nothing beside them. A name of such parts alone is noise; beside any other part ("related-work")
#: the element is only suspected, and its density decides.
NOISE_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors promo promos promotion promotions sidebar side-bar comment comments commentlist disqus respond reply replies"
    " cookie cookies consent gdpr notice notices alert alerts popup pop-up modal overlay newsletter subscribe signup login share sharing social related recommended widget widgets toolbar pagination pager"
    " breadcrumb breadcrumbs skip-link".split()
)
NOISE_PARTS_OUTSIDE = frozenset("menu menus nav navbar navigation topbar footer header masthead banner".split())
PLAIN_PARTS = frozenset(
    "area article articles bar block body bottom box button buttons card column container content end form group inner item items l left link links list main outer page panel placeholder post posts r right row"
    " section site slot stories story sub text thread title top unit wrap wrapper".split()
)
NAME_PART = re.compile(r"skip-link|side-?bar|pop-?up|[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A page's elements as parallel lists, parents before children; element 0 is the root."""

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.noise, self.suspect, self.inside, self.link = ["html"], [0], [False], [False], [False], [False]
        self.pieces: list[tuple[int, str]] = []  # element and text; an empty text ends a block
        self.stack = [0]
        #: Places in the stack of the open elements of each tag, and of those that end a search for siblings.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.borders: list[int] = []
        self.parse(html)
        self.weigh()

    def open(self, tag: str, attributes: str) -> int:
        up = self.stack[-1]
        inside = self.inside[up] or tag in ("article", "main")
        noise, suspect = (False, False) if tag in ("html", "body", "article", "main") else judged(tag, attributes, inside, self.by_name)
        noise = noise or self.noise[up]
        self.tag.append(tag)
        self.parent.append(up)
        self.noise.append(noise)
        self.suspect.append(suspect)
        self.inside.append(inside)
        self.link.append(self.link[up] or tag == "a")
        return len(self.tag) - 1

    def push(self, node: int) -> None:
        tag = self.tag[node]
        self.places[tag].append(len(self.stack))
        if tag in BORDER:
            self.borders.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, at: int) -> None:
        if any(self.tag[i] in BLOCK for i in self.stack[at:]):
            self.pieces.append((self.stack[at], ""))
        for i in self.stack[at:]:
            self.places[self.tag[i]].pop()
        while self.borders and self.borders[-1] >= at:
            self.borders.pop()
        del self.stack[at:]

    def last_open(self, tag: str) -> int:
        """Place of the last open element of the tag; zero if none is open."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def end_siblings(self, tag: str) -> None:
        at = max(map(self.last_open, SIBLINGS.get(tag, ())), default=0)
        if tag in CLOSES_P:
            at = max(at, self.last_open("p"))
        if at and (not self.borders or at >= self.borders[-1]):
            self.pop_to(at)

    def parse(self, html: str) -> None:
        at, raw = 0, ""
        for m in TOKEN.finditer(html):
            if m.start() < at:
                continue
            name = (m[2] or "").lower()
            if raw:  # only the end tag of a raw element counts inside it
                if not (m[1] and name == raw):
                    continue
                raw = ""
            elif m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if not name:
                continue
            if m[1]:
                if self.last_open(name):
                    self.pop_to(self.last_open(name))
                continue
            self.end_siblings(name)
            if name == "html" or name == "body" and self.last_open(name):
                continue
            node = self.open(name, m[3] or "")
            if name == "br":
                self.pieces.append((node, "\n"))
            if name in BLOCK:
                self.pieces.append((node, ""))
            if name not in VOID and not (m[3] or "").endswith("/"):
                self.push(node)
                raw = name if name in RAW else ""
        if not raw and at < len(html):
            self.text(html[at:])

    def text(self, text: str) -> None:
        node = self.stack[-1]
        if not self.noise[node]:
            self.pieces.append((node, unescape(text)))

    def weigh(self) -> None:
        """Characters, tags and those in links of each subtree; its density and the sum of its children's."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            size = len("".join(text.split())) if text else 0
            chars[node] += size
            if self.link[node]:
                link_chars[node] += size
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                link_chars[up] += link_chars[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body_ratio = link_chars[0] / chars[0] if chars[0] else 0.0
        self.chars, self.link_chars = chars, link_chars
        self.density = [composite_density(chars[i], tags[i], link_chars[i], link_tags[i], body_ratio) for i in range(n)]
        self.sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                self.sums[self.parent[i]] += self.density[i]

    def path(self, node: int) -> list[int]:
        """The element and its ancestors up to the root."""
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out

    def chosen(self) -> list[bool]:
        """Which elements belong to the main text.

        The element with the greatest sum of child densities leads: its nearest container is taken whole.
        The least density on its path up to the body is the threshold: containers beside that path which
        reach it are taken too, as parts of one text, and blocks below it that are mostly links, or only
        suspected to be noise, are left out.
        """
        n = len(self.tag)
        live = [i for i in range(n) if not self.noise[i] and self.chars[i]]
        if not live:
            return [False] * n
        best = max(live, key=lambda i: (self.sums[i] or self.density[i], -i))
        path = self.path(best)
        threshold = min(self.density[i] for i in path)
        top = next(i for i in path if self.tag[i] in CONTAINER)
        taken = [False] * n
        for i in range(n):
            up = taken[self.parent[i]] if i else False
            below = self.density[i] < threshold and i not in path
            out = below and self.tag[i] in BLOCK and (self.suspect[i] or self.link_chars[i] > 0.5 * self.chars[i])
            part = self.tag[i] in CONTAINER and i not in path and not below
            taken[i] = not self.noise[i] and (up or i == top or part) and not out
        return taken

    def main_text(self) -> str:
        taken, blocks, run = self.chosen(), [], []
        for node, text in [*self.pieces, (0, "")]:
            if text:
                if taken[node]:
                    run.append(text)
            elif run:
                blocks.append(" ".join("".join(run).split()))
                run = []
        return "\n".join(b for b in blocks if b)


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters per tag, scaled down as links hold more of the characters and tags."""
    if not chars:
        return 0.0
    tags, link_chars_, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + e)
    value = chars / link_chars_ * tags / link_tags
    # The floor keeps pages without any link, whose base would be one, on the same scale.
    return chars / tags * max(0.0, log(max(value, 1.0))) / max(log(base), 0.1)


def judged(tag: str, attributes: str, inside: bool, by_name: bool = True) -> tuple[bool, bool]:
    """Whether an element is noise by its kind, role or whole name, and whether its name makes it suspect:
    a part of it, or all of it where names alone do not decide."""
    if tag in NOISE_TAGS or (tag in NOISE_OUTSIDE and not inside):
        return True, False
    suspect = False
    if not attributes or attributes.isspace():
        return False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in value.lower().split():
                parts = set(NAME_PART.findall(word))
                known = parts & NOISE_PARTS if inside else parts & (NOISE_PARTS | NOISE_PARTS_OUTSIDE)
                if by_name and known and parts <= known | PLAIN_PARTS | NOISE_PARTS_OUTSIDE:
                    return True, False
                suspect = suspect or bool(known)
        elif name == "role" and value.lower() in NOISE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True, False
    return False, suspect


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by newlines; empty for null, empty or text-free pages.

    If nothing is left, the names of elements lose their say: the only text of a page is not a notice
    beside it, and density alone decides.
    """
    return (Page(html).main_text() or Page(html, by_name=False).main_text()) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of each page, from its whole HTML. One row per row, repeats included.

    Null and empty pages, and pages without text outside of the parts that are left out, have the empty
    text. Time grows in proportion to a page's length, however its elements are nested.
    """

    def start():
        def one(page, url, html):
            text = main_text(html)
            return page, url, text, len(text)

        return one

    return map_rows(pages, start, f"{id_col} long, {url_col} string, text string, n_chars long", [id_col, url_col, html_col])
