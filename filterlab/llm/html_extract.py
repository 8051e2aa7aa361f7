"""Main text of web pages by line-block distribution.

Markup is stripped block by block, so every block is a line, and its length is that of its text
outside links: menus and link lists are nearly empty lines. Lengths are summed over sliding windows of
lines. Where the sum surges from nothing text begins, where it dives back to nothing it ends; the
heaviest such stretch, after which the rest of the page is judged, is the core of the article.

The article may go on before or after the stretch (short first and last lines, text beyond an advert),
so the stretch names its container: the innermost element around most of it, widened while the next
element adds more text lines than link lines, up to the article or main element that the page marks.
What lies in the container is kept. Where only the page itself contains the stretch, what lies
between the surge and dive points of a stretch is kept.

Tags, roles and class names of page furniture (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) are a prior: their blocks count as empty lines and are left out, unless the
element holds most of the page's text or its main heading; then it is a wrapper of the article.

A page is read in one pass, and sums over elements are made from the innermost outwards, so time and memory grow with the
page alone, however its tags nest and whatever isn't closed.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by one line break; nothing else is dropped or cut. Null and empty pages, and pages without any text
outside furniture, give an empty text. Of two equal stretches the first is taken. Repeated rows give
repeated results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filterlab.llm.common import mapped

WINDOW, SURGE = 3, 40
#: An element that holds this share of the page's text is a wrapper, whatever its name.
WRAPPER_SHARE = 0.7
#: Elements whose content is no text of the page.
_MUTE = "script style noscript template svg iframe object canvas textarea select audio video title"
_MUTE_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _MUTE.split()}
_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_STOP, _ANGLE = re.compile("[<>\"']"), re.compile("[<>]")
#: HTML elements that stand inside a line of text, elements without content, and furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
HOLDERS = frozenset(("article", "main"))
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|header|masthead|comments?|commentlist|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|skip-link|copyright)(?:$|[\s_-])", re.I)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HEADLINE = re.compile(r"(?:^|[\s_-])(?:entry|post|article|story)[_-]?header(?:$|[\s_-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def _kind(tag: str, attributes: str, in_holder: bool) -> str:
    """'hidden' for what no reader sees, 'out' for page furniture by name, 'holder' for what marks the article, else ''."""
    named = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes.strip() else {}
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(named.get("style", "")):
        return "hidden"
    role = named.get("role", "").lower()
    if tag in FURNITURE or role in FURNITURE_ROLES or (tag == "header" and not in_holder):
        return "out"
    if tag in ("body", "html"):
        return ""
    if tag not in INLINE and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and any(_NAME.search(_HEADLINE.sub(" ", named.get(k, ""))) for k in ("class", "id")):
        return "out"
    if tag in HOLDERS or role == "main" or named.get("itemprop", "").lower() == "articlebody":
        return "holder"
    return ""


@dataclass
class Block:
    """A line of the page: its text, characters outside links, and the number of the innermost element around it."""

    text: str
    plain: int
    element: int
    furniture: bool = False


@dataclass
class Tree:
    """The elements of a page by number, each after its parent; 0 is the page itself. below_holder: whether an
    element around it marks the article."""

    parent: list[int]
    kind: list[str]
    tag: list[str]
    below_holder: list[bool]

    def summed(self, own: list[int]) -> list[int]:
        """For each element the sum of its own number and those of all elements in it."""
        for n in range(len(own) - 1, 0, -1):
            own[self.parent[n]] += own[n]
        return own

    def inherited(self, own: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        for n in range(1, len(own)):
            own[n] = own[n] or own[self.parent[n]]
        return own


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the markup of a page, in order; the name is empty for comments,
    declarations and elements without text of the page.

    Nothing is scanned twice, whatever isn't closed: a tag that meets another one's start is text up to there. Once
    a quote runs to the end of the page, quotes no longer hide angles; where no angle closes anything, the rest is text."""
    at, n, quotes = page.find("<"), len(page), True
    while at >= 0:
        end, name, closing, attributes = at, "", False, ""
        if page.startswith("<!--", at):
            found = page.find("-->", at + 4)
            end = n if found < 0 else found + 3
        elif page.startswith(("<!", "<?"), at):
            found = page.find(">", at)
            if found < 0:
                return
            end = found + 1
        elif m := _TAG.match(page, at):
            stop = m.end()
            while (x := (_STOP if quotes else _ANGLE).search(page, stop)) and x[0] in "\"'":
                stop = page.find(x[0], x.end()) + 1
                if not stop:
                    stop, quotes = m.end(), False
            if not x:
                if not quotes:
                    return
                stop, quotes = m.end(), False
                x = _ANGLE.search(page, stop)
                if not x:
                    return
            if x[0] == "<":
                at = x.start()
                continue
            end, name, closing, attributes = x.end(), m[2].lower(), bool(m[1]), page[m.end() : x.start()]
            if name in _MUTE_END and not closing:
                found = _MUTE_END[name].search(page, end)
                end, name = found.end() if found else n, ""
        if end > at:
            yield at, end, name, closing, attributes
        at = page.find("<", max(end, at + 1))


def blocks(page: str) -> tuple[list[Block], Tree]:
    """The blocks of a page that have text, in page order, and its elements."""
    out: list[Block] = []
    tree = Tree([0], [""], [""], [False])
    stack = [0]
    opened: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def said(parts: list[str]) -> str:
        return _SPACE.sub(" ", html.unescape("".join(parts))).strip()

    def add(part: str) -> None:
        text.append(part)
        if in_link:
            linked.append(part)

    def flush() -> None:
        if text:
            if whole := said(text):
                out.append(Block(whole, max(0, len(whole) - len(said(linked))) if linked else len(whole), stack[-1]))
            text.clear()
            linked.clear()

    def close() -> str:
        tag = tree.tag[stack.pop()]
        opened[tag] -= 1
        return tag

    for start, end, tag, closing, attributes in tags(page):
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            if opened.get(tag):
                while close() != tag:
                    pass
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            # these end where the next one begins, and a paragraph ends where any block does
            top = tree.tag[stack[-1]]
            if top == "p" or (top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                close()
            around = stack[-1]
            tree.parent.append(around)
            tree.below_holder.append(tree.below_holder[around] or tree.kind[around] == "holder")
            tree.kind.append(_kind(tag, attributes, tree.below_holder[-1]))
            tree.tag.append(tag)
            stack.append(len(tree.tag) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out, tree


def marked(found: list[Block], tree: Tree) -> list[Block]:
    """The blocks that a reader sees, with furniture marked: what a name in the list is around, unless that is a wrapper."""
    hidden = tree.inherited([k == "hidden" for k in tree.kind])
    seen = [b for b in found if not hidden[b.element]]
    weight, heads = [0] * len(tree.tag), [0] * len(tree.tag)
    for b in seen:
        weight[b.element] += b.plain
        heads[b.element] += tree.tag[b.element] == "h1"
    weight, heads = tree.summed(weight), tree.summed(heads)
    most = WRAPPER_SHARE * weight[0]
    out = tree.inherited([k == "out" and w < most and not (h and t != "header") for k, w, h, t in zip(tree.kind, weight, heads, tree.tag, strict=True)])
    for b in seen:
        b.furniture = out[b.element]
    return seen


def stretches(lengths: np.ndarray) -> list[tuple[int, int]]:
    """From surge to dive: a stretch begins where the sum of WINDOW lines rises over the bound, and
    ends where a line and the lines of the window after it hold nothing."""
    sums = np.convolve(lengths, np.ones(WINDOW, int))[WINDOW - 1 :]  # of the WINDOW lines from each on
    spans, begin, limit = [], None, min(SURGE, sums.max())
    for k, n in enumerate(lengths):
        if begin is None and n and sums[k] >= limit:
            begin = k
        elif begin is not None and not n and not sums[k]:
            spans.append((begin, k))
            begin = None
    return spans + [(begin, len(lengths))] if begin is not None else spans


def container(found: list[Block], tree: Tree, first: int, end: int) -> int | None:
    """The element that a stretch of lines makes out to be the article's; None if only the page is."""
    weight, lines, links = ([0] * len(tree.tag) for _ in range(3))
    whole = 0
    for k, b in enumerate(found):
        if not b.furniture:
            lines[b.element] += 1
            links[b.element] += 2 * b.plain < len(b.text)
            if first <= k < end and b.element:
                whole += b.plain
                weight[tree.parent[b.element]] += b.plain
            elif first <= k < end:
                whole += b.plain
    weight, lines, links = tree.summed(weight), tree.summed(lines), tree.summed(links)
    now = next((n for n in range(len(weight) - 1, 0, -1) if 2 * weight[n] > whole), 0)
    while now and tree.kind[now] != "holder":
        around, held = tree.parent[now], tree.below_holder[now]
        if not around or (not held and tree.tag[around] in ("body", "html")):
            break
        if not held and 2 * (links[around] - links[now]) > lines[around] - lines[now]:
            break
        now = around
    return now if now and tree.tag[now] not in ("body", "html") else None


def main_text(page: str | None) -> str:
    """The article of a page."""
    every, tree = blocks(page or "")
    found = marked(every, tree)
    lengths = np.array([0 if b.furniture else b.plain for b in found])
    if not lengths.any():
        return ""
    spans = stretches(lengths)
    sums = np.r_[0, lengths.cumsum()]
    first, end = max(spans, key=lambda s: (sums[s[1]] - sums[s[0]], -s[0]))
    around = container(found, tree, first, end)
    if around is not None:
        inside = tree.inherited([n == around for n in range(len(tree.tag))])
        kept = [not b.furniture and inside[b.element] for b in found]
    else:
        between = np.zeros(len(found), bool)
        for x, y in spans:
            between[x:y] = True
        kept = [not b.furniture and bool(k) for b, k in zip(found, between, strict=True)]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages."""
    def texts(pages_of: list[str | None]) -> list[pa.Array]:
        return [pa.array([main_text(p) for p in pages_of], pa.string())]

    return mapped(pages, "html", lambda: texts, "text string", ["page_id", "url"])
