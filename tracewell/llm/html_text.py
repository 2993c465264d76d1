"""The main text of web pages, by composite text density (Sun et al., 2011).

A page becomes a tree of its block elements; inline elements belong to their block's text. Elements that are never article text (NEVER, hidden ones, and those whose role, or a
whole class or id of theirs, names a menu, header, footer, sidebar, notice, advert, form or comment) are left out first. For each other node the composite density is

    C/T * log_b(C/LC * T/LT)    with b = ln(C/NC * LC + LCb/Cb * C + e)

with C its characters, T its block tags, LC and LT the characters and number of its links, NC its characters outside links, and LCb, Cb those of the body; zeros count as
one. The node with the largest sum of its children's densities is the core; the threshold is the smallest density on the path from the core to the body. Every other node of at
least that density (and more than none) is article too, and the text is the smallest subtree that holds them all. Three rules make it whole:

- Where the core is inside an article or main element, only nodes in the closest one count, and the subtree grows to that element: headings and short lines have little density.
- Else, where the smallest subtree is the whole body, each such node gives its own subtree of the largest sum, the text of those that hold none but it.
- The body is the subtree if it is the core.

Text: character references decoded, white space inside a block turned into one space, trimmed, blocks joined by a blank line in page order.

Cases: null html is empty; a page without text gives an empty text; unclosed and misnested tags close as their parents do; a tag that never ends, and what follows, is no text, as in
browsers; very long and very deep pages take time in proportion to their length; equal densities go to the later node in page order; rows are independent, so equal rows and null ids
each come out; an empty table gives no rows; all other columns stay, whatever their names, but one of the text's name is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices, spare

#: Elements whose text is never the article's.
NEVER = frozenset("head script style noscript template nav header footer aside form button select option textarea input label fieldset iframe object embed svg canvas audio video map dialog menu".split())
#: Elements inside a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg".split())
#: An element that starts ends an open one of these at once.
_BLOCK_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
_SCOPE = frozenset("table ul ol dl article section div main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Whole names of what is left out, whatever the element.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion nav navbar navigation menubar breadcrumb breadcrumbs
    masthead topbar footer sidebar sidebars comment comments commentlist disqus cookie cookies consent gdpr topnav sidenav subnav leftnav rightnav mainnav topmenu sidemenu submenu
    mainmenu popup modal overlay newsletter paywall pagination pager""".split()
)
#: Names that say so of a box, but not of a paragraph, heading or item, which may treat of such things.
BOX_NAMES = frozenset(
    """menu menus header aside reply replies respond responses discussion feedback notice notices notification notifications alert alerts subscribe subscription signup login share sharing
    social related recommended recommendations trending widget widgets toolbar banner banners form search hidden skip""".split()
)
BOXES = frozenset("div section ul ol dl table article details center fieldset".split())
#: Words that may stand beside one of those names in a name of several words, which is otherwise about something else.
BESIDE = frozenset(
    """main left right top bottom site page global primary secondary sub user users reader readers box block wrapper wrap container inner outer list area bar panel sticky floating fixed mobile
    desktop links link buttons button module slot unit strip zone skyscraper leaderboard posts js""".split()
)
#: Words that may stand beside one of NAMES alone: the comments of an article are none of it, its header is.
ABOUT = frozenset("post entry article blog story content".split())
#: Ends of words that name the same in one word.
ENDS = ("sidebar", "navbar", "footer", "masthead", "breadcrumbs", "comments", "advert", "adverts")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What stands in a tag after its name; quotes count after an equals sign.
_INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")


def _names(attributes: str) -> tuple[dict[str, str], list[list[str]]]:
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    names = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower().split()
    parts = ([p.rstrip("0123456789") or p for p in _PARTS.split(n) if p] for n in names)
    return found, list(parts)


def _left_out(tag: str, found: dict[str, str], names: list[list[str]]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    left = lambda x: x in NAMES or (x in BOX_NAMES and tag in BOXES) or len(x) > 6 and x.endswith(ENDS)
    near = lambda p: BESIDE | BOX_NAMES | (ABOUT if NAMES.intersection(p) else frozenset())
    return any(any(map(left, p)) and all(left(x) or x in near(p) for x in p) for p in names)


class Page:
    """A page's block tree: for node n its tag and parent; and the blocks of text with their node. One pass over the source."""

    def __init__(self, source: str):
        self.tag, self.parent = ["body"], [-1]
        self.blocks: list[tuple[int, str, int, int]] = []  # node, text, characters in links, links
        at_node, out = 0, 0  # the open node; how many elements that are left out are open around it
        stack: list[tuple[str, int, bool]] = []  # open block elements: tag, node around them, left out
        open_: Counter[str] = Counter()  # their tags; and those since each open element of _SCOPE
        scopes: list[Counter[str]] = [Counter()]
        text: list[tuple[str, bool]] = []
        link = False
        links = 0
        skip, skip_tag = 0, ""  # open elements of the tag of a left out run inside a line

        def close_block() -> None:
            nonlocal links
            if text:
                whole = " ".join(html.unescape("".join(x for x, _ in text)).split())
                if whole:
                    in_links = len(" ".join(html.unescape("".join(x for x, y in text if y)).split()))
                    self.blocks.append((at_node, whole, min(in_links, len(whole)), links))
                text.clear()
            links = 0

        def pop() -> None:
            nonlocal at_node, out, link, skip
            close_block()
            tag, at_node, left = stack.pop()
            open_[tag] -= 1
            if tag in _SCOPE:
                scopes.pop()
            scopes[-1][tag] -= 1
            out -= left
            link, skip = False, 0

        def end(tags: tuple[str, ...], counts: Counter[str]) -> None:
            """Close the closest open element of these tags, if there is one among those counted, and what is open in it; else the block alone."""
            if not any(counts[t] for t in tags):
                close_block()
                return
            while stack[-1][0] not in tags:
                pop()
            pop()

        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            stop = size if start < 0 else start
            if stop > at and not out and not skip:
                text.append((source[at:stop], link))
            if start < 0:
                break
            closing = source.startswith("/", start + 1)
            m = _NAME.match(source, start + 1 + closing)
            if not m:
                mark = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")) if source.startswith(x[0], start)), None)
                if mark is None:  # a lone sign
                    if not out and not skip:
                        text.append(("<", link))
                    at = start + 1
                else:
                    at = source.find(mark[1], start + len(mark[0])) + len(mark[1])
                    at = at if at >= len(mark[1]) else size
                continue
            tag = m[0].lower()
            inside = _INSIDE.match(source, m.end())
            if inside.end() >= size or source[inside.end()] != ">":
                break  # a tag that never ends
            at, attributes = inside.end() + 1, inside[0]
            if tag == "br":
                if not skip:
                    text.append((" ", link))
            elif skip and tag == skip_tag:
                skip += -1 if closing else 1
            elif tag == "a" and not skip:
                link = not closing
                links += link
                if link and attributes and not out and _left_out(tag, *_names(attributes)):
                    skip, skip_tag, link = 1, tag, False
            elif tag in INLINE or tag in ("html", "body"):
                if not skip and not closing and tag not in VOID and tag not in ("html", "body") and attributes and not out and _left_out(tag, *_names(attributes)):
                    skip, skip_tag = 1, tag  # a hidden or labelled run of text, up to its end or that of its block
            elif closing:
                end((tag,), open_)
            elif tag in RAW:
                if tag != "svg" or not attributes.endswith("/"):  # a slash closes nothing in HTML, but in drawings
                    finish = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    at = source.find(">", finish.end()) + 1 if finish else size
                    at = at or size
            else:
                if stack and stack[-1][0] == "p":
                    pop()
                if tag in _BLOCK_ENDS:
                    end(_BLOCK_ENDS[tag], scopes[-1])
                close_block()
                if tag in VOID:
                    continue
                left = _left_out(tag, *(_names(attributes) if attributes else ({}, [])))
                stack.append((tag, at_node, left))
                open_[tag] += 1
                scopes[-1][tag] += 1
                if tag in _SCOPE:
                    scopes.append(Counter())
                out += left
                skip = 0
                if not out:
                    self.tag.append(tag)
                    self.parent.append(at_node)
                    at_node = len(self.tag) - 1
        while stack:
            pop()
        close_block()

    def text(self) -> str:
        n = len(self.tag)
        if not self.blocks:
            return ""
        # anonymous blocks are leaves below their node
        chars, tags, link_chars, links, total = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        for node, words, inside, count in self.blocks:
            chars[node] += len(words)
            link_chars[node] += inside
            links[node] += count
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            link_chars[p] += link_chars[i]
            links[p] += links[i]
        body_share = link_chars[0] / max(1, chars[0])

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            inside = max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))
            return c / max(1, t) * (math.log(inside) / math.log(base) if base > 1 else math.log(inside) + 1)

        own = [density(*x) for x in zip(chars, tags, link_chars, links)]
        for node, words, inside, count in self.blocks:
            total[node] += density(len(words), 0, inside, count)
        for i in range(1, n):
            total[self.parent[i]] += own[i]
        core = max(range(n), key=lambda i: (total[i], i))
        around = [core]
        while around[-1]:
            around.append(self.parent[around[-1]])
        path = set(around)
        least = min(own[i] for i in around)
        marked = next((i for i in around if self.tag[i] in ("article", "main")), 0)
        within = [False] * n  # nodes in the marked element, or in the body
        within[marked] = True
        for i in range(marked + 1, n):
            within[i] = within[self.parent[i]]
        dense = [i for i in range(n) if within[i] and i not in path and own[i] >= least and own[i] > 0]
        if marked or not core:
            chosen = [marked]
        else:
            holds = [0] * n  # how many of the core and the dense nodes each subtree holds
            for i in (core, *dense):
                holds[i] += 1
            for i in range(n - 1, 0, -1):
                holds[self.parent[i]] += holds[i]
            smallest = next(i for i in around if holds[i] == len(dense) + 1)
            chosen = [smallest]
            if not smallest:
                best = list(range(n))  # the node of the largest sum in each subtree
                for i in range(n - 1, 0, -1):
                    p = self.parent[i]
                    if total[best[i]] > total[best[p]]:
                        best[p] = best[i]
                chosen = [core, *(best[i] for i in dense)]
        inside = [False] * n
        for i in chosen:
            inside[i] = True
        for i in range(1, n):
            inside[i] |= inside[self.parent[i]]
        return "\n\n".join(words for node, words, _, _ in self.blocks if inside[node])


def main_text(source: str | None) -> str:
    return Page(source or "").text()


def extract(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """All columns but `source`, and the main text (in the place of a column of that name); no shuffle."""
    rest = [c for c in pages.columns if c not in (source, text)]
    held = spare(rest, "html")
    schema = T.StructType([*pages.select(*rest).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            texts = [main_text(x) for x in batch.column(held).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(texts, pa.string())], [*rest, text])

    return pages.select(*rest, F.col(source).cast("string").alias(held)).mapInArrow(run, schema)
