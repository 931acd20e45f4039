"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A small classifier gives each block the cost of calling it content
and the cost of calling it boilerplate; these become capacities to the two terminals. Blocks that follow one another, and
blocks that follow one another within the same container, are joined by smoothness edges. The maximum flow separates
content from boilerplate at the least total cost. Blocks of the content side are kept whole.

Elements such as nav and roles speak for themselves. A class or id that sounds like boilerplate is a hint: on a page that has
no article or main element it counts the less, the more of the page's text without links lies in the element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .names import fresh

#: Elements and names with a meaning in HTML or common usage.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
             " header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg math iframe object applet canvas audio video select textarea button head title datalist noframes".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend", "optgroup", "option"}
MAIN = {"article", "main"}
ASIDE = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "fieldset"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer footer gdpr header"
    " infobox legal login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination paywall popup privacy"
    " promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags"
    " toc toolbar widget".split())
COMMENT_NAMES = set("comment comments commentlist disqus discussion replies reply respond".split())
#: words that make a class tell of the page, as in has-sidebar
ABOUT_NAMES = set("has with without no enabled disabled".split())
CONTENT_NAMES = set("article articlebody content entry main post postbody story".split())

#: costs: a cue of the container, a main element, a paragraph, links, per hundred characters, and the two kinds of edges
CUE, MAIN_CUE, NAME_CUE, PARAGRAPH, LINKS, LENGTH = 9.0, 5.0, 2.0, 0.6, 2.5, 0.8
NEXT, SIBLING = 0.4, 0.8

_COMMENT_END = re.compile(r"-->|\Z")
#: a tag whose attributes hold no "<", which is nearly every one; it reads no further than the next "<"
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+)>""")
_OPEN = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)""")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile(r"[a-z0-9]+")


class Block:
    __slots__ = ("container", "cue", "hint", "length", "linked", "share", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, cue: str, container: int, hint: int):
        self.hint, self.share = hint, 0.0  # the nearest element with a hint, and its share of the page's text
        self.text, self.linked, self.tag, self.cue, self.container, self.length = text, linked, tag, cue, container, len(text)


def _cue(tag: str, attributes: str, above: str) -> str:
    """What the element says of what is in it: 'aside', 'comment', 'main', 'named', 'new hint', 'hint' or ''; comments
    stay comments."""
    if above == "comment":
        return above
    names: set[str] = set()
    hinted = False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "role" and value.lower() in ROLES:
                return "aside"
            if key == "role" and value.lower() in MAIN:
                names.add("main")
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                return "aside"
            if key in ("class", "id"):
                for name in value.split():
                    words = set(_NAME.findall(_CAMEL.sub(" ", name).lower()))
                    names |= words
                    # the header of a post or the like holds its title
                    own = words - {"header"} if words & CONTENT_NAMES else words
                    hinted = hinted or bool(own & ASIDE_NAMES) and not words & ABOUT_NAMES
    if tag in ("html", "body"):
        return above
    if names & COMMENT_NAMES:
        return "comment"
    if tag in ASIDE and not (tag == "header" and above == "main"):
        return "aside"
    if hinted and above != "aside" and tag not in MAIN and tag not in ("h1", "h2", "h3", "p", "span", "b", "strong", "em", "i", "a"):
        return "new hint"
    if tag in MAIN:
        return "main"
    if names & CONTENT_NAMES and above not in ("main", "aside", "hint"):
        return "named"
    return above


class _Tags:
    """The tags of a page in order, each character read a bounded number of times whatever quotes or tags are left open.

    A tag ends at the first > outside quotes; without one it is text. Where a scan from a quote ends is the same for every
    tag that comes upon that quote, so it is remembered."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] = {}  # by opening quote: where a tag that goes on from it ends, or -1
        self.special: list[int] | None = None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """start, end, slash, name (empty for a comment or declaration) and attributes of the first tag from ``at`` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if m := _TAG.match(page, start):
                return start, m.end(), m[1], m[2], m[3]
            if page.startswith("<!--", start):
                return start, _COMMENT_END.search(page, start + 4).end(), "", "", ""
            if start > self.last:  # no tag can end any more, but a comment may begin
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            if page[start + 1:start + 2] in ("!", "?"):
                return start, page.index(">", start) + 1, "", "", ""
            if m := _OPEN.match(page, start):
                end = self._end(m.end())
                if end >= 0:
                    return start, end, m[1], m[2], page[m.end():end - 1]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """After the first > outside quotes from ``at`` on, or -1."""
        if self.special is None:
            self.special = [m.start() for m in _SPECIAL.finditer(self.page)]
        passed, end = [], -1
        while (k := bisect_left(self.special, at)) < len(self.special):
            place = self.special[k]
            mark = self.page[place]
            if mark == ">":
                end = place + 1
                break
            if place in self.ends:
                end = self.ends[place]
                break
            passed.append(place)
            at = self.page.find(mark, place + 1) + 1
            if not at:
                break
        self.ends |= dict.fromkeys(passed, end)
        return end


class _Stack:
    """Open elements as (tag, cue, number), with the places of each tag, so that a look for one reads no other."""

    def __init__(self):
        self.items: list[tuple[str, str, int]] = [("", "", 0)]
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places of block elements but p

    def push(self, tag: str, cue: str, number: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag in BLOCKS and tag != "p":
            self.walls.append(len(self.items))
        self.items.append((tag, cue, number))

    def nearest(self, *tags: str) -> int:
        """Place of the innermost of the tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def wall(self) -> int:
        return self.walls[-1] if self.walls else 0

    def cut(self, place: int) -> int:
        """Closes the element at the place and all in it; returns how many links were among them."""
        links = sum(tag == "a" for tag, _, _ in self.items[place:])
        for tag, _, _ in self.items[place:]:
            self.places[tag].pop()
        while self.walls and self.walls[-1] >= place:
            self.walls.pop()
        del self.items[place:]
        return links


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Unclosed and stray tags are borne; unknown tags are inline."""
    out: list[Block] = []
    stack, tags = _Stack(), _Tags(page)
    pieces: list[str] = []
    linked = links = number = at = 0
    hint_of, outer = {0: 0}, {}  # nearest element with a hint by element, and the next one around it
    endless: set[str] = set()  # hidden elements that have no end tag from here on

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                _, cue, inner = stack.items[-1]
                place = max(stack.wall(), stack.nearest("p"))
                tag, _, container = stack.items[place]
                if place and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt"):
                    container = stack.items[place - 1][2]
                out.append(Block(text, min(linked, len(text)), tag, cue, container, hint_of[inner]))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if links:
                linked += len(text.strip())

    while (found := tags.next(at)) is not None:
        start, end, slash, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCKS:
                flush()
            place = stack.nearest(tag)
            if place and (tag in BLOCKS or place > stack.wall()):
                links -= stack.cut(place)
            continue
        if tag in HIDDEN:
            close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close is not None:
                at = close.end()
            else:  # an unclosed head or the like ends with its tag, raw text with the page
                endless.add(tag)
                at = at if tag in ("head", "button", "svg", "math", "object", "audio", "video") else len(page)
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and stack.nearest("p") > stack.wall():
                links -= stack.cut(stack.nearest("p"))
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                place = stack.nearest(tag)
                if place > stack.nearest("ul", "ol", "dl", "table", "menu"):
                    links -= stack.cut(place)
        if tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCKS - VOID:
            number += 1
            _, above, around = stack.items[-1]
            cue = _cue(tag, attributes, above)
            hint_of[number] = hint_of[around]
            if cue == "new hint":
                cue, hint_of[number], outer[number] = "hint", number, hint_of[around]
            stack.push(tag, cue, number)
            links += tag == "a"
    # a tag that is cut off at the end of the page is no text
    rest = page[at:]
    cut = re.compile(r"<[a-zA-Z/!?]").search(rest, rest.rfind(">") + 1)
    add(rest[: cut.start()] if cut else rest)
    flush()
    if not any(b.cue == "main" for b in out):
        free = dict.fromkeys([0, *outer], 0)
        for b in out:
            if b.cue not in ("aside", "comment"):
                free[b.hint] += b.length - b.linked
        for hint in sorted(outer, reverse=True):  # inner elements have the higher numbers
            free[outer[hint]] += free[hint]
        for b in out:
            b.share = free[b.hint] / free[0] if b.cue == "hint" and free[0] else 0.0
    return out


def costs(b: Block) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and content."""
    content = LENGTH * min(b.length, 400) / 100 + (PARAGRAPH if b.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") else 0)
    other = 0.3 + LINKS * b.linked / b.length
    if b.cue == "main":
        content += MAIN_CUE
    elif b.cue == "named":
        content += NAME_CUE
    elif b.cue:
        content = b.share * content + (1 - b.share) * min(content, 1.0)
        other += CUE * (1 - b.share)
    return content, other


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, by maximum flow in level graphs; edges carry flow either way."""
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        cap.append(there)
        heads[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k in range(n):
        common = min(source[k], sink[k])  # flows straight through
        if source[k] > common:
            join(s, k, source[k] - common, 0.0)
        elif sink[k] > common:
            join(k, t, sink[k] - common, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(heads[a]):
                path.append(heads[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def extract(page: str | None) -> str:
    """The main text: content blocks in page order, joined by line feeds; '' for null and empty pages and where none is left."""
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    source, sink = zip(*map(costs, blocks), strict=True)
    edges = [(k, k + 1, NEXT) for k in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.container in last:
            edges.append((last[b.container], k, SIBLING))
        last[b.container] = k
    return "\n".join(b.text for b, keep in zip(blocks, minimum_cut(source, sink, edges), strict=True) if keep)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with `text`, one row out for each row in.

    All other columns are kept, but for one named text. A page is one row and is handled in one go, whatever its length.
    """
    kept = pages.drop(html_col, "text")
    rows = kept.columns
    html = fresh(kept, "_html")
    source = pages.select(*rows, F.col(html_col).alias(html))
    schema = kept.select("*", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x) for x in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rows), texts], names=[*rows, "text"])

    return source.mapInArrow(run, schema)
