"""HTML extraction: tag-path ratios.

Every run of text hangs on its root-to-leaf tag path (each tag with its class and id). Over a page, the
length of text, its punctuation and its linked share are summed by path and turned into ratios per node;
the ratios of text and of punctuation are fused, smoothed with those of the other paths in the same
container (weighted by text), and paths under a share of the page's best are dropped.

Before that, elements that never hold an article go (scripts, menus, hidden ones), and elements that their
tag or class marks as something else (headers, footers, forms, adverts, comments, ...), unless the article or
most of the page's text is inside them. A name marks an element if it is made of such words and words of layout alone; one that only begins or ends
so ("social-issues", "comment-on-results") lowers a path's score, and is decisive only where an element is short or mostly links. Words that
also name parts of articles ("related-work") lower a score within an article, and no more; a short notice goes there, too. An
article's header keeps its headings.

What the ratios leave out comes back where it belongs to kept text: tables, lists, headings and captions in a container most of whose text is
kept, unless they are mostly links; and, where no headline is kept, the last one before the text whose parent holds the text. A table's cell is a
container of its own only if it is as long as a text.

Null, empty and text-free pages give empty text and zero characters. Unclosed elements, a tag cut off by
the end of the page and stray < are read as browsers read them. Memory is linear in the page, however deep
its elements are. Repeated rows get one result each; ties keep all paths; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset address details summary hr center hgroup dialog menu search".split()
)
CONTAINER = frozenset("html body main article section div td aside blockquote".split())
NEVER = frozenset("head nav menu dialog search button select option label legend fieldset template svg canvas object audio video".split()) | RAW
ASIDE = frozenset("header footer aside form".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of a class, id or role that mark what isn't the article, wherever they stand in it.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos cookie cookies consent gdpr popup popups modal modals newsletter newsletters "
    "subscribe signup login sidebar sidebars widget widgets navbar breadcrumb breadcrumbs footer footers masthead topbar toolbar sharing social disqus pagination pager complementary contentinfo".split()
)
#: The same, for what readers write.
COMMENTS = frozenset("comment comments commentlist reply replies respond".split())
#: Words that mark it only where all of the name is such words or PLAIN ones.
AMBIGUOUS = frozenset(
    "side menu menus nav navs navigation header headers share related recommended tags meta byline discussion copyright legal skip toc feedback survey search".split()
)
#: The same, for notices.
NOTICE = frozenset("banner banners notice notices alert alerts notification notifications disclaimer overlay".split())
#: Words that say where something is or what it is made of.
PLAIN = frozenset(
    "site page global main primary secondary top bottom left right inner outer upper lower mobile desktop sticky fixed user reader post posts article articles story stories item items entry "
    "wrap wrapper container box block section area panel module bar row col column content body text title list link links button buttons icon icons form group widget region role "
    "author avatar thread count slot unit zone placement rail strip leaderboard skyscraper rectangle holder".split()
)
_LAYOUT = STRONG | COMMENTS | AMBIGUOUS | NOTICE | PLAIN
#: Words before a strong one that speak of a layout.
FLAGS = frozenset("has no with without is not hide show".split())
#: A start tag of these ends an open element of those (up to the nearest container).
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul center dialog hgroup search".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "option": {"select"}}
_P_STOP = CONTAINER | {"li", "table"}
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z))""", re.S)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，、！？]")
#: Attributes of what a browser doesn't show.
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
KEEP_SHARE, SMOOTH, WEAK, MOST = 0.35, 0.6, 0.6, 0.6
#: Characters: what is named like something else only in part is dropped below SHORT, a notice in an article below NOTE; a cell holds text of its own from CELL.
SHORT, NOTE, CELL = 80, 300, 400


@lru_cache(10_000)
def marked(marks: str) -> str:
    """What classes, ids and roles say of an element: comments, other, notice, likely (something else), maybe, or nothing."""
    said = set()
    for name in marks.split():
        words = re.findall("[a-z]+", name)
        if not words or words[0] in FLAGS:
            continue
        if all(w in _LAYOUT or len(w) < 3 for w in words):
            said.update(what for what, known in (("comments", COMMENTS), ("other", STRONG), ("notice", NOTICE), ("maybe", AMBIGUOUS)) if known.intersection(words))
        elif {words[0], words[-1]} & (STRONG | COMMENTS):
            said.add("likely")
    return next((x for x in ("comments", "other", "notice", "likely", "maybe") if x in said), "")


class _Node:
    """An element. Its tag path is a number, for paths share their beginnings."""

    __slots__ = ("tag", "up", "path", "container", "whole", "link", "says", "never", "weak", "muted", "chars", "linked", "article")

    def __init__(self, tag: str, marks: str, up: _Node | None, paths: dict, hidden: bool = False):
        self.tag, self.up = tag, up
        self.path = paths.setdefault((up.path if up else -1, tag, marks), len(paths))
        self.says = "" if tag in ("html", "body") else marked(marks) if marks else ""
        # an article is one container with all that is in it, and so is a main element but for its articles
        inside = up.whole if up else ""
        self.whole = tag if tag in ("article", "main") and inside != "article" else inside
        self.container = up is None or tag in CONTAINER and (not self.whole or inside != self.whole)  # a path, once all is read
        self.link = tag == "a" or bool(up and up.link)
        self.weak = bool(up and up.weak)
        self.never = bool(up and up.never) or hidden or tag in NEVER
        # of an article's header only headings count
        self.muted = tag not in HEADING and (bool(up and up.muted) or tag == "header" and inside != "")
        if tag in ("article", "main") and self.says != "comments":
            self.says = ""
        elif self.says == "maybe" and inside == "article" or tag == "header" and inside:
            self.weak, self.says = self.weak or self.says == "maybe", ""
        elif tag in ASIDE:
            self.says = self.says if self.says == "comments" else "other"
        self.chars, self.linked, self.article = 0, 0, tag in ("article", "main") and not self.says and not self.never


class _Open:
    """The stack of open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: _Node):
        self.stack, self.places = [root], {}

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, else 0."""
        if len(tags) > len(self.places):
            return max((p[-1] for t, p in self.places.items() if p and t in tags), default=0)
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def end(self, tags, stop) -> bool:
        """Closes the innermost of the tags unless one of stop is open inside it."""
        place = self.last(tags)
        if place and place >= self.last(stop):
            self.cut(place)
            return True
        return False


def runs(page: str) -> tuple[list[list[tuple[_Node, str]]], list[_Node]]:
    """The page's blocks in order, each as its runs of text with the element that holds them; and all elements."""
    blocks: list[list[tuple[_Node, str]]] = [[]]
    paths: dict = {}
    nodes = [_Node("html", "", None, paths)]
    tree = _Open(nodes[0])
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s and not tree.stack[-1].never:
            s = html.unescape(s)
            blocks[-1].append((tree.stack[-1], s))
            n = len(s) - s.count(" ") - s.count("\n")
            tree.stack[-1].chars += n
            tree.stack[-1].linked += n * tree.stack[-1].link

    def cut() -> None:
        if blocks[-1]:
            blocks.append([])

    while at < n:
        i = page.find("<", at)
        if i < 0:
            text(page[at:])
            break
        m = _TAG.match(page, i)
        if not m:
            text(page[at : i + 1])
            at = i + 1
            continue
        text(page[at:i])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                text(" ")
            elif tag in BLOCK:
                cut()
            tree.end((tag,), () if tag in BLOCK else CONTAINER)
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK:
                cut()
            if tag == "html" and len(tree.stack) == 1:
                continue
            if tag in _P_ENDS:
                tree.end(("p",), _P_STOP)
            if tag == "body":
                tree.end(("head",), ())
            if tag in _ENDS:
                for _ in range(3):
                    tree.end(_ENDS[tag], _STOP[tag])
            marks = " ".join(x.strip("\"'") for x in _MARKS.findall(m[3])).lower() if m[3] else ""
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in RAW:
                j = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = n if j is None else max(page.find(">", j.start()) + 1, j.end())
                continue
            nodes.append(_Node(tag, marks, tree.stack[-1], paths, bool(m[3]) and bool(HIDDEN.search(m[3]))))
            tree.push(nodes[-1])
    return [b for b in blocks if b], nodes


def judge(nodes: list[_Node]) -> None:
    """Settles which elements never count: what says that it is something else, unless it holds an article, or, on a page
    without articles, is a form or a class with most of the page's text, comments apart."""
    for node in reversed(nodes):
        if node.up:
            node.up.chars += node.chars
            node.up.linked += node.linked
            node.up.article |= node.article
    most = MOST * nodes[0].chars
    for k, node in enumerate(nodes):
        up = node.up
        # cells of one path are a menu and a text, so a long one is a container by itself
        own = node.container and (node.tag not in ("td", "blockquote") or node.chars >= CELL)
        node.container = (-k if node.tag == "td" else node.path) if own else up.container
        if up is None:
            continue
        spared = node.article or not nodes[0].article and node.says != "comments" and node.tag not in ("header", "footer", "aside") and node.chars > most
        other = bool(node.says) and not spared
        if node.says == "notice" and node.whole == "article" and node.tag not in CONTAINER:
            other, node.weak = False, True
        elif node.says == "likely" or node.says == "notice" and node.whole == "article":
            other = other and (node.chars < (SHORT if node.says == "likely" else NOTE) or 2 * node.linked > node.chars)
            node.weak = node.weak or not other
        node.weak = node.weak or up.weak
        node.never = node.never or other or up.never


def main_text(page: str) -> str:
    """The article's blocks, each with its white space as single spaces, joined by two line ends."""
    blocks, nodes = runs(page)
    judge(nodes)
    kept = [[(node, t) for node, t in b if not node.never and not node.muted] for b in blocks]
    found = [(b, " ".join("".join(t for _, t in b).split())) for b in kept]
    found = [(b, t) for b, t in found if t]
    if not found:
        return ""
    size: dict[int, list[float]] = {}
    holder: dict[int, _Node] = {}
    for b, t in found:
        x = size.setdefault(b[0][0].path, [0, 0, 0, 0])
        holder[b[0][0].path] = b[0][0]
        x[0] += len(t)
        x[1] += len(PUNCTUATION.findall(t))
        x[2] += sum(len(s) for node, s in b if node.link)
        x[3] += 1
    fused = {p: math.log1p(chars / count) * (1 + math.log1p(points / count)) * max(0.0, 1 - linked / chars) for p, (chars, points, linked, count) in size.items()}
    whole: dict[int, list[float]] = {}
    for p, (chars, *_) in size.items():
        x = whole.setdefault(holder[p].container, [0.0, 0.0])
        x[0] += chars * fused[p]
        x[1] += chars
    smooth = {}
    for p, f in fused.items():
        total, chars = whole[holder[p].container]
        # containers count by the logarithm of their text too: one long article outweighs a long line elsewhere
        smooth[p] = ((1 - SMOOTH) * f + SMOOTH * total / chars) * math.log1p(chars) * (WEAK if holder[p].weak else 1.0)
    least = KEEP_SHARE * max(smooth.values())
    stay = [smooth[b[0][0].path] >= least for b, _ in found]
    text: dict[int, list[int]] = {}
    for (b, t), s in zip(found, stay):
        x = text.setdefault(b[0][0].container, [0, 0])
        x[0] += len(t)
        x[1] += len(t) * s
    for i, (b, t) in enumerate(found):
        chars, kept_chars = text[b[0][0].container]
        stay[i] = stay[i] or not b[0][0].weak and 2 * kept_chars > chars and 2 * sum(len(s) for node, s in b if node.link) <= len(t)
    _headline(found, stay)
    return "\n\n".join(t for (_, t), s in zip(found, stay) if s)


def _headline(found: list, stay: list[bool]) -> None:
    """Keeps the last headline before the text, if none is kept and its parent holds the text."""
    first = next((i for i, s in enumerate(stay) if s), 0)
    if any(s and "h1" in _tags(b[0][0]) for (b, _), s in zip(found, stay)):
        return
    above = set()
    node = found[first][0][0][0]
    while node is not None:
        above.add(id(node))
        node = node.up
    for i in range(first - 1, -1, -1):
        b, t = found[i]
        head = b[0][0]
        while head is not None and head.tag != "h1":
            head = head.up
        if head is not None and id(head.up) in above and 2 * sum(len(s) for n, s in b if n.link) <= len(t):
            stay[i] = True
            return


def _tags(node: _Node | None) -> set[str]:
    """The tags around a text up to its block."""
    out = set()
    while node is not None:
        out.add(node.tag)
        if node.tag in BLOCK:
            break
        node = node.up
    return out


def html_extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
