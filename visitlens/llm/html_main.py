"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to the containers above them, less to those farther up; points of
linked text do not count. The container with the most points and those of its siblings that have enough are the
article. Each page is worked on by itself, so Spark only deals the pages out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, small_batches

_TAG = re.compile(
    # A quote opens a value only behind an equals sign, and the value ends with the next such quote, however far.
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|aria-hidden|hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[a-z]+", re.I)
_LAYOUT = re.compile(r"(?:^|[\s_-])(?:no|has|with|without)[_-][a-z]+", re.I)
_STEMS = re.compile("comment|sidebar|cookie|advert|navbar|breadcrumb|newsletter|popup|masthead|consent|disqus|sponsor")
_COMMAS = re.compile("[,،、，;；]")

#: Elements whose content is no markup, and all that are never part of an article.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = _RAW | frozenset(
    "head nav header footer aside noscript template svg math object canvas audio video select button input "
    "option datalist dialog menu label fieldset".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of the first closes an open one of the second, up to the third.
_CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset({"p"}), frozenset({"button", "td", "th", "table", "caption"})) for t in _BLOCK - {"html", "body"}},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tr", "td", "th", "p"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements that an end tag of inline markup does not reach across.
_WALL = frozenset("article aside body div footer form header html li main nav section table td th ul ol dl blockquote".split())

#: Words of class, id and role that mark what is no article, and those that mark one.
_OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner banners sponsor sponsored promo promoted promotion "
    "nav navbar navigation navigate menu menus submenu breadcrumb breadcrumbs pagination pager paging toc "
    "sidebar sidebars aside rail complementary widget widgets masthead topbar toolbar contentinfo "
    "footer foot header comment comments commentlist commentary reply replies respond disqus discussion feedback "
    "cookie cookies consent gdpr notice notices alert alerts notification notifications disclaimer popup modal overlay dialog "
    "share sharing social related recommended recommendations trending newsletter subscribe subscription signup login search form "
    "copyright legal skip hidden".split()
)
#: Of these the ones that hardly ever stand on a box around the whole page.
_READERS = frozenset("comment comments commentlist commentary reply replies respond disqus discussion".split())
_INSIDE = frozenset("article articlebody body content entry hentry main post story text blog maincontent".split())
#: What elements start with; the first two are enough to win over any stray box.
_START = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0} | {
    t: -3.0 for t in ("address", "ol", "ul", "dl", "dd", "dt", "li", "form", "th", *sorted(_HEADING))
}
#: Share of linked text above which a list of several links is a menu, and so many links at least.
_MENU_SHARE, _MENU_LINKS = 0.8, 3
#: Characters below which a container outside article and main is no article yet.
_SHORT = 140
#: A sibling is kept from this share of the best container's points.
_SIBLING = 0.2


class _Node:
    __slots__ = ("tag", "up", "kids", "words", "out", "named", "points", "size", "linked", "links", "scored")

    def __init__(self, tag: str, up: _Node | None, attributes: str = "") -> None:
        self.tag, self.up, self.kids = tag, up, []
        self.points, self.size, self.linked, self.links, self.scored = 0.0, 0, 0, 0, False
        self.words: set[str] = set()
        #: ``out`` is left out of the article; ``named``, for its name alone.
        self.named = tag == "form"
        self.out = tag in _NEVER or self.named
        if attributes:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        hidden = False
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif self.tag not in ("html", "body"):
                self.words.update(_WORDS.findall(_LAYOUT.sub(" ", value)))  # has-sidebar says how the page is laid out
        if self.tag in _HEADING:
            self.words.discard("header")
        if self.tag in ("main", "article"):
            pass
        elif self.words & _OUTSIDE or any(map(_STEMS.search, self.words)):
            self.named |= self.tag not in _NEVER
            self.out = True
        if self.tag == "article" and self.words & {"comment", "comments", "reply", "replies", "ad", "advert", "promo", "sponsored"}:
            self.out = True
        if hidden:
            self.out, self.named = True, False


def parse(html: str) -> _Node:
    """A tolerant tree: unclosed elements end where HTML says they do, stray end tags are ignored."""
    root = _Node("html", None)
    node, at, end = root, 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            node.kids.append(html[at:])
            break
        if tag.start() > at:
            node.kids.append(html[at : tag.start()])
        at = tag.end()
        name = tag.group(1)
        if name is None:
            continue
        name = name.lower()
        if html[tag.start() + 1] == "/":
            node = _closed(node, name)
            continue
        if name in ("html", "body"):
            continue
        if name in _CLOSES:
            node = _implied(node, *_CLOSES[name])
        new = _Node(name, node, tag.group(2) or "")
        node.kids.append(new)
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif name not in _VOID and not (tag.group(2) or "").endswith("/"):
            node = new
    return root


def _closed(node: _Node, name: str) -> _Node:
    look = node
    while look.up is not None:
        if look.tag == name:
            return look.up
        if name not in _BLOCK and look.tag in _WALL:
            break
        look = look.up
    return node


def _implied(node: _Node, ends: frozenset[str], wall: frozenset[str]) -> _Node:
    look, stay = node, node
    while look.up is not None and look.tag not in wall:
        if look.tag in ends:
            stay = look.up
        elif look.tag in _WALL and look.tag not in ends:
            break
        look = look.up
    return stay


def _unlinked(node: _Node, named: bool) -> tuple[int, bool, list[_Node]]:
    """Characters outside links below a node, whether an article or main element has any, and the elements that
    are left out for their names; what is below these counts only with ``named``."""
    size, article, out = 0, False, []
    stack = [(node, False)]
    while stack:
        item, inside = stack.pop()
        for kid in item.kids:
            if isinstance(kid, str):
                n = len(kid.strip())
                size += n
                article |= inside and n > 0
            elif kid.tag == "a":
                continue
            elif not kid.out or (named and kid.named):
                stack.append((kid, inside or kid.tag in ("article", "main")))
            elif kid.named:
                out.append(kid)
    return size, article, out


def _restore(root: _Node) -> None:
    """Take back elements that were left out for their names where hardly any text remains without them: a word such
    as ``sidebar`` may stand on a box around the whole page. The one with the most text comes first; boxes of readers'
    comments only if there are no others."""
    while True:
        size, article, out = _unlinked(root, False)
        if size >= _SHORT or article:
            return
        held = [(not (n.words & _READERS), _unlinked(n, True)[0], n) for n in out]
        held = [h for h in held if h[1] >= _SHORT]
        if not held:
            return
        best = max(held, key=lambda h: h[:2])[2]
        best.out = best.named = False


def _measure(root: _Node) -> list[_Node]:
    """Sizes of text and linked text of every element, and points of the containers; elements with points."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append((node, in_link))
        for kid in node.kids:
            if not isinstance(kid, str) and not kid.out:
                stack.append((kid, in_link or kid.tag == "a"))
    own: dict[int, list[float]] = {}
    for node, in_link in order:
        text = [kid for kid in node.kids if isinstance(kid, str)]
        size = sum(len(t.strip()) for t in text)
        commas = sum(len(_COMMAS.findall(t)) for t in text)
        node.size, node.linked, node.links = size, size if in_link else 0, int(node.tag == "a")
        block = node
        while block.tag not in _BLOCK and block.up is not None:
            block = block.up
        tally = own.setdefault(id(block), [0, 0, 0, block])
        tally[0] += size
        tally[1] += commas
        tally[2] += size if in_link else 0
    for node, _ in reversed(order):
        if node.up is not None:
            node.up.size += node.size
            node.up.linked += node.linked
            node.up.links += node.links
    scored = []
    for size, commas, linked, block in own.values():
        if not size:
            continue
        points = (1 + commas + min(size / 100, 3)) * (1 - linked / size)
        above, level = (block.up, 0) if block.tag in ("p", "li", "pre", *_HEADING) and block.up is not None else (block, 0)
        while above is not None:
            if above.tag in _BLOCK:
                if not above.scored:
                    above.scored = True
                    above.points += _START.get(above.tag, 0.0) + (25.0 if above.words & _INSIDE else 0.0)
                    scored.append(above)
                above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            above = above.up
    return scored


def _worth(node: _Node) -> float:
    return node.points * (1 - node.linked / node.size) if node.size else 0.0


def _blocks(node: _Node, blocks: list[list[str]], in_article: bool) -> None:
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:  # an element ended
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.tag == "br":
            blocks[-1].append(" ")
        elif item.out and in_article and (item.tag == "header" or "header" in item.words):
            stack.extend(reversed(_headings(item)))
        elif not item.out and not _is_menu(item):
            if item.tag in _BLOCK:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(item.kids))


def _headings(node: _Node) -> list[_Node]:
    """Headings of a header inside an article: its title."""
    found, stack = [], list(reversed(node.kids))
    while stack:
        kid = stack.pop()
        if isinstance(kid, str):
            continue
        if kid.tag in _HEADING:
            found.append(kid)
        elif kid.tag not in _NEVER:
            stack.extend(reversed(kid.kids))
    return found


def _is_menu(node: _Node) -> bool:
    return (
        node.tag in ("ul", "ol", "dl", "div", "section", "table", "menu")
        and node.links >= _MENU_LINKS
        and node.linked >= _MENU_SHARE * node.size
    )


def main_text(html: str) -> str:
    """The article of one page, blocks joined by one space; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _restore(root)
    scored = _measure(root)
    if not scored:
        return ""
    best = max(scored, key=_worth)  # of equals the first, which is the innermost met first
    above = best
    while above is not None:
        if above.tag in ("article", "main"):
            best = above
            if above.tag == "article":
                break
        above = above.up
    while best.tag not in ("article", "main") and best.size < _SHORT and best.up is not None:
        best = best.up  # too little to tell an article from its parts
    kept = [best]
    if best.up is not None:
        least = max(10.0, _SIBLING * _worth(best))
        kept = []
        for kid in best.up.kids:
            if kid is best:
                kept.append(kid)
            elif not isinstance(kid, str) and not kid.out:
                loose = kid.tag == "p" and kid.size > 80 and kid.linked < 0.25 * kid.size
                title = kid.tag in _HEADING and best.tag not in ("article", "main")
                if loose or title or (kid.scored and _worth(kid) >= least):
                    kept.append(kid)
    blocks: list[list[str]] = [[]]
    for node in kept:
        _blocks(node, blocks, node.tag in ("article", "main") or bool(node.words & _INSIDE))
        blocks.append([])
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks)
    return " ".join(line for line in lines if line)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty page, and one without text outside menus and the like, has an empty text. Repeated rows and
    null ids each get a row; other columns do not matter.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return html.map(lambda page: main_text(page or ""), na_action=None)

    own = columns_of(pages, page_id=id_col, url=url_col, html=html_col)
    found = own.select("page_id", "url", extract(F.coalesce("html", F.lit(""))).alias("text"))
    return found.select("*", F.length("text").cast("bigint").alias("n_chars"))
