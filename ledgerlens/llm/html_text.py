"""Main text of web pages by flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  Each block is described by its
word count and link density, those of its two neighbours, whether it lies in
a main container or in a part marked as menu, footer, advert and the like,
and by the longest unmarked block of the page, which tells short pages.  A
decision tree, grown here on a small labelled table of such descriptions,
tells the blocks of the article from the rest.  In a main container a block
that is one link belongs to the article, unless it stands among short links.

Null or empty html gives an empty text.  Unclosed, cut-off and unknown tags
are tolerated; whole pages are read, however long.  Repeated rows are
treated one by one.  An empty table gives an empty result.  Columns other
than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins "
                   "kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u "
                   "var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe"  # hold no tags
HIDDEN = frozenset("head noscript template svg math object select button".split())
FOREIGN = frozenset(("svg", "math"))
OPTIONS = frozenset(("option", "optgroup"))
IN_HEAD = frozenset("base link meta title script style noscript template".split())
#: Tags that end an <svg> or <math> left open, as in browsers.
BREAK_OUT = frozenset("article aside blockquote body center dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr "
                      "li main menu nav ol p pre section table ul".split())
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial adbox adslot adunit "
    "adspace adwrap adframe adbanner adsense adsbygoogle adchoices banner sidebar comment comments reply replies disqus "
    "cookie cookies notice consent gdpr popup modal share sharing social related recommended promo "
    "sponsor sponsored newsletter subscribe breadcrumb breadcrumbs menu nav navbar navigation "
    "footer header masthead login signup search widget toolbar pagination pager copyright "
    "disclaimer skip complementary contentinfo form alert".split())
#: Words that a name of a marked part may hold besides: share-box, main-nav, related-posts.
PLAIN_NAMES = frozenset(
    "box bar block list wrapper wrap container area section link links button buttons icon icons item items "
    "inner outer site page main top bottom left right primary secondary post posts entry article "
    "articles body text title widget widgets holder user users reader readers visitor visitors guest "
    "guests customer facebook fb thread threads feed latest recent new count all top your slot unit space zone".split())
#: Names of a part with readers' comments.
SAID_NAMES = frozenset("comment comments reply replies disqus".split())
#: Names that an <article> bears which holds a reader's comment, not the page's article.
COMMENT_NAMES = frozenset("comment comment-item comment-body reply reply-item".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|"
    r"</?[a-z](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>|</?[a-z][^<>]*(?:>|\Z)|<[!?][^<>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL)
_NAME = re.compile(r"</?([a-z][a-z0-9:-]*)", re.IGNORECASE)
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^<>]*(?:>|\Z)", re.IGNORECASE) for n in RAW.split("|")}
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_HREF = re.compile(r"[\s\"'/]href\s*=", re.IGNORECASE)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_LETTERS = re.compile(r"[a-z]{2,}")


def _marked(tag: str, names: frozenset[str] = ASIDE_NAMES) -> bool:
    """Whether a whole class, id or role names a part that is not the article.

    ``has-sidebar`` or ``search-results`` do not: all words of the name must
    be of ``names`` or plain, and one of ``names``.
    """
    for v in _NAMED.findall(tag):
        for name in v.strip("\"'").lower().split():
            words = set(_LETTERS.findall(name))
            if words & names and words <= names | ASIDE_NAMES | PLAIN_NAMES:
                return True
    return False


def _commented(tag: str) -> bool:
    """Whether a tag's class, id or role is, as a whole name, that of a reader's comment."""
    return any(n in COMMENT_NAMES
               for v in _NAMED.findall(tag) for n in v.strip("\"'").lower().split())


def text_blocks(html: str | None) -> list[tuple[str, int, float, int, int]]:
    """Blocks of a page: text, words, link density, in a main container, in a marked part.

    What a hidden element holds is dropped at its own end tag.  One that is
    closed by the end of an enclosing element, or of the page, only drops its
    text up to the next tag of a block.

    A <main> is a main container wherever it stands.  If no main container
    outside marked parts holds text, a <form> or a part marked by its name may
    be a wrapper around the page: it is, if its articles -- or, of a form
    without any, its blocks -- hold more words than all blocks outside marked
    parts.  Menus, footers, <aside> and comments are never wrappers.
    """
    blocks, parts, stack, opened, endless = [], [], [], Counter(), set()
    linked = link = across = link_depth = foreign = 0
    level = [0] * 5  # open: sure asides, named asides, forms, main containers, articles in a wrapper

    def end(name: str = "") -> None:
        nonlocal linked, link
        words = unescape("".join(parts)).split()
        if words:
            blocks.append((" ".join(words), len(words), min(1.0, linked / len(words)), *level))
        parts.clear()
        linked = 0
        link = link and across
        if stack and stack[-1][2] is not None and stack[-1][3] is None and name not in OPTIONS:
            stack[-1][3] = len(blocks)

    def pop(own: bool) -> str:
        """Closes the innermost element, by its own end tag or not."""
        nonlocal level, foreign, link
        name, before, first, own_end = stack.pop()
        opened[name] -= 1
        level, foreign = before, foreign - (name in FOREIGN)
        if first is not None:
            del blocks[first:None if own else own_end]
        if len(stack) < link_depth:
            link = 0
        return name

    def seen(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece.split())

    at, html = 0, html or ""
    while m := _TOKEN.search(html, at):
        seen(html[at:m.start()])
        at = m.end()
        tag = m.group()
        named = _NAME.match(tag)
        if not named:
            continue
        name = named.group(1).lower()
        if stack and stack[-1][0] == "head" and tag[1] != "/" and name not in IN_HEAD:
            end()
            pop(False)
        if name in _RAW_END and tag[1] != "/":
            end()
            last = None if name in endless else _RAW_END[name].search(html, at)
            if last:
                at = last.end()
            elif name in ("script", "style"):  # the rest of the page, as in browsers
                at = len(html)
            else:
                endless.add(name)
                if name == "title":  # up to the next tag
                    after = html.find("<", at)
                    at = after if after >= 0 else len(html)
            continue
        if name in INLINE:
            if name == "a":
                link = int(tag[1] != "/" and _HREF.search(tag) is not None)
                if link:  # over several blocks only if its end tag comes before another link
                    after = _ANCHOR.search(html, at)
                    across, link_depth = int(after is not None and after.group(1) == "/"), len(stack)
            elif name == "br":
                parts.append(" ")
            continue
        end(name)
        if tag[1] == "/":
            if opened[name]:
                while pop(stack[-1][0] == name) != name:
                    pass
            continue
        if name == "body":
            while opened["head"]:
                pop(False)
        if foreign and name in BREAK_OUT:
            while foreign:
                pop(False)
        if tag.endswith("/>") and (foreign or name in FOREIGN):
            continue
        if name != "p" and name not in VOID and name not in OPTIONS:
            before, level = level, list(level)
            said = _commented(tag)
            if name == "main" and not said:
                level = [0, 0, 0, 1, 0]
            elif name == "article" and not said and not level[0]:
                if level[1] or level[2]:
                    level[4] = sum(level[1:3])  # marks outside it
                else:
                    level[3] += 1
            elif name in ASIDE_TAGS or (name == "header" and not level[3] and not level[4]):
                level[0] += 1
            elif name not in ("body", "html") and (said or _marked(tag)):
                level[0 if said or _marked(tag, SAID_NAMES) else 1] += 1
            elif name == "form":
                level[2] += 1
            stack.append([name, before, len(blocks) if name in HIDDEN else None, None])
            opened[name] += 1
            foreign += name in FOREIGN
    seen(html[at:])
    end()
    while stack:
        pop(False)
    return _placed(blocks)


def _placed(blocks: list[tuple]) -> list[tuple[str, int, float, int, int]]:
    """Blocks with their place: in a main container, in a marked part that is no wrapper."""
    def words(chosen: Callable[[tuple], bool]) -> int:
        return sum(b[1] for b in blocks if b[2] < 0.5 and not b[3] and chosen(b))

    def of(main: Callable[[tuple], bool], aside: Callable[[tuple], bool]) -> list[tuple]:
        return [(*b[:3], int(main(b)), int(aside(b))) for b in blocks]

    def marked(b: tuple) -> bool:
        return any(b[3:6])

    if not any(b[6] and not marked(b) for b in blocks):
        outside = words(lambda b: not marked(b))
        if words(lambda b: b[7] == b[4] + b[5] > 0) > outside:
            return of(lambda b: b[7], lambda b: b[3] or b[7] != b[4] + b[5])
        if words(lambda b: not b[4] and b[5]) > outside:
            return of(lambda b: 0, lambda b: b[3] or b[4])
    return of(lambda b: b[6], marked)


def describe(blocks: list[tuple]) -> list[tuple[float, ...]]:
    """Features of each block: own, previous and next words and link density, and its place."""
    some_main = float(any(b[3] for b in blocks))
    longest = max((b[1] for b in blocks if b[2] < 0.5 and not b[4]), default=0)
    edge = ("", 0, 0.0, 0, 0)
    return [(b[1], b[2], p[1], p[2], n[1], n[2], float(b[3]), float(b[4]), some_main, longest)
            for p, b, n in zip([edge, *blocks], blocks, [*blocks[1:], edge])]


def labelled_blocks() -> list[tuple[tuple[float, ...], int]]:
    """The small labelled table: features of blocks, and 1 for those of an article."""
    rows = []

    def add(label: int, *features: float, longest: int = 60) -> None:
        rows.append(((*features, longest), label))

    sizes = ((1, 0), (3, 2), (8, 30), (25, 4), (60, 80), (200, 1))
    for words, near in sizes:
        for prev, nxt in ((near, 40), (40, near), (near, near)):
            for longest in (3, 60, 400):
                add(1, words, 0.0, prev, 0.0, nxt, 0.0, 1, 0, 1, longest=longest)  # in the article
                add(1, words, 0.2, prev, 1.0, nxt, 0.0, 1, 0, 1, longest=longest)
                add(1, words, 0.0, prev, 1.0, nxt, 1.0, 1, 0, 1, longest=longest)
                add(1, words, 0.1, prev, 0.0, nxt, 1.0, 1, 0, 1, longest=longest)
                add(1, words, 1.0, prev, 0.0, nxt, 0.0, 1, 0, 1, longest=longest)  # one link
                add(1, words, 1.0, prev, 0.0, nxt, 1.0, 1, 0, 1, longest=longest)
                add(1, words, 1.0, prev, 1.0, nxt, 0.0, 1, 0, 1, longest=longest)
                add(0, words, 0.0, prev, 0.0, nxt, 0.0, 0, 0, 1, longest=longest)  # beside the article
                add(0, words, 0.0, prev, 0.0, nxt, 1.0, 0, 0, 1, longest=longest)
                add(0, words, 0.0, prev, 0.0, nxt, 0.0, 1, 1, 1, longest=longest)  # marked parts
                add(0, words, 0.3, prev, 0.0, nxt, 0.5, 1, 1, 1, longest=longest)
                for d, main in ((0.0, 1), (0.0, 0), (1.0, 1), (1.0, 0)):
                    add(0, words, d, prev, 1.0 - d, nxt, 0.0, main, 1, 1, longest=longest)
                    add(0, words, 1.0, prev, d, nxt, 1.0 - d, main, 1, 1, longest=longest)
                add(0, words, 0.3, prev, 1.0, nxt, 1.0, 0, 1, 1, longest=longest)
                add(0, words, 0.0, prev, 0.0, nxt, 0.0, 0, 1, 0, longest=longest)
                add(0, words, 1.0, prev, 1.0, nxt, 1.0, 0, 0, 0, longest=longest)
    for near in (1, 2, 3, 5, 9, 30):  # links among links: long ones are text, short ones a list of links
        for words in (5, 8, 25):
            add(1, words, 1.0, near, 1.0, near, 1.0, 1, 0, 1)
        for words in (1, 2, 3):
            add(0, words, 1.0, near, 1.0, near, 1.0, 1, 0, 1)
    for words in (20, 35, 60, 150, 400):  # pages without container
        for d in (0.0, 0.2):
            for p, n in ((30, 30), (0, 30), (30, 0), (4, 4)):
                add(1, words, d, p, 0.0, n, 0.0, 0, 0, 0, longest=max(words, p, n))
        add(1, words, 0.1, 3, 1.0, 30, 0.0, 0, 0, 0, longest=max(words, 30))
        add(1, words, 0.1, 30, 0.0, 3, 1.0, 0, 0, 0, longest=max(words, 30))
    for words in (1, 3, 6, 9):
        add(1, words, 0.0, 40, 0.0, 40, 0.0, 0, 0, 0)
        add(1, words, 0.0, 25, 0.0, 60, 0.1, 0, 0, 0)
        for p, d in ((0, 0.0), (3, 0.0), (2, 1.0), (6, 1.0)):  # a heading
            add(1, words, 0.0, p, d, 40, 0.0, 0, 0, 0)
            add(1, words, 0.0, p, d, 25, 0.1, 0, 0, 0, longest=120)
        add(0, words, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0)
        add(0, words, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0)
        add(0, words, 0.0, 0, 0.0, 2, 0.5, 0, 0, 0)
        for p in (0, 1, 2, 4, 9):  # short pages
            for n in (0, 1, 2, 4, 9):
                add(1, words, 0.0, p, 0.0, n, 0.0, 0, 0, 0, longest=max(words, p, n))
                add(1, words, 0.0, p, 1.0, n, 0.0, 0, 0, 0, longest=max(words, n))
                for near in (0.0, 1.0):
                    add(0, words, 1.0, p, near, n, 1.0, 0, 0, 0, longest=0 if near else max(p, 1))
                    add(0, words, 1.0, p, near, n, 0.0, 0, 0, 0, longest=max(n, 1))
    return rows


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: a label, or (feature, limit, tree up to it, tree above)."""
    labels = [y for _, y in rows]
    most = int(2 * sum(labels) >= len(labels))
    if not depth or len(set(labels)) < 2:
        return most

    def impurity(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            low = [r for r in rows if r[0][f] <= (a + b) / 2]
            high = [r for r in rows if r[0][f] > (a + b) / 2]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0]:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None or best[0] >= impurity(rows) - 1e-12 and depth < 2:
        return most
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def decide(tree: tuple | int, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(html: str | None, tree: tuple | int) -> str:
    blocks = text_blocks(html)
    return " ".join(b[0] for b, x in zip(blocks, describe(blocks)) if decide(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    ready(pages)
    tree = grow(labelled_blocks())

    @F.pandas_udf("string")
    def article(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in parts:
            yield pd.Series([main_text(h, tree) for h in htmls], dtype=object)

    got = pages.select("page_id", "url", article("html").alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
