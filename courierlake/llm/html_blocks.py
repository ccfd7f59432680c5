"""Main text of HTML pages by two-pass block rules.

A scanner cuts the page into blocks at block-level tags and notes for each its
text, link characters and enclosing containers. Two rules of structure come
first: containers that hold no article text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments of readers) are out, but not
a main element in them, nor an article that is longer than those elsewhere, nor
a form that holds more text than the rest of the page; and where a page has an
article container, what is outside of it is out, but for the page's one h1
before it if it has none itself. A class, id or role says so by itself only if
all its parts do or are words of layout (comment-list), or if its last part can
mean nothing else (fb-comments). Other names with such a part
(elementor-widget-container) are evidence beside the densities: what bears one
is out unless it holds most of the page's text; on an element of running text
and on headings they say nothing. All other blocks are decided by their text:

1. First pass, by densities. A block of more than MAX_LINKS link text is out; in
   an article container it stays open, and a heading is in. A block of LONG
   characters is in if MIN_STOP of its words are stop words, out if fewer than
   LOW_STOP are (in an article container it stays open), and open in between. If
   no list fits the language of the page, length alone decides. Shorter blocks
   stay open.
2. Second pass. An open block takes the label of its nearest decided neighbours
   in the same container; where a container has none, an article container is
   in; in any other that has no block that is in, blocks without links are.

The scanner reads each character a bounded number of times, whatever is broken:
tags and their attributes by the rules of HTML (a quote opens a value only after
an equals sign), open elements counted by name, and inline elements but for
links not tracked.

One pass over the rows with no shuffle and no key; a worker holds one page and
its blocks. Defined results: a null or empty page gives an empty text; broken
or truncated markup is read to its end, past a head or an embedded element that
is never closed (scripts, styles, text areas and comments run to the end, and a
tag that is cut off ends the page); very long pages are read whole; repeated
rows repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import rows_of, slices, small_batches

# Elements of HTML by what they mean for text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header head hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math textarea noembed noframes xmp title".split())
TO_END = frozenset("script style textarea".split())
# Start tags that can stand in a head; any other ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
OUT = frozenset("nav footer aside form menu button select dialog fieldset search".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE = frozenset("html head body".split())
# Elements of running text: a doubtful name on one says nothing.
TEXT = frozenset("p pre blockquote li td th dd dt caption figcaption".split())
# Words in class, id and role names that mark what is not article text.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs"
    " footer masthead topbar header cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended"
    " comment comments disqus replies respond widget toolbar pagination pager complementary contentinfo search".split()
)
# Those that say so whatever they are the last part of: fb-comments.
LAST_WORDS = frozenset("ads adverts advertisement advertisements sidebar navbar navigation breadcrumb breadcrumbs footer cookies newsletter comments disqus replies pagination".split())
# Words of layout, which leave the meaning of a name to its other parts: comment-list.
LAYOUT_WORDS = frozenset(
    "site page main global top bottom left right upper lower inner outer first last primary secondary mobile desktop sticky fixed wide small large"
    " area bar block body box btn button buttons card cell col column container content cta group icon icons inline item items label layer line link links list module pane panel region row section side"
    " slot space strip text title unit view wrap wrapper form field input post posts article articles entry story page pages user reader author tag tags js id ul li div".split()
)
# Before header or title these say that it is the article's own: entry-header.
OWN_WORDS = frozenset("article articles entry page post story content section chapter".split())
# Names that say what surrounds the element rather than what it is: has-sidebar.
AROUND = re.compile(r"(?<![^\s_-])(?:has|with|without|no)[_-]+[a-z]+", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|post-body|entry|entry-content|content|main|main-content|story|story-body|text)(?:$|[\s_-])", re.I)
# The commonest function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or that the they this to was were which with you"
    " aber als auch auf aus bei das dem den der des die ein eine einen er es für im ist mit nicht sich sie sind und von war wie wird zu zum"
    " au aux avec ce cette dans de des du elle en est et il la le les mais ne pas par plus pour qu que qui se son sur un une"
    " al con como de del el en es esta la las lo los más no para pero por que se sin su sus un una y".split()
)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+|=[^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]*+))?")
TAG_END = re.compile(r"[\s/]*+>")
NAMING = frozenset(("class", "id", "role"))
TITLE_WORDS = frozenset("header title".split())
PARTS = re.compile("[-_]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[^\W\d_]+")
LONG, MAX_LINKS, MIN_STOP, LOW_STOP = 140, 0.5, 0.12, 0.04


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    article: int
    group: int
    head: bool = False
    root: int = 0
    saved: bool = False
    forms: tuple[int, ...] = ()
    doubtful: tuple[str, ...] = ()
    title: bool = False


@dataclass
class Level:
    tag: str
    out: bool
    article: int
    group: int
    link: bool
    root: int = 0  # the outermost article container
    saved: bool = False  # an article inside what holds no article text
    forms: tuple[int, ...] = ()  # open forms outside articles
    doubtful: tuple[str, ...] = ()  # names around that may mark what is no article text


@dataclass
class Tag:
    """A tag: its name, whether it closes, where it ends, the names it bears, and whether it is hidden or closes itself."""

    name: str
    closes: bool
    end: int
    names: str = ""
    hidden: bool = False
    empty: bool = False


def read_tag(html: str, at: int) -> Tag | None:
    """The tag that begins at a less-than sign and a letter or slash; None if the page ends in it."""
    m = NAME.match(html, at + 1)
    tag = Tag(m[2].lower(), bool(m[1]), 0)
    place, names = m.end(), []
    while True:
        end = TAG_END.match(html, place)
        if end:
            tag.end, tag.names, tag.empty = end.end(), " ".join(names), html[end.end() - 2] == "/"
            return tag
        a = ATTRIBUTE.match(html, place)
        if not a:
            return None
        place = a.end()
        key, value = a[1].lower(), a[2] or ""
        if key in NAMING:
            names.append(value.strip("\"'"))
        elif key == "hidden" or (key == "style" and UNSEEN.search(value)):
            tag.hidden = True


@dataclass
class Scan:
    """Blocks of one page, and what is open at the scanner's place."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    groups: int = 0
    stack: list[Level] = field(default_factory=lambda: [Level("", False, 0, 0, False)])
    open: Counter = field(default_factory=Counter)

    def end(self) -> None:
        """A block ends here."""
        at = self.stack[-1]
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, at.out, at.article, at.group, at.tag in HEADINGS, at.root, at.saved, at.forms, at.doubtful, at.tag == "h1"))
        self.parts, self.linked = [], 0

    def add(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.stack[-1].link:
                self.linked += len(text.strip())

    def push(self, level: Level) -> None:
        self.stack.append(level)
        self.open[level.tag] += 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.open[tag] -= 1
        return tag


def scan(html: str) -> list[Block]:
    """Blocks in page order."""
    s = Scan()
    ends: dict[str, dict[int, int]] = {}
    place, text, size = 0, 0, len(html)
    while True:
        at = html.find("<", place)
        if at < 0 or at + 1 >= size:
            s.add(html[text:])
            break
        sign = html[at + 1]
        if sign in "!?" or (sign == "/" and not html[at + 2 : at + 3].isascii()) or (sign == "/" and not html[at + 2 : at + 3].isalpha()):
            s.add(html[text:at])
            close = html.find("-->", at + 2) + 2 if html.startswith("<!--", at) else html.find(">", at + 2)
            text = place = close + 1 if close > at else size
            continue
        if sign != "/" and not (sign.isascii() and sign.isalpha()):
            place = at + 1  # a less-than sign of the text
            continue
        s.add(html[text:at])
        tag = read_tag(html, at)
        if tag is None:
            break
        text = place = tag.end
        if s.stack[-1].tag == "head" and not tag.closes and tag.name not in HEAD:
            shut(s, "head")
        if tag.name in TO_END:
            if not tag.closes and not tag.empty:
                close = re.compile(rf"</{tag.name}\s*+>", re.I).search(html, place)
                text = place = close.end() if close else size
        elif tag.name in RAW:
            if not tag.closes and not tag.empty:
                if tag.name not in ends:
                    ends[tag.name] = pairs(html, tag.name)
                text = place = ends[tag.name].get(at, place)
        elif tag.name == "br":
            s.parts.append(" ")
        elif tag.name == "hr":
            s.end()
        elif tag.closes:
            shut(s, tag.name)
        elif tag.name == "a":
            if s.stack[-1].tag == "a":
                s.pop()
            s.push(replace(s.stack[-1], tag="a", link=True))
        elif tag.name in BLOCK:
            start(s, tag)
    s.end()
    return s.blocks


def pairs(html: str, tag: str) -> dict[int, int]:
    """Where each element of the tag begins, and where its end tag ends; those without one are left out."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+>", re.I).finditer(html, 0, html.rfind(">") + 1):
        if not m[1]:
            if not m[0].endswith("/>"):
                begun.append(m.start())
        elif begun:
            found[begun.pop()] = m.end()
    return found


def standing(names: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a name says by itself that an element holds no article text, and the names that may say so."""
    doubtful = []
    for name in AROUND.sub(" ", names).lower().replace("side-bar", "sidebar").split():
        parts = [p for p in PARTS.split(name) if p]
        if not any(p in OUT_WORDS for p in parts) or (len(parts) > 1 and parts[-1] in TITLE_WORDS and parts[-2] in OWN_WORDS):
            continue
        if parts[-1] in LAST_WORDS or all(p in OUT_WORDS or p in LAYOUT_WORDS or p.isdigit() for p in parts):
            return True, ()
        doubtful.append(name)
    return False, tuple(doubtful)


def start(s: Scan, tag: Tag) -> None:
    """A block element opens."""
    s.end()
    name = tag.name
    if name in ("p", "li") and any(x.tag == name for x in s.stack[-3:]):  # an unclosed one ends here
        while s.pop() != name:
            pass
    top = s.stack[-1]
    new = replace(top, tag=name)
    if name not in PAGE:
        named, doubtful = standing(tag.names) if tag.names and name not in HEADINGS else (False, ())
        named_out = tag.hidden or named
        if name in ARTICLE or (tag.names and not named_out and not doubtful and ARTICLE_NAMES.search(tag.names)):
            s.groups += 1
            if not top.article:
                new.root = s.groups
            if name in ARTICLE:
                new.forms = ()
            if top.out and name == "main" and not s.open["article"] and not s.open["main"]:
                new.out, new.saved, new.root = False, False, s.groups
            elif top.out and name == "article" and not s.open["article"]:
                new.out, new.saved, new.root = False, True, s.groups
            new.article, new.group = top.article + 1, s.groups
        elif name == "form" and not top.article and not named_out:
            if not top.forms:  # forms do not nest
                s.groups += 1
                new.group, new.forms = s.groups, (s.groups,)
        elif name in OUT or named_out or (name == "header" and not top.article):
            s.groups += 1
            new.out, new.group = True, s.groups
        elif doubtful and name not in TEXT:
            s.groups += 1
            new.doubtful, new.group = (*top.doubtful, *doubtful), s.groups
    new.out = new.out or name == "head"
    s.push(new)


def shut(s: Scan, name: str) -> None:
    """An end tag: elements open inside end with it, and a link ends with its own only."""
    if name == "a":
        if s.stack[-1].tag == "a":
            s.pop()
    elif name in BLOCK:
        s.end()
        if s.open[name]:
            while s.pop() != name:
                pass


def settle(blocks: list[Block]) -> None:
    """Mark as out the forms and the articles inside other containers that are not what the page is about."""

    def plain(b: Block) -> int:
        return 0 if b.linked > MAX_LINKS * len(b.text) else len(b.text)

    if any(b.doubtful for b in blocks):
        # a name that stands for most of the page's text, by the first pass, is no evidence
        named: Counter = Counter()
        whole = 0
        for b in blocks:
            if not b.out and plain(b) and (len(b.text) < LONG or density(b) >= LOW_STOP):
                whole += len(b.text)
                for name in set(b.doubtful):
                    named[name] += len(b.text)
        for b in blocks:
            b.out |= any(2 * named[name] <= whole for name in b.doubtful)
    if any(b.forms for b in blocks):
        # characters and number of blocks, of all and of those in article containers; key 0 is the page
        sums: dict[int, list[int]] = {}
        for b in blocks:
            if not b.out:
                for key in (0, *b.forms):
                    n = sums.setdefault(key, [0, 0, 0])
                    n[0] += plain(b)
                    n[1] += plain(b) if b.article else 0
                    n[2] += bool(b.article)
        page = sums.get(0, [0, 0, 0])
        about = {f for f, n in sums.items() if n[0] > (page[1] - n[1] if page[2] > n[2] else page[0] - n[0])}
        for b in blocks:
            b.out |= any(f not in about for f in b.forms)
    if any(b.saved for b in blocks):
        sizes: dict[tuple[bool, int], int] = {}
        for b in blocks:
            if b.article and not b.out:
                sizes[b.saved, b.root] = sizes.get((b.saved, b.root), 0) + len(b.text)
        usual = [n for (saved, _), n in sizes.items() if not saved]
        least = max(usual) if usual else sum(plain(b) for b in blocks if not b.out and not b.article)
        for b in blocks:
            b.out |= b.saved and sizes.get((True, b.root), 0) <= least


def own_title(blocks: list[Block]) -> None:
    """Leave the mark of a title only to the page's one h1 before an article container that has none."""
    first = next((i for i, b in enumerate(blocks) if b.article and not b.out), 0)
    inside = any(b.title and b.article and not b.out for b in blocks)
    found = [i for i, b in enumerate(blocks[:first]) if b.title and not b.out and b.linked <= MAX_LINKS * len(b.text)]
    for i, b in enumerate(blocks):
        b.title = not inside and found == [i]


def density(b: Block) -> float:
    """Share of stop words of the four languages."""
    words = [w.lower() for w in WORD.findall(b.text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def decide(b: Block, has_article: bool, known: bool) -> tuple[bool | None, str]:
    """First pass: in, out or open, and the rule that says so."""
    if b.out:
        return False, "container"
    if has_article and not b.article:
        return (True, "title") if b.title else (False, "outside")
    if b.linked > MAX_LINKS * len(b.text):
        return (True if b.head else None) if b.article else False, "links"
    if len(b.text) < LONG:
        return None, "short"
    if not known:
        return True, "length"
    share = density(b)
    if share >= MIN_STOP:
        return True, "stop words"
    return (False if share < LOW_STOP and not b.article else None), "few stop words"


def in_known_language(blocks: list[Block]) -> bool:
    """Whether most long text has the stop words of a list; if not, they tell nothing about the page."""
    long = [b for b in blocks if not b.out and len(b.text) >= LONG and b.linked <= MAX_LINKS * len(b.text)]
    return 2 * sum(len(b.text) for b in long if density(b) >= MIN_STOP) >= sum(len(b.text) for b in long)


def first_pass(blocks: list[Block]) -> list[tuple[bool | None, str]]:
    """Label and rule of each block."""
    settle(blocks)
    has_article = any(b.article and not b.out for b in blocks)
    own_title(blocks)
    known = in_known_language(blocks)
    return [decide(b, has_article, known) for b in blocks]


def second_pass(blocks: list[Block], first: list[bool | None]) -> list[bool]:
    """Labels of all blocks: open ones take those of their neighbours."""
    first = list(first)
    kept = {b.group for b, label in zip(blocks, first, strict=True) if label}
    for i, b in enumerate(blocks):
        if first[i] is None and not b.article and not b.linked and b.group not in kept:
            first[i] = True
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            near[i] = last.get(blocks[i].group)
            if first[i] is not None:
                last[blocks[i].group] = i
    out = []
    for i, label in enumerate(first):
        if label is None:
            a, b = before[i], after[i]
            if a is None and b is None:
                label = bool(blocks[i].article)
            elif a is None or b is None:
                label = first[b if a is None else a]
            elif i - a == b - i:
                label = bool(first[a] or first[b])
            else:
                label = first[a if i - a < b - i else b]
        out.append(bool(label))
    return out


def labels(blocks: list[Block]) -> list[bool]:
    """Both passes."""
    return second_pass(blocks, [label for label, _ in first_pass(blocks)])


def main_text(html: str) -> str:
    blocks = scan(html)
    return "\n".join(b.text for b, keep in zip(blocks, labels(blocks), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield rows_of(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    small_batches(pages.sparkSession)
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
