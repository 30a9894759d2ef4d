"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at its block-level tags. The first pass decides on each block by itself, by its length, the share of
its characters that are in links, and the share of its words that are stop words: of a list for four languages, or
those that the page itself repeats most, whichever share is larger, so that other languages and scripts have theirs. Long blocks
rich in stop words are good, blocks of links and long blocks poor in stop words are bad, others are near good,
or short. The second pass gives short and near good blocks the label of their nearest decided neighbours.

The page's own marks come in twice. Being in an article element, or in an element whose class or id has a word such as
`share` beside other words, only moves the shares that a block needs. What is no main text whatever its words
are, prose or not, is bad by its mark: menus, headers, footers, sidebars, forms, hidden elements, and elements whose class,
id or role consists of words for adverts, notices, reader comments and the like. Where a page marks its
article, blocks outside it are bad.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.common import slices

STOP_WORDS = frozenset(
    # English, French, German, Spanish
    """the of and to in a is that it for on was as with be by are this at an from or not have has but they his her she he you we
    were been which their its will would can all there what when who if more about into than them these so no do
    le la les de des du un une et en au aux est que qui dans pour par sur pas avec ce cette ces il elle ils nous vous on ne se sont
    son sa ses plus ou mais comme être avoir fait
    der die das und den dem des ein eine einen einem einer ist im in zu von mit auf für nicht sich es auch als an werden aus er sie
    hat dass nach bei um am wird sind noch wie über so war haben
    el los las y del al que se por con para una su es lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre
    también me hasta hay donde""".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select")}
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_DROP = frozenset("nav footer aside form menu button dialog head label".split())
#: Words in class, id or role that mark an element as boilerplate; those of the second list also name the layout around
#: an article, which is then kept. The third list turns either around ("no-sidebar", "ad-free"). A name that has words of
#: neither the first two nor the last list ("share-price", "related-work") is a weak mark.
_HINTS = frozenset(
    """ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies
    consent gdpr notice notification alert popup modal overlay subscribe subscription newsletter signup login related
    recommended recommendations share sharing social comment comments discussion disqus reply replies respond form
    pagination pager copyright disclaimer breadcrumb breadcrumbs""".split()
)
_LAYOUT = frozenset("banner nav navbar navigation menu sidebar aside widget widgets footer masthead search searchbox toolbar complementary contentinfo".split())
_TURNED = frozenset("no free without has with open closed".split())
_PLAIN = frozenset(
    """box bar block area section panel list item items container wrapper wrap holder inner outer group row column link links
    button buttons icon icons text title body site page main primary secondary global top bottom left right fixed sticky mobile
    desktop small large thread reader readers user count""".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))

#: Characters and shares at which a block's label turns; what a mark adds to or takes off the shares of stop words; words a
#: page must have to learn stop words from, and how many it gives.
SHORT, LONG, STOP_LOW, STOP_HIGH, MAX_LINKS, LEAN, LEAST_WORDS, LEARNED = 70, 200, 0.15, 0.25, 0.3, 0.1, 60, 12
_NO_SPACES = re.compile("[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")


class Block(NamedTuple):
    text: str
    links: int
    inside: bool
    dropped: bool
    weak: bool
    heading: bool


class Open(NamedTuple):
    """An element that is open, with what holds here or above it."""

    tag: str
    dropped: int
    inside: bool
    linked: bool
    weak: bool
    heading: bool


def _marks(tag: str, attrs: str) -> tuple[int, bool, bool]:
    """Whether an element begins boilerplate (2; 1 if by its layout alone), whether it may, and whether it begins the
    main text."""
    main = tag in _MAIN
    level, weak = 2 if tag in _DROP else 0, False
    if not attrs:
        return level, False, main
    marked = 0
    for name, value in _ATTR.findall(attrs):
        value = value.strip("\"'")
        if (name.lower() == "role" and value == "main") or (name.lower() == "itemprop" and value == "articleBody"):
            main = True
            continue
        names = value.split()
        for one in names[:1] if main else names:  # further names of an article tell its state, not what it is
            words = {w.lower() for w in _NAME.findall(one)}
            if words & _TURNED or not words & (_HINTS | _LAYOUT):
                continue
            if words <= _HINTS | _LAYOUT | _PLAIN:
                marked = max(marked, 2 if words & _HINTS else 1)
            else:
                weak = True
    if tag in ("html", "body"):
        marked, weak = 0, False
    if _HIDDEN.search(attrs):
        marked = 2
    return max(level, marked), weak, main and marked < 2


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    found: list[Block] = []
    parts: list[str] = []
    links = 0
    # p and li end at their like; `open_` counts the open elements of each tag.
    stack = [Open("", 0, False, False, False, False)]
    open_: Counter = Counter()
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal links
        if parts:
            if text := " ".join("".join(parts).split()):
                top = stack[-1]
                found.append(Block(text, links, top.inside, top.dropped > 0, top.weak, top.heading))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].linked:
            links += len("".join(text.split()))

    def close(tag: str, limits: frozenset[str] = frozenset()) -> None:
        if not open_[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                for e in stack[i:]:
                    open_[e.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    def after_inline(tag: str, at: int) -> int:
        """Where the inline element that began before `at` ends, with those of its kind in it; `at` if it has no end."""
        if tag in unclosed:
            return at
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
            depth += -1 if m[1] else 1
            if not depth:
                return m.end()
        unclosed.add(tag)
        return at

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            if not re.match(r"<[/!?a-zA-Z][^>]*\Z", page[(cut := page.rfind("<", at)) :] if page.rfind("<", at) >= 0 else ""):
                add(page[at:])
            else:  # a tag that the end of the page cuts off
                add(page[at:cut])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        ending, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag in _BLOCK:
                flush()
                close(tag)
            elif tag == "a":
                close(tag, _BLOCK)
            continue
        if tag in _RAW_END:
            if not attrs.endswith("/"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append("\n")
        if tag in _BLOCK:
            flush()
            if tag in ("p", "li", "dd", "dt", "td", "th", "tr"):
                close(tag, _BLOCK - {tag, "p"})
            elif stack[-1].tag == "p":
                close("p", _BLOCK - {"p"})
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _BLOCK or tag == "a" or attrs:
            drop, weak, main = _marks(tag, attrs)
            top = stack[-1]
            dropped = top.dropped
            if tag == "header" and not top.inside:
                drop = 2
            if main and dropped < 2:
                dropped = 0
            if tag in _BLOCK:
                begins = main and dropped < 2
                stack.append(Open(tag, max(dropped, drop), top.inside or begins, top.linked, weak or (top.weak and not begins), top.heading or tag in _HEADINGS))
                open_[tag] += 1
            elif tag == "a":
                stack.append(top._replace(tag=tag, dropped=dropped, linked=True))
                open_[tag] += 1
            elif drop == 2 and tag in ("span", "ins", "button", "label"):
                # An inline element of boilerplate is a block of its own.
                flush()
                at = after_inline(tag, at)
    flush()
    return found


def _words(text: str) -> list[str]:
    """In lower case; characters of scripts that leave no space between words count as words."""
    return _NO_SPACES.findall(text) or _WORD.findall(text.lower())


def _learned(words: list[list[str]]) -> frozenset[str]:
    """The words that a page repeats most, over the blocks that are not links or boilerplate."""
    total = sum(map(len, words))
    if total < LEAST_WORDS:
        return frozenset()
    counts = Counter(w for block in words for w in block)
    return frozenset(w for w, n in counts.most_common(LEARNED) if n > 2 and n * 200 >= total)


def labels(page: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    marked = any(b.inside and not b.dropped for b in page)
    out_of_it = [b.dropped or (marked and not b.inside) or b.links > MAX_LINKS * len(b.text.replace(" ", "")) for b in page]
    words = [[] if bad else _words(b.text) for b, bad in zip(page, out_of_it, strict=True)]
    learned = _learned(words)
    first: list[str] = []
    for b, bad, own in zip(page, out_of_it, words, strict=True):
        if bad:
            first.append("bad")
            continue
        n = len(b.text)
        stops = max(sum(map(known.__contains__, own)) for known in (STOP_WORDS, learned)) / max(1, len(own))
        stops += LEAN * (b.inside - b.weak)
        if not b.inside and n < LONG and ("©" in b.text or "copyright" in b.text.lower()):
            first.append("bad")
        elif n < SHORT:
            first.append("bad" if (b.links or b.weak) and not b.inside else "short")
        elif stops >= STOP_HIGH and (n > LONG or b.inside):
            first.append("good")
        elif stops >= STOP_LOW or (b.inside and not b.weak):
            first.append("near")
        else:
            first.append("bad")
    out = [x == "good" for x in first]
    before, after = _nearest(first, page), _nearest(first[::-1], page[::-1])[::-1]
    for i, (x, b) in enumerate(zip(first, page, strict=True)):
        around = {before[i], after[i]}
        if b.weak and x in ("near", "short"):
            out[i] = around == {"good"}
        elif x == "near" or (x == "short" and b.inside):
            out[i] = around != {"bad"}
        elif x == "short":
            out[i] = around in ({"good"}, {"good", None}) or (b.heading and after[i] == "good")
    return out


def _nearest(first: list[str], page: list[Block]) -> list[str | None]:
    """The label of the last decided block before each, among blocks on the same side of the article's bounds;
    what is boilerplate by its element says nothing about the article around it."""
    last: dict[bool, str] = {}
    found = []
    for x, b in zip(first, page, strict=True):
        found.append(last.get(b.inside))
        if x in ("good", "bad") and not (b.inside and b.dropped):
            last[b.inside] = x
    return found


def extract(page: str | None) -> str:
    """The main text: its blocks in page order, joined by one space."""
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, labels(found), strict=True) if good)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Return page_id, url, text (empty if none) and n_chars, its code points, of every row.

    Null and empty html give empty text. Repeated rows stay; an empty table gives no rows; other columns are
    not read, whatever their names.
    """
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return read.mapInArrow(run, f"{kinds}, text string, n_chars long")
