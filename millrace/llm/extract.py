"""Main text of HTML by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone, in this order: mostly link text
is boilerplate; a block marked as menu, header, footer, sidebar, notice, advert, form or comment section (a declared
feature: element, role, words of class or id) is boilerplate, as density cannot tell a reader's comment from prose; a
long block that is dense in stop words is text, and a long one with hardly any is boilerplate unless its container says
that it is the main text; all else, short blocks and dense ones of middle length, is open. If nothing is text by then,
the dense ones of middle length are.

In the second pass an open block inherits the label of its nearest decided neighbours. If they differ, it is text where
its container is the text side's. The edges of a page count as decided neighbours that are boilerplate, those of an
article or main element as ones that are text; where a class or id only hints at the main text, open blocks stay that are not short, or have no decided neighbours.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one newline in
page order. A null or empty page gives an empty text; malformed and cut-off markup is read as far as it goes; pages of
any length are read whole; repeated rows are read each by itself; an empty table gives no rows; extra columns are ignored.
A page is one row's work: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Elements by their role in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNREAD = frozenset("script style noscript template iframe object embed svg math canvas audio video head title select option textarea button datalist map".split())
RAW = frozenset("script style iframe noscript textarea title xmp noembed noframes".split())
BOILER = frozenset("nav header footer aside form menu dialog search fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner breadcrumb breadcrumbs nav navbar navigation menu menubar header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login comment comments disqus respond share sharing social related recommended pagination pager toolbar topbar topnav commentlist adsbygoogle skip copyright legal disclaimer".split())
BODY = frozenset(("article", "main"))
BODY_WORDS = frozenset("article main content post entry story".split())
AD_WORDS = frozenset("ad ads advert advertisement sponsored adsbygoogle".split())
INLINE = frozenset("span ins a".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th option p".split())

# Function words of the four languages.
STOP_WORDS = frozenset(
    "the of and to a in is that for it with as was on be by this are from or an at not but have which they his her you we "
    "der die das und ist in zu den mit von auf für im ein eine nicht dem des sich als auch es an werden aus er hat "
    "le la les de des et est un une du en que qui dans pour par sur pas au avec ce il plus ne se sont "
    "el los las y que se del por con una su para es al lo como más o pero sus le ha me si sin".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Words that say how a page is laid out, as "has-sidebar", mark nothing.
_LAYOUT = re.compile(r"(?i)\b(?:has|no|with|without)[-_][a-z_-]+")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

TEXT, BOILERPLATE, OPEN = 1, 0, None
#: How sure it is that a container holds the main text: by its element, by its class or id.
SURE, HINTED = 2, 1
#: Blocks are short below MIN_CHARS and long from LONG_CHARS on.
MIN_CHARS, LONG_CHARS, STOP_DENSITY, LOW_DENSITY, LINK_DENSITY = 70, 200, 0.2, 0.05, 0.5


class _Block:
    __slots__ = ("parts", "linked", "boiler", "body", "heading", "box")

    def __init__(self, boiler: bool, body: int, heading: bool, box: int):
        self.parts, self.linked, self.boiler, self.body, self.heading, self.box = [], 0, boiler, body, heading, box


def _marks(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether attributes mark boilerplate, hide the element, or hint at the main text."""
    boiler = hidden = body = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif key == "role":
            boiler |= value.lower() in BOILER_ROLES
        elif key in ("class", "id") and name not in ("html", "body", "article", "main"):
            words = {w.lower() for w in _WORDS.findall(_LAYOUT.sub("", value))}
            if name in INLINE:
                hidden |= not words.isdisjoint(AD_WORDS)
            boiler |= not words.isdisjoint(BOILER_WORDS)
            body |= not words.isdisjoint(BODY_WORDS)
    return boiler, hidden, body


def blocks(html: str) -> Iterator[tuple[str, float, bool, int, bool, int]]:
    """(text, link density, boiler, body, heading, container) of each block that has text."""
    # The stack holds (element, boiler, body, unread, number); the number tells containers apart.
    stack: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, 0)]
    now, at, link, boxes, out = _Block(False, 0, False, 0), 0, 0, 0, []

    def flush() -> None:
        nonlocal now
        if now.parts and (text := " ".join("".join(now.parts).split())):
            out.append((text, now.linked / len(text), now.boiler, now.body, now.heading, now.box))
        name, boiler, body, _, box = stack[-1]
        heading = name in HEADINGS
        # A heading in the header of an article is the article's; one in a page's header is not.
        if heading and boiler and body and all(not s[1] or s[0] in (*HEADINGS, "header") for s in stack):
            boiler = False
        now = _Block(boiler, body, heading, stack[-2][4] if heading or name == "p" else box)

    def say(text: str) -> None:
        if text and not stack[-1][3]:
            if "&" in text:
                text = unescape(text)
            now.parts.append(text)
            if link:
                now.linked += len(" ".join(text.split()))

    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br" or name == "hr":
            now.parts.append(" ")
        if name == "a":
            link = 0 if close else 1
        tracked = name in BLOCKS or name in UNREAD or name in INLINE
        if close:
            if tracked and any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
                flush() if name in BLOCKS or name in UNREAD else None
            elif name in BLOCKS:
                flush()
            continue
        if not tracked:
            continue
        if name in VOID or attrs.endswith("/") and name in ("svg", "math", "canvas"):
            flush() if name in BLOCKS else None
            continue
        if name in RAW and (c := re.compile(rf"</{name}", re.I).search(html, at)):
            now.parts.append(" ") if name not in ("script", "style") else None
            at = html.find(">", c.end()) + 1 or end
            continue
        if name in RAW:
            break  # an unclosed script or style runs to the end
        if name in BLOCKS:
            while stack[-1][0] in INLINE and not stack[-1][3]:  # left open
                stack.pop()
            if stack[-1][0] == "p" or name in CLOSED_BY_SAME and stack[-1][0] == name:
                stack.pop()
            elif stack[-1][0] == "head":
                stack.pop()
        boiler, hidden, hint = _marks(name, attrs) if attrs else (False, False, False)
        _, was_boiler, was_body, unread, box = stack[-1]
        if name in INLINE:
            stack.append((name, was_boiler, was_body, unread or hidden, box))
            continue
        boxes += 1
        boiler = was_boiler or boiler or name in BOILER
        stack.append((name, boiler, SURE if name in BODY else max(was_body, HINTED if hint else 0), unread or hidden or name in UNREAD, boxes))
        if name in BLOCKS:
            flush()
    flush()
    return iter(out)


def first_pass(found: list[tuple[str, float, bool, int, bool, int]]) -> list[tuple[int | None, str]]:
    """Label and deciding rule of each block by itself."""
    out, middling = [], []
    for i, (text, links, boiler, body, _, _) in enumerate(found):
        words = text.lower().split() if len(text) >= MIN_CHARS else ()
        density = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
        if links > LINK_DENSITY:
            out.append((BOILERPLATE, "links"))
        elif boiler:
            out.append((BOILERPLATE, "mark"))
        elif len(text) >= LONG_CHARS and density >= STOP_DENSITY:
            out.append((TEXT, "density"))
        elif len(text) >= LONG_CHARS and density < LOW_DENSITY and not body:
            out.append((BOILERPLATE, "density"))
        else:
            if density >= STOP_DENSITY:
                middling.append(i)
            out.append((OPEN, ""))
    if not any(label == TEXT for label, _ in out):
        for i in middling:
            out[i] = (TEXT, "density")
    return out


def judged(found: list[tuple[str, float, bool, int, bool, int]]) -> list[tuple[bool, str]]:
    """Whether each block is text, and the rule that decided: links, mark, density, neighbours, article or hint."""
    first = first_pass(found)
    n = len(found)
    before, after, last = [None] * n, [None] * n, None
    for i in range(n):
        before[i] = last
        last = i if first[i][0] is not OPEN else last
    last = None
    for i in reversed(range(n)):
        after[i] = last
        last = i if first[i][0] is not OPEN else last
    # Where the article or main element that a block is in begins and ends.
    begin, end = list(range(n)), list(range(n))
    for i in range(1, n):
        begin[i] = begin[i - 1] if found[i][3] == SURE == found[i - 1][3] else i
    for i in reversed(range(n - 1)):
        end[i] = end[i + 1] if found[i][3] == SURE == found[i + 1][3] else i
    out = []
    for i, (label, rule) in enumerate(first):
        if label is not OPEN:
            out.append((label == TEXT, rule))
            continue
        sure = found[i][3] == SURE
        sides = [None if j is None or sure and not begin[i] <= j <= end[i] else j for j in (before[i], after[i])]
        near = [j for j in sides if j is not None]
        labels = {first[j][0] for j in near} if len(near) == 2 else {BOILERPLATE, *(first[j][0] for j in near)}
        if sure and len(near) < 2:
            out.append((True, "article"))
        elif found[i][3] == HINTED and (not near or len(found[i][0]) >= MIN_CHARS):
            out.append((True, "hint"))
        elif len(labels) == 1:
            out.append((labels.pop() == TEXT or sure, "neighbours"))
        else:
            out.append((sure or any(first[j][0] == TEXT and found[j][5] == found[i][5] for j in near), "neighbours"))
    return out


def classify(found: list[tuple[str, float, bool, int, bool, int]]) -> list[bool]:
    """Which blocks are text."""
    return [kept for kept, _ in judged(found)]


def main_text(html: str | None) -> str:
    found = list(blocks(html or ""))
    return "\n".join(b[0] for b, keep in zip(found, classify(found), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages"))
