"""The main text of web pages by the distribution of text over their line blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import pieces

#: A window of the distribution has so many lines; a surge has so many characters in its window.
WINDOW, SURGE = 3, 86

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|title|textarea|select|button)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>"
    r"|<[a-z/!?][^<>]*\Z",
    re.IGNORECASE | re.DOTALL,
)
_attribute = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_spaces = re.compile(r"\s+")
#: Elements that stand in a line of text; all others end it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose end tags are followed up.
CONTAINERS = frozenset("div section article main nav header footer aside form ul ol dl table figure body".split())
CHROME = frozenset("nav header footer aside form".split())
#: Words of a class, id or role that mark what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login sidebar widget related recommended "
    "recommendations comment comments disqus respond replies menu nav navbar navigation breadcrumb breadcrumbs toolbar "
    "pagination pager share sharing social footer header masthead search contentinfo complementary".split()
)
CHROME_INSIDE = CHROME_WORDS - {"header", "masthead"}


def lines_of(page: str) -> Iterator[tuple[str, int, bool, bool]]:
    """The page's lines without markup: text (none in chrome), weight, whether it stands in an article, or in a headline.

    The weight is the number of characters; what is mostly links has none, unless it stands in an article. Where a
    container begins or ends there is a blank line.
    """
    text: list[str] = []
    stack: list[tuple[str, bool]] = []
    at = hidden = linked = 0
    in_link = in_headline = False

    def line() -> tuple[str, int, bool, bool]:
        nonlocal linked
        joined = "" if hidden else _spaces.sub(" ", html.unescape("".join(text))).strip()
        inside = any(n in ("article", "main") for n, _ in stack)
        weight = 0 if linked > 0.6 * len(joined) and not inside else len(joined)
        text.clear()
        linked = 0
        return joined, weight, inside, in_headline

    for tag in _markup.finditer(page):
        text.append(page[at : tag.start()])
        linked += in_link * (tag.start() - at)
        at = tag.end()
        closes = tag[2] or tag[5]
        name = (tag[3] or tag[6] or "").lower()
        if name == "br":
            text.append(" ")
        elif name == "a":
            in_link = not closes
        if name in INLINE or not name and tag[1] is None:
            continue
        yield line()
        in_headline = name == "h1" and not closes
        if name not in CONTAINERS:
            continue
        if not closes:
            inside = any(n in ("article", "main") for n, _ in stack)
            named = " ".join(filter(None, sum(_attribute.findall(tag[4] or tag[7] or ""), ()))).lower()
            words = set(re.split(r"[^a-z]+", named))
            chrome = name != "body" and bool(words & (CHROME_INSIDE if inside else CHROME_WORDS))
            chrome = chrome or name in CHROME and not (inside and name == "header")
            if name in ("article", "main") and not inside and not chrome:
                # An article is not part of a menu or an advert whose end was left out.
                hidden, stack = 0, [(n, False) for n, _ in stack]
            stack.append((name, chrome))
            hidden += chrome
        elif any(name == n for n, _ in stack):
            last = ""
            while last != name:
                last, chrome = stack.pop()
                hidden -= chrome
        yield "", 0, False, False
    text.append(page[at:])
    yield line()


def main_text(page: str) -> str:
    """The article's blocks, one a line.

    A page that marks its article has all lines of it. Elsewhere, over the lines, the sum of the weights in a window of
    ``WINDOW`` lines rises above ``SURGE`` where the article begins and falls to 0 where it ends; where no sum is that
    high, the stretch with the most text is the article. All lines between the first and the last of such points are kept,
    whatever their weight, and before the first those with a weight from the last headline on.
    """
    lines = list(lines_of(page))
    if any(text and inside for text, _, inside, _ in lines):
        return "\n".join(text for text, _, inside, _ in lines if text and inside)
    weights = [weight for _, weight, _, _ in lines]
    stretches: list[tuple[int, int, int]] = []
    begin = None
    for k, weight in enumerate(weights):
        ahead = sum(weights[k : k + WINDOW])
        if begin is None and weight:
            begin, most = k, ahead
        if begin is not None:
            most = max(most, ahead)
            if not ahead:
                stretches.append((begin, k, most))
                begin = None
    if begin is not None:
        stretches.append((begin, len(lines), most))
    kept = [s for s in stretches if s[2] > SURGE]
    kept = kept or sorted(stretches, key=lambda s: -sum(weights[s[0] : s[1]]))[:1]
    if not kept:
        return ""
    begin, end = kept[0][0], kept[-1][1]
    headline = max((k for k in range(begin) if lines[k][0] and lines[k][3]), default=begin)
    before = [lines[k][0] for k in range(headline, begin) if weights[k] or k == headline]
    return "\n".join(before + [lines[k][0] for k in range(begin, end) if lines[k][0]])


def extract_main_text(pages: DataFrame, html_column: str = "html", text_column: str = "main_text") -> DataFrame:
    """Add the main text of each whole page: its article without menus, headers, footers, adverts and the like.

    Character references are decoded, white space inside a block is one space, and blocks stand one a line in page
    order. A null or empty page, or one without an article, has an empty text. A column of the new name is replaced;
    all others stay.
    """
    names = [c for c in pages.columns if c.lower() != text_column.lower()]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                found = [main_text(page) if page else "" for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.string())], ["row", "text"])

    kept = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {kept}, text string")
    return out.select("row.*", F.col("text").alias(text_column))
