"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block element; blocks that this leaves empty and blank lines of the source stay as
empty lines. A line weighs its characters outside of links (a heading all of them). Lines inside containers that are never main
text (navigation, page header and footer, asides, forms, adverts, notices, comments of readers, named by tag or by a whole role,
class or id) have weight 0; if the page marks its article, so do the lines outside of it. The weights are summed over windows of
WINDOW lines. A text region begins where the sum rises from 0 and ends at the dive, where it falls back to 0. Regions with a
surge, a window of at least SURGE characters, are main text. Of the others the lines that stand in the same container as the
heavy lines of such a region are, and all of them in a marked article: a short part of the article between dives stays. So do
fewer than WINDOW lines of nothing but links there; longer runs of them only beside the heavy lines of a marked article.

Edge cases: null or empty html gives an empty text; so does a page without any text line. On a page whose only text is links,
links weigh like other text. Unclosed tags, comments and scripts reach to the end of the page. Character references are decoded, white space inside a line becomes one space. Pages of any
length are read whole. Repeated rows get equal results; all other columns pass unchanged.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WINDOW = 3
SURGE = 80  # characters that a window of a main region needs on a page without a marked article, if any window has them

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?", re.S)
_MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title xmp".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*+>?", re.I) for t in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("nav footer aside form button menu dialog head".split())
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold text of the container around them and are none themselves.
_PARTS = _HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre center figure figcaption section table caption thead tbody tfoot tr td th".split())
#: Words of class, id and role values that mark a container which is not main text.
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination header masthead topbar toolbar footer foot copyright "
    "comment comments commentlist reply replies disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended widget widgets search skip complementary contentinfo".split()
)
#: Words that only say where or how a container stands: a name of these and at least one of _MARKED is marked too.
_PLACING = frozenset("site left right top bottom box container wrapper wrap list bar item items area block inner outer link links posts buttons icons form".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HREF = re.compile(r"(?<![^\s\"'])href\s*=", re.I)


def marked(attributes: str) -> bool:
    """Whether a class, id or role as a whole names a container that is not main text: cookie-notice does, has-sidebar does not."""
    if not attributes or "=" not in attributes:
        return False
    for a, b, c in _MARK.findall(attributes):
        for name in (a or b or c).split():
            words = {w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()}
            if words & _MARKED and words <= _MARKED | _PLACING:
                return True
    return False


class Line(NamedTuple):
    text: str
    never: bool = False  # stands in a container that is never main text
    main: bool = False  # stands in a marked article
    weight: int = 0  # characters outside of links
    home: int = 0  # number of the container around it


def plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def lines_of(page: str) -> list[Line]:
    """The lines of a page; of empty lines next to each other at most WINDOW."""
    out: list[Line] = []
    parts: list[str] = []
    outside: list[str] = []  # the parts that are not in a link
    stack: list[tuple[str, bool, bool, int]] = []
    open_names: dict[str, int] = {}
    never = main = at = homes = blank = 0
    link = -1  # depth of the stack at which a link was opened

    def add(raw: str) -> None:
        parts.append(raw)
        outside.append(raw if link < 0 else " ")

    def flush() -> None:
        nonlocal blank
        text = plain(parts)
        if text:
            weight = len(text)
            if outside != parts and not (stack and stack[-1][0] in _HEADINGS):
                rest = plain(outside)
                weight = len(rest) if any(c.isalnum() for c in rest) else 0
            out.append(Line(text, never > 0, main > 0, weight, stack[-1][3] if stack else 0))
            blank = 0
        else:
            more = min(max(1, "".join(parts).count("\n")), WINDOW - blank)
            out.extend([Line("")] * more)
            blank += more
        parts.clear()
        outside.clear()

    def pop() -> str:
        nonlocal never, main, link
        name, is_never, is_main, _ = stack.pop()
        open_names[name] -= 1
        never -= is_never
        main -= is_main
        if len(stack) < link:
            link = -1
        return name

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name in _RAW and not m.group(1):
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            link = len(stack) if not m.group(1) and _HREF.search(m.group(3) or "") else -1
        block = name not in _INLINE
        if block:
            flush()
        if m.group(1):
            if open_names.get(name, 0):
                # What stands open inside a marked article or a never-main container ends with it, not before.
                while pop() != name:
                    pass
            continue
        if name in _VOID or (m.group(3) or "").endswith("/"):
            continue
        if block and stack and stack[-1][0] == "p":
            pop()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop()
        is_never = name in _NEVER or (name == "header" and main == 0) or (name not in ("html", "body", *_MAIN) and marked(m.group(3)))
        if block or is_never or open_names.get(name, 0):
            if block and name not in _PARTS:
                homes += 1
                home = homes
            else:
                home = stack[-1][3] if stack else 0
            stack.append((name, is_never, name in _MAIN, home))
            open_names[name] = open_names.get(name, 0) + 1
            never += is_never
            main += name in _MAIN
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its lines joined by a line feed."""
    if not page:
        return ""
    found = lines_of(page)
    has_main = any(x.main and not x.never for x in found)
    open_ = [bool(x.text) and not x.never and (x.main or not has_main) for x in found]
    weight = [x.weight if o else 0 for x, o in zip(found, open_)]
    if not any(weight):
        weight = [len(x.text) if o else 0 for x, o in zip(found, open_)]
    blocks = [sum(weight[i : i + WINDOW]) for i in range(len(weight) + 1)]
    need = max(1, min(SURGE, max(blocks)))
    kept = [False] * len(found)
    regions, begin = [], None
    for i, block in enumerate(blocks):
        if block and begin is None:
            begin = i
        if begin is not None and not block:  # the dive
            at = [j for j in range(begin, i) if weight[j]]
            regions.append((max(blocks[begin:i]) >= need, at[0], at[-1] + 1))
            begin = None
    homes = {found[j].home for heavy, a, b in regions if heavy for j in range(a, b) if weight[j] * WINDOW >= need}
    for heavy, a, b in regions:
        for j in range(a, b):
            kept[j] = open_[j] and (heavy or has_main or found[j].home in homes)
    run: list[int] = []  # lines of nothing but links since the last line with weight
    for j in range(len(found) + 1):
        if j < len(found) and not weight[j]:
            run += [j] if open_[j] else []
            continue
        for k in run:
            beside = found[k].home in homes
            kept[k] = (beside or has_main) if len(run) < WINDOW else (beside and has_main)
        run = []
    return "\n".join(x.text for x, k in zip(found, kept) if k)


def extract_text(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """All rows and columns, with the main text of the page."""

    @pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return pd.Series([main_text(v) for v in values], dtype=object)

    return pages.withColumn(into, texts(F.col(page)))
