"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. Scripts, styles, forms, navigation, page
headers and footers, sidebars, notices, adverts and reader comments, told by element, role, class or
id, leave no text but a gap of empty lines. A line's weight is its length; lines that are mostly
links weigh nothing, and on pages with an article or main element the lines outside it weigh
``OUTSIDE`` of their length. Weights are summed over sliding windows of ``WINDOW`` lines; text surges
where a window's sum leaves zero and dives where it falls to zero again, and the lines between form
a region. So a link or two among prose stay, while ``WINDOW`` lines of links or more (a menu, a
list of tags or teasers) part the text and go, inside articles too. Regions of an article stay; others
stay where their highest window reaches ``PEAK`` and the article's highest, or, on pages that mark
no article, the lesser of ``PEAK`` and a quarter of the page's highest.

Classes and ids mark an element by whole names: a name counts if all of its parts (split at - and _) are
words for what isn't main text or for boxes (``related-posts``, not ``related-work``).

Defined cases: null and empty pages give an empty text; a page cut off anywhere gives what stands
before the cut; an unclosed script or comment takes the rest of the page; an article of links alone is kept
whole; a break inside a block is white space; end tags that HTML lets authors omit are implied, those that
match nothing are ignored, and each tag costs constant time; repeated pages give equal rows; extra columns
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import bounded_batches

WINDOW, PEAK, SHARE, LINKS, OUTSIDE = 3, 80, 0.25, 0.6, 0.125

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![\w-])(hidden)(?![\w-])""")
# Elements of the HTML standard by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in "script style noscript template svg math iframe head title textarea".split()}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead caption tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = frozenset(["br", "td", "th"])
_OUT = frozenset("nav footer aside form dialog menu search select datalist button audio video object canvas".split())
#: What the start of an element ends, unless one of the second group stands open inside it.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "a": (("a", "anchor"), ("td", "th", "table", "button", "object")),
}
_MARKED = frozenset("div section aside ul ol li p span table header footer figure article details nav".split())
_ANCHORED = frozenset("section article details figure p span li".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in names of page parts that aren't main text, and words for the boxes they stand in.
_PART = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner banners "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footers masthead siteheader pageheader topbar comment comments commentlist disqus replies respond share sharing social related recommended "
    "newsletter newsletters subscribe signup login searchbox searchform widget widgets toolbar pagination pager copyright".split()
)
_BOX = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container content count desktop feed fixed form global group header "
    "holder icon icons inner item items left link links list main media message mobile module outer page pane panel policy post posts primary region right row "
    "secondary section side site slot sticky stories story text thread title top unit warning wrap wrapper zone".split()
)
_READERS = frozenset("comments comment-list commentlist respond disqus_thread replies".split())


def _names_part(token: str) -> bool:
    token = token.lower()
    words = re.split("[-_]+", token.strip("-_"))
    return "".join(words) in _PART or all(w in _PART or w in _BOX for w in words) and any(w in _PART for w in words)


def _hidden(name: str, raw: str) -> bool:
    """Whether an element's attributes mark it as other than main text."""
    for key, a, b, c, flag in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), a or b or c
        if flag or key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value.lower() in _ROLES:
            return True
        if key == "class" and name in _MARKED and any(map(_names_part, value.split())):
            return True
        if key == "id" and name in _MARKED and (value.lower() in _READERS or name not in _ANCHORED and _names_part(value)):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines(page: str) -> list[tuple[str, float, bool] | None]:
    """(text, share of link text, in an article) of every block in page order; None for each gap."""
    out: list[tuple[str, float, bool] | None] = []
    stack: list[str] = []  # open elements; an empty name is one that was closed out of order
    places: dict[str, list[int]] = {}  # of each name, where it stands in the stack
    blocks: list[int] = []
    text: list[str] = []
    linked = 0
    skip_from = inside = 0  # skip_from: depth of the stack at which skipping began, 0 if not
    seen = head_seen = False

    def close() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, min(1.0, linked / len(line)), inside > 0))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not skip_from:
            piece = html.unescape(piece)
            text.append(piece)
            if places.get("a") and not any(places.get(h) for h in _HEADING):
                linked += len(piece.strip())

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def unskip() -> None:
        nonlocal skip_from
        skip_from = 0
        out.append(None)

    def pop_to(depth: int) -> None:
        nonlocal inside
        while len(stack) > depth:
            top = stack.pop()
            if top:
                places[top].pop()
            if top in ("article", "main"):
                inside -= 1
                if not inside:
                    out.append(None)
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        if skip_from and depth < skip_from:
            unskip()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in _BLOCK:
                close()
            place = last(("a", "anchor") if name == "a" else (name,))
            if place < 0:
                continue
            if name not in _BLOCK and blocks and blocks[-1] > place:  # an inline element that holds open blocks ends alone
                places[stack[place]].pop()
                stack[place] = ""
                if skip_from == place + 1:
                    unskip()
            else:
                pop_to(place)
            continue
        if name in _RAW:
            if raw.endswith("/") or name == "head" and head_seen:
                continue
            head_seen |= name == "head"
            stop = _RAW[name].search(page, at)
            if name == "head" and not stop:
                continue
            at = stop.end() if stop else end
            continue
        if name in _BLOCK:
            close()
            place = last(("p",))
            if name != "html" and place > last(("table", "td", "th", "button")):
                pop_to(place)  # a block ends an open paragraph
        elif name in _SPACE:
            add(" ")
        if name in _ENDS:
            ends, unless = _ENDS[name]
            place = last(ends)
            if place > last(unless):
                pop_to(place)
        if name in _VOID or raw.endswith("/"):
            continue
        if name in ("article", "main"):
            if skip_from and not seen:
                unskip()
            seen = True
        if name == "a" and "href" not in raw.lower():
            name = "anchor"
        places.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append(name)
        if name in ("article", "main"):
            if not inside:
                out.append(None)
            inside += 1
        if not skip_from and (name in _OUT or name == "header" and not inside or name not in ("html", "body", "main") and raw and _hidden(name, raw)):
            close()
            out.append(None)
            skip_from = len(stack)
    close()
    return out


def regions(weight: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """(first line, end, highest window sum) between each surge from zero and the dive to zero."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            out.append((start, i, max(sums[start:i])))
            start = None
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    spread: list[tuple[str, float, bool] | None] = []
    for line in lines(page or ""):
        spread += [line] if line else [None] * window
    marked = any(x and x[2] for x in spread)
    only_links = marked and all(x[1] > LINKS for x in spread if x and x[2])

    def weight(x: tuple[str, float, bool] | None) -> float:
        if not x or x[1] > LINKS and not (only_links and x[2]):
            return 0
        return len(x[0]) * (1 if x[2] or not marked else OUTSIDE)

    weights = [weight(x) for x in spread]
    found = regions(weights, window)
    own = [(a, z) for a, z, _ in found if any(spread[i] and spread[i][2] and weights[i] for i in range(a, z))]
    top = [peak for a, z, peak in found if not marked or (a, z) in set(own)]
    least = max(PEAK, max(top, default=0)) if marked else min(PEAK, SHARE * max(top, default=0))
    kept = []
    for a, z, peak in found:
        mine = (a, z) in set(own)
        if not mine and peak < least:
            continue
        heavy = [i for i in range(a, z) if weights[i]]
        lo, hi = heavy[0], heavy[-1] + 1
        if mine:  # a short run of links at the edge of an article's region belongs to it
            for step in (-1, 1):
                edge = lo - 1 if step < 0 else hi
                run = edge
                while 0 <= run < len(spread) and spread[run] and spread[run][2] and not weights[run]:
                    run += step
                if abs(run - edge) < window:
                    lo, hi = (run + 1, hi) if step < 0 else (lo, run)
        kept += [spread[i][0] for i in range(lo, hi) if spread[i] and (spread[i][2] or not mine)]
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
