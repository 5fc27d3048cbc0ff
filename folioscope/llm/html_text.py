"""Main text of web pages by line-block distribution.

Markup is stripped to a row of blocks, each with its text and the part of it that stands in links.  Elements that HTML
itself sets apart (navigation, asides, forms, footers, hidden ones) are left out on the way.  Then the lengths of WINDOW
neighbouring blocks are summed: where the sum surges from below to above a threshold the text begins, where it dives below
it for the last time it ends, and all blocks between are kept, however short.  Blocks that the page marks as article or
main are weighted: each counts as a window of text, so short ones begin or end the text too.

Names that authors give (class, id) are weights.  A name made of nothing but NAMES and HELPERS (``ad-slot``, ``comments``)
calls its element no text, one that only has such a part (``has-sidebar``, ``related-work``) weighs its blocks nothing
outside of articles, so they neither begin nor end the text.  Neither counts for an element that holds most of the text
that the page marks, or of the page if it marks none.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import texts

WINDOW = 3
#: A window counts as text from so many characters outside links; how long other windows are doesn't matter.
LEAST = 60

# fixed values: elements of HTML by what they do here
RAW = frozenset("script style noscript template iframe textarea select object svg math canvas audio video title xmp".split())
DROPPED = frozenset("nav aside footer form button dialog menu datalist fieldset".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer form login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promotion recommended related search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Parts of a name that say where or how large an element is, and nothing of what it holds.
HELPERS = frozenset(
    "area bar block bottom box btn button card cell center col column container content desktop div element fixed floating footer form global grid group header holder home in inline inner item items js left link links list main mid middle "
    "mobile module my new nav outer page panel placement post posts right row section site slot slots space sticky story tag tags the title top unit units user users view vertical wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())

_TAG = re.compile(r"<(?:!--(?:>|->|.*?--!?>|.*\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_READERS = frozenset("comment comments commentlist disqus".split())


def _dropped(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the text by what HTML says of it."""
    if name in DROPPED or name == "header" and not in_article:
        return True
    if name in ("body", "html", "main") or not attributes.strip():
        return False
    if re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)", attributes):
        return True
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(name: str, attributes: str, in_article: bool) -> tuple[int, bool] | None:
    """What the names of an element say: 2 for no text, 1 for text without weight; and whether readers wrote it."""
    if name in ("body", "html", "main") or name in VOID or not attributes.strip():
        return None
    level, readers = 0, False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id") or m[1].lower() == "id" and name in _HEADINGS:  # a heading's id is an anchor
            continue
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = {x.lower() for x in _PARTS.findall(token)}
            if not parts & NAMES and (in_article or "header" not in parts) or name == "article" and not parts & (_READERS | {"ad", "ads"}):
                continue
            whole = parts <= NAMES | HELPERS | {"header"}
            level = max(level, 2 if whole else 0 if in_article or name not in BLOCKS else 1)
            readers |= whole and bool(parts & _READERS)
    return (level, readers) if level else None


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Blocks:
    def __init__(self) -> None:
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.regions: list[int] = []
        #: elements with telling names: first block, the one after the last, level, whether readers wrote it
        self.named: list[tuple[int, int, int, bool]] = []
        self.now: list[str] = []
        self.links = 0

    def close(self, region: int) -> None:
        if self.now:
            text = " ".join(entities.unescape("".join(self.now)).split())
            if text:
                self.texts.append(text)
                self.linked.append(min(self.links, len(text)))
                self.regions.append(region)
            self.now, self.links = [], 0

    def end(self, first: int, level: int, readers: bool, region: int) -> None:
        """The end of an element with a telling name that began at block ``first``."""
        self.close(region)
        if len(self.texts) > first:
            self.named.append((first, len(self.texts), level, readers))


def _ends(tags: list[tuple]) -> list[int]:
    """The number of each tag's closing one; of those never closed that of the next tag that marks the text, or how many there are."""
    n, open_tags = len(tags), {}
    ends, marked = [n] * n, n
    for k in range(n - 1, -1, -1):
        ends[k] = marked
        if not tags[k][2] and tags[k][3] in ("article", "main", "body"):
            marked = k
    for k, (_, _, slash, name, attributes, _) in enumerate(tags):
        if slash:
            if open_tags.get(name):
                ends[open_tags[name].pop()] = k
        elif not attributes.rstrip().endswith("/"):
            open_tags.setdefault(name, []).append(k)
    return ends


def blocks(page: str) -> _Blocks:
    """The page's blocks in order; regions: 2 in an article, 1 in main, else 0."""
    out = _Blocks()
    tags = [(m.start(), m.end(), m[1] or m[4] or "", (m[2] or m[5] or "").lower(), m[3] or m[6] or "", m[0]) for m in _TAG.finditer(page)]
    at, k, n, article, main, link = 0, 0, len(tags), 0, 0, 0
    region = lambda: 2 if article else 1 if main else 0
    ends, inside = _ends(tags), []
    while k < n:
        start, end, slash, name, attributes, whole = tags[k]
        while inside and inside[-1][0] < k:  # elements that ended within something left out
            out.end(*inside.pop()[1:], region())
        if inside and inside[-1][0] == k:
            if start >= at:
                out.now.append(page[at:start])
                out.links += start - at if link else 0
                at = start
            while inside and inside[-1][0] == k:
                out.end(*inside.pop()[1:], region())
        k += 1
        if start < at:
            continue
        text = page[at:start]
        if text:
            out.now.append(text)
            if link:
                out.links += len(text)
        at = end
        if not name:
            continue
        if not whole.endswith(">"):  # cut off within a tag
            at = len(page)
            break
        if slash:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS:
                out.close(region())
                if name == "article":
                    article = max(0, article - 1)
                elif name == "main":
                    main = max(0, main - 1)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, end)
                at = close.end() if close else len(page)
            out.now.append(" ")
            continue
        if name == "head" or name not in VOID and _dropped(name, attributes, article > 0):
            out.close(region())
            j = ends[k - 1]
            if j < n and tags[j][2] and tags[j][3] == name:
                at, j = tags[j][1], j + 1
            else:  # never closed: it ends where the text is marked, or with the page
                at = tags[j][0] if j < n else len(page)
            k = j
            continue
        if name and not attributes.rstrip().endswith("/") and (what := _named(name, attributes, article > 0)):
            out.close(region())
            limit = min(ends[k - 1], inside[-1][0]) if inside else ends[k - 1]  # elements that cross end together
            inside.append((limit, len(out.texts), *what))
        if name in BLOCKS:
            out.close(region())
            article += name == "article"
            main += name == "main"
        elif name in ("br", "td", "th", "img", "wbr", "option"):
            out.now.append("" if name == "wbr" else " ")
        elif name == "a":
            link += 1
    if at < len(page):
        rest = page[at:]
        out.now.append(rest[: i] if (i := rest.rfind("<")) >= 0 and re.match(r"<[a-zA-Z/!]?\Z", rest[i:]) else rest)
    out.close(region())
    while inside:
        out.end(*inside.pop()[1:], region())
    return out


def weights(found: _Blocks) -> list[int]:
    """The level of each block: 2 is no text by its name, 1 has no weight, 0 counts."""
    own = [max(0, len(t) - n) for t, n in zip(found.texts, found.linked, strict=True)]
    page, marked = [0], [0]
    for n, r in zip(own, found.regions, strict=True):
        page.append(page[-1] + n)
        marked.append(marked[-1] + (n if r else 0))
    change = [[0, 0] for _ in range(len(own) + 1)]
    for a, b, level, readers in found.named:
        within, all_marked, held, all_held = marked[b] - marked[a], marked[-1], page[b] - page[a], page[-1]
        if readers and within < all_marked:  # the text stands elsewhere
            most = False
        elif readers or not all_marked:
            most = 2 * held > all_held
        else:
            most = 2 * within > all_marked
        if not most:
            change[a][level - 1] += 1
            change[b][level - 1] -= 1
    out, light, none = [], 0, 0
    for x, y in change[:-1]:
        light, none = light + x, none + y
        out.append(2 if none else 1 if light else 0)
    return out


def text_region(found: _Blocks, levels: list[int] | None = None) -> tuple[int, int]:
    """First block and the one after the last of the text, by the first surge and the last dive of the window sums."""
    size = [max(0, len(t) - n) if n < 0.6 * len(t) else 0 for t, n in zip(found.texts, found.linked, strict=True)]
    size = [max(n, LEAST) if r else n for n, r in zip(size, found.regions, strict=True)]
    if levels is not None:
        size = [0 if x else n for n, x in zip(size, levels, strict=True)]
    text = [i for i in range(len(size)) if sum(size[i : i + WINDOW]) >= LEAST]
    if not text:
        return 0, len(size) if sum(size) else 0
    first = next(i for i in range(text[0], len(size)) if size[i])
    last = max(i for i in range(text[-1], min(text[-1] + WINDOW, len(size))) if size[i])
    return first, last + 1


def main_text(page: str | None) -> str:
    """The main text: blocks with one space for white space, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    found = blocks(page)
    levels = weights(found)
    if 2 in levels:
        some = [i for i, x in enumerate(levels) if x < 2]
        found.texts, found.linked, found.regions, levels = ([x[i] for i in some] for x in (found.texts, found.linked, found.regions, levels))
    a, b = text_region(found, levels)
    return "\n\n".join(found.texts[a:b])


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    pages: page_id, url, html; other columns are ignored.  Returns page_id, url, text, n_chars (long, code points).  A
    null or empty page has an empty text.  Pages are treated one by one: repeated rows give repeated rows, an empty table
    an empty result; nothing is cut however long a page is.  Bytes that aren't UTF-8 become U+FFFD.
    """

    def run(batches):
        for batch in batches:
            found = [main_text(h) for h in texts(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
