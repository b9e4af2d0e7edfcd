"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks of text at block-level tags. Each block has its number of words and its link
density (share of words inside links), the same of the block before and after it, and where it stands:
inside the page's main container, inside a marked container (navigation, advert, form, comments ...), as a
heading or a list item. A decision tree, grown on the small labelled table below when the module is
loaded, says which blocks are article text. The text of these blocks is joined in page order.

Pages are read once and nothing is shuffled; a task holds one batch of pages.

Marks. Containers are marked by their element, role, class or id; the words of class names are parted at humps and looked
up whole or as the beginning or end of a compound, in English and some German, French and Spanish. A mark is one
feature of the tree; marks by class alone are taken back where they would leave nothing of a page, but not those of
readers' comments.

Defined results. A null or empty page has an empty text. An empty table gives an empty result; a very long page is one
row, read once, and its cost grows with its length and not with its depth. Script, style and other raw elements end at
their closing tag or, unclosed, with the page. Unclosed tags stay open as long as their container.
Character references are decoded once; a stray ``<`` or ``&`` stays text. White space (Unicode) in a
block becomes one space. Nothing else is dropped or capped. Rows that repeat an id give rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package

# Element names by role, and the words that mark a container by its class, id or role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style title noscript template textarea iframe svg math xmp noembed noframes object audio video canvas select datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset("br img wbr input hr".split()) - {"wbr"}
MARKED_TAGS = frozenset("nav aside footer form button label menu dialog".split())
RESET_TAGS = frozenset("nav footer form header menu".split())
MARK_WORDS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs toc pager pagination "
    "sidebar sidebars sidenav rail aside widget widgets "
    "header masthead topbar footer foot bottombar copyright legal colophon "
    "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay paywall disclaimer "
    "comment comments commentlist discussion disqus respond replies reply feedback reviews "
    "share sharing social related recommended recommendations popular trending teaser teasers outbrain taboola "
    "newsletter subscribe subscription signup login search form tags hidden skip "
    "anzeige anzeigen werbung hinweis teilen empfehlungen publicite pub partage pied menue publicidad anuncio anuncios compartir pie".split()
)
#: Words that mark readers' comments, and beginnings or ends of compounds that mark a container. Fixed values.
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond replies reply feedback reviews".split())
COMMENT_PARTS = ("comment", "kommentar", "comentari", "leserbrief", "guestbook", "gaestebuch")
MARK_PARTS = (
    "sidebar", "advert", "werbung", "anzeige", "publicit", "publicidad", "promo", "sponsor", "banner", "cookie", "consent", "newsletter", "breadcrumb", "navig", "navbar", "footer", "teaser", "related",
    "widget", "popup", "subscri", "masthead", "toolbar", "copyright", "disclaimer", "paywall", "seitenleiste", "randspalte", "fusszeile", "kopfzeile", "impressum", "verwandt", "empfehl", "partage",
)
#: Words that only look like a mark.
NO_MARKS = frozenset("commentary commentator commented navigator".split())
#: How firmly a container is marked: by a class or id, by its element or role, as readers' comments.
SOFT, FIRM, COMMENTS = 1, 2, 3
MARK_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
MAIN_WORDS = frozenset("articlebody".split())

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
PART = re.compile(r"[^\W\d_]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: The article's own parts, whose names hold a mark word.
OWN_PART = re.compile(r"(?:article|entry|post|story|content)[-_ ]*(?:header|headline|title|body|text)")

# The labelled table, fixed values: words, link density, words and link density of the block before and of
# the block after, inside main container, inside marked container, page has a main container, heading or
# list item (1, 2); and whether such a block is article text.
LABELLED = """
words link  p.words p.link  n.words n.link  main marked has kind  text
40    0.00  35      0.00    50      0.00    1    0      1   0     1
12    0.00  40      0.00    60      0.05    1    0      1   0     1
1     0.00  55      0.00    44      0.00    1    0      1   0     1
2     0.00  1       0.00    1       0.00    1    0      1   0     1
7     0.00  0       0.00    30      0.00    1    0      1   1     1
5     0.00  60      0.00    70      0.00    1    0      1   1     1
9     0.00  12      0.00    14      0.00    1    0      1   2     1
3     0.00  3       0.00    3       0.00    1    0      1   2     1
80    0.20  30      0.10    45      0.00    1    0      1   0     1
25    0.45  50      0.00    40      0.10    1    0      1   0     1
6     0.00  4       1.00    33      0.00    1    0      1   1     1
30    0.00  6       1.00    5       1.00    1    0      1   0     1
1     0.00  1       1.00    40      0.00    1    0      1   0     1
15    0.60  70      0.00    80      0.00    1    0      1   0     1
45    0.00  60      0.00    0       0.00    1    0      1   0     1
45    0.00  60      0.00    3       1.00    1    0      1   0     1
8     0.00  50      0.00    4       1.00    1    0      1   0     1
25    0.05  4       1.00    0       0.00    1    0      1   0     1
70    0.00  2       1.00    2       1.00    1    0      1   0     1
14    0.00  20      0.00    1       1.00    1    0      1   0     1
27    0.10  5       1.00    60      0.00    1    0      1   0     1
33    0.00  35      0.00    9       0.80    1    0      1   0     1
6     0.00  40      0.00    0       0.00    1    0      1   0     1
9     0.00  40      0.00    35      0.00    1    0      1   0     1
20    0.00  45      0.00    40      0.00    1    0      1   0     1
11    0.00  60      0.90    70      0.85    1    0      1   0     1
60    0.00  60      0.00    50      0.00    1    0      1   0     1
45    0.00  60      0.00    50      0.00    1    1      1   0     0
20    0.00  45      0.00    40      0.00    1    1      1   0     0
9     0.00  40      0.00    35      0.00    1    1      1   0     0
60    0.00  60      0.00    3       1.00    1    1      1   0     0
45    0.00  60      0.00    0       0.00    0    0      1   0     0
45    0.00  60      0.00    50      0.00    0    0      1   0     0
20    0.00  30      0.00    25      0.10    0    0      1   0     0
9     0.00  40      0.00    35      0.00    0    0      1   0     0
60    0.00  45      0.00    40      0.00    0    0      1   0     0
14    0.00  20      0.00    30      0.00    0    0      1   0     0
45    0.00  40      0.00    45      0.00    0    1      0   0     0
20    0.00  45      0.00    40      0.00    0    1      0   0     0
60    0.00  45      0.00    40      0.00    0    1      0   0     0
9     0.00  40      0.00    35      0.00    0    1      0   0     0
4     1.00  4       1.00    4       1.00    1    0      1   2     0
2     1.00  3       1.00    60      0.00    1    0      1   2     0
3     1.00  50      0.00    2       1.00    1    0      1   0     0
6     1.00  40      0.00    5       1.00    1    0      1   2     0
5     1.00  60      0.00    0       0.00    1    0      1   0     0
40    0.00  35      0.00    50      0.00    1    1      1   0     0
12    0.10  40      0.00    6       1.00    1    1      1   0     0
3     0.00  50      0.00    30      0.00    1    1      1   1     0
2     1.00  2       1.00    2       1.00    0    1      1   2     0
1     1.00  0       0.00    1       1.00    0    1      1   2     0
8     0.00  3       1.00    12      0.00    0    1      1   0     0
9     0.10  40      0.00    0       0.00    0    1      1   0     0
60    0.00  30      0.00    50      0.00    0    1      1   0     0
30    0.00  5       0.00    40      0.00    0    0      1   0     0
6     0.00  2       1.00    30      0.00    0    0      1   1     0
10    0.00  3       1.00    45      0.00    0    0      1   0     0
70    0.10  20      0.00    10      0.50    0    0      1   0     0
3     1.00  3       1.00    9       0.00    0    0      1   2     0
25    0.00  60      0.00    0       0.00    0    0      1   0     0
45    0.00  40      0.00    38      0.00    0    0      0   0     1
60    0.10  8       0.00    52      0.10    0    0      0   0     1
22    0.00  30      0.00    40      0.00    0    0      0   0     1
100   0.20  50      0.00    3       1.00    0    0      0   0     1
16    0.00  2       1.00    35      0.00    0    0      0   0     1
30    0.10  45      0.00    2       0.50    0    0      0   0     1
4     0.00  40      0.00    50      0.00    0    0      0   0     1
1     0.00  30      0.00    25      0.00    0    0      0   0     1
8     0.00  35      0.00    20      0.00    0    0      0   2     1
6     0.00  3       1.00    40      0.00    0    0      0   1     1
5     0.00  60      0.00    45      0.00    0    0      0   1     1
9     0.00  0       0.00    50      0.00    0    0      0   1     1
3     0.00  2       0.00    44      0.00    0    0      0   1     1
14    0.00  20      0.00    2       1.00    0    0      0   0     1
13    0.20  42      0.00    0       0.00    0    0      0   0     1
2     1.00  2       1.00    2       1.00    0    0      0   2     0
1     1.00  0       0.00    1       1.00    0    0      0   2     0
5     1.00  3       1.00    40      0.00    0    0      0   0     0
12    0.90  4       1.00    6       1.00    0    0      0   0     0
18    0.80  10      0.70    9       1.00    0    0      0   0     0
25    0.75  5       1.00    5       1.00    0    0      0   0     0
3     0.00  2       1.00    1       1.00    0    0      0   0     0
4     0.00  1       1.00    2       1.00    0    0      0   1     0
2     0.00  0       0.00    2       1.00    0    0      0   0     0
5     0.00  40      0.00    0       0.00    0    0      0   0     0
4     0.50  30      0.00    3       1.00    0    0      0   0     0
6     0.20  2       1.00    3       1.00    0    0      0   0     0
7     0.00  5       1.00    4       1.00    0    0      0   0     0
9     0.00  40      0.00    35      0.00    0    0      0   0     1
9     0.00  40      0.95    35      1.00    0    0      0   0     0
14    0.00  30      0.05    25      0.10    0    0      0   0     1
14    0.00  30      0.90    25      0.90    0    0      0   0     0
11    0.00  60      0.90    70      0.85    0    0      0   0     0
11    0.00  60      0.00    70      0.05    0    0      0   0     1
6     0.00  25      1.00    28      1.00    0    0      0   1     0
6     0.00  25      0.05    28      0.00    0    0      0   1     1
20    0.00  45      1.00    40      0.95    0    0      0   0     0
20    0.00  45      0.00    40      0.00    0    0      0   0     1
30    0.00  35      0.00    50      0.00    0    1      0   0     0
5     0.00  20      0.00    9       0.00    0    1      0   1     0
"""


@dataclass
class Block:
    """A flat block of text and what is known of it."""

    text: str
    words: int
    linked: int
    main: bool
    marked: int
    kind: int

    @property
    def density(self) -> float:
        return self.linked / self.words


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 1, depth: int = 12):
    """A decision tree by Gini impurity: (feature, threshold, left, right) or a leaf's label."""
    share = labels.mean()
    if share in (0.0, 1.0) or depth == 0 or len(labels) < 2 * least:
        return int(share >= 0.5)
    best = (len(labels) * share * (1 - share) - 1e-12, None, None)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(part.sum() * (m := labels[part].mean()) * (1 - m) for part in (low, ~low))
            if min(low.sum(), (~low).sum()) >= least and cost < best[0] - 1e-12:
                best = (cost, f, float(cut))
    _, f, cut = best
    if f is None:
        return int(share >= 0.5)
    low = rows[:, f] <= cut
    return f, cut, grow(rows[low], labels[low], least, depth - 1), grow(rows[~low], labels[~low], least, depth - 1)


def decide(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([line.split() for line in LABELLED.strip().splitlines()[1:]], float)
    return table[:, :-1], table[:, -1]


TREE = grow(*labelled_table())


@lru_cache(maxsize=4096)
def mark_of(value: str) -> int:
    """How firmly a class or id marks its element: words are parted at humps, and compounds by their beginning or end."""
    out = 0
    for word in PART.findall(OWN_PART.sub(" ", HUMP.sub(" ", value).lower())):
        if word in NO_MARKS:
            continue
        if word in COMMENT_WORDS or word.startswith(COMMENT_PARTS) or word.endswith(("comment", "comments", "kommentar", "kommentare", "comentarios")):
            return COMMENTS
        if word in MARK_WORDS or word.startswith(MARK_PARTS) or word.endswith(MARK_PARTS):
            out = SOFT
    return out


def _flags(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element opens the main container, and how firmly it is marked as something else."""
    main, marked = tag in ("article", "main"), FIRM if tag in MARKED_TAGS else 0
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            name, raw = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = raw.lower()
            if name in ("class", "id"):
                marked = max(marked, mark_of(raw) if tag not in ("html", "body") else 0)
            elif name == "role":
                main, marked = main or value == "main", max(marked, FIRM if value in MARK_ROLES else 0)
            elif name == "itemprop":
                main = main or value in MAIN_WORDS
            elif name == "style":
                marked = max(marked, FIRM if "display:none" in value.replace(" ", "") else 0)
            elif name == "hidden" or value == "true":
                marked = max(marked, FIRM)
    return main, marked


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    # Tag and the state outside it: main, marked, how firmly (2 by its element, 1 by its class), kind.
    stack: list[tuple[str, bool, int, int, int]] = []
    within: Counter = Counter()  # open elements by tag
    main = seen = False
    marked = fixed = kind = link = linked = 0

    def flush() -> None:
        nonlocal linked, seen
        if parts:
            text = "".join(parts).split()
            if text:
                out.append(Block(" ".join(text), len(text), min(linked, len(text)), main, marked, kind))
                seen = seen or main and not marked
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.split())

    at = 0
    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK_TAGS or tag in MARKED_TAGS:
                flush()
                if within[tag]:
                    while True:
                        name, main, marked, fixed, kind = stack.pop()
                        within[name] -= 1
                        if name == tag:
                            break
                    link = 0 if tag in ("article", "main", "nav", "body", "div", "section", "ul", "footer") else link
            elif tag in ("span", "ins") and any(s[0] == tag for s in stack[-8:]):
                while stack[-1][0] != tag:
                    within[stack.pop()[0]] -= 1
                was = marked
                _, main, marked, fixed, kind = stack[-1]
                if was != marked:
                    flush_as(out, parts, linked, main, was, kind)
                    linked = 0
                within[stack.pop()[0]] -= 1
            continue
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                at = close.end() if close else end
            if tag not in ("script", "style", "template"):
                parts.append(" ")
            continue
        if tag == "a":
            link += 1
        elif tag in SPACE_TAGS and tag not in BLOCK_TAGS:
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag in MARKED_TAGS:
            flush()
            if tag in VOID_TAGS:
                continue
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") or tag[0] == "h" and tag[1:].isdigit():
                # These end where the next of their kind begins.
                if stack and (stack[-1][0] == tag or stack[-1][0] == "p"):
                    name, main, marked, fixed, kind = stack.pop()
                    within[name] -= 1
            opens, is_marked = _flags(tag, m[3])
            stack.append((tag, main, marked, fixed, kind))
            within[tag] += 1
            if tag == "header" and not main:
                is_marked = max(is_marked, FIRM)
            if opens and is_marked:
                marked, fixed = max(marked, is_marked), 2
            elif opens:
                # The first article inside an element marked by class only: that element was not closed.
                if not fixed or fixed == 1 and not seen:
                    marked, fixed = 0, 0
                main = True
            elif is_marked:
                marked = max(marked, is_marked)
                fixed = max(fixed, 0 if tag in RESET_TAGS else 2 if tag in MARKED_TAGS else 1)
            kind = 1 if tag[0] == "h" and tag[1:].isdigit() else 2 if tag == "li" else 0 if tag != "p" else kind
        elif tag in ("span", "ins") and m[3] and _flags(tag, m[3])[1] and not m[3].rstrip().endswith("/"):
            flush()
            stack.append((tag, main, marked, fixed, kind))
            within[tag] += 1
            marked, fixed = max(marked, _flags(tag, m[3])[1]), max(fixed, 1)
    flush()
    return out


def flush_as(out: list[Block], parts: list[str], linked: int, main: bool, marked: int, kind: int) -> None:
    """End a marked inline element's own block."""
    text = "".join(parts).split()
    parts.clear()
    if text:
        out.append(Block(" ".join(text), len(text), min(linked, len(text)), main, marked, kind))


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(_kept(found, 0) or _kept(found, SOFT))


def _kept(found: list[Block], least: int) -> list[str]:
    """The blocks that the tree takes for text, where only marks firmer than ``least`` count.

    Class names by themselves can't empty a page: if they leave nothing, :func:`main_text` asks again without them.
    """
    if least and not any(b.marked == least for b in found):
        return []
    has = any(b.main and b.marked <= least for b in found)
    kept = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        row = (b.words, b.density, before.words if before else 0, before.density if before else 0, after.words if after else 0, after.density if after else 0, b.main, b.marked > least, has, b.kind)
        if decide(TREE, row):
            kept.append(b.text)
    return kept


def _extract(schema: pa.Schema, at: int):
    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(at).to_pylist()]
            keep = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.record_batch([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return run


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page, its main ``text`` and ``n_chars`` (code points)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship_package(pages.sparkSession)
    source = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(_extract(to_arrow_schema(schema), len(keep)), schema)
