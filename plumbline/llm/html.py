"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into text blocks at block-level tags. A block's features are its word count and link density, those of its
neighbours, and what its open ancestors say (landmark tags, words in class, id and role). A small labelled table of such
blocks trains a decision tree (Gini impurity, numpy); blocks it calls content make up the text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.llm.common import map_arrow

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']+))?""")
_WORDS = re.compile(r"[a-z]+")
_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # a slash that ends an unquoted value doesn't close the tag
#: HTML element groups and words used in class, id and role attributes.
RAW = set("script style noscript template textarea select svg iframe title object canvas annotation annotation-xml xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
MATH = set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CHROME = set("nav header footer aside form menu dialog button fieldset head".split())
BODY = set("article main".split())
CHROME_WORDS = set(
    "ad ads adbox advert adverts advertisement sponsor sponsored promo banner cookie cookies notice consent gdpr popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond pagination pager "
    "toolbar tags tagcloud copyright legal disclaimer alert search form contentinfo complementary skip hidden".split()
)
BODY_WORDS = set("content article post entry story main articlebody hentry".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

FEATURES = "chrome_tag chrome_word body heading paged words links words_before links_before words_after links_after".split()
#: Labelled blocks: the features in order (paged: the page has a body element somewhere), then 1 for content.
LABELLED = """
1 0 0 0 1   1 1.0   0 0.0   1 1.0  0
1 0 0 0 1   2 1.0   1 1.0   4 0.0  0
1 0 0 0 1   3 0.0   0 0.0  30 0.0  0
1 0 0 0 1  12 0.0  60 0.0   0 0.0  0
1 0 0 0 1  40 0.1  80 0.0   0 0.0  0
1 1 0 0 1   6 0.5  20 0.0   3 1.0  0
1 0 1 0 1   5 0.2  12 0.0  60 0.0  0
1 0 1 0 1   9 0.0  70 0.0   9 0.0  0
1 0 1 0 1   2 0.0   4 0.0  60 0.0  0
1 0 1 0 1   3 0.0   9 0.0  25 0.0  0
1 0 1 0 1  30 0.0   9 0.0  40 0.0  0
1 0 1 1 1   3 0.0   2 1.0   2 0.0  1
1 0 1 1 1  12 0.0   2 1.0   3 0.3  1
1 1 1 0 1  14 0.3  90 0.0   2 1.0  0
1 0 1 1 1   9 0.0   3 1.0  60 0.0  1
1 0 1 1 1   4 0.0   0 0.0   6 0.2  1
1 0 0 1 1   3 0.0   0 0.0   2 1.0  0
1 0 0 1 0   5 0.0   0 0.0   2 1.0  0
0 1 0 0 1   8 0.0   2 1.0   9 0.0  0
0 1 0 0 1  15 0.0   3 1.0  12 0.0  0
0 1 0 0 1  45 0.0  60 0.0  20 0.0  0
0 1 0 0 0  30 0.0   2 1.0  50 0.0  0
0 1 0 1 1   2 0.0  50 0.0  20 0.0  0
0 1 1 0 1  25 0.0  50 0.0  70 0.0  0
0 1 1 0 1  60 0.0  40 0.0   5 0.0  0
0 1 1 0 1   7 0.9  90 0.0   7 0.9  0
0 1 1 1 1   3 0.0  90 0.0  20 0.0  0
0 0 1 1 1   9 0.0   8 0.0  60 0.0  1
0 0 1 1 1   2 0.0  60 0.0  70 0.0  1
0 0 1 0 1  60 0.0   9 0.0  80 0.0  1
0 0 1 0 1  90 0.1  60 0.0   1 0.0  1
0 0 1 0 1   1 0.0  60 0.0  70 0.0  1
0 0 1 0 1   2 0.0   9 0.0  12 0.0  1
0 0 1 0 1   4 0.0  60 0.0  12 0.0  1
0 0 1 0 1  10 0.0   2 0.0  10 0.0  1
0 0 1 0 1  25 0.4  40 0.0  30 0.0  1
0 0 1 0 1  12 0.5  40 0.0  30 0.0  1
0 0 1 0 1   2 1.0  40 0.0   2 1.0  0
0 0 1 0 1   3 1.0  40 0.0  30 0.0  1
0 0 1 0 1   1 1.0  12 0.0   9 0.0  1
0 0 1 0 1   6 1.0  70 0.1  60 0.0  1
0 0 1 0 1   3 1.0  70 0.0   3 1.0  0
0 0 1 0 1   6 0.95 30 0.0   5 1.0  0
0 0 0 0 1   6 0.0   2 1.0   9 0.0  0
0 0 0 0 1  12 0.0  60 0.0   0 0.0  0
0 0 0 0 1  30 0.0  60 0.0  10 0.0  0
0 0 0 0 1   2 1.0   0 0.0   2 1.0  0
0 0 0 1 1   4 0.0   0 0.0   9 0.0  0
0 0 0 0 0   2 1.0   0 0.0   2 1.0  0
0 0 0 0 0   5 0.8   3 1.0   4 1.0  0
0 0 0 0 0   3 0.0   2 1.0   2 1.0  0
0 0 0 0 0  14 0.7  50 0.0   6 1.0  0
0 0 0 0 0   5 0.0   3 1.0   2 0.6  0
0 0 0 0 0   7 0.0  60 0.0   0 0.0  0
0 0 0 0 0   4 0.0  30 0.0   3 1.0  0
0 0 0 0 0  60 0.0   5 0.0  70 0.0  1
0 0 0 0 0  40 0.1  70 0.0   8 0.0  1
0 0 0 0 0  25 0.2  40 0.0  30 0.0  1
0 0 0 0 0  20 0.0   2 1.0  50 0.0  1
0 0 0 0 0  16 0.0   9 0.0   4 0.0  1
0 0 0 0 0   8 0.0  45 0.0  50 0.0  1
0 0 0 0 0   5 0.0  60 0.0  40 0.0  1
0 0 0 0 0  24 0.0   3 1.0   3 0.0  1
0 0 0 0 0  22 0.0   3 0.0   3 1.0  1
0 0 0 0 0  30 0.0   6 0.5   6 1.0  1
0 0 0 0 0  24 0.1  60 0.0  60 0.0  1
0 0 0 0 0  18 0.0   2 0.0   5 0.0  1
0 0 0 0 0  17 0.0   2 1.0   2 1.0  1
0 0 0 0 0   3 0.0  24 0.0  24 0.0  1
0 0 0 0 0   1 0.0  30 0.0  40 0.0  1
0 0 0 0 0   2 0.0  50 0.0  18 0.0  1
0 0 0 0 0   2 0.0  24 0.0   3 1.0  0
0 0 0 0 0   2 0.0   3 1.0  24 0.0  0
0 0 0 1 0   6 0.0   3 1.0  50 0.0  1
0 0 0 1 0   3 0.0  60 0.0  50 0.0  1
0 0 0 1 0   2 0.0  50 0.0   2 1.0  0
"""


def _open(name: str, attrs: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """What an element says: chrome tag, hidden, chrome words, body, surely body, heading.

    An element is surely the body if its tag is main, or a class or id ends in a body word and holds no chrome word, or
    it is an article without chrome words, and no class is a chrome word as a whole ("sidebar content"). Compounds beside
    it then name states ("comments-open") and are not read.
    """
    words, whole, sure, gone, hide = set(), False, name == "main", False, r"display\s*:\s*none|visibility\s*:\s*hidden"
    if attrs and attrs.strip("/ "):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("hidden", "style", "aria-hidden"):
                gone |= key == "hidden" or (value.strip() == "true" if key == "aria-hidden" else bool(re.search(hide, value)))
            elif key in ("class", "id", "role", "aria-label"):
                for parts in map(_WORDS.findall, value.split()):
                    words |= set(parts)
                    whole |= len(parts) == 1 and parts[0] in CHROME_WORDS
                    sure |= key != "aria-label" and bool(parts) and parts[-1] in BODY_WORDS and not CHROME_WORDS.intersection(parts)
    page = name in ("html", "body")
    sure = (sure or (name == "article" and not words & CHROME_WORDS)) and not page and not whole
    chrome = bool(words & CHROME_WORDS) and not page and not sure
    return name in CHROME, gone, chrome, name in BODY or (bool(words & BODY_WORDS) and not page), sure, name in HEADINGS


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """(text, features) of every non-empty text block, in page order.

    Chrome words of an element that holds the body don't count: "with-sidebar" around the article is no sidebar.
    """
    found, stack, flags = [], [], (False, False, (), False, False)
    around, count = set(), 0  # elements with chrome words that hold the body; elements with chrome words so far
    parts, linked, in_link, at, n = [], 0, False, 0, len(page)

    def close() -> None:
        nonlocal parts, linked, in_link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            found.append((text, flags, words, min(1.0, linked / words)))
        parts, linked, in_link = [], 0, False

    def put(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(html.unescape(text).split())

    while at < n:
        less = page.find("<", at)
        if less < 0:
            put(page[at:])
            break
        if less > at:
            put(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, less)
        if not m:
            if page.startswith(("<!", "<?"), less):
                end = page.find(">", less)
                at = n if end < 0 else end + 1
            else:
                put("<")
                at = less + 1
            continue
        name, at = m[2].lower(), m.end()
        if name in RAW:
            if not m[1] and not _CLOSED.search(m[3]):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if name in MATH:
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m[1]
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if name in VOID:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                flags = stack[k][1]
                del stack[k:]
            continue
        if stack and stack[-1][0] in ("p", *HEADINGS):  # these end where the next block begins
            flags = stack.pop()[1]
        if not _CLOSED.search(m[3]):
            stack.append((name, flags))
            tag, gone, chrome, body, sure, heading = _open(name, m[3])
            if sure and not (flags[0] or flags[1]):
                around.update(flags[2])
            if chrome:
                count += 1
            flags = (flags[0] or tag, flags[1] or gone, (*flags[2], count) if chrome else flags[2], flags[3] or body, heading)
    close()
    found = [(text, (f[0], f[1] or not around.issuperset(f[2]), f[3], f[4]), words, link) for text, f, words, link in found]
    paged = any(f[2] and not (f[0] or f[1]) for _, f, _, _ in found)  # a menu named "main" is no body element
    size = [0.0, *(float(w) for *_, w, _ in found), 0.0]
    link = [0.0, *(x for *_, x in found), 0.0]
    return [
        (text, [float(f[0]), float(f[1]), float(f[2] and paged), float(f[3]), float(paged), size[i], link[i], size[i - 1], link[i - 1], size[i + 1], link[i + 1]])
        for i, (text, f, _, _) in enumerate(found, 1)
    ]


class Tree:
    """Decision tree: the split with the lowest weighted Gini impurity, halfway between values, until nodes are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.value, self.split = bool(y.mean() >= 0.5), None
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < cut
                impurity = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, cut)
        if best:
            low = x[:, best[1]] < best[2]
            self.split = best[1:]
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def __call__(self, row: list[float]) -> bool:
        node = self
        while node.split:
            node = node.low if row[node.split[0]] < node.split[1] else node.high
        return node.value


def train(table: str = LABELLED) -> Tree:
    """Where ancestors or own links decide a labelled block, it holds beside any neighbours, so it is repeated with those of
    all rows. Blocks without such signs, on pages without a body element, are learnt with their own neighbours."""
    rows = np.array([line.split() for line in table.split("\n") if line.strip()], float)
    linked_body = (rows[:, 2] == 1) & ~rows[:, [0, 1]].any(1) & (rows[:, 6] >= 0.5)
    decided = (rows[:, [0, 1, 2, 4]].any(1) | (rows[:, 6] >= 0.5)) & ~linked_body
    more = np.repeat(rows[decided], len(rows), axis=0)
    more[:, 7:11] = np.tile(rows[:, 7:11], (decided.sum(), 1))
    rows = np.vstack([np.repeat(rows[~decided], len(rows), axis=0), more])  # every labelled block has one weight
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None, tree: Tree) -> str:
    """Content blocks joined by newlines; empty for null, empty and contentless pages."""
    return "\n".join(text for text, row in blocks(page or "") if tree(row))


def extract_text(pages: DataFrame, html_col: str = "html", text_out: str = "text") -> DataFrame:
    """All columns of `pages` and the main text; a column of that name is replaced. Row by row, no shuffle.

    Null, empty and contentless pages give an empty text; repeated rows stay, an empty table gives none.
    """
    pages = pages.drop(text_out) if text_out != html_col else pages
    tree = train()  # a small tree, sent with the task's code

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(text_out, pa.array([main_text(x, tree) for x in batch.column(html_col).to_pylist()], pa.string()))

    return map_arrow(pages, run, StructType([*pages.schema.fields, StructField(text_out, StringType())]))
