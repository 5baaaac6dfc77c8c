"""Main-text extraction: flat text blocks classified by a small decision tree.

A page is read as a stream of tags and text.  Text is gathered into blocks
that end at block tags; script, style and other invisible elements are
skipped.  A block has its word count, link density, those of its neighbours,
whether it lies in a landmark of the article, of page furniture or of a form,
and whether a class, id or role around it names furniture and nothing else
(``ad-slot``), or has such a word in another name (``share-price``).  A Gini tree fitted
on ``LABELLED`` decides which blocks are main text.

Null or empty html gives the empty text.  A page cut off in mid-tag keeps the
text before that tag.  Pages are read whole; repeated rows are each given, an
empty table gives none.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrays, column, strings

#: HTML element names.
INVISIBLE = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "math", "canvas",
             "select", "textarea", "button", "audio", "video"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
         "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul", "caption", "label", "legend", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
HINTS = re.compile(r"(?<![a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notification|alert|"
                   r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|"
                   r"recommend\w*|comments?|commentlist|disqus|replies|reply|respond|sidebar|side-?bar|widget|menu|"
                   r"nav\w*|breadcrumbs?|pagination|pager|toolbar|footer|header|masthead|search|skip|tags?|toc)(?![a-z])")
#: Words that beside a furniture name say no more than where or what box it is.
GENERIC = {"ad", "area", "article", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content",
           "entry", "fixed", "form", "global", "group", "holder", "inline", "inner", "item", "items", "left", "link", "links", "list",
           "main", "module", "news", "outer", "page", "panel", "policy", "post", "posts", "primary", "reader", "right", "row", "secondary",
           "section", "site", "slot", "small", "sticky", "stories", "the", "thread", "top", "unit", "up", "user", "wrap", "wrapper", "zone"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog",
         "alert", "alertdialog", "alertbanner", "toolbar"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|data-role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")

NAMES = ["words", "links", "before_words", "before_links", "after_words", "after_links", "in_main", "in_furniture",
         "hinted", "page_has_main"]
#: Labelled blocks: the columns of NAMES, then 1 for main text.  First pages with a landmark, then pages without.
LABELLED = [
    (80, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 9, 0.0, 90, 0.0, 1, 0, 0, 1, 1), (40, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 1, 0.0, 8, 0.0, 1, 0, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (12, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1, 1), (30, 0.3, 50, 0.0, 8, 0.5, 1, 0, 0, 1, 1),
    (2, 1.0, 12, 0.0, 30, 0.0, 1, 0, 0, 1, 1), (150, 0.1, 4, 0.0, 8, 0.0, 1, 0, 0, 1, 1),
    (30, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0.5, 1, 1), (12, 0.0, 30, 0.0, 20, 0.0, 1, 0, 0.5, 1, 1), (60, 0.1, 9, 0.0, 1, 0.0, 1, 0, 0.5, 1, 1),
    (4, 1.0, 30, 0.0, 3, 1.0, 1, 0, 0.5, 1, 0), (3, 1.0, 4, 1.0, 20, 0.0, 1, 0, 0.5, 1, 0), (8, 0.9, 3, 1.0, 5, 1.0, 1, 0, 0.5, 1, 0),
    (8, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1, 1, 0), (40, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1, 1, 0),
    (12, 0.0, 3, 0.0, 1, 0.0, 1, 0, 1, 1, 0), (60, 0.0, 80, 0.0, 20, 0.0, 0, 0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0, 0),
    (9, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (14, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0),
    (25, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 0, 0), (20, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 1, 0),
    (90, 0.0, 20, 0.0, 30, 0.0, 1, 1, 0, 1, 0), (70, 0.0, 20, 0.0, 30, 0.0, 0, 1, 1, 0, 0),
    (10, 0.0, 20, 0.0, 30, 0.0, 0, 0, 0, 1, 0), (60, 0.0, 90, 0.0, 10, 0.0, 0, 0, 0, 1, 0),
    (5, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (30, 0.8, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 0),
    # running text, headings, short lines, lists, first and last blocks
    (60, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 0, 1), (25, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (80, 0.0, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (30, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (40, 0.0, 50, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (40, 0.0, 50, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 1, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 3, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (4, 0.0, 5, 0.0, 6, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 4, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 4, 0.0, 20, 0.0, 0, 0, 0, 0, 1),
    (30, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, 1), (45, 0.1, 4, 1.0, 30, 0.0, 0, 0, 0, 0, 1), (35, 0.0, 50, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 1, 1.0, 30, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 3, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 30, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (30, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 1), (30, 0.0, 20, 0.0, 20, 0.0, 0, 0, 0.5, 0, 1),
    (35, 0.5, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (6, 0.4, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    # link lists, lines between them, furniture by name
    (4, 1.0, 3, 1.0, 50, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (4, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (20, 0.9, 10, 1.0, 12, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (6, 0.8, 4, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (5, 0.8, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (6, 0.0, 40, 0.0, 3, 0.0, 0, 0, 0.5, 0, 0), (4, 0.0, 2, 0.0, 30, 0.0, 0, 0, 0.5, 0, 0), (9, 0.5, 30, 0.0, 30, 0.0, 0, 0, 0.5, 0, 0),
]


def hinted(named: str) -> float:
    """1 if a class, id or role names furniture and nothing else; 0.5 if a furniture name is part of another name."""
    weight = 0.0
    for name in named.split():
        if HINTS.search(name):
            rest = re.split(r"[-_:\d]+", HINTS.sub("-", name))
            weight = max(weight, 1.0 if all(not w or w in GENERIC for w in rest) else 0.5)
    return weight


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text blocks in page order with their features."""
    found: list[list] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, int, int, float, int]] = []  # tag, depth of main, furniture, hint, unseen around it
    main = furniture = hint = unseen = link = 0
    has_main = False

    def close():
        nonlocal linked
        whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            n = len(whole.split())
            found.append([whole, n, min(1.0, linked / n), main > 0, furniture > 0, hint])
        text.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if not unseen and m.start() > at:
            s = page[at:m.start()]
            text.append(s)
            linked += len(s.split()) if link else 0
        if m.start() < at:
            continue
        at = m.end()
        if m[1] is not None and not unseen:
            text.append(m[1].replace("&", "&amp;"))
        if not m[3]:
            continue
        tag, ending = m[3].lower(), m[2] == "/"
        if tag in BLOCK and not unseen:
            close()
        elif tag == "br" and not unseen:
            text.append(" ")
        if tag in VOID:
            continue
        if not ending:
            if tag in ("script", "style", "textarea", "title"):  # raw text up to the end tag
                end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            named = " ".join(x for g in _NAMED.findall(m[4]) for x in g).lower()
            stack.append((tag, main, furniture, hint, unseen))
            if tag == "p" and len(stack) > 1 and stack[-2][0] == "p":
                stack.pop(-2)
            has_main |= tag in MAIN
            # an article's own header is part of it
            inner = tag == "header" and main and not furniture
            main, furniture = main + (tag in MAIN), furniture + (tag in FURNITURE and not inner or bool(ROLES & {*named.split()}))
            hint = max(hint, hinted(named) if named and tag not in ("body", "html", "article", "main") else 0)
            unseen += tag in INVISIBLE or bool(_HIDDEN.search(m[4]))
            link += tag == "a"
            if m[4].endswith("/") and tag in ("svg", "path"):
                _, main, furniture, hint, unseen = stack.pop()
        else:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag == "a":
                link = max(0, link - 1)
            if k is not None and (tag in BLOCK or tag in INVISIBLE or k >= len(stack) - 3):
                _, main, furniture, hint, unseen = stack[k]
                del stack[k:]
    if at < len(page) and not unseen:
        text.append(page[at:])
    close()
    out = []
    for i, (s, n, d, *flags) in enumerate(found):
        b, a = (found[i - 1][1:3] if i else (0, 0.0)), (found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0))
        out.append((s, [n, d, *b, *a, *map(float, flags), float(has_main)]))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A Gini tree: (feature, threshold, left, right), or the label at a leaf."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(y.mean() >= 0.5)
    best = (1e9, 0, 0.0)
    for j in list(range(6, x.shape[1])) + list(range(6)):  # flags first among equal splits
        for t in np.unique(x[:, j])[:-1]:
            side = x[:, j] <= t
            gini = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (side, ~side))
            if gini < best[0] - 1e-12:
                above = x[~side, j].min()
                best = (gini, j, float((t + above) / 2))
    side = x[:, best[1]] <= best[2]
    if side.all() or not side.any():
        return int(y.mean() >= 0.5)
    return (best[1], best[2], grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1))


def trained():
    """The tree; its first split is on whether the page has a landmark."""
    table = np.array(LABELLED, float)
    at = NAMES.index("page_has_main")
    without, having = table[table[:, at] == 0], table[table[:, at] == 1]
    return (at, 0.5, grow(without[:, :-1], without[:, -1]), grow(having[:, :-1], having[:, -1]))


def decide(tree, row) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree) -> str:
    return "\n".join(s for s, row in blocks(page) if decide(tree, row)) if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = trained()

    def run(batches):
        for b in batches:
            texts = [main_text(p, tree) for p in strings(b, "html")]
            yield arrays(["page_id", "url", "text", "n_chars"], [
                column(b, "page_id"), column(b, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
