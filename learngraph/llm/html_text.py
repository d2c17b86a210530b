"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one per block of text: paragraphs, headings, list items, cells and
so on); scripts, styles and controls give none. Regions that markup itself names as menus, headers,
footers, sidebars, notices, adverts, forms or reader comments are suspect, and text density has the last word on them: one that holds most of
the page's text, in lines that read like text, with no article elsewhere, is no boilerplate whatever its name (a page-wide form, a
layout with a sidebar's name). Names that say something else too (``newsletter-archive``) and, inside an article or main
element, words that its own sections bear (``AMBIGUOUS``) count only for regions of which links
are a third or lines are short. On the lines left, the amount
of text (links counted against it) is summed over sliding windows of ``WINDOW`` lines: where the
sum surges over the threshold the main text begins, where it dives to nothing it ends, and the
stretches between are kept. A surge inside an article or main element is carried out to
the edges of that element, but for dives: ``WINDOW`` lines or more that are nothing but links, with their heading. Outside of any, a stretch takes in the heading before it and the
lines without links beside it. So no line of the article is lost for being short. Stretches outside
of such elements go where those inside hold more text, as an article does and a teaser doesn't.

Null and empty pages give an empty text. Character references are decoded once; white space in a
block becomes one space; blocks are joined by one line feed. Pages of any length are taken whole;
unclosed and misnested tags are read as browsers do for the elements that matter here, in time that grows with the
page's length alone. Repeated rows are read alike, empty tables give none, other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")

# Elements of HTML by what they mean here.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SUSPECT = {"nav", "header", "footer", "aside", "form", "menu"}
DROPPED = {"button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "head", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | DROPPED | SUSPECT
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id or role that name what isn't the article's own text.
BOILERPLATE = {
    "ad", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "footnav", "gdpr", "header", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "reply",
    "replies", "respond", "search", "share", "sharing", "sidebar", "sidebars", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
# Of them, words that sections of an article bear too: inside of one they drop a block only if it doesn't read like text.
AMBIGUOUS = {
    "banner", "complementary", "consent", "copyright", "discussion", "menu", "notice", "notification", "promotion", "recommended", "related",
    "reply", "respond", "search", "share", "sharing", "skip", "social", "subscription",
}
# Of the others, those that a page's outer wrapper bears too: where an article or main element opens inside of it, it is no boilerplate itself.
WRAPPERS = {"ad", "ads", "banner", "breadcrumb", "breadcrumbs", "complementary", "cookie", "cookies", "header", "menu", "nav", "navbar", "search", "sidebar", "sidebars", "skip", "social", "widget", "widgets"}
# Words that stand beside these in a name and change nothing of what it says; with others (or numbers) a name may speak of the page's matter.
COMPANIONS = {
    "area", "author", "bar", "block", "blog", "body", "bottom", "box", "button", "buttons", "center", "col", "column", "container", "content", "count", "desktop", "entry", "fixed", "form",
    "global", "google", "group", "heading", "icon", "icons", "id", "inline", "inner", "item", "items", "js", "large", "left", "link", "links", "list", "local", "main", "meta", "mobile", "module",
    "new", "outer", "page", "panel", "placeholder", "policy", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "small", "stories", "sticky", "story", "text", "thread",
    "title", "top", "unit", "user", "wide", "wp", "wrap", "wrapper", "zone",
}
COMMENTS = {"comment", "comments", "disqus", "discussion", "reply", "replies", "respond"}  # what readers write can be more than the article
MODIFIERS = {"has", "is", "no", "not", "with", "without"}  # before a word in a name: it speaks of the page around
DENSE = 25  # characters outside of links in a line of text, on average
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Words of ``BOILERPLATE`` in names that say nothing else, and in names that do."""
    sure, doubtful = set(), set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if parts and parts[0] not in MODIFIERS and (found := BOILERPLATE.intersection(parts)):
                other = any(len(p) > 1 and not p.isdigit() and p not in COMPANIONS and p not in BOILERPLATE for p in parts)
                (doubtful if other else sure).update(found)
    return sure, doubtful


def _sparse(chars: int, linked: int, n: int) -> bool:
    """Whether ``n`` lines are mostly links or too short for text."""
    return 3 * linked >= chars or chars - linked < DENSE * n


def lines(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, is a heading, number of its article or main element or -1) of every block, in page order."""
    out: list[tuple[str, int, bool, int]] = []
    text: list[tuple[str, int, int]] = []  # piece, characters inside links, doubtful inline element or 0
    stack: list[tuple[str, bool, int, int, int]] = []  # element, dropped from here on, container, suspect region, doubtful inline element
    opened: Counter[str] = Counter()  # elements on the stack
    last = page.rfind(">")
    token = _TOKEN
    above = [0]  # suspect region around each suspect region, from 1 on
    kinds = [0]  # of each: 1 if its name counts unless it holds the page's text, 2 if only for what doesn't read like text
    freed = [False]  # an article stands in it, and all regions around may hold one
    passable = [True]  # it and all regions around it may hold an article
    outermost = [0]  # the first region around it (or itself) whose name counts
    started = [-1]  # its place on the stack
    commented = [False]  # its name speaks of readers' comments
    marks: list[int] = []  # suspect region of each line
    containers = inlines = 0
    link_depth, dropped, container = 0, False, -1
    at, size = 0, len(page)
    lowered = None

    def cut(k):
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    def tag(start):
        """The next tag or comment from ``start`` on; quotes that never close are none from there on."""
        nonlocal token
        while (start := page.find("<", start)) >= 0 and (start < last or page.startswith("<!--", start)):
            found = token.match(page, start)
            if not found and token is _TOKEN and re.match("/?[a-zA-Z]", page[start + 1 : start + 3]):
                token = _LOOSE
                found = token.match(page, start)
            if found:
                return found
            start += 1
        return None

    def flush():
        if text:
            kept = text
            if any(t[2] for t in text):  # inline elements of doubtful name stay in a line that is text without them, or if they are text themselves
                plain = [t for t in text if not t[2]]
                if _sparse(sum(len(t[0].strip()) for t in plain), sum(t[1] for t in plain), 1):
                    parts: dict[int, list[tuple[str, int, int]]] = {}
                    for t in text:
                        parts.setdefault(t[2], []).append(t)
                    gone = {k for k, own in parts.items() if k and _sparse(sum(len(t[0].strip()) for t in own), sum(t[1] for t in own), 1)}
                    kept = [t for t in text if t[2] not in gone]
            joined = _SPACE.sub(" ", html.unescape("".join(t[0] for t in kept))).strip()
            if joined:
                out.append((joined, sum(t[1] for t in kept), bool(stack) and any(s[0] in HEADINGS for s in stack[-3:]), container))
                marks.append(stack[-1][3] if stack else 0)
            text.clear()

    while at < size:
        m = tag(at)
        end = m.start() if m else size
        if end > at and not dropped:
            piece = page[at:end]
            text.append((piece, len(piece.strip()) if link_depth else 0, stack[-1][4] if stack else 0))
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None) if opened[name] else None
            if name in BLOCKS:
                flush()
            if name == "a" and link_depth:
                link_depth -= 1
            if depth is None:
                continue
            cut(depth)
            dropped, container = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
            continue
        if name in RAW:
            if lowered is None:
                lowered = page.lower()
            close = lowered.find("</" + name, at)
            close = size if close < 0 else close
            stop = page.find(">", close)
            at = size if stop < 0 else stop + 1
            continue
        if name in BLOCKS or name == "br":
            if name in BLOCKS:
                flush()
            elif not dropped:
                text.append((" ", 0, 0))
        if name in VOID:
            continue
        if name == "a":
            link_depth += 1
            continue
        if name not in BLOCKS and not m[3]:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack:
            for k in range(len(stack) - 1, -1, -1):  # an open one ends where the next of its kind begins
                if stack[k][0] == name:
                    cut(k)
                    break
                if stack[k][0] in BLOCKS and not (name == "p" and stack[k][0] in HEADINGS):
                    break
            dropped, container = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
        if name == "body":
            cut(0)
            dropped, container = False, -1
        elif name in ("article", "main"):
            region = stack[-1][3] if stack else 0
            first = next(k for k, x in enumerate(stack) if x[0] == "head") if opened["head"] else started[outermost[region]]
            if first >= 0 and stack[first][0] in ("nav", "menu", "head"):  # one that was never closed ends here
                cut(first)
                dropped, container = (stack[-1][1], stack[-1][2]) if stack else (False, -1)
                region = stack[-1][3] if stack else 0
            if passable[region] and not dropped and not any(_names(m[3])):
                freed[region] = True
        own = dropped
        block, inline = stack[-1][3:5] if stack else (0, 0)
        if not own:
            inside = opened["article"] + opened["main"] > 0
            suspect = name in SUSPECT and not (name == "header" and inside)
            own = name in DROPPED
            if not own and (suspect or m[3]) and name not in ("html", "body", "article", "main"):
                sure, doubtful = _names(m[3]) if m[3] else (set(), set())
                if inside:
                    sure, doubtful = sure - AMBIGUOUS - {"header"}, (doubtful | sure & AMBIGUOUS) - {"header"}
                own = bool(m[3] and _HIDDEN.search(m[3]))
                if not own and (suspect or sure or doubtful):
                    if name in BLOCKS or sure or suspect:
                        flush()
                        above.append(block)
                        kinds.append(1 if suspect or sure else 2)
                        wraps = name == "form" if suspect else not inside and sure | doubtful <= WRAPPERS
                        passable.append(passable[block] and (kinds[-1] == 2 or wraps))
                        outermost.append(outermost[block] or (len(kinds) - 1) * (kinds[-1] == 1))
                        started.append(len(stack))
                        commented.append(bool((sure | doubtful) & COMMENTS))
                        freed.append(False)
                        block = len(above) - 1
                    else:
                        inlines += 1
                        inline = inlines
            if own:
                flush()
        if name in ("article", "main"):
            containers += 1
            container = containers
        if m[3].endswith("/"):
            continue
        stack.append((name, own, container, block, inline))
        opened[name] += 1
        dropped = own
    flush()
    if len(above) == 1:
        return out
    return [line for line, kept in zip(out, _judged(out, marks, above, kinds, freed, commented), strict=True) if kept]


def _judged(found: list[tuple[str, int, bool, int]], marks: list[int], above: list[int], kinds: list[int], freed: list[bool], commented: list[bool]) -> list[bool]:
    """Which lines stay, by the suspect regions around them; inner regions have larger numbers."""
    n = len(above)
    own = np.zeros((n, 4), np.int64)  # characters, of them inside links, lines, of them in articles
    for (t, linked, _, container), mark in zip(found, marks, strict=True):
        own[mark] += (len(t), linked, 1, (container >= 0) * max(0, len(t) - 2 * linked))
    whole = own.copy()
    for k in range(n - 1, 0, -1):
        whole[above[k]] += whole[k]
        freed[above[k]] |= freed[k]
    total = whole[0]
    gone = [False] * n
    for k in range(1, n):
        if kinds[k] == 1 and not freed[k]:
            plain, rest = whole[k, 0] - whole[k, 1], total[0] - total[1] - (whole[k, 0] - whole[k, 1])
            apart = rest == 0 if commented[k] else plain > 2 * rest
            gone[k] = not (apart and total[3] == whole[k, 3] and not _sparse(*whole[k, :3].tolist()))
    left = own.copy()
    for k in range(n - 1, 0, -1):  # what stays of inner regions counts for the outer ones
        if kinds[k] == 2 and not gone[k]:
            gone[k] = _sparse(*left[k, :3].tolist())
        if not gone[k]:
            left[above[k]] += left[k]
    for k in range(1, n):
        gone[k] |= gone[above[k]]
    return [not gone[mark] for mark in marks]


def spans(found: list[tuple[str, int, bool, int]]) -> list[tuple[int, int]]:
    """Stretches of lines (first, end) between a surge and the dive after it, carried to the edges of their elements."""
    n = len(found)
    if not n:
        return []
    weight = np.array([max(0, len(t) - 2 * linked) for t, linked, _, _ in found], float)
    blocks = np.convolve(weight, np.ones(WINDOW))[WINDOW - 1 :]  # sum of a line and those after it
    threshold = min(86.0, 0.5 * blocks.max())
    inside: list[tuple[int, int]] = []
    k = 0
    while k < n:
        if blocks[k] > threshold and weight[k] > 0:  # surge
            end = k
            while end < n and weight[end : end + WINDOW].sum() > 0:  # dive: nothing for a whole window
                end += 1
            inside.append((k, end))
            k = end
        k += 1
    keep = np.zeros(n, bool)
    for a, b in inside:
        keep[a:b] = True
    owner = np.array([c for _, _, _, c in found])
    outside = owner < 0
    if weight[keep & ~outside].sum() > weight[keep & outside].sum():
        keep &= ~outside  # an article that holds most of the text: what is outside of it isn't the article
    keep |= ~outside & np.isin(owner, owner[keep & ~outside])
    k = 0
    while k < n:  # dives inside an element
        end = k
        while end < n and not outside[end] and weight[end] == 0 and owner[end] == owner[k]:
            end += 1
        if end - k >= WINDOW:
            keep[k:end] = False
            if k and found[k - 1][2] and owner[k - 1] == owner[k]:
                keep[k - 1] = False
        k = max(end, k + 1)
    plain = [linked == 0 for _, linked, _, _ in found]
    for k in range(1, n):
        keep[k] |= outside[k - 1] and outside[k] and keep[k - 1] and plain[k]
    for k in range(n - 2, -1, -1):
        keep[k] |= outside[k + 1] and outside[k] and keep[k + 1] and (plain[k] or found[k][2])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def main_text(page: str | None) -> str:
    found = lines(page or "")
    return "\n".join(found[k][0] for a, b in spans(found) for k in range(a, b))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_spans, the number of kept stretches, of every page."""

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for page in batch.column(2).to_pylist():
                found = lines(page or "")
                kept = spans(found)
                texts.append("\n".join(found[k][0] for a, b in kept for k in range(a, b)))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_spans"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_spans long")
