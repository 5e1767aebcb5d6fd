"""Main-text extraction by minimum-cut labelling of text blocks.

A page is read once into blocks: runs of text between block-level tags. Each block has
features of its own (length, punctuation, share of link text) and of the elements around
it (their names, class, id and role words). A logistic classifier gives each block a
probability of content; its costs become terminal capacities, -log p towards boilerplate
and -log (1 - p) towards content. Neighbouring blocks, and blocks under the same parent,
are joined by smoothness edges that weigh more the nearer the blocks are in the DOM. The
minimum cut, found by max-flow (shortest augmenting paths on a small graph), is the
labelling of least total cost; the blocks on the content side are the main text.

The classifier is trained here, on blocks of a bounded sample of pages (`SAMPLE_PAGES`,
by hash) whose elements settle their label (article or main against nav, header,
footer, aside, form). What stands nearest around a block, an article or a class, id or role word of
boilerplate, is a feature like any other, blanked in half of the training blocks so that it also learns
from text; the name of the element that holds a block is none, so text of an article
counts alike in a paragraph, a list, a table or a bare div. Without such pages a prior
stands in. Reader comments are boilerplate where a word names them, on a nested article too, or a
heading announces them. Only elements that never hold main text (scripts, styles, forms, nav, footer, aside, a page's
header, hidden elements) are excluded through an infinite capacity. Extraction is one pass
over whole pages without a shuffle, linear in the page however deep its elements nest.

Cases: null and empty html give an empty text. Unclosed, stray and badly nested tags are
tolerated: a block-level tag closes open paragraphs, an end tag closes what is open
inside its element, an unknown end tag is ignored. Character references are decoded.
Repeated rows are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.training import fit_logistic, hashed_sample, logistic, trained

SAMPLE_PAGES = 400

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b", re.I)
#: Elements whose content is no markup; the first two hold the rest of a page if they are not closed.
_RAW = {"script", "style", "template", "textarea", "title", "iframe"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "option", "button", "label", "legend", "video", "audio",
}
#: Elements whose text is never the article's.
_NEVER = {"nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "option", "select", "input"}
_GOOD = {"article", "main"}
_BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?:ads?|adverts?|advertisement|advertising|adsense|banners?|sponsor|sponsors|sponsored|promo|promos|promotion|nav|navbar|navigation|menus?"
    r"|breadcrumbs?|footer|header|masthead|topbar|toolbar|sidebar|widgets?|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|share|sharing|social|comments?|disqus|replies|reply|respond|related|recommended|recommendations|more-from|pagination|pager|copyright|search|form|skip|skiplinks?|alert|disclaimer)(?:$|[\s_-])",
    re.I,
)
_GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|prose|page)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    name: str
    words: str = ""
    hidden: bool = False
    parent: Element | None = None
    depth: int = 0
    good: bool = False  # the nearest of what tells is an article or main element
    never: bool = False
    bad: bool = False  # the nearest is a boilerplate word in a class, id or role
    fine: bool = False
    blocks: int = 0  # block-level elements from the root to here


@dataclass
class Block:
    text: str
    parent: Element
    linked: int = 0
    path: list[Element] = field(default_factory=list)


def _opened(name: str, attributes: str, parent: Element | None) -> Element:
    words, hidden = "", False
    if attributes:
        for key, value, bare in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            key = key.lower()
            if bare or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                hidden = True
            elif key in ("class", "id", "role"):
                words += " " + value
    e = Element(name, words.strip(), hidden, parent, parent.depth + 1 if parent else 0)
    inner, spoilt = (parent.good, parent.bad) if parent else (False, False)
    told = bool(words) and bool(_BAD_WORDS.search(words))
    main = name in _GOOD or "role" in attributes and words.strip().lower().endswith("main")
    if main and not (inner or spoilt and told):
        e.good, e.bad = True, False  # an article, whatever its page or itself is called
    elif told and name not in ("html", "body", "main"):
        e.good, e.bad = False, True
    else:
        e.good, e.bad = inner, spoilt
    e.blocks = (parent.blocks if parent else 0) + (name in _BLOCK)
    e.fine = bool(words) and bool(_GOOD_WORDS.search(words)) or bool(parent and parent.fine)
    never = name in _NEVER or name == "header" and not e.good or hidden
    e.never = never or bool(parent and parent.never)
    return e


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page, in order."""
    here, found = Element("#root"), []
    opened: dict[str, list[Element]] = {}  # those open, by name, the innermost last
    text: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", references.unescape("".join(text))).strip()
            if joined:
                found.append(Block(joined, here, linked))
            text.clear()
        linked = 0

    def leave(to: Element) -> None:
        nonlocal here
        while here is not to:
            opened[here.name].pop()
            here = here.parent

    source, at = html or "", 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        piece = source[at : m.start()] if m else source[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue  # comment, declaration
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                text.append(" ")
            e = opened[name][-1] if opened.get(name) else None
            if name in _BLOCK:
                flush()
            if e is not None and (name in _BLOCK or here.blocks == e.blocks):
                leave(e.parent)
            continue
        if name in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if end or name in ("script", "style"):
                at = end.end() if end else len(source)
                text.append(" ")
                continue
        if name in _VOID:
            if name in ("br", "hr"):
                if name == "hr":
                    flush()
                else:
                    text.append(" ")
            continue
        if name in _BLOCK:
            flush()
            leave(_implied(here, name))
        if m[3].endswith("/"):
            continue
        if name == "a":
            links += 1
        here = _opened(name, m[3], here)
        opened.setdefault(name, []).append(here)
    flush()
    return _without_comments(found)


#: Headings that announce reader comments.
_COMMENTS = re.compile(
    r"^\W*(?:\d+\W+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|responses|replies|reactions?|discussion|leave a (?:comment|reply)|join the (?:discussion|conversation)|what (?:our )?readers say|kommentare?|leserkommentare|leserbriefe"
    r"|commentaires?|r[ée]actions|comentarios?|respuestas|commenti|reacties)\W*(?:\(?\d+\)?)?\W*$",
    re.I,
)
_LEVEL = {f"h{k}": k for k in range(1, 7)}


def _heading(e: Element | None) -> Element | None:
    """The heading that a block is, or None."""
    while e is not None and e.name not in _LEVEL:
        e = None if e.name in _BLOCK else e.parent
    return e


def _comment(e: Element) -> Element:
    return Element("#comments", parent=e, depth=e.depth + 1, never=e.never, bad=True, blocks=e.blocks)


def _without_comments(page: list[Block]) -> list[Block]:
    """Marks what a heading of comments announces: what follows it in the element that holds it, up to a heading of its rank."""
    holder, level = None, 0
    for b in page:
        heading = _heading(b.parent)
        if holder is not None and (not _stands_in(b.parent, holder) or heading is not None and heading.parent is holder and _LEVEL[heading.name] <= level):
            holder = None
        if holder is None and heading is not None and heading.parent is not None and _COMMENTS.match(b.text):
            holder, level = heading.parent, _LEVEL[heading.name]
        if holder is not None:
            b.parent = _comment(b.parent)
    return page


def _stands_in(e: Element | None, holder: Element) -> bool:
    while e is not None and e.depth > holder.depth:
        e = e.parent
    return e is holder


#: Elements that a start tag of the key closes when open (nearest first, up to a container).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_INLINE_OPEN = {"p", "b", "i", "em", "strong", "span", "font", "u", "a", "small", "big", "tt", "code", "mark", "h1", "h2", "h3", "h4", "h5", "h6"}


def _implied(here: Element, name: str) -> Element:
    """Where a block-level start tag goes: an open paragraph, with inline tags in it, ends."""
    e: Element | None = here
    closes = _CLOSES.get(name, set())
    while e is not None and (e.name in _INLINE_OPEN or e.name in closes):
        if e.name == "p" or e.name in closes:
            return e.parent or here
        e = e.parent
    return here


FEATURES = 10


def features(page: list[Block]) -> np.ndarray:
    """One row a block; the first three come from names, the rest from text and place."""
    n, rows = len(page), []
    for k, b in enumerate(page):
        e, t = b.parent, b.text
        words = t.count(" ") + 1
        ends = t[-1:] in tuple(".!?:;\"'”’»…)")
        rows.append([
            float(e.good), float(e.bad), float(e.fine),
            math.log1p(words), math.log1p(len(t)), min(1.0, b.linked / max(1, len(t))), float(ends), (t.count(".") + t.count(",")) / words,
            float("©" in t or "|" in t), min(k, n - 1 - k) / max(1, n),
        ])
    return np.array(rows).reshape(len(rows), FEATURES)


#: Weights used where no page of the sample has elements that settle labels.
PRIOR = (np.zeros(FEATURES), np.ones(FEATURES), np.array([3.5, -7.0, 1.0, 0.5, 0.1, -4.0, 0.8, 0.5, -1.5, 0.5, -1.5]))


def train(pages: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = [], []
    for html in pages:
        page = blocks(html)
        rows = features(page)
        for b, row in zip(page, rows, strict=True):
            if b.parent.good and not b.parent.never and not b.parent.bad:
                x.append(row), y.append(1.0)
            elif b.parent.never or b.parent.bad:
                x.append(row), y.append(0.0)
    if not y or min(y) == max(y):
        return PRIOR
    x, y = np.array(x), np.array(y)
    blank = np.random.default_rng(2).random(len(x)) < 0.5
    x[np.ix_(blank, [0, 1, 2])] = 0.0
    return fit_logistic(x, y)


def min_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes stay with the content terminal in a minimum cut.

    content[k] is what is paid if node k is cut from content, boilerplate[k] if it is
    content; an edge is paid if its ends part. Shortest augmenting paths.
    """
    n = len(content)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), cap.append(there)
        out[b].append(len(to)), to.append(a), cap.append(back)

    for k in range(n):
        through = min(content[k], boilerplate[k])  # flows straight through the node
        if content[k] > through:
            arc(s, k, float(content[k] - through), 0.0)
        if boilerplate[k] > through:
            arc(k, t, float(boilerplate[k] - through), 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for i in out[a]:
                if cap[i] > 1e-12 and level[to[i]] < 0:
                    level[to[i]] = level[a] + 1
                    queue.append(to[i])
        if level[t] < 0:
            return np.array([level[k] >= 0 for k in range(n)], dtype=bool)
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[i] for i in path)
                for i in path:
                    cap[i] -= flow
                    cap[i ^ 1] += flow
                first = next(k for k, i in enumerate(path) if cap[i] <= 1e-12)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                i = out[a][turn[a]]
                if cap[i] > 1e-12 and level[to[i]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -2
                i = path.pop()
                a = to[i ^ 1]
            else:
                break


#: Steps through the DOM from which blocks count as far apart.
FAR = 64


def _smoothness(page: list[Block], strength: float) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by DOM distance, and along the blocks of a parent."""
    edges, last = [], {}
    for k, b in enumerate(page):
        if k:
            a, e, d = page[k - 1].parent, b.parent, 0
            while a is not e and (a or e) and d < FAR:
                if a and (not e or a.depth >= e.depth):
                    a = a.parent
                else:
                    e = e.parent
                d += 1
            edges.append((k - 1, k, strength / (1 + d)))
        over = id(b.parent.parent or b.parent)
        if over in last and last[over] != k - 1:
            edges.append((last[over], k, strength / 2))
        last[over] = k
    return edges


def extract(html: str | None, model: tuple[np.ndarray, np.ndarray, np.ndarray] = PRIOR, strength: float = 1.0) -> str:
    """The main text: content blocks in page order, joined by line feeds."""
    page = blocks(html)
    if not page:
        return ""
    p = np.clip(logistic(model, features(page)), 1e-6, 1 - 1e-6)
    never = np.array([b.parent.never for b in page])
    content, boilerplate = np.where(never, 0.0, -np.log(1 - p)), np.where(never, 1e6, -np.log(p))
    kept = min_cut(content, boilerplate, _smoothness(page, strength))
    return "\n".join(b.text for b, k in zip(page, kept, strict=True) if k)


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = pages.select(F.col("html").cast("string").alias("text")).where("text is not null")
    sample = hashed_sample(found, F.xxhash64("text"), rows).groupBy("text").agg(F.xxhash64("text").alias("doc_id"), F.lit(0).alias("y"))
    return trained(sample, lambda pages_, _: train(pages_))


def extracted(pages: DataFrame, rows: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, model.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
