"""Main text of web pages: flat text blocks, shallow features of a block and its neighbours, and a decision tree.

A page is cut into flat blocks at block-level tags. Of each block the features are its word count and link density, those of
the block before and after it, whether it is a heading or list item, and what the nearest ancestor that says anything about
its role says (an ``article`` or a class of content, or a ``nav`` or a class of advert). A decision tree, grown on the small
labelled table in :mod:`mergestone.llm.html_labels`, classifies the blocks. Pages are independent rows, so Spark deals them
to tasks and no shuffle is needed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag whose quotes hold no angle brackets; tags of any other form are found by :meth:`Scanner.tag_end`.
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+)*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
QUOTE_OR_END = re.compile("[\"'>]")
#: Elements that are skipped with all that they hold. Of one that isn't closed, or a head that isn't before the body, only the tag
#: is skipped, but for scripts and styles, which take the rest of the page.
SKIPPED = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in "script style template svg noscript iframe object title head".split()}
BODY = re.compile(r"<body\b", re.I)
SPACE_ONLY = frozenset({"br", "wbr", "img", "input", "hr"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
NOT_P = BLOCK - {"p"}
CLOSES_P = BLOCK - {"body", "html", "label", "button", "option"}
#: Elements that end at the start of the next of their kind.
AGAIN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset({"ul", "ol", "menu", "dl", "table", "select"})
AWAY_TAGS = frozenset("nav header footer aside form menu dialog select button textarea fieldset label legend".split())
MAIN_TAGS = frozenset({"article", "main"})
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?s?|sidebar|side|widgets?|menu|nav|navbar|navigation|breadcrumbs?"
    r"|topbar|masthead|header|footer|foot|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|shar(?:e|ing)"
    r"|related|recommend(?:ed|ations)?|more|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|search|copyright|legal|disclaimer|pag(?:er|ination)|tags?|toolbar"
    r"|skip|contentinfo|complementary|form|dialog|teasers?|trending|popular|byline|meta)(?:$|[\s_-])",
    re.I,
)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|content|story|main|maincontent|body|text|prose)(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s\"'=_-])(?:article|articlebody|post|entry|story|prose)(?:$|[\s\"'>_-])", re.I)
SURELY_AWAY = re.compile(r"comment|advert|\bads?\b|sidebar|footer|header|related|share|promo|notice|cookie|newsletter|\b(?:nav|menu|form|login|modal|popup|breadcrumbs?|subscribe)\b", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "role", "main_tag", "away_tag", "heading", "item", "stop", "page_has_main")


def _role(tag: str, attributes: str) -> int:
    """+1: main text, -1: something else, 0: says nothing; -2: not shown."""
    away, main = tag in AWAY_TAGS, tag in MAIN_TAGS
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and m[0].lower() == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return -2
        if name in ("class", "id", "role"):
            main = main or bool(MAIN.search(value)) and tag not in AWAY_TAGS
            away = away or bool(AWAY.search(value))
            if value.lower() in ("navigation", "banner"):
                away = True
    if main and away:  # such as main-menu or modal-body: only a name of the article itself outweighs the other
        return 1 if tag in MAIN_TAGS or ARTICLE.search(attributes) and not SURELY_AWAY.search(attributes) else -1
    return 1 if main else -1 if away else 0


class Scanner:
    """The tags of a page, in time proportional to its length whatever its markup: what isn't found behind some place is not
    looked for again behind later ones, and no quote that leads nowhere is followed twice."""

    def __init__(self, page: str):
        self.page, self.missing, self.dead = page, {}, set()

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        got = self.page.find(what, at)
        if got < 0:
            self.missing[what] = at
        return got

    def closed(self, tag: str, at: int) -> int:
        """Where the next end tag of an element that is skipped ends, or -1."""
        if at >= self.missing.get(tag, len(self.page) + 1):
            return -1
        got = SKIPPED[tag].search(self.page, at)
        if got is None:
            self.missing[tag] = at
        return got.end() if got and not (tag == "head" and BODY.search(self.page, at, got.start())) else -1

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, outside quotes, or, where a quote is not closed, the next > at all; or -1."""
        begin, opened = at, []
        while at < self.missing.get("", len(self.page) + 1):
            if (m := QUOTE_OR_END.search(self.page, at)) is None:
                self.missing[""] = at  # nor behind any later place
                break
            if m[0] == ">":
                return m.start()
            at = self.find(m[0], m.end()) + 1
            if m.start() in self.dead or not at:
                break
            opened.append(m.start())
        self.dead.update(opened)
        return self.find(">", begin)

    def tags(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, name, closing, attributes); the name is None for what is skipped."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
                yield at, end, None, False, ""
            elif page.startswith("<![CDATA[", at):
                end = self.find("]]>", at)
                end = len(page) if end < 0 else end + 3
                yield at, end, None, False, ""
            elif page.startswith(("<!", "<?"), at):
                end = self.find(">", at) + 1
                if not end:
                    return
                yield at, end, None, False, ""
            else:
                m = TAG.match(page, at) or NAME.match(page, at)
                if m is None:
                    at += 1
                    continue
                end = m.end() if m.lastindex == 3 else self.tag_end(m.end()) + 1
                if not end:
                    at += 1
                    continue
                name, closing = m[2].lower(), bool(m[1])
                if name in SKIPPED and not closing:
                    past = self.closed(name, end)
                    if past < 0 and name in ("script", "style"):
                        past = len(page)
                    if past >= 0:
                        yield at, past, None, False, ""
                        at = past
                        continue
                yield at, end, name, closing, m[3] if m.lastindex == 3 else page[m.end() : end - 1]
            at = end


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Flat blocks of a page in order: (text, own features), white space inside made one space."""
    out: list[tuple[str, list[float]]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, role so far, inside article or main, inside nav, form and the like
    opened: Counter[str] = Counter()  # tags in the stack
    text: list[str] = []
    linked = 0
    anchors = 0
    tag_of_block = "p"
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            top = stack[-1] if stack else ("", 0, False, False)
            if words and top[1] != -2:
                joined = " ".join(words)
                own = [len(words), min(1.0, linked / len(words)), top[1], top[2], top[3], tag_of_block[0] == "h" and tag_of_block[1:].isdigit(), tag_of_block in ("li", "td", "dd", "dt", "th"), joined[-1] in ".!?…\"”»:"]
                out.append((joined, own))
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if anchors:
                linked += len(part.split())

    def close(tags: set[str] | frozenset[str], up_to: frozenset[str]) -> None:
        """Ends the innermost open element of some tags, unless one of ``up_to`` is open inside it."""
        if any(opened[t] for t in tags):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    return
                if stack[k][0] in up_to:
                    return

    for start, end, tag, closing, attributes in Scanner(page).tags():
        if start > at:
            add(page[at:start])
        at = end
        if tag is None:
            text.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag in BLOCK:
            flush()
            tag_of_block = "p" if closing else tag
            anchors = 0
        elif tag in SPACE_ONLY:
            text.append(" ")
        if tag in VOID:
            continue
        if closing:
            close({tag}, frozenset())
            continue
        if tag in CLOSES_P:
            close({"p"}, NOT_P)
        if tag in AGAIN:
            close(AGAIN[tag], SCOPE)
        if tag in BLOCK or tag in ("span", "b", "i", "em", "strong", "font"):
            _, role, inside, away = stack[-1] if stack else ("", 0, False, False)
            own = _role(tag, attributes) if tag not in ("body", "html") and (attributes or tag in AWAY_TAGS or tag in MAIN_TAGS) else 0
            role = -2 if -2 in (role, own) else own or role
            stack.append((tag, role, inside or tag in MAIN_TAGS, away or tag in AWAY_TAGS))
            opened[tag] += 1
    add(page[at:])
    flush()
    return out


def features(own: list[list[float]]) -> np.ndarray:
    """Of the blocks of one page, with those of their neighbours; beyond the ends stands a block of nothing."""
    a = np.array(own, float).reshape(-1, 8)
    before, after = np.vstack([np.zeros((1, 8)), a[:-1]]), np.vstack([a[1:], np.zeros((1, 8))])
    has = np.full((len(a), 1), float((a[:, 2] > 0).any())) if len(a) else np.zeros((0, 1))
    return np.hstack([a[:, :2], before[: len(a), :2], after[: len(a), :2], a[:, 2:], has])


class Tree:
    """A binary decision tree grown by Gini impurity; arrays of (feature, threshold, left, right, value)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.nodes: list[list[float]] = []
        self._grow(x, y, depth, least)
        self.table = np.array(self.nodes)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        number = len(self.nodes)
        self.nodes.append([-1, 0, 0, 0, float(y.mean() >= 0.5)])
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
        if depth and 0 < y.mean() < 1:
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                v, c = x[order, k], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= least) & (len(y) - cut >= least)]
                if len(cut):
                    left, right = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(y) - cut)
                    cost = 2 * (left * (1 - left) * cut + right * (1 - right) * (len(y) - cut))
                    i = int(cost.argmin())
                    if cost[i] < best[0]:
                        best = (cost[i], k, (v[cut[i]] + v[cut[i] - 1]) / 2)
        if best[1] is not None:
            low = x[:, best[1]] <= best[2]
            self.nodes[number][:2] = best[1], best[2]
            self.nodes[number][2] = self._grow(x[low], y[low], depth - 1, least)
            self.nodes[number][3] = self._grow(x[~low], y[~low], depth - 1, least)
        return number

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            k = self.table[at, 0].astype(int)
            inner = k >= 0
            if not inner.any():
                return self.table[at, 4] > 0
            low = x[np.arange(len(x)), np.maximum(k, 0)] <= self.table[at, 1]
            at = np.where(inner, np.where(low, self.table[at, 2], self.table[at, 3]).astype(int), at)


#: What tells a role outright: elements and attributes.
TELLING_TAG = re.compile(rf"<(/?)(?:{'|'.join(sorted((AWAY_TAGS | MAIN_TAGS) - {'select', 'menu'}))})\b[^>]*>", re.I)
TELLING_ATTRIBUTE = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def without_names(page: str) -> str:
    """The page with all that names a role taken out, so that only its blocks and their neighbours tell what is main text."""
    return TELLING_ATTRIBUTE.sub("", TELLING_TAG.sub(r"<\1div>", page))


@lru_cache(1)
def trained() -> Tree:
    """Grown on every page of the labelled table as it is and without names."""
    from mergestone.llm.html_labels import LABELLED

    x, y = [], []
    for page, main in LABELLED:
        for form in (page, without_names(page)):
            found = blocks(form)
            x.append(features([b[1] for b in found]))
            y += [any(b[0].startswith(m) for m in main) for b in found]
    return Tree(np.vstack(x), np.array(y, float))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_blocks, n_kept) for each row of ``pages``; text is the kept blocks in page order,
    joined by two line ends, empty where there is none. A null html is an empty page; null page_id and url stay null;
    repeated rows give equal rows; extra columns are not read; whole pages are parsed, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                kept = tree.predict(np.vstack([features([b[1] for b in f]) for f in found]))
                text, n, at = [], [], 0
                for f in found:
                    good = [b[0] for b, k in zip(f, kept[at : at + len(f)]) if k]
                    at += len(f)
                    text.append("\n\n".join(good))
                    n.append(len(good))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(f) for f in found], pa.int64()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_blocks", "n_kept"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_kept long")
