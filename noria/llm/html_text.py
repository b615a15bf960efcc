"""Main text of web pages by minimum cut.

A page is cut into text blocks at block-level tags. A logistic classifier over a block's text, links, tag,
place among its neighbours and in the page, and containers gives it two costs, which become the capacities from the
source (content) and to the sink (boilerplate). Blocks that follow each other, and blocks in the same container,
are tied by edges of small capacity. The maximum flow then parts the page where disagreeing with the
classifier and cutting ties costs least in sum. The classifier is trained here, on the blocks of PAGES, small
labelled pages of several styles (half of them name no container), parsed as all pages are.

Each page is a row of its own, so there is no shuffle. Formulas, fallbacks of objects and canvases, and buttons within sentences are text like any
other; what is hidden, other buttons, and what stands in a noscript outside an article are blocks that the classifier sees as away from content. Null or empty html gives an empty text;
very long and deeply nested pages are parsed in one pass, in linear time; broken and cut-off markup is read as far
as it goes. Repeated rows are extracted each; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import clean_input
from .workers import tidy

_TAG = re.compile(r"""<(?:!--(?:.*?--\s*>|.*$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|/?$|/[^a-zA-Z>][^>]*(?:>|$))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Never text of the page: code, drawings and form controls. What is inside is skipped.
RAW = frozenset("script style template textarea iframe svg select".split())
#: Of these, the ones that hold text only: without an end tag they hold the rest of the page.
_TEXT_ONLY = frozenset("script style textarea iframe".split())
VOID = frozenset("br img meta link hr input wbr area base col embed source track param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input object canvas".split()) | frozenset(
    "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd merror".split()
)
#: A button in one of these is part of a sentence; elsewhere it is a control.
_SENTENCES = frozenset("p li dd td th blockquote figcaption caption summary h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("p div ul ol dl li h1 h2 h3 h4 h5 h6 article section nav header footer aside main table blockquote pre form figure hr address details fieldset".split())
_AWAY = frozenset("nav footer aside form head menu dialog fieldset title".split())
_TOWARD = frozenset("article main".split())
_AWAY_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|replies|respond|disqus|sidebar|side|widget\w*|related|recommend\w*|share|sharing|social|follow|menu|nav\w*|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topbar|toolbar|subscribe|newsletter|signup|login|search\w*|tags?|meta|copyright|legal|disclaimer|skip)(?:$|[\s_-])", re.I)
_TOWARD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|entry|story|body|text|prose)(?:$|[\s_-])", re.I)
_AWAY_ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|menu|menubar|dialog|alert|form)$", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = re.compile(r"[.!?…。！？][\"'»”)\]]*$")
#: Ties between neighbours, and between blocks of one container.
NEXT_TIE, CONTAINER_TIE = 0.25, 0.35
#: Most of a block's cost: no number of ties is worth more than a few sure blocks.
MOST_COST = 8.0


_CONTAINERS = frozenset("article section div main ul ol table nav aside footer header form body".split())
_CELLS, _HEADINGS = frozenset("li td th dt dd".split()), frozenset("h1 h2 h3 h4 h5 h6".split())


class Block:
    """Text of one block with what the classifier needs."""

    __slots__ = ("text", "linked", "place", "away", "container", "tag")

    def __init__(self, text: str, linked: int, place: int, away: bool, container: int, tag: str):
        self.text, self.linked, self.place, self.away, self.container, self.tag = text, linked, place, away, container, tag

    def features(self) -> list[float]:
        words = self.text.count(" ") + 1
        return [float(self.place > 0), float(self.place < 0), float(self.away), min(words, 60) / 20, min(1.0, self.linked / max(1, len(self.text))), float(bool(_END.search(self.text))), float(self.tag in _CELLS), float(self.tag in _HEADINGS), float(words < 4)]


def page_features(found: list[Block]) -> np.ndarray:
    """A row for each block: its own features, length and links of the blocks before and after it, and its place in the page."""
    own = np.array([b.features() for b in found])
    near = np.zeros((len(own) + 2, 2))
    near[1:-1] = own[:, 3:5]
    at = (np.arange(len(own)) + 0.5) / len(own)
    return np.column_stack([np.ones(len(own)), own, near[:-2], near[2:], at, (at - 0.5) ** 2])


def _side(tag: str, attributes: str, inside_article: bool) -> tuple[int, bool]:
    """(1 toward content, -1 away from it, 0 neither; hidden)."""
    names, hidden, side = "", False, 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                side = -1 if _AWAY_ROLES.match(value) else 1 if value.lower() in ("main", "article") else side
            elif key == "style":
                hidden |= bool(_HIDDEN.search(value))
            elif key == "itemprop":
                side = 1 if value.lower() == "articlebody" else side
            elif not m[0].lower().endswith(('"false"', "'false'", "=false")):
                hidden = True
    if tag in _AWAY or (tag == "header" and not inside_article):
        return -1, hidden
    if tag in INLINE:
        return 0, hidden
    if names and _AWAY_NAMES.search(names) and tag not in ("body", "html", "article", "main"):
        return -1, hidden
    if tag in _TOWARD or (names and _TOWARD_NAMES.search(names)):
        return 1, hidden
    return side, hidden


class _Open:
    """An open element: what it and the elements around it say about text inside."""

    __slots__ = ("tag", "side", "away", "option", "block", "container", "article")

    def __init__(self, tag: str, side: int, away: bool, option: bool, block: int, container: int, article: bool):
        #: block: place on the stack of the nearest element that isn't inline; container: number of the nearest container
        self.tag, self.side, self.away, self.option, self.block, self.container, self.article = tag, side, away, option, block, container, article


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack = [_Open("", 0, False, False, 0, 0, False)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked, links, serial, at, end = 0, 0, 0, 0, len(page)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            top = stack[-1]
            if text and not top.option:
                own = stack[top.block]
                out.append(Block(text, linked, own.side, own.away, top.container, own.tag))
        parts, linked = [], 0

    def pop(k: int) -> None:
        """Close the elements from place k on."""
        nonlocal links
        for s in stack[k:]:
            open_tags[s.tag] -= 1
            links -= s.tag == "a"
        del stack[k:]

    while at < end:
        opening = page.find("<", at)
        if opening < 0:
            opening = end
        if opening > at:
            parts.append(page[at:opening])
            if links:
                linked += opening - at
        if opening == end:
            break
        m = _TAG.match(page, opening)
        if not m:
            parts.append("<")
            at = opening + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            # a slash at the end closes an svg or math element only
            if not closing and not (attributes.rstrip().endswith("/") and tag in ("svg", "math")):
                stop = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
                over = page.find(">", stop.start()) if stop else -1
                if stop:
                    at = over + 1 if over >= 0 else end
                elif tag in _TEXT_ONLY:
                    at = end
            continue
        inline = tag in INLINE
        if tag == "button":
            opened = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if closing else 0
            inline = stack[opened].block < opened if closing else stack[stack[-1].block].tag in _SENTENCES
        if not inline:
            close()
        if closing:
            if open_tags.get(tag):
                # a stray inline end tag doesn't close blocks
                for k in range(len(stack) - 1, stack[-1].block if inline else 0, -1):
                    if stack[k].tag == tag:
                        pop(k)
                        break
            continue
        if tag in VOID:
            continue
        # an option's end tag may be left out: a block ends it, and a button if it is no mere div; so it is with paragraphs and list items
        if not inline and (stack[stack[-1].block].tag == "option" or stack[stack[-1].block].tag == "button" and tag in _CLOSES_P and tag != "div"):
            pop(stack[-1].block)
        if (tag in _CLOSES_P or tag in ("tr", "td", "th", "dt", "dd", "option")) and stack[stack[-1].block].tag == ("li" if tag == "li" else "p"):
            pop(stack[-1].block)
        top = stack[-1]
        side, hidden = _side(tag, attributes, top.article)
        if (tag == "button" and not inline) or (tag == "noscript" and not top.article):
            side = -1
        serial += 1
        block = top.block if inline else len(stack)
        stack.append(_Open(tag, side or top.side, top.away or side < 0 or hidden, top.option or tag == "option", block, serial if tag in _CONTAINERS else top.container, top.article or tag in _TOWARD))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
    close()
    return out


#: Labelled pages: a block that begins with + is content, one that begins with - is not. S is a sentence of some
#: words, W a word; they differ from page to page.
PAGES = (
    "<nav><ul><li><a>-W</a><li><a>-W W</a><li><a>-W</a></ul></nav><div class=ad>-S</div><article><h1>+W W W</h1><p>+S S</p><p>+S</p><p>+S S S</p></article><footer>-W S S</footer>",
    "<header><a>-W W</a></header><main><h1>+W W</h1><p>+S S S</p><ul><li>+S<li>+W W W</ul><p>+S</p></main><aside><h3>-W</h3><p>-S S</p></aside><footer><p>-S</p></footer>",
    "<div id=menu><a>-W</a> <a>W</a></div><div id=content><h2>+W W</h2><p>+S</p><blockquote>+S S</blockquote><p>+S S</p></div><div id=sidebar><p>-S S</p></div><div class=comments><p>-S S</p><p>-S</p></div>",
    "<body><div class=cookie-notice>-S S <button>-W</button></div><div class=post><p>+S S S S</p><p>+W W W.</p><p>+S S</p></div><div class=related><a>-W W W W W</a></div><form><label>-W W</label></form>",
    "<article><header><h1>+W W W W</h1><p>+S</p></header><p>+S S</p><table><tr><td>+W<td>+W W</table><p>+S</p><section class=comments><h2>-W</h2><p>-S S S</p></section></article><div class=newsletter>-S</div>",
    "<div class=banner>-W S</div><div class=story>+S S S</div><div class=share><a>-W</a> <a>W</a></div><div class=story>+S S</div><div class=footer>-W W S</div>",
    "<div><a>-W</a> <a>W</a> <a>W</a></div><div><h1>+W W W</h1></div><div><p>+S S S</p><p>+S S</p><p>+W W W W W.</p><p>+S S S S</p></div><div><a>-W W</a> <a>W</a></div><div>-W W W</div>",
    "<table><tr><td><a>-W</a><td><a>-W W</a></table><p>+S S S S</p><p>+S S S</p><h2>+W W</h2><p>+S S</p><p><a>-W W W</a></p><p>-W</p>",
    "<div><div>-W</div><div><a>-W W</a></div></div><div><div>+S S S</div><div>+S S S S S</div><div>+S S</div></div><div><div><a>-W W W</a></div><div><a>-W W</a></div></div>",
    "<p>-W W</p><p><a>-W</a> <a>W</a></p><h1>+W W W W W</h1><p>+S S</p><p>+S <a>W W</a> S S</p><ul><li>+S S<li>+S<li>+W W W W</ul><p>+S S S</p><ul><li><a>-W W W</a><li><a>-W W</a><li><a>-W W W W</a></ul>",
    "<div>+S S S S S S</div>",
    "<article><p>+W.</p><p>+S S</p><p>+W</p></article>",
    "<nav><a>-W</a></nav><article><h1>+W</h1><p>+W</p><p>+S</p><p>+W</p></article><footer>-W S</footer>",
    "<main><p>+W W</p><p>+S</p><p>+W</p><p>+W.</p></main>",
    "<div class=ad>-W S</div><article><p>+W.</p><p>+W W</p></article>",
    "<ul><li><a>-W</a><li><a>-W</a></ul><p>+S</p><p>+S</p><p>+S S</p><ul><li><a>-W</a><li><a>-W W</a></ul><p>-W W W</p>",
)
_SYLLABLES = "ba de ka lo mi no pu ri so ta ve zu el an or in un est ol th".split()


def labelled_blocks(copies: int = 12, seed: int = 1, pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the blocks of labelled pages, each filled with other words several times."""
    rng, x, y = np.random.default_rng(seed), [], []
    word = lambda: "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))
    for page in pages * copies:
        filled = re.sub(r"\b[SW]\b", lambda m: word().capitalize() if m[0] == "W" else " ".join(word() for _ in range(rng.integers(6, 22))).capitalize() + ".", page)
        found = blocks(filled)
        labels = [b.text[0] == "+" for b in found]
        for b in found:
            b.text = b.text.lstrip("+-")
        x.append(page_features(found))
        y += labels
    return np.concatenate(x), np.array(y, float)


@functools.cache
def weights() -> np.ndarray:
    """Logistic regression by gradient descent; small decay, so clear cases become clear."""
    x, y = labelled_blocks()
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    for _ in range(3_000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (y - p) / len(y) - 2e-4 * w)
    return w / scale


def min_cut(costs: np.ndarray, ties: list[tuple[int, int, float]]) -> np.ndarray:
    """Which nodes stay with the source. costs[i] = (capacity from the source, capacity to the sink).

    The direct way through each node is filled first; what is left flows from nodes with a surplus
    along ties to nodes with room, by shortest augmenting paths. Nodes that a search without success
    has seen can't reach the sink any more and are with the source.
    """
    n = len(costs)
    surplus = (costs[:, 0] - costs[:, 1]).tolist()
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in ties:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    source = np.zeros(n, bool)
    for s in range(n):
        while surplus[s] > 1e-12 and not source[s]:
            before, queue, hit = {s: s}, deque([s]), -1
            while queue and hit < 0:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in before:
                        before[v] = u
                        if surplus[v] < -1e-12:
                            hit = v
                            break
                        queue.append(v)
            if hit < 0:
                source[list(before)] = True
                break
            flow, v = min(surplus[s], -surplus[hit]), hit
            while v != s:
                flow, v = min(flow, room[before[v]][v]), before[v]
            v = hit
            while v != s:
                u = before[v]
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0.0) + flow
                v = u
            surplus[s] -= flow
            surplus[hit] += flow
    return source


def main_text(page: str | None) -> str:
    """The blocks on the source's side, joined by an empty line."""
    found = blocks(page or "")
    if not found:
        return ""
    z = page_features(found) @ weights()
    costs = np.minimum(np.stack([np.logaddexp(0, z), np.logaddexp(0, -z)], axis=1), MOST_COST)
    ties, last = [], {}
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, NEXT_TIE))
        if b.container in last:
            ties.append((last[b.container], i, CONTAINER_TIE))
        last[b.container] = i
    keep = min_cut(costs, ties)
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return clean_input(pages, "page_id", "url", "html").mapInArrow(tidy(_extract), "page_id long, url string, text string, n_chars long")
