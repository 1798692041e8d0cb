"""Main-text extraction from HTML by minimum-cut labelling.

A page is a sequence of text blocks. A linear classifier turns a block's cues (the elements around it, their class names, link
density, length) into two costs, which become the capacities of its edges to the source (content) and the sink (boilerplate).
Neighbouring blocks, and more strongly blocks of the same container, are tied by smoothness edges. The
minimum cut, found by max-flow, labels the blocks.

Scale: one map pass, one page at a time, no shuffle. The graph has about two edges a block.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import cut, with_fields

OPENS = re.compile(r"<(?=[!?/a-zA-Z])")
ASIDES = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

#: Element names by their part in a page.
RAW = frozenset("script style template textarea title noscript iframe object svg math canvas select option datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form table ul ol dl menu dialog fieldset figure details blockquote td center".split())
PLAIN_BAD = frozenset("nav aside form menu dialog button fieldset head".split())
EDGES = frozenset("header footer".split())
#: Class, id and role words of boilerplate and of content.
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertisements adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail aside widget footer foot header masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search share sharing social related recommended recommendations teaser comment comments commentlist respond reply replies disqus "
    "discussion copyright legal disclaimer pagination pager skip contentinfo complementary dialog form".split()
)
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: What an article inside doesn't lift; first words of a class that tells what a layout has; what also marks an article or main element, and what doesn't mark a part of an article.
LASTING = COMMENTS | frozenset("teaser related recommended sponsored promoted".split())
ASIDE = frozenset("aside nav".split())
LAYOUT = frozenset("with without has no".split())
STRONG = COMMENTS | frozenset("ad ads advert advertisement sponsored promo promoted teaser related recommended".split())
TITLES = frozenset("header head".split())
GOOD = frozenset("article content main post entry story body text maintext articlebody".split())
WORDS = re.compile(r"[a-z]+")

#: Weights of the block classifier (positive: content), and of the smoothness edges.
W_BAD, W_EDGE, W_ARTICLE, W_GOOD, W_BASE, W_LINKS, W_LONG, W_SHORT = -9.0, -6.0, 6.0, 2.0, 0.6, -2.5, 1.5, -0.45
NEAR, SAME = 0.3, 0.5
SHORT = 40  # characters below which an unmarked block alone says nothing for content


class _Open:
    __slots__ = ("tag", "bad", "article", "good", "key", "lasting")

    def __init__(self, tag, bad, article, good, key, lasting):
        self.tag, self.bad, self.article, self.good, self.key, self.lasting = tag, bad, article, good, key, lasting


def _child(parent: _Open, tag: str, attrs: str, key: int) -> _Open:
    bad, article, good, lasting = parent.bad, parent.article, parent.good, parent.lasting
    if tag in PLAIN_BAD:
        bad = min(bad, W_BAD)
        lasting = lasting or tag in ASIDE
    elif tag in EDGES:
        bad = min(bad, W_EDGE if not article or tag == "footer" else 0.0)
    elif tag in ("article", "main"):
        article = True
        if not lasting:
            bad = 0.0  # a layout's class, as in with-sidebar, doesn't speak for the article inside
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                bad = min(bad, W_BAD)
            elif name in ("class", "id", "role"):
                for w in value.split():
                    parts = WORDS.findall(w)
                    if parts and parts[0] in LAYOUT:
                        continue
                    marks = () if tag in ("html", "body") else STRONG.intersection(parts) if tag in ("article", "main") else BAD.intersection(parts)
                    fine = not GOOD.isdisjoint(parts)
                    if marks and not ((article or fine) and TITLES.issuperset(marks)):
                        bad = min(bad, W_BAD)
                        lasting = lasting or not LASTING.isdisjoint(marks)
                    elif fine:
                        good = True
    return _Open(tag, bad, article, good, key if tag in CONTAINERS else parent.key, lasting)


def _next_tag(page: str, at: int):
    """The next tag or comment. A tag whose quotes don't close ends at the next >; without one, what follows is text. Each character is read a few times at most."""
    while m := OPENS.search(page, at):
        found = ASIDES.match(page, m.start()) or TAG.match(page, m.start()) or LOOSE.match(page, m.start())
        if found:
            return found
        if page.find(">", m.start()) < 0:
            return None
        at = m.end()
    return None


def blocks(page: str) -> list[tuple[str, float, int]]:
    """Text, score and container of each text block, in page order."""
    out: list[tuple[str, float, int]] = []
    stack = [_Open("", 0.0, False, False, 0, False)]
    parts: list[str] = []
    linked = keys = 0
    in_link = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                # a mark of boilerplate nearer than the article leaves none of the article's credit
                plain = not (top.bad or top.article or top.good)
                score = W_SHORT if plain and len(text) < SHORT else W_BASE + (top.bad or (W_ARTICLE if top.article else 0.0) + (W_GOOD if top.good else 0.0))
                share = min(1.0, linked / len(text))
                if not top.article and share > 0.6:
                    score += W_LINKS
                if len(text) > 120 and share < 0.3 and not top.bad:
                    score += W_LONG
                out.append((text, score, top.key))
        linked = 0

    while at < end:
        m = _next_tag(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m.re is ASIDES:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                done = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = done.end() if done else end
            if tag == "title":
                close()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            continue
        close()
        if tag in VOID:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in CONTAINERS and stack[i].tag in CONTAINERS:
                    break
            in_link = 0
        else:
            if stack[-1].tag == "p":
                stack.pop()
            elif tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].tag == tag:
                stack.pop()
            keys += 1
            stack.append(_child(stack[-1], tag, m[3], keys))
    close()
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the blocks on the source's side: those for which content costs less.

    A block's capacity from the source is max(score, 0), to the sink max(-score, 0). Edges are undirected.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def link(u: int, v: int, c: float, back: float) -> None:
        adj[u].append(len(to))
        to.append(v)
        cap.append(c)
        adj[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for u, v, c in edges:
        link(u, v, c, c)
    tiny = 1e-9
    while True:  # Dinic: levels, then blocking flow
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                for i, e in enumerate(path):
                    if cap[e] <= tiny:
                        u = to[e ^ 1]
                        del path[i:]
                        break
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(adj[u]):
                path.append(adj[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                e = path.pop()
                u = to[e ^ 1]
                nxt[u] += 1
            else:
                break


def labelled(page: str | None) -> list[tuple[str, float, bool]]:
    """Text, score and label (content or not, by the minimum cut) of each block.

    Where nothing on a page is marked as content or long, short unmarked blocks count as content as well.
    """
    got = blocks(page) if page else []
    if got and max(x for _, x, _ in got) <= 0:
        got = [(t, W_BASE if x == W_SHORT else x, key) for t, x, key in got]
    edges, last = [], {}
    for i, (_, _, key) in enumerate(got):
        if i:
            edges.append((i - 1, i, NEAR + (SAME if got[i - 1][2] == key else 0.0)))
        if key in last and last[key] != i - 1:
            edges.append((last[key], i, SAME))
        last[key] = i
    return [(t, x, k) for (t, x, _), k in zip(got, min_cut([x for _, x, _ in got], edges))] if got else []


def main_text(page: str | None) -> str:
    return "\n".join(t for t, _, k in labelled(page) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text (the main text, empty if there is none) and n_flipped (blocks whose label the cut has changed from what their own score says);
    older columns of these names are replaced.

    Long pages are read in time that grows with their length, unclosed tags and quotes included. Null and empty pages give an empty text. Repeated rows each come back. An empty table gives an empty result.
    """
    new = ("text", "n_flipped")
    keep = [c for c in pages.columns if c not in new or c == html_col]
    names = [c for c in keep if c not in new] + list(new)
    source = pages.select(*keep)

    def run(batches):
        for b in cut(batches, html_col):
            got = [labelled(x) for x in b.column(html_col).to_pylist()]
            out = {
                "text": pa.array(["\n".join(t for t, _, k in page if k) for page in got], pa.string()),
                "n_flipped": pa.array([sum(k != (x > 0) for _, x, k in page) for page in got], pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([out[c] if c in new else b.column(c) for c in names], names=names)

    return source.mapInArrow(run, with_fields(source.select(*[c for c in keep if c not in new]).schema, "text string, n_flipped long"))
