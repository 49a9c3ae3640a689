"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import random
import re
from collections import deque
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetflow.llm.common import table
from octetflow.llm.quality import fit_logistic

#: Capacity of the edge between neighbours under one parent; halved for each step between their places in the tree. Between siblings that do not touch.
SMOOTH, SIBLING = 2.5, 0.5
PAGES, SEED = 800, 5
#: How far up an end tag without a start tag looks for one, in open elements.
NESTED = 200

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|)|[\"'])*+)>")
_LOOSE = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRS = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|hidden)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Not shown as text of the page, with all they hold.
_UNSEEN = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "template", "svg", "select", "datalist", "button", "canvas", "audio", "video", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}

GROUPS = ["nav", "header", "footer", "aside", "form", "article", "main", "list", "table", "notice", "hidden"]
NAMED = ["nav", "header", "footer", "aside", "form", "ad", "comment", "notice", "share", "related", "content"]
_BY_TAG = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "article": "article", "main": "main", "ul": "list", "ol": "list", "dl": "list", "table": "table", "dialog": "notice"}
#: What class and id names often say. One kind of evidence beside structure; the classifier is trained on pages whose names say nothing as well.
_BY_WORD = {w: g for g, ws in {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip", "header": "header masthead topbar branding logo", "footer": "footer copyright colophon legal bottom imprint",
    "aside": "sidebar side rail widget widgets aside complementary column", "form": "form search login signin", "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner adbox",
    "comment": "comment comments commentlist respond reply replies disqus discussion thread", "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall dialog toast",
    "share": "share sharing social follow like tweet", "related": "related recommended recommendations popular trending more readmore also teaser teasers links tags tag", "content": "content post entry story text body articlebody prose main article",
}.items() for w in ws.split()}
_BIT = {("tag", g): 1 << k for k, g in enumerate(GROUPS)} | {("name", g): 1 << (len(GROUPS) + k) for k, g in enumerate(NAMED)}
_KINDS = ["p", "li", "cell", "heading", "quote", "box"]
_KIND_OF = {"p": 0, "li": 1, "dd": 1, "dt": 1, "td": 2, "th": 2, "caption": 2, "blockquote": 4, "pre": 4, "figcaption": 4} | dict.fromkeys(_HEADS, 3)


class Block:
    __slots__ = ("above", "bits", "depth", "kind", "link", "low", "parent", "path", "text")

    def __init__(self, text, link, element, depth, low):
        self.text, self.link, self.depth, self.low = text, link, depth, low
        self.bits, self.parent, self.above, self.path, self.kind = element.bits, element.parent, element.above, element.path, element.kind


class _Element:
    """An open block-level element: what its ancestors and it say, its parent's number and that one's parent's, and a hash of its tags from the root."""

    __slots__ = ("above", "bits", "kind", "number", "parent", "path", "tag")

    def __init__(self, tag, bits, number, parent):
        self.tag, self.bits, self.number = tag, bits, number
        self.parent, self.above, self.path = (parent.number, parent.parent, hash((parent.path, tag))) if parent else (-1, -1, 0)
        self.kind = _KIND_OF.get(tag, 5)


def _bits(tag: str, attrs: str, inside: int) -> int:
    bits = 0
    if g := _BY_TAG.get(tag):
        if not (g == "header" and inside & _BIT["tag", "article"]):  # an article's own header is part of it
            bits |= _BIT["tag", g]
    if attrs and tag not in ("body", "html"):
        for m in _ATTRS.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value):
                bits |= _BIT["tag", "hidden"]
            elif name != "style":
                for w in _WORDS.findall(value):
                    if g := _BY_WORD.get(w):
                        bits |= _BIT["name", g]
    return bits


class _Scan:
    """Searches that remember when nothing is left, so that each kind of search costs one pass over the page in all."""

    def __init__(self, html: str):
        self.html, self.gone, self.loose = html, set(), False

    def find(self, what: str, pos: int) -> int:
        if what in self.gone:
            return -1
        at = self.html.find(what, pos)
        if at < 0:
            self.gone.add(what)
        return at

    def tag(self, pos: int):
        """The tag whose name starts at ``pos``. Quotes count after = only; where a tag would never end, it and all later ones end at the first >."""
        if self.find(">", pos) < 0:
            return None
        m = None if self.loose else _TAG.match(self.html, pos)
        if m is None:
            m = _LOOSE.match(self.html, pos)
            self.loose = self.loose or m is not None
        return m

    def end_of(self, tag: str, pos: int) -> int:
        """Where the end tag of an element opened before ``pos`` starts; -1 if there is none before the next one of that name."""
        if tag in self.gone:
            return -1
        m = _same_tag(tag).search(self.html, pos)
        if m is None:
            self.gone.add(tag)
        return m.start() if m and m[1] else -1


@cache
def _same_tag(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}(?![a-zA-Z0-9:_-])", re.I)


def blocks(html: str | None) -> list[Block]:
    """Texts between block-level tags in page order, character references decoded, white space collapsed; scripts, styles, comments, markup and what browsers do not show as text are left out.

    What is opened and never closed loses nothing that follows: a tag without > is text, a comment without end closes at its first >, an unseen element without its
    end tag hides the text up to the next tag only. Time is linear in the page, however it is broken."""
    html = html or ""
    scan, out = _Scan(html), []
    stack = [_Element("", 0, 0, None)]
    parts: list[str] = []
    count = linked = pos = anchors = 0
    low = 1
    hide = False

    def flush():
        nonlocal linked, low
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, min(1.0, linked / len(text)), stack[-1], len(stack), low))
                low = len(stack)
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        text = unescape(text)
        parts.append(text)
        if anchors:
            linked += len(" ".join(text.split()))

    n = len(html)
    while pos < n:
        lt = scan.find("<", pos)
        if lt != pos and not hide:
            say(html[pos : lt if lt >= 0 else n])
        if lt < 0:
            break
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?") or after == "/" and not html[lt + 2 : lt + 3].isalpha():
            end = scan.find("-->", lt + 2) + 2 if html.startswith("<!--", lt) and "-->" not in scan.gone else -1
            end = end if end > 1 else scan.find(">", lt)
            if end < 0:
                say(html[lt:])
                break
            pos = end + 1
            continue
        m = scan.tag(lt + 1)
        if m is None:
            if not hide:
                say("<")
            pos = lt + 1
            continue
        pos, hide = m.end(), False
        tag = m[2].lower()
        if m[1]:  # closing
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCK:
                flush()
                for k in range(len(stack) - 1, max(0, len(stack) - 1 - NESTED), -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        low = min(low, len(stack))
                        break
            continue
        if tag in _UNSEEN:
            if (end := scan.end_of(tag, pos)) >= 0:
                pos = html.find(">", end) + 1 or n
            else:
                hide = True
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            anchors = 0 if m[3].endswith("/") else 1
        elif tag in _BLOCK:
            flush()
            anchors = 0
            if len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in _CLOSES.get(tag, ())):
                stack.pop()
            if tag == "tr" and stack[-1].tag == "tr":
                stack.pop()
            low = min(low, len(stack))
            count += 1
            stack.append(_Element(tag, stack[-1].bits | _bits(tag, m[3], stack[-1].bits), count, stack[-1]))
    flush()
    return out


_MARKS = re.compile(r"[.!?:;,،。、！？]")
FEATURES = [*(f"tag {g}" for g in GROUPS), *(f"name {g}" for g in NAMED), *_KINDS, "words", "short", "link", "links", "marks", "ends", "rights", "first", "last", "through", "bare",
            "box words", "box share", "box link", "box alone", "outer share", "outer link", "prose share", "path words", "path many", "path link", "before words", "before link", "after words", "after link", "long near", "again"]


def _by_group(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of each of the values over the members of a row's group, and the number of members."""
    kinds, at = np.unique(key, return_inverse=True)
    return [np.bincount(at, v, len(kinds))[at] for v in (*values, np.ones(len(key)))]


def block_features(found: list[Block]) -> np.ndarray:
    """Evidence of each block: tags and names around it, its kind, its words, links and marks, and how it stands in its page: the share of the page's words in its box and the
    box around that, what other blocks on the same path of tags are like, its neighbours, its place."""
    n, all_bits = len(found), len(GROUPS) + len(NAMED)
    words = np.array([b.text.count(" ") + max(1, sum("⺀" < c < "ﬀ" for c in b.text) // 2) for b in found], float)  # scripts without spaces: two signs a word
    link = np.array([b.link for b in found])
    bits = np.array([b.bits for b in found])
    marks = np.array([len(_MARKS.findall(b.text)) for b in found]) / words
    ends = np.array([b.text[-1] in ".!?\"”»…。！？" for b in found], float)
    k = np.arange(n)
    box_words, box_linked, box_n = _by_group(np.array([b.parent for b in found]), words, words * link)
    outer_words, outer_linked, _ = _by_group(np.array([b.above for b in found]), words, words * link)
    path_words, path_linked, path_n = _by_group(np.array([b.path for b in found]), words, words * link)
    prose = np.where((words > 8) & (link < 0.3) & (ends + marks > 0.05), words, 0.0)
    box_prose, _ = _by_group(np.array([b.parent for b in found]), prose)
    again = _by_group(np.array([hash(b.text) for b in found]))[0]
    every, all_prose = max(1.0, words.sum()), max(1.0, prose.sum())
    size = lambda x: np.minimum(2.0, np.log1p(x) / 2.5)
    shift = lambda x, d: np.r_[np.zeros(1), x[:-1]] if d > 0 else np.r_[x[1:], np.zeros(1)]
    long_ = np.flatnonzero(prose > 25)
    if len(long_):
        at = np.searchsorted(long_, k)
        away = np.minimum(np.abs(k - long_[np.maximum(at - 1, 0)]), np.abs(k - long_[np.minimum(at, len(long_) - 1)]))
    else:
        away = np.full(n, n)
    kind = np.array([b.kind for b in found])
    sides = sum(_BIT["tag", g] for g in ("nav", "header", "footer", "aside", "form", "notice", "hidden"))
    columns = [
        size(words), words < 5, link, link > 0.6, np.minimum(1.0, marks * 3), ends, [("©" in b.text) or ("®" in b.text) for b in found], 1.0 / (1 + k), 1.0 / (n - k), k / n, (bits & sides) == 0,
        size(box_words), box_words / every, box_linked / box_words, box_n == 1, outer_words / every, outer_linked / outer_words, box_prose / all_prose, size(path_words / path_n), np.log1p(path_n) / 4, path_linked / path_words,
        size(shift(words, 1)), shift(link, 1), size(shift(words, -1)), shift(link, -1), 1.0 / (1 + away), again > 1,
    ]
    return np.column_stack([*(bits >> g & 1 for g in range(all_bits)), *(kind == g for g in range(len(_KINDS))), *columns]).astype(float)


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: |unary| for each node against its sign, a capacity for each edge cut. True: the positive side; ties go to the negative.

    Exact. Nodes whose own cost outweighs all their edges are settled first and their edges handed to their neighbours, again and
    again; what is left goes to a maximum flow (Dinic)."""
    n = len(unary)
    cost, near = list(unary), [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    work = deque(range(n))
    while work:
        v = work.popleft()
        if label[v] is None and abs(cost[v]) > sum(near[v].values()):
            label[v] = cost[v] > 0
            for u, c in near[v].items():
                cost[u] += c if label[v] else -c
                del near[u][v]
                work.append(u)
            near[v] = {}
    rest = [v for v in range(n) if label[v] is None]
    if rest:
        side = _flow(rest, cost, near)
        for v in rest:
            label[v] = v in side
    return label


def _flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut between source (positive costs) and sink (negative ones)."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {v: dict(near[v]) for v in nodes}
    cap[s], cap[t] = {}, {}
    for v in nodes:
        if cost[v] > 0:
            cap[s][v], cap[v][s] = cost[v], 0.0
        elif cost[v] < 0:
            cap[v][t], cap[t][v] = -cost[v], 0.0
    eps = 1e-12
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for u, c in cap[v].items():
                if c > eps and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if t not in level:
            return set(level) - {s}
        todo = {v: iter(list(cap[v])) for v in level}
        path = [s]
        while path:
            v = path[-1]
            if v == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                k = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] <= eps)
                del path[k + 1 :]
                continue
            for u in todo[v]:
                if cap[v][u] > eps and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                path.pop()
                if path:
                    level[v] = -1


def neighbours(all_blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between blocks that follow each other, the weaker the further apart they are in the tree, and to the last block before under the same parent."""
    out, last = [], {}
    for k, b in enumerate(all_blocks):
        if k:
            out.append((k - 1, k, SMOOTH * 0.5 ** max(0, all_blocks[k - 1].depth + b.depth - 2 * b.low - 2)))
        j = last.get(b.parent)
        if j is not None and j != k - 1:
            out.append((j, k, SIBLING))
        last[b.parent] = k
    return out


def extract(html: str | None, model: tuple[np.ndarray, float]) -> str:
    found = blocks(html)
    if not found:
        return ""
    unary = (block_features(found) @ model[0] + model[1]).tolist()
    return "\n".join(b.text for b, keep in zip(found, minimum_cut(unary, neighbours(found)), strict=True) if keep)


def _made_page(r: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the texts of its article's blocks."""
    word = lambda: "".join(r.choice(["ba", "ter", "on", "li", "sche", "ró", "an", "the", "mi", "é", "qu"]) for _ in range(r.randint(1, 4)))

    def sentence(lo=4, hi=18):
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice("....!?")

    line = lambda lo=1, hi=4: " ".join(word() for _ in range(r.randint(lo, hi)))
    gold: set[str] = set()

    def keep(text):
        gold.add(text)
        return text

    #: What names say on this page: what they are in English, nothing, or something in another language.
    naming = r.choice(["plain", "plain", "coded", "foreign", "none"])
    tags = r.random() < (0.75 if naming == "plain" else 0.5)

    def named(kind, tag):
        """A container that says what it is by its tag, its class, both, or not at all."""
        words = {"nav": ["nav", "menu", "main-menu", "breadcrumbs"], "header": ["header", "masthead", "site-header"], "footer": ["footer", "site-footer", "copyright"], "aside": ["sidebar", "widget", "right-rail"], "ad": ["ad", "ads", "advert", "sponsored", "promo"],
                 "comment": ["comments", "comment-list", "respond"], "notice": ["cookie-notice", "consent", "newsletter", "alert", "paywall"], "form": ["search-form", "login"], "share": ["share", "social-links"], "related": ["related", "popular", "more-stories"], "article": ["post", "entry-content", "article-body", "story"]}[kind]
        how = r.random()
        use = tag if how < 0.6 and tag and tags else "div"
        name = {"plain": r.choice(words), "coded": f"c{r.randint(0, 99)}x", "foreign": r.choice(["bereich", "kasten", "bloque", "boite", "zeile"]), "none": ""}[naming]
        cls = f' {r.choice(["class", "id"])}="{name}"' if name and (use == "div" and how < 0.95 or r.random() < 0.4) else ""
        return f"<{use}{cls}>", f"</{use}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def box(kind, tag, inner):
        a, b = named(kind, tag)
        return a + inner + b

    boil = {
        "nav": lambda: box("nav", "nav", links(r.randint(2, 8))), "header": lambda: box("header", "header", f"<div>{line()}</div><p>{sentence(3, 7)}</p>"),
        "aside": lambda: box("aside", "aside", f"<h3>{line()}</h3><p>{sentence(3, 20)}</p>" + links(r.randint(0, 5))), "ad": lambda: box("ad", "", r.choice([sentence(3, 16), f"<p>{sentence(3, 12)} {sentence(3, 12)}</p>", f'<a href="#">{sentence(3, 8)}</a>'])),
        "notice": lambda: box("notice", "", f"<p>{sentence(5, 20)}</p>" + r.choice(["", "<button>OK</button>"])), "form": lambda: box("form", "form", f"<label>{line()}</label><input name='q'><p>{sentence(2, 8)}</p>"),
        "share": lambda: box("share", "", links(3)), "related": lambda: box("related", "", f"<h2>{line()}</h2>" + links(4) + f"<p>{sentence(4, 12)}</p>"),
        "comment": lambda: box("comment", "section", "".join(f'<div class="{r.choice(["comment", "reply", "c"])}"><b>{word()}</b><p>{sentence(3, 18)} {sentence()}</p></div>' for _ in range(r.randint(1, 4)))),
        "hidden": lambda: r.choice(["<div hidden>", '<div style="display: none">', '<div aria-hidden="true">']) + f"<p>{sentence(5, 20)}</p></div>",
        "footer": lambda: box("footer", "footer", f"<p>{r.choice(['&copy;', '&copy; 2020', ''])} {line(1, 3)} &middot; {sentence(3, 9)}</p>"),
    }
    body = "".join(boil[k]() for k in r.sample(["nav", "header", "ad", "notice", "form", "aside", "hidden"], r.randint(1, 5)))
    bare = r.random() < 0.08  # nothing but the article
    inner = f"<h1>{keep(line(3, 9))}</h1>" if not bare or r.random() < 0.5 else ""
    for _ in range(r.randint(1, 9)):
        k = r.random()
        text = keep(" ".join(sentence() for _ in range(r.choice([1, 1, 2, 4, 7]))) if r.random() < 0.9 else line(1, 3) + r.choice([".", "", "", " |"]))
        if k < 0.75:
            inner += f"<p>{text}</p>"
        elif k < 0.83:
            inner += f"<p><b>{text}<br>"
        elif k < 0.9:
            inner += f"<h2>{text}</h2>"
        elif k < 0.95:
            inner += f"<blockquote>{text}</blockquote>"
        elif k < 0.975:
            inner += f"<ul><li>{text}</li></ul>"
        else:
            inner += f"<table><tr><td>{text}</td></tr></table>"
        if r.random() < 0.15 and not bare:
            inner += boil[r.choice(["ad", "ad", "form", "aside", "notice", "related", "comment", "share", "hidden"])]()
    a, b = named("article", "article")
    body += r.choice(["", "<main>", '<div class="page">']) + a + inner + b
    body += "".join(boil[k]() for k in r.sample(["comment", "related", "share", "aside", "footer", "ad", "nav"], r.randint(1, 5)))
    if bare:
        body = inner if r.random() < 0.5 else a + inner + b
    return f"<!DOCTYPE html><html><head><title>{line()}</title><style>p{{}}</style></head><body>{body}</body></html>", gold


def train(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, float]:
    """A logistic classifier of blocks; its log odds are the terminal capacities. Fitted to made-up pages, the same for every input."""
    r, x, y = random.Random(seed), [], []
    for _ in range(pages):
        html, gold = _made_page(r)
        found = blocks(html)
        x.append(block_features(found))
        y += [b.text in gold for b in found]
    return fit_logistic(np.concatenate(x), np.array(y, float), ridge=3.0)


@cache
def model_of(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, float]:
    return train(pages, seed)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """One row a row of ``pages``: id_col, url_col, text, n_chars (code points).

    Blocks are labelled article or not by a minimum cut: the classifier's log odds are the terminal capacities, adjacency and nearness in the
    tree the smoothness edges. Null and empty pages, and pages without an article, give an empty text. Null and repeated ids keep their rows; other columns are ignored. No shuffle."""
    use = model or model_of()

    def run(batches):
        for batch in batches:
            texts = [extract(t.as_py(), use) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n long").toDF(id_col, url_col, "text", "n_chars")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
