"""HTML extraction: gradient-boosted trees over DOM-node features, hierarchical decoding.

A tolerant parser builds a tree of block elements; every node has features of its tag, attribute
tokens, subtree density, depth and siblings. Boosted trees, trained on pages that a generator lays
out and labels, give each node odds of being main text. Decoding picks, by one pass over the tree,
the most likely labels under which nothing inside a rejected node is kept, so an ancestor and a
descendant never contradict each other.

Defined results: null or empty html gives an empty text; a page without markup is one block; repeated
rows are extracted each; of labels that tie the rejecting one is taken; a very long page is parsed
alone, in time in proportion to its size; an empty table gives an empty result; other columns of any
name are ignored.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe head".split())
#: Form controls and drawings, whose content goes up to their end if they have one.
SKIPPED = frozenset("select svg canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
KINDS = ("article", "main", "section", "div", "p", "h", "list", "item", "table", "quote", "nav", "header", "footer", "aside", "form", "body", "text")
#: Attribute tokens that speak for and against main text.
GOOD = frozenset("article articlebody body content entry main page post story text prose single".split())
BAD = frozenset("ad ads advert advertisement banner bar breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog disqus feedback footer form gdpr header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())
COMMENTS = frozenset("comment comments disqus reply replies respond discussion reader".split())
NOTICES = frozenset("ad ads advert advertisement banner consent cookie cookies gdpr notice promo sponsor sponsored popup modal newsletter subscribe".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = frozenset(("class", "id", "role", "itemprop"))
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[a-z]+")
#: Beginnings of utility classes, which say how a box is drawn or what it has, not what it is.
_DRAWN = re.compile(r"^(?:overflow|sm|md|lg|xl|xs|no|has|not|with|without)-")


def attributes_of(source: str) -> dict[str, str]:
    """Names, in small letters, and values of a tag's attributes; of two with one name the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    return out


def tokens_of(attributes: dict[str, str]) -> frozenset:
    """Words of the names that a page gives to an element, without those of utility classes."""
    names = [x for k in _NAMES if k in attributes for x in attributes[k].lower().split()]
    return frozenset(t for x in names if not _DRAWN.search(x) for t in _PART.findall(x))


def unseen(attributes: dict[str, str]) -> bool:
    """Whether an element says of itself that it isn't shown."""
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


class Node:
    """A block element, or a run of inline text (kind text)."""

    __slots__ = ("chars", "children", "hidden", "inside", "kind", "links", "parent", "tag", "text", "tokens")

    def __init__(self, tag: str, parent, tokens: frozenset = frozenset(), hidden: bool = False) -> None:
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.children: list[Node] = []
        self.text, self.chars, self.links, self.inside = "", 0, 0, 0


def _kind(tag: str) -> int:
    kind = {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item", "dd": "item", "td": "table", "th": "table", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "table", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "html": "body", "fieldset": "form", "dialog": "aside", "noscript": "aside", "address": "footer"}.get(tag, tag)
    kind = "h" if re.fullmatch(r"h[1-6]", kind) else kind
    return KINDS.index(kind) if kind in KINDS else KINDS.index("div")


def parse(source: str) -> Node:
    """The tree of block elements; markup, scripts and styles are gone, references are decoded."""
    root = Node("body", None)
    at, pieces, link, links = root, [], 0, 0
    stack: list[tuple[str, Node | None]] = []  # open elements; None for inline ones
    opened: dict[str, int] = {}  # how many of each tag are open
    ahead: dict[str, int] = {}  # where the next end tag of a skipped element was found, or the end of the source
    spot = 0

    def flush() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                leaf = Node("text", at)
                leaf.text, leaf.chars, leaf.links = text, len(text), min(links, len(text))
                at.children.append(leaf)
            pieces, links = [], 0

    def close_to(k: int) -> None:
        """Closes all open elements from place k of the stack on."""
        nonlocal at, link
        if any(x[1] is not None for x in stack[k:]):
            flush()
        for tag, node in reversed(stack[k:]):
            opened[tag] = opened.get(tag, 0) - 1
            if node is not None:
                at = node.parent
            elif tag == "a":
                link -= 1
        del stack[k:]

    def text(part: str) -> None:
        nonlocal links
        if part:
            pieces.append(part)
            if link:
                links += len(part)

    n = len(source)
    while spot < n:
        begin = source.find("<", spot)
        if begin < 0:
            text(source[spot:])
            break
        text(source[spot:begin])
        m = _TOKEN.match(source, begin)
        if m is None:
            text("<")
            spot = begin + 1
            continue
        spot = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        ends = bool(m.group(1) or m.group(4))
        attributes = m.group(3) or ""
        if ends:
            if tag == "br":
                text(" ")
                continue
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if opened.get(tag, 0) > 0 else -1
            if k >= 0 and not (tag not in BLOCK and any(x[1] is not None for x in stack[k + 1 :])):
                close_to(k)
            elif k >= 0:
                stack[k] = ("", None)  # misnested inline element: it only stops being open
                opened[tag] -= 1
                opened[""] = opened.get("", 0) + 1
                if tag == "a":
                    link -= 1
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr") and tag != "wbr":
                text(" ")
            if tag == "hr":
                flush()
            continue
        if (tag in RAW or tag in SKIPPED) and tag != "head":
            if not attributes.rstrip().endswith("/") and ahead.get(tag, 0) <= n:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, spot)
                if stop:
                    spot = stop.end()
                elif tag in RAW:
                    spot = n
                else:
                    ahead[tag] = n + 1  # no end from here on: not searched for again
            text(" ")
            continue
        if tag == "head":
            continue
        if tag in BLOCK:
            if opened.get("p", 0) > 0:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
            if tag in CLOSES and any(opened.get(x, 0) > 0 for x in CLOSES[tag][0].split()):
                shut, scope = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in shut.split():
                        close_to(i)
                        if tag != "tr" or not any(x[0] in shut.split() for x in stack):
                            break
                    elif stack[i][0] in scope:
                        break
            flush()
            if tag in ("html", "body"):
                continue
            given = attributes_of(attributes) if attributes else {}
            node = Node(tag, at, tokens_of(given), unseen(given))
            at.children.append(node)
            at = node
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1
        else:
            stack.append((tag, None))
            opened[tag] = opened.get(tag, 0) + 1
            if tag == "a":
                link += 1
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents first and in page order; fills in the sums over subtrees."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        if node.tag != "text":
            node.chars = sum(c.chars for c in node.children)
            node.links = sum(c.links for c in node.children)
            node.inside = sum(c.inside + 1 for c in node.children)
    return out


NAMES = 24


def features(nodes: list[Node]) -> np.ndarray:
    """A row of features for each node."""
    depth, own, where = {}, [], {id(x): i for i, x in enumerate(nodes)}
    total = max(nodes[0].chars, 1)
    seen = 0
    for node in nodes:
        parent = node.parent
        up = own[where[id(parent)]] if parent is not None else None
        depth[id(node)] = d = depth[id(parent)] + 1 if parent is not None else 0
        kids = parent.children if parent is not None else [node]
        tokens, kind = node.tokens, _kind(node.tag)
        good, bad = len(tokens & GOOD), len(tokens & BAD)
        talk, notice = bool(tokens & COMMENTS), bool(tokens & NOTICES)
        text = node.text
        around = sum(k.chars for k in kids) / len(kids)
        at_kind = KINDS[kind]
        boiler = at_kind in ("nav", "header", "footer", "aside", "form")
        body = at_kind in ("article", "main")
        own.append([
            kind, d, np.log1p(node.chars), node.links / max(node.chars, 1), node.chars / total, node.chars / (node.inside + 1), np.log1p(node.inside), good, bad, talk, notice, node.hidden,
            len(kids), np.log1p(around), node.chars / max(around, 1), seen / total, text.count(",") + text.count("."), bool(text) and text[-1] in ".!?…»”\"",
            up[18] + boiler if up else boiler, up[19] + body if up else body, up[20] + bad if up else bad, up[21] + talk if up else talk, up[22] + notice + node.hidden if up else notice + node.hidden, up[0] if up else -1,
        ])
        if node.tag == "text":
            seen += node.chars
    return np.array(own, float).reshape(-1, NAMES)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, split by histograms."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.3, bins: int = 32, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        width = self.bins + 1
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            size = 2 ** (self.depth + 1) - 1
            column, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            leaf = np.zeros(len(y), np.int64)
            for node in range(size):
                mine = leaf == node
                count = int(mine.sum())
                if not count:
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                value[node] = self.rate * gs / (hs + 1)
                if node >= 2**self.depth - 1 or count < 2 * self.least:
                    continue
                best, found = 1e-6, None
                for j, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    bins = code[mine, j]
                    gl, hl, nl = (np.cumsum(np.bincount(bins, w, width))[: len(cuts)] for w in (g[mine], h[mine], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (count - nl < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, found = gain[k], (j, k)
                if found:
                    j, k = found
                    column[node], cut[node] = j, self.cuts[j][k]
                    leaf[mine] = 2 * node + 1 + (code[mine, j] > k)
            self.trees.append((column, cut, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for column, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = column[at]
                at = np.where(j < 0, at, 2 * at + 1 + (x[every, np.maximum(j, 0)] > cut[at]))
            out += value[at]
        return out


def decoded(nodes: list[Node], odds: np.ndarray) -> list[str]:
    """Texts of the kept blocks in page order: the likeliest labels with nothing kept inside a rejected node."""
    where = {id(x): i for i, x in enumerate(nodes)}
    reject, keep, gain = (np.zeros(len(nodes)) for _ in range(3))
    for i in range(len(nodes) - 1, -1, -1):
        weight = odds[i]
        kids = [where[id(c)] for c in nodes[i].children]
        reject[i] = -weight + sum(reject[k] for k in kids)
        keep[i] = weight + sum(max(keep[k], reject[k]) for k in kids)
        gain[i] = keep[i] - reject[i]
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        if i and gain[i] <= 0:
            continue
        if nodes[i].tag == "text":
            out.append(nodes[i].text)
        todo.extend(where[id(c)] for c in reversed(nodes[i].children))
    return out


def sample_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A laid-out page and its main blocks."""
    letters = "etaoinshrdlucmfwypvbgk"
    if rng.random() < 0.15:
        letters += "äöüßéèñóíç"

    def words(n: int) -> str:
        return " ".join("".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(n))

    def sentence(a: int = 4, b: int = 22) -> str:
        return words(int(rng.integers(a, b))).capitalize() + str(rng.choice([".", ".", ".", "?", "!"]))

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(1, k))))

    def pick(*options):
        return options[rng.integers(len(options))]

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(int(rng.integers(1, 3)))}</a></li>' for i in range(n)) + "</ul>"

    kept: list[str] = []

    def block(tag: str, text: str) -> str:
        kept.append(text)
        inner = text
        if rng.random() < 0.2:
            cut = text.split(" ")
            k = int(rng.integers(0, len(cut)))
            cut[k] = pick("<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "{}<br>").format(cut[k])
            inner = " ".join(cut)
        if rng.random() < 0.05:
            inner = "<b>" + inner + "<br>"
        return f"<{tag}>{inner}</{tag}>" if rng.random() < 0.95 or tag != "p" else f"<p>{inner}"

    def boiler(kind: str) -> str:
        tag = {"nav": pick("nav", "div", "nav"), "header": pick("header", "div"), "footer": pick("footer", "footer", "div"), "sidebar": pick("aside", "div"), "comments": pick("section", "div", "aside"), "form": "form"}.get(kind, pick("div", "div", "aside", "section"))
        names = {"nav": ("nav", "menu", "navbar", "breadcrumb", "navigation"), "header": ("header", "masthead", "site-header", "top-bar"), "footer": ("footer", "site-footer", "copyright"), "sidebar": ("sidebar", "widget", "related", "side-bar"), "ad": ("ad", "ads", "advert", "banner", "sponsored", "promo"), "notice": ("cookie", "cookie-notice", "notice", "consent", "gdpr", "newsletter", "popup"), "comments": ("comments", "comment-list", "reader-comments", "disqus", "replies"), "form": ("search", "login", "subscribe", "feedback"), "share": ("share", "social", "tags", "meta")}
        own = f' {pick("class", "class", "id")}="{pick(*names[kind])}"' if tag in ("div", "section") or rng.random() < 0.5 else ""
        role = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "form": "search"}.get(kind)
        if role and rng.random() < 0.12:
            own = f' role="{role}"'
        if kind == "nav":
            inner = links(int(rng.integers(3, 10)))
        elif kind == "header":
            inner = pick("<h1>{}</h1>", "<h2>{}</h2>", '<a href="/">{}</a>', "<p>{}</p>").format(words(3)) + (links(4) if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = pick("&copy; {} &middot; {}", "<p>&copy; 2020 {}</p><p>{}</p>", "{} {}").format(words(2), prose(3))
        elif kind == "sidebar":
            inner = pick("<h3>{}</h3>", "<h2>{}</h2>", "<p>{}</p>").format(words(2)) + pick(links(5), f"<p>{prose(4)}</p>", f"{prose(3)}")
        elif kind == "comments":
            inner = pick("<h3>Comments</h3>", "<h2>" + words(2) + "</h2>", "") + "".join(pick('<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li><p>{}</p></li>", "<article class='comment'><p>{}</p></article>").format(prose(5)) for _ in range(int(rng.integers(1, 6))))
        elif kind == "form":
            inner = f'<label>{words(2)}</label><input name="q"><p>{sentence()}</p><button>{words(1)}</button>'
        else:
            inner = pick("{}", "<p>{}</p>", "<span>{}</span>", "<p>{}</p><a href='#'>ok</a>").format(prose(4) if kind in ("ad", "notice") else words(4))
        return f"<{tag}{own}>{inner}</{tag}>"

    def odd(frame: str) -> str:
        """At times a name on the main element that speaks against it."""
        name = pick("card related-article", "post related", "sidebar-left entry", "overflow-hidden", "story-header", "ad-free", "article-comments-open", "menu-open page")
        return frame.replace(">", f' data-x="hidden" class="{name}">', 1) if rng.random() < 0.2 and "class" not in frame.split(">")[0] else frame

    n = int(rng.integers(1, 14))
    main = []
    if rng.random() < 0.8:
        title = block(pick("h1", "h1", "h2"), sentence(2, 9))
        main.append(f"<header>{title}</header>" if rng.random() < 0.25 else title)
    for _ in range(n):
        turn = rng.random()
        if turn < 0.8:
            main.append(block("p", prose(int(rng.integers(2, 12))) if rng.random() < 0.85 else sentence(1, 4)))
        elif turn < 0.86:
            main.append(block(pick("h2", "h3"), sentence(2, 6)))
        elif turn < 0.91:
            main.append("<ul>" + "".join(block("li", sentence(2, 12)) for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        elif turn < 0.95:
            main.append(block("blockquote", prose(3)))
        else:
            main.append("<table><tr>" + "".join(block("td", words(2)) for _ in range(3)) + "</tr></table>")
        if rng.random() < 0.06:
            main.append(boiler(pick("ad", "share", "notice", "form", "sidebar")))
    shell = odd(pick("<article>{}</article>", "<article>{}</article>", '<div role="main">{}</div>', "<article class='post'>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="entry-content">{}</div></div>', '<section class="story">{}</section>', "<div>{}</div>", '<div class="wrapper"><article>{}</article></div>'))
    before = [boiler(k) for k in ("header", "nav", "notice", "ad") if rng.random() < 0.55]
    after = [boiler(k) for k in ("share", "comments", "sidebar", "form", "ad", "nav", "notice", "footer") if rng.random() < (0.9 if k == "footer" else 0.35)]
    inside = boiler("comments") if rng.random() < 0.15 else boiler("footer") if rng.random() < 0.1 else ""
    page = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(before) + shell.format("".join(main) + inside) + "".join(after) + "</body></html>"
    return page, kept


@functools.lru_cache(maxsize=2)
def trained(pages: int = 600, seed: int = 11) -> Trees:
    """Trees trained on generated pages: a node is main text if most of its characters are; made once in a process."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, kept = sample_page(rng)
        nodes = nodes_of(parse(page))
        main: dict[str, int] = {}
        for t in kept:
            main[" ".join(t.split())] = main.get(" ".join(t.split()), 0) + 1
        good = {id(x): x.chars if x.text in main else 0 for x in nodes if x.tag == "text"}
        for x in reversed(nodes):
            if x.tag != "text":
                good[id(x)] = sum(good[id(c)] for c in x.children)
        xs.append(features(nodes))
        ys.append([good[id(x)] > 0.5 * x.chars if x.chars else False for x in nodes])
    return Trees().fit(np.concatenate(xs), np.concatenate([np.asarray(y, float) for y in ys]))


def extract(source: str | None, trees: Trees) -> str:
    """Main text of a page: kept blocks in page order, joined by a space."""
    if not source:
        return ""
    nodes = nodes_of(parse(source))
    if not nodes[0].chars:
        return ""
    return " ".join(decoded(nodes, trees.score(features(nodes))))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """id_col, url_col, text and n_chars of each row."""
    kind = pages.schema[id_col].dataType.simpleString()
    model = trees or trained()

    def kernel(batch: pa.RecordBatch) -> dict:
        held = [nodes_of(parse(s)) if s else [] for s in batch.column("html").to_pylist()]
        full = [x for x in held if x and x[0].chars]
        odds = model.score(np.concatenate([features(x) for x in full])) if full else np.zeros(0)
        texts, at = [], 0
        for x in held:
            if x and x[0].chars:
                texts.append(" ".join(decoded(x, odds[at : at + len(x)])))
                at += len(x)
            else:
                texts.append("")
        return {id_col: batch.column("id"), url_col: batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return per_slice(rows, "html", kernel, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long", 1 << 20)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
