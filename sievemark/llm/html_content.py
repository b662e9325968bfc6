"""Main-text extraction by a tree-structured graphical model over the page's block elements.

Every block element is a binary variable: inside the main content or not. Its
own features give its potential, the two values of a parent and a child give
another, and sum-product messages up and down the tree give exact marginals.
The weights are trained by the exact gradient of the likelihood of labelled
pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import batch_of, column_of, hash_sample, text_slices, texts_of

TRAINING_PAGES = 150
TRAINING_BYTES = 32_768
TRAINING_BLOCKS = 40
EPOCHS = 25
RATE = 0.08
DECAY = 1e-4

# HTML element names by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    "svg math object a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SAME_KIND = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
# Elements that no drawing or formula has; one that begins inside ends it.
HTML_ONLY = ENDS_PARAGRAPH | INLINE | VOID | frozenset("body head html li dd dt td th tr thead tbody tfoot caption button form select option".split())
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

TAG_GROUPS = (
    ("article", "main"), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "select", "option", "button", "input", "legend"),
    ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre", "address"), ("figure", "figcaption", "details", "summary"),
    ("html", "body"),
)
HINTS = (
    ("article", "content", "post", "entry", "story", "main", "body", "text", "page"),
    ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond"),
    ("nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toolbar", "skip"),
    ("sidebar", "side", "widget", "related", "recommended", "aside", "complementary", "trending", "popular", "more"),
    ("ad", "ads", "advert", "advertisement", "promo", "sponsor", "sponsored", "banner", "commercial"),
    ("cookie", "notice", "consent", "alert", "popup", "modal", "overlay", "gdpr", "dialog", "message", "warning"),
    ("header", "masthead", "top", "topbar", "logo", "brand"),
    ("footer", "bottom", "copyright", "legal", "contentinfo", "colophon"),
    ("form", "search", "login", "signup", "subscribe", "newsletter", "share", "social"),
)
OTHERS = ("bias", "has text", "log words", "link share", "sentence end", "copyright sign", "short text", "depth", "early", "late", "has paragraphs")
FEATURES = tuple(g[0] for g in TAG_GROUPS) + ("other tag",) + tuple(f"hint {h[0]}" for h in HINTS) + OTHERS
GROUP_OF = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}
HINT_OF = {word: k for k, words in enumerate(HINTS) for word in words}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LABEL = re.compile(r"data-content-label\s*=\s*\"?([01])", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    """A block element; nodes are stored in document order, parents first."""

    tag: str
    parent: int
    depth: int
    hints: tuple[int, ...] = ()
    label: int | None = None
    runs: list[int] = field(default_factory=list)
    link_chars: int = 0
    paragraphs: int = 0


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str]]  # the node and the decoded text of each run of inline content


class _Open:
    """The open elements: blocks on a stack, inline ones as counts in the block they were opened in.

    For each name the depths at which it was opened, so that an end tag finds its element without a search.
    """

    def __init__(self):
        self.blocks: list[tuple[str, int]] = []     # name and node
        self.inline: list[dict[str, int]] = []
        self.depths: dict[str, list[tuple[int, int]]] = {}
        self.links = 0

    def push(self, name: str, node: int) -> None:
        self.depths.setdefault(name, []).append((len(self.blocks), node))
        self.blocks.append((name, node))
        self.inline.append({})

    def push_inline(self, name: str) -> None:
        at = len(self.blocks) - 1
        self.inline[at][name] = self.inline[at].get(name, 0) + 1
        self.depths.setdefault(name, []).append((at, self.blocks[at][1]))
        self.links += name == "a"

    def depth_of(self, name: str) -> int:
        """Where the innermost open element of that name is, or -1; entries of closed blocks are dropped on the way."""
        places = self.depths.get(name)
        while places:
            at, node = places[-1]
            if at < len(self.blocks) and self.blocks[at][1] == node:
                return at
            places.pop()
        return -1

    def end_inline(self, name: str) -> bool:
        at = self.depth_of(name)
        if at < 0:
            return False
        self.depths[name].pop()
        self.inline[at][name] -= 1
        self.links -= name == "a"
        return True

    def cut(self, at: int) -> None:
        """Close all blocks from a depth on, with the inline elements in them."""
        self.links -= sum(open_.get("a", 0) for open_ in self.inline[at:])
        del self.blocks[at:], self.inline[at:]


def parse(source: str) -> Page:
    """Block tree and text runs of a page. Unclosed and stray tags are repaired the way browsers do it in outline.

    Drawings and formulas are inline; a block that begins inside ends them. Each tag takes a constant number of
    steps, however deeply elements are nested.
    """
    nodes = [Node("html", -1, 0)]
    open_ = _Open()
    open_.push("html", 0)
    runs: list[tuple[int, str]] = []
    pieces: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            at = open_.blocks[-1][1]
            nodes[at].runs.append(len(runs))
            nodes[at].link_chars += min(links, len(text))
            runs.append((at, text))
        links = 0

    def close(k: int) -> None:
        flush()
        open_.cut(k)

    at, size, last = 0, len(source), source.rfind(">")
    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text = source[at:start]
            pieces.append(text)
            if open_.links:
                links += len(text)
            at = start
            continue
        # Beyond the last ">" no tag can end, only a comment that is never closed.
        found = _TOKEN.match(source, at) if at < last or source.startswith("<!--", at) else None
        if not found:
            pieces.append("&lt;")
            at += 1
            continue
        at = found.end()
        ending, name, rest = (found.group(k) if found.group(2) is not None else found.group(k + 3) for k in (1, 2, 3))
        if name is None:
            continue
        name = name.lower()
        drawn = any(open_.depth_of(f) == len(open_.blocks) - 1 for f in FOREIGN)
        if ending:
            if name in INLINE or open_.depth_of(name) == -1:
                open_.end_inline(name)
            elif (k := open_.depth_of(name)) > 0:
                if open_.blocks[k][0] == name:
                    close(k)
                else:
                    open_.end_inline(name)
            continue
        if name in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
            pieces.append(" ")
            continue
        if drawn and name not in HTML_ONLY:
            if not rest.endswith("/"):
                open_.push_inline(name)     # a drawing's or formula's own element
            pieces.append(" ")
            continue
        if drawn and name not in INLINE:
            for f in FOREIGN:
                while open_.depth_of(f) == len(open_.blocks) - 1:
                    open_.end_inline(f)
        if name in ("br", "wbr", "img"):
            pieces.append("" if name == "wbr" else " ")
            continue
        if name in INLINE:
            if not (name in FOREIGN and rest.endswith("/")):
                open_.push_inline(name)
            continue
        if name in ("head", "html"):
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name == "body":
            if len(open_.blocks) == 1 and not any(open_.inline[0].values()):
                flush()
                nodes.append(Node("body", 0, 1, hints_of(rest)))
                open_.push("body", 1) if len(nodes) == 2 else nodes.pop()
            continue
        if name in ENDS_PARAGRAPH and open_.blocks[-1][0] == "p":
            close(len(open_.blocks) - 1)
        if name in SAME_KIND:
            same = max(open_.depth_of(n) for n in SAME_KIND[name])
            if same > max(0, *(open_.depth_of(n) for n in SCOPE.get(name, ("table",)))):
                close(same)
        flush()
        parent = open_.blocks[-1][1]
        label = _LABEL.search(rest)
        nodes.append(Node(name, parent, nodes[parent].depth + 1, hints_of(rest), int(label.group(1)) if label else None))
        nodes[parent].paragraphs += name == "p"
        open_.push(name, len(nodes) - 1)
    flush()
    return Page(nodes, runs)


def hints_of(attributes: str) -> tuple[int, ...]:
    if "=" not in attributes:
        return ()
    words = {w for m in _NAMES.finditer(attributes) for w in _SPLIT.split(next((g for g in m.groups() if g), "")) if w}
    return tuple(sorted({HINT_OF[w.lower()] for w in words if w.lower() in HINT_OF}))


def features_of(page: Page) -> np.ndarray:
    """Per node its indicator features and its measured ones, in one row."""
    n = len(page.nodes)
    x = np.zeros((n, len(FEATURES)))
    base = len(TAG_GROUPS) + 1 + len(HINTS)
    total = max(len(page.runs), 1)
    for k, node in enumerate(page.nodes):
        row = x[k]
        row[GROUP_OF.get(node.tag, len(TAG_GROUPS))] = 1
        for h in node.hints:
            row[len(TAG_GROUPS) + 1 + h] = 1
        row[base] = 1
        row[base + 7] = min(node.depth, 10) / 10
        row[base + 10] = min(node.paragraphs, 3) / 3
        if node.runs:
            text = [page.runs[r][1] for r in node.runs]
            chars = sum(map(len, text))
            words = sum(t.count(" ") + 1 for t in text)
            row[base + 1] = 1
            row[base + 2] = min(math.log1p(words), 6) / 6
            row[base + 3] = node.link_chars / chars
            row[base + 4] = text[-1][-1] in ".!?\"'”’…:"
            row[base + 5] = "©" in text[0] or "copyright" in text[0].lower()
            row[base + 6] = words <= 4
            row[base + 8] = node.runs[0] / total < 0.1
            row[base + 9] = node.runs[-1] / total > 0.9
    return x


PAIR_KINDS = 3


def pair_kind(node: Node) -> int:
    """Text blocks, marked-off regions and plain containers relate to their parents differently."""
    if node.tag in ("nav", "header", "footer", "aside", "form", "article", "main"):
        return 1
    return 2 if node.tag in ("div", "section", "body") else 0


@dataclass
class TreeModel:
    unary: np.ndarray  # weight of each feature for "inside"
    pair: np.ndarray  # kind x parent value x child value

    @staticmethod
    def start() -> TreeModel:
        """Before training: a parent's and a child's values tend to agree."""
        return TreeModel(np.zeros(len(FEATURES)), np.tile(np.array([[0.5, -0.5], [-1.0, 1.0]]), (PAIR_KINDS, 1, 1)))


def messages(parents: list[int], kinds: list[int], scores: list[float], pair: list) -> tuple[list[float], list, float]:
    """Sum-product on a tree given in document order.

    Returns each node's probability of value 1, each edge's joint probabilities
    and the log partition function. Messages go up from the leaves in reverse
    order, then down in order; every message is divided by its sum.
    """
    n = len(parents)
    up0, up1 = [1.0] * n, [1.0] * n  # products of the children's messages
    own1 = [math.exp(max(-30.0, min(30.0, s))) for s in scores]
    sent = [(0.5, 0.5)] * n
    log_z = 0.0
    for k in range(n - 1, 0, -1):
        b0, b1 = up0[k], up1[k] * own1[k]
        p = pair[kinds[k]]
        m0 = p[0][0] * b0 + p[0][1] * b1
        m1 = p[1][0] * b0 + p[1][1] * b1
        total = m0 + m1
        log_z += math.log(total)
        m0, m1 = m0 / total, m1 / total
        sent[k] = m0, m1
        j = parents[k]
        up0[j] *= m0
        up1[j] *= m1
        big = up0[j] + up1[j]
        if big < 1e-100:
            up0[j] /= big
            up1[j] /= big
            log_z += math.log(big)
    b0, b1 = up0[0], up1[0] * own1[0]
    log_z += math.log(b0 + b1)
    belief = [(0.0, 0.0)] * n
    belief[0] = b0 / (b0 + b1), b1 / (b0 + b1)
    edges = [None] * n
    for k in range(1, n):
        j = parents[k]
        p = pair[kinds[k]]
        # What the parent believes without this child's message.
        d0, d1 = belief[j][0] / max(sent[k][0], 1e-300), belief[j][1] / max(sent[k][1], 1e-300)
        b0, b1 = up0[k], up1[k] * own1[k]
        e = d0 * p[0][0] * b0, d0 * p[0][1] * b1, d1 * p[1][0] * b0, d1 * p[1][1] * b1
        total = sum(e)
        edges[k] = tuple(v / total for v in e)
        belief[k] = (e[0] + e[2]) / total, (e[1] + e[3]) / total
    return [b[1] for b in belief], edges, log_z


def marginals(page: Page, model: TreeModel) -> list[float]:
    x = features_of(page)
    pair = np.exp(model.pair).tolist()
    return messages([v.parent for v in page.nodes], [pair_kind(v) for v in page.nodes], (x @ model.unary).tolist(), pair)[0]


def labels_of(page: Page) -> list[int]:
    """A node's label is the nearest one given at it or above it; outside any, 0."""
    out: list[int] = []
    for node in page.nodes:
        out.append(node.label if node.label is not None else out[node.parent] if node.parent >= 0 else 0)
    return out


def train(sources: list[str], epochs: int = EPOCHS, rate: float = RATE) -> TreeModel:
    """Stochastic gradient ascent on the log likelihood of labelled pages: observed less expected features."""
    prepared = []
    for source in sources:
        page = parse(source)
        prepared.append(([v.parent for v in page.nodes], [pair_kind(v) for v in page.nodes], features_of(page), np.array(labels_of(page))))
    model = TreeModel.start()
    squares = np.full_like(model.unary, 1e-6), np.full_like(model.pair, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for k in order.permutation(len(prepared)):
            parents, kinds, x, y = prepared[k]
            p, edges, _ = messages(parents, kinds, (x @ model.unary).tolist(), np.exp(model.pair).tolist())
            g_unary = x.T @ (y - np.array(p)) / len(parents) - DECAY * model.unary
            g_pair = np.zeros_like(model.pair)
            for v in range(1, len(parents)):
                g_pair[kinds[v], y[parents[v]], y[v]] += 1
                g_pair[kinds[v]] -= np.array(edges[v]).reshape(2, 2)
            g_pair = g_pair / len(parents) - DECAY * model.pair
            for value, slope, square in ((model.unary, g_unary, squares[0]), (model.pair, g_pair, squares[1])):
                square += slope**2
                value += rate * slope / np.sqrt(square)
    return model


def extract(source: str, model: TreeModel) -> str:
    """Runs of text whose block is more likely inside the main content, in page order."""
    page = parse(source)
    if not page.runs:
        return ""
    inside = marginals(page, model)
    return "\n\n".join(text for at, text in page.runs if inside[at] >= 0.5)


# --- labelled pages -----------------------------------------------------------------------------------------------

_PLACEHOLDER = [
    "A first sentence stands here, and a second one follows it. They fill a paragraph as any text would.",
    "Some paragraphs are short.", "Others go on for a while, with commas, with clauses, and with an end that comes later than one thinks.",
]


def article_blocks(source: str) -> list[str]:
    """Texts of the blocks inside a page's only article element; none if there is not exactly one."""
    if len(re.findall(r"<article\b", source, re.I)) != 1:
        return []
    page = parse(re.sub(r"<article\b", '<article data-content-label="1"', source, flags=re.I))
    labels = labels_of(page)
    return [text for at, text in page.runs if labels[at]]


def labelled_variants(source: str, seed: int) -> list[str]:
    """Pages with known labels made from a page: itself, if it marks an article, and its text in another layout.

    The other layout has the first ``TRAINING_BLOCKS`` blocks of the text and is drawn by ``seed``: which element holds the article, and which menus, headers, notices,
    adverts, forms, sidebars, reader comments and footers stand around and inside it.
    """
    blocks = article_blocks(source)
    out = []
    if blocks:
        out.append(re.sub(r"<article\b", '<article data-content-label="1"', source, flags=re.I))
    rng = np.random.default_rng(seed)
    texts = [html.escape(t, quote=False) for t in (blocks or _PLACEHOLDER)][:TRAINING_BLOCKS]
    one = lambda options: options[int(rng.integers(len(options)))]
    some = lambda share: rng.random() < share
    words = " ".join(texts).split()
    phrase = lambda low, high: " ".join(words[int(rng.integers(len(words)))] for _ in range(int(rng.integers(low, high))))
    sentence = lambda: phrase(4, 14).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{k}">{phrase(1, 3)}</a></li>' for k in range(n))
    body = []
    for k, text in enumerate(texts):
        if k == 0 and some(0.7):
            body.append(f"<h1>{text}</h1>")
        elif some(0.08):
            body.append(f"<h2>{phrase(2, 6)}</h2><p>{text}</p>")
        elif some(0.06):
            body.append(f"<ul><li>{text}</li><li>{sentence()}</li></ul>")
        elif some(0.05):
            body.append(f"<blockquote><p>{text}</p></blockquote>")
        elif some(0.04):
            body.append(f"<table><tr><th>{phrase(1, 3)}</th><td>{phrase(1, 4)}</td></tr></table><p>{text}</p>")
        else:
            body.append(f"<p>{text}</p>")
        if some(0.05):
            body.append(f'<div class="{one(("ad", "advert", "promo", "sponsored"))}" data-content-label="0"><p>{sentence()}</p></div>')
        if some(0.04):
            body.append(f'<aside data-content-label="0"><h3>{phrase(1, 3)}</h3><p>{sentence()}</p></aside>')
    comments = "".join(f'<div class="{one(("comment", "reply"))}"><p>{sentence()}</p></div>' for _ in range(int(rng.integers(1, 5))))
    region = one(("section", "div"))
    comments = f'<{region} class="comments" data-content-label="0"><h3>{phrase(1, 3)}</h3>{comments}</{region}>' if some(0.4) else ""
    form = f'<form data-content-label="0"><p>{phrase(2, 5)}</p><label>{phrase(1, 2)}</label><button>{phrase(1, 2)}</button></form>'
    inner = "".join(body) + (comments if some(0.5) else "") + (form if some(0.15) else "")
    open_tag = one((
        "<article {}>", "<article {}>", "<main {}>", '<div class="content" {}>', '<div id="main-content" {}>', '<div class="post-body" {}>',
        '<section class="article" {}>', '<div class="entry-content" {}>', '<div class="story text" {}>', "<div {}>",
    ))
    close_tag = "</" + re.match(r"<(\w+)", open_tag).group(1) + ">"
    before, after = [], [comments] if comments and comments not in inner else []
    if some(0.6):
        before.append(one((f"<nav><ul>{links(5)}</ul></nav>", f'<div class="menu"><ul>{links(4)}</ul></div>', f'<ul id="navigation">{links(6)}</ul>')))
    if some(0.4):
        before.append(one((f"<header><p>{phrase(1, 4)}</p></header>", f'<div class="header"><p>{sentence()}</p></div>', f'<div id="masthead">{phrase(1, 4)}</div>')))
    if some(0.3):
        before.append(f'<div class="{one(("cookie-notice", "notice", "alert", "consent-banner"))}"><p>{sentence()}</p></div>')
    if some(0.4):
        one((before, after)).append(f'<div class="{one(("ad", "ads", "promo", "banner"))}">{sentence()}</div>')
    if some(0.35):
        one((before, after)).append(one((f"<aside><p>{sentence()}</p><ul>{links(3)}</ul></aside>", f'<div class="sidebar"><h3>{phrase(1, 3)}</h3><p>{sentence()}</p></div>',
                                         f'<div class="related"><ul>{links(4)}</ul></div>')))
    if some(0.25):
        after.append(form)
    if some(0.7):
        after.append(one((f"<footer>&copy; {phrase(2, 9)}</footer>", f'<div class="footer"><p>{sentence()}</p></div>', f"<footer><p>{sentence()}</p><ul>{links(3)}</ul></footer>")))
    wrap = one(("{}", "{}", '<div class="wrapper">{}</div>', '<div id="page">{}</div>'))
    whole = "".join(before) + open_tag.format('data-content-label="1"') + inner + close_tag + "".join(after)
    out.append(f"<html><body>{wrap.format(whole)}</body></html>")
    return out


def seed_of(source: str) -> int:
    return int.from_bytes(hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def training_pages(pages: DataFrame, rows: int = TRAINING_PAGES, limit: int = TRAINING_BYTES) -> list[str]:
    """Labelled pages made from at most ``rows`` distinct pages of at most ``limit`` bytes, the first by a hash of the html."""
    short = pages.select(F.col("html").cast("string").alias("html")).filter(F.octet_length("html") <= limit).withColumn("hash", F.xxhash64("html"))
    # Hashes first, so that copies of a page count once; then the pages of the few chosen ones.
    chosen = [r["hash"] for r in hash_sample(short.select("hash").distinct(), "hash", rows).collect()]
    sources = sorted(r["html"] for r in short.filter(F.col("hash").isin(chosen)).dropDuplicates(["hash"]).collect())
    made = [v for s in sources for v in labelled_variants(s, seed_of(s))]
    # Without pages to learn from, the layouts are filled with placeholder sentences.
    return made + [v for k in range(max(0, 60 - len(sources))) for v in labelled_variants("", k)]


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    The model is trained on a bounded number of labelled pages made from the
    given ones. NULL or empty html gives empty text; text outside any tag
    belongs to the page's root. Repeated rows are treated alike, columns
    beyond the three named are not read, an empty table gives no row.
    """
    model = train(training_pages(pages))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            texts = [extract(source, model) for source in texts_of(part, "html")]
            yield batch_of(RESULT, page_id=column_of(part, "page_id"), url=column_of(part, "url"), text=texts, n_chars=[len(t) for t in texts])

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
