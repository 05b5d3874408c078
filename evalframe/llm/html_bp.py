"""Main text of web pages by belief propagation over the DOM tree.

Every element of a page is a node with a hidden label: boilerplate, content or
frame (what encloses both, such as the body).
A node's own potential comes from binary features of its tag, its attribute
words and its text; parent-child potentials say how labels follow each other
down the tree. Sum-product messages pass upward and then downward, so every
node's marginal takes the whole page into account. A text belongs to the
article if its element's marginal for content is above one half.

The potentials are counted, with smoothing, on labelled pages: a
bounded sample of the corpus (``TRAIN_PAGES``) whose semantic markup labels
itself (an ``article`` or ``main`` element against navigation, header, footer,
form and advert elements). Scoring is a map over all pages; nothing but the
small model leaves the sample.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hash_sample

#: labelled pages that the potentials are counted on, about
TRAIN_PAGES = 2_000

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext q s samp small span strike strong sub sup time tspan tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside blockquote body div footer form header html main nav ol section table td th ul".split())

# words in class, id and role values that name a part of a page
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments complementary contentinfo cookie cookies consent "
    "discussion disqus dialog footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination "
    "popup promo related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
BOILER_TAGS = frozenset("aside button dialog footer form head header iframe menu nav noscript script select style template textarea title".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    """An element: its texts and children in page order."""

    __slots__ = ("tag", "words", "hidden", "parts", "parent", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, words: frozenset[str] = frozenset(), hidden: bool = False):
        self.tag, self.words, self.hidden, self.parts, self.parent = tag, words, hidden, [], parent
        self.chars = self.linked = 0  # characters of text below, and of those in links


def _attributes(source: str) -> tuple[frozenset[str], bool]:
    words: set[str] = set()
    hidden = False
    for name, value in _ATTRIBUTE.findall(source):
        name = name.lower()
        if name in ("class", "id", "role", "aria-label"):
            words.update(w.lower() for w in _WORD.findall(html.unescape(value.strip("\"'"))))
        hidden |= name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and "display:none" in value.replace(" ", "").lower()
    return frozenset(words), hidden


def parse(source: str) -> Node:
    """Tree of a page. Unclosed and stray tags are mended by the usual implied end tags; an unfinished tag at the end is dropped."""
    root = node = Node("#root", None)
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            node.parts.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            node.parts.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group() == "<":
                node.parts.append("<")
            continue
        if not m.group(4):  # the page ends inside the tag
            break
        tag = tag.lower()
        if m.group(1):
            up = node
            while up.parent is not None and up.tag != tag and not (tag not in SCOPE and up.tag in SCOPE):
                up = up.parent
            if up.parent is not None and up.tag == tag:
                node = up.parent
            continue
        if tag in ENDS_P or tag in SELF_CLOSING:
            closes = SELF_CLOSING.get(tag, {"p"})
            up = node
            while up.parent is not None and up.tag not in closes and up.tag not in SCOPE:
                up = up.parent
            if up.tag in closes and up.parent is not None:
                node = up.parent
        words, hidden = _attributes(m.group(3))
        child = Node(tag, node, words, hidden)
        node.parts.append(child)
        if tag in RAW:  # its text is no markup
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            child.parts.append(source[at : end.start()] if end else source[at:])
            at = end.end() if end else n
        elif tag not in VOID and not m.group(3).rstrip().endswith("/"):
            node = child
    return root


def nodes(root: Node) -> list[tuple[Node, int]]:
    """(node, index of its parent) in page order; the root is its own parent."""
    out, stack = [], [(root, 0)]
    while stack:
        node, up = stack.pop()
        at = len(out)
        out.append((node, up))
        stack.extend((x, at) for x in reversed(node.parts) if isinstance(x, Node))
    for node, _ in reversed(out):
        own = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        below = [x for x in node.parts if isinstance(x, Node)]
        node.chars = 0 if node.tag in RAW else own + sum(x.chars for x in below)
        node.linked = node.chars if node.tag == "a" else sum(x.linked for x in below)
    return out


def features(node: Node) -> list[str]:
    own = " ".join(x for x in node.parts if isinstance(x, str)).split()
    out = [f"tag={node.tag}", f"words={min(4, len(own) // 4)}"]
    if node.tag in CONTENT_TAGS or not node.words.isdisjoint(CONTENT_WORDS):
        out.append("names content")
    if node.tag in BOILER_TAGS or node.hidden or not node.words.isdisjoint(BOILER_WORDS):
        out.append("names boilerplate")
    if node.chars:
        out.append("links" if 2 * node.linked > node.chars else "no links")
    return out


BOILERPLATE, CONTENT, FRAME = LABELS = (0, 1, 2)
#: smoothing: names define the labels, so they count almost as seen; other features and turns from content to an
#: inserted boilerplate part keep a share for what the sample lacks
SURE, OPEN, INSERTED = 0.1, 0.1, 0.2


def self_label(parent: int, node: Node) -> int:
    """Boilerplate under a part named so, content inside an article or main element, else frame."""
    if parent == BOILERPLATE or node.tag in BOILER_TAGS or node.hidden:
        return BOILERPLATE
    if node.tag not in ("html", "body") and not node.words.isdisjoint(BOILER_WORDS):
        return BOILERPLATE
    return CONTENT if parent == CONTENT or node.tag in CONTENT_TAGS else FRAME


def count_page(source: str) -> Counter:
    """Label counts of a page: ("own", feature, label), ("label", label) and ("edge", parent's label, label)."""
    out: Counter = Counter()
    tree = nodes(parse(source))
    labels: list[int] = []
    for i, (node, up) in enumerate(tree):
        labels.append(self_label(labels[up], node) if i else FRAME)
    if CONTENT not in labels:
        return out
    for i, (node, up) in enumerate(tree):
        out["label", labels[i]] += 1
        for f in features(node):
            out["own", f, labels[i]] += 1
        if i:
            out["edge", labels[up], labels[i]] += 1
    return out


class Model:
    """Log potentials from counts; unseen features say nothing."""

    def __init__(self, counts: dict):
        n = [counts.get(("label", y), 0) + 10.0 for y in LABELS]
        self.prior = [math.log(x) for x in (0.01, 0.01, 0.98)]  # of the root
        self.own: dict[str, tuple[float, ...]] = {}
        for f in {k[1] for k in counts if k[0] == "own"} | {"names content", "names boilerplate"}:
            some = [SURE if f.startswith("names ") else OPEN * n[y] for y in LABELS]
            if f == "names boilerplate":
                some[BOILERPLATE] += 0.2 * n[BOILERPLATE]
            if f == "names content":
                some[CONTENT] += 0.2 * n[CONTENT]
            self.own[f] = tuple(math.log((counts.get(("own", f, y), 0) + some[y]) / (n[y] + 2 * some[y])) for y in LABELS)
        e = [[counts.get(("edge", x, y), 0) + 1.0 for y in LABELS] for x in LABELS]
        e[CONTENT][BOILERPLATE] += INSERTED * sum(e[CONTENT])
        self.edge = [[math.log(e[x][y] / sum(e[x])) for y in LABELS] for x in LABELS]

    def own_of(self, node: Node) -> list[float]:
        seen = [self.own[f] for f in features(node) if f in self.own]
        return [sum(x[y] for x in seen) for y in LABELS]

    def marginals(self, tree: list[tuple[Node, int]]) -> list[float]:
        """P(content) of every node by one upward and one downward pass."""
        up = [self.own_of(node) for node, _ in tree]
        sent: list[list[float]] = [[0.0] * 3 for _ in tree]
        for i in range(len(tree) - 1, 0, -1):  # children come after their parents
            message = [_log_sum([self.edge[x][y] + up[i][y] for y in LABELS]) for x in LABELS]
            top = max(message)
            sent[i] = [m - top for m in message]
            parent = up[tree[i][1]]
            for x in LABELS:
                parent[x] += sent[i][x]
        down: list[list[float]] = [self.prior] * len(tree)
        out = []
        for i, (_, p) in enumerate(tree):
            if i:
                rest = [down[p][x] + up[p][x] - sent[i][x] for x in LABELS]
                top = max(rest)
                down[i] = [_log_sum([rest[x] - top + self.edge[x][y] for x in LABELS]) for y in LABELS]
            belief = [down[i][y] + up[i][y] for y in LABELS]
            out.append(math.exp(belief[CONTENT] - _log_sum(belief)))
        return out


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def main_text(source: str | None, model: Model) -> str:
    """Text of the page's content nodes, blocks joined by one space. Empty for a null or empty page."""
    if not source:
        return ""
    root = parse(source)
    tree = nodes(root)
    chosen = {id(node): p > 0.5 for (node, _), p in zip(tree, model.marginals(tree), strict=True)}
    out: list[str] = []
    stack: list[Node | str | None] = [root]
    where: list[Node] = []
    while stack:
        x = stack.pop()
        if x is None:
            node = where.pop()
            if node.tag not in INLINE:
                out.append(" ")
        elif isinstance(x, str):
            if chosen[id(where[-1])] and where[-1].tag not in RAW:
                out.append(x)
        else:
            if x.tag not in INLINE:
                out.append(" ")
            where.append(x)
            stack.append(None)
            stack.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def fit(pages: DataFrame, source: str = "html") -> Model:
    """Count the potentials on about ``TRAIN_PAGES`` pages chosen by hash; only the counts reach the driver."""
    page = F.col(f"`{source}`").alias("_page")
    sample = hash_sample(pages.select(page).where(F.col("_page").isNotNull()), ["_page"], TRAIN_PAGES, 7)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for x in batch["_page"]:
                total.update(count_page(x))
            yield pd.DataFrame([("\t".join(map(str, k)), n) for k, n in total.items()], columns=["key", "n"])

    counted = sample.mapInPandas(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    counts = {}
    for r in counted:
        kind, *rest = r["key"].split("\t")
        counts[(kind, rest[0], int(rest[1])) if kind == "own" else (kind, *map(int, rest))] = r["n"]
    return Model(counts)


def extract(pages: DataFrame, source: str = "html", model: Model | None = None) -> DataFrame:
    """All columns of ``pages`` plus text (never null) and n_chars (its code points).

    Repeated pages get equal texts; a null or empty page an empty text; an empty
    table gives no rows. Caller columns named text or n_chars are replaced.
    """
    model = model or fit(pages, source)

    @F.pandas_udf("string")
    def text_of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: main_text(x, model))

    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*keep, text_of(F.col(f"`{source}`")).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
