"""Main text of web pages: boosted trees over DOM nodes, decoded by hierarchy.

A page becomes a tree of its block elements (inline markup stays inside their
text). Every node gets features of its own and its subtree: text and link
density, size, class and id tokens, depth, place among its siblings, and what stands
above it. Gradient-boosted trees give the probability that a node belongs to the
article. A decision for the whole tree follows by dynamic programming: a
subtree is article, is page furniture, or is mixed; inside the first two every
descendant agrees with its ancestor, so contradictory choices cannot arise, and
"mixed" costs something. Text of the article's nodes comes out block by block.

Training (``train``, on the driver) uses a bounded sample: at most ``SAMPLE_PAGES``
pages of at most ``SAMPLE_CHARS`` characters, taken by hash, whose nodes are labelled
from their elements (inside the one article or main element against outside it, never by class words),
and ``LAYOUTS`` generated layouts with known labels, which cover pages built
another way (class names only, no hints at all, comments, notices, forms, and furniture words on bodies, wrappers
and articles). Class and id words are a feature of a node and of what lies inside it, but not those of wrappers: bodies,
articles, and nodes that hold the article besides other things.

Defined results: null or empty html has empty text; html without an article
has empty text; markup that is cut off ends where the page ends; unclosed
elements close with their parent; character references without a meaning stay as they
are; repeated rows get equal results; an empty table gives an empty result (the model then
comes from the generated layouts alone); pages of any size are read whole, one page in one task. Pictures (svg, void or
nested) have no text, formulas keep theirs. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 150
SAMPLE_CHARS = 100_000
LAYOUTS = 250
TREES, DEPTH, RATE, BINS = 50, 3, 0.25, 32
MIXED_COST = 0.7
BATCH_PAGES = 500

# Element names of HTML, by role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title noscript iframe template textarea noembed noframes".split())
DRAWN = {"svg"}         # elements whose text is part of a picture; they may be void and nest
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | set(
    "html body article main section div nav header footer aside form fieldset p ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details "
    "summary dialog menu hr center button select option label".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Class and id words that say what a node is for.
ARTICLE_WORDS = set("article content main post entry story text body page-content".split())
FURNITURE_WORDS = set(
    "nav navbar navigation menu header masthead footer sidebar side aside ad ads advert "
    "advertisement sponsor sponsored banner promo comment comments reply replies disqus cookie "
    "cookies consent notice notification alert gdpr form search login signup subscribe "
    "newsletter share sharing social related recommended breadcrumb breadcrumbs widget popup modal "
    "pagination pager copyright toolbar skip".split())
FURNITURE_TAGS = set("nav header footer aside form menu dialog button select option label fieldset".split())
ARTICLE_TAGS = {"article", "main"}
LISTS, ITEMS = {"ul", "ol", "dl"}, {"li", "dt", "dd"}
BOXES, CELLS = {"div", "section"}, {"table", "tr", "td", "th"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset = frozenset()
    chars: int = 0        # of the node's own text, then of its subtree
    links: int = 0        # characters inside links
    stops: int = 0        # sentence ends
    anchors: int = 0      # links
    tags: int = 1         # elements
    kids: list = field(default_factory=list)
    own: int = 0
    start: int = 0        # characters of the page before the node
    main: bool = False    # holds an article or main element
    titled: bool = False  # holds a first-level heading
    within: bool = False  # lies in an article or main element


class Page:
    """Block nodes of a page and its text blocks ``(node, text)`` in order."""

    def __init__(self, text: str):
        self.nodes = [Node("html", -1, 0)]
        self.blocks: list[tuple[int, str]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._parts: list[str] = []
        self._link_chars = self._open_links = self._chars = 0
        self._parse(text)
        for node in self.nodes:
            node.own = node.chars
        for i in range(len(self.nodes) - 1, 0, -1):
            node, up = self.nodes[i], self.nodes[self.nodes[i].parent]
            up.chars += node.chars
            up.links += node.links
            up.stops += node.stops
            up.anchors += node.anchors
            up.tags += node.tags
            up.main |= node.main or node.tag in ARTICLE_TAGS
            up.titled |= node.titled or node.tag == "h1"
            up.kids.append(i)
        for node in self.nodes:
            node.kids.reverse()
            node.within = node.parent >= 0 and (self.nodes[node.parent].within
                                                or self.nodes[node.parent].tag in ARTICLE_TAGS)

    def wrapper(self, node: Node) -> bool:
        """Whether a node holds the article besides other things, or is it: its class words then say nothing about
        what stands inside."""
        if node.tag in ("html", "body") or node.tag in ARTICLE_TAGS or node.main:
            return True
        root = self.nodes[0]
        if node.titled:
            return node.chars >= 0.3 * root.chars
        return not (root.main or root.titled) and node.chars >= 0.6 * root.chars

    def furniture_tag(self, node: Node) -> bool:
        """Furniture by its element; the header of an article, or one that stands among paragraphs, is not."""
        if node.tag == "header" and (node.within or any(
                self.nodes[k].tag == "p" for k in self.nodes[node.parent].kids)):
            return False
        return node.tag in FURNITURE_TAGS

    def _parse(self, text: str) -> None:
        at, end = 0, len(text)
        while at < end:
            m = _TOKEN.search(text, at)
            self._text(text[at:m.start()] if m else text[at:])
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                self._close(name)
            elif name in DRAWN:
                at = self._past(text, at, name, m.group(3) or "")
            elif name in RAW:
                stop = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(text, at)
                at = text.find(">", stop.start()) + 1 or end if stop else end
            else:
                self._open(name, m.group(3) or "")
        self._flush()

    def _past(self, text: str, at: int, name: str, rest: str) -> int:
        """The place behind an element whose inside is not text."""
        if rest.rstrip(">").endswith("/"):
            return at
        tags, depth = re.compile(f"<(/?){name}(?=[\\s/>])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I), 1
        for m in tags.finditer(text, at):
            depth += -1 if m.group(1) else 0 if m.group(2).endswith("/") else 1
            if not depth:
                return m.end()
        return at  # never closed: only the tag goes

    def _text(self, raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = entities.unescape(raw)
            self._parts.append(raw)
            if self._open_links:
                self._link_chars += len(raw.strip())

    def _owner(self) -> int:
        return next(i for _, i in reversed(self._stack) if i >= 0)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                owner = self._owner()
                node = self.nodes[owner]
                node.chars += len(text)
                node.links += min(len(text), self._link_chars)
                node.stops += len(_SENTENCE.findall(text))
                self.blocks.append((owner, text))
                self._chars += len(text)
            self._parts = []
        self._link_chars = 0

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for tag, _ in self._stack[depth:]:
            self._open_links -= tag == "a"
        del self._stack[depth:]

    def _open(self, name: str, attributes: str) -> None:
        if name == "br" or name == "img":
            self._parts.append(" ")
            return
        if name not in BLOCKS:
            self.nodes[self._owner()].tags += 1
            if name not in VOID:
                if name == "a":
                    self._open_links += 1
                    self.nodes[self._owner()].anchors += 1
                self._stack.append((name, -1))
            return
        self._flush()
        closes = CLOSES.get(name, ())
        for depth in range(len(self._stack) - 1, 0, -1):
            tag, node = self._stack[depth]
            if tag == "p" or tag in closes:
                self._pop_to(depth)
                if not closes or tag in closes:
                    break
            elif node >= 0:
                break
        if name in ("hr", "html", "body") and (name == "hr" or len(self.nodes) > 1
                                               or name == "html"):
            return
        words = set()
        if "=" in attributes:
            for found in _NAMED.findall(attributes):
                words.update(_WORDS.findall("".join(found).lower()))
        up = self._owner()
        self.nodes.append(Node(name, up, self.nodes[up].depth + 1, frozenset(words),
                               start=self._chars))
        self._stack.append((name, len(self.nodes) - 1))

    def _close(self, name: str) -> None:
        if name in ("br", "p") and not any(t == name for t, _ in self._stack):
            self._parts.append(" ")
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth][0] == name:
                if name in BLOCKS:
                    self._pop_to(depth)
                else:
                    for tag, _ in self._stack[depth:]:
                        self._open_links -= tag == "a"
                    if any(i >= 0 for _, i in self._stack[depth:]):
                        self._flush()
                    del self._stack[depth:]
                return
            if name not in BLOCKS and self._stack[depth][1] >= 0:
                return  # a stray inline end tag does not close blocks


def features(page: Page) -> np.ndarray:
    """One row per node."""
    nodes = page.nodes
    total = max(1, nodes[0].chars)
    above = np.zeros((len(nodes), 4), np.float32)
    shared: dict[int, dict[str, int]] = {}
    rows = np.zeros((len(nodes), 27), np.float32)
    for i, n in enumerate(nodes):
        p = n.parent
        named = (not n.words.isdisjoint(ARTICLE_WORDS),
                 not n.words.isdisjoint(FURNITURE_WORDS) and not page.wrapper(n))
        above[i] = (*named, n.tag in ARTICLE_TAGS, page.furniture_tag(n))
        if p < 0:
            beside, same, sib_chars, up_links = 1, 1, n.chars, 0.0
        else:
            above[i] += above[p]
            up = nodes[p]
            counts = shared.get(p)
            if counts is None:
                counts = shared[p] = Counter(nodes[k].tag for k in up.kids)
            beside, same = len(up.kids), counts[n.tag]
            sib_chars, up_links = (up.chars - up.own) / beside, up.links / max(1, up.chars)
        rows[i] = (
            n.chars, n.own, n.links / max(1, n.chars), n.chars / n.tags,
            n.stops / max(1, n.chars) * 100, n.tags, n.anchors / n.tags, n.depth,
            beside, same / beside, sib_chars, n.chars / max(1.0, sib_chars), n.start / total,
            n.chars / total, *named, 0, 0, 0, 0,
            n.tag in HEADINGS, n.tag == "p", n.tag in LISTS, n.tag in ITEMS,
            n.tag in BOXES, n.tag in CELLS, up_links)
    rows[:, 16:20] = above
    rows[:, (0, 1, 5, 10)] = np.log1p(rows[:, (0, 1, 5, 10)])
    return rows


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees as arrays: feature and threshold of every inner
    node of a complete tree, value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            score += leaf[at - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-score))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic gradient boosting on binned features, level by level."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.average(y, weights=weight)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    out = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        feature = np.zeros(2 ** DEPTH - 1, np.int64)
        threshold = np.full(2 ** DEPTH - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                n_bins = len(edges[f]) + 1
                if n_bins < 2:
                    continue
                cell = (at - first) * n_bins + binned[:, f]
                sg = np.bincount(cell, g, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                sh = np.bincount(cell, h, width * n_bins).reshape(width, n_bins).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = (sg ** 2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1)
                        - tg ** 2 / (th + 1))[:, :-1]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[first + better] = f
                threshold[first + better] = edges[f][cut[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf_of = at - (2 ** DEPTH - 1)
        sg, sh = np.bincount(leaf_of, g, 2 ** DEPTH), np.bincount(leaf_of, h, 2 ** DEPTH)
        leaf = -RATE * sg / (sh + 1)
        score += leaf[leaf_of]
        out.append((feature, threshold, leaf))
    return Trees(*map(np.stack, zip(*out)), base)


def article_text(page: Page, probability: np.ndarray) -> str:
    """Decode the tree: every subtree is article, furniture or mixed."""
    nodes = page.nodes
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    weight = np.array([0.3 + np.log1p(n.own) for n in nodes])
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    all_yes, all_no = yes.copy(), no.copy()
    # A mixed node has no label of its own; only its own text takes a side.
    mixed = np.array([max(a, b) if n.own else 0.0 for n, a, b in zip(nodes, yes, no)]) - MIXED_COST
    best = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        best[i] = max(all_yes[i], all_no[i], mixed[i] if nodes[i].kids else -np.inf)
        if i:
            up = nodes[i].parent
            all_yes[up] += all_yes[i]
            all_no[up] += all_no[i]
            mixed[up] += best[i]
    kept = np.zeros(len(nodes), bool)
    ruled: list = [None] * len(nodes)  # the decision an ancestor made
    for i, n in enumerate(nodes):
        decision = ruled[n.parent] if i else None
        if decision is None:
            if nodes[i].kids and best[i] == mixed[i] > max(all_yes[i], all_no[i]):
                kept[i] = yes[i] > no[i]
                continue
            decision = bool(all_yes[i] > all_no[i])
        ruled[i] = kept[i] = decision
    return "\n".join(text for owner, text in page.blocks if kept[owner])


# -- training -----------------------------------------------------------------

def semantic_labels(page: Page) -> np.ndarray:
    """1 article, 0 furniture, -1 unknown, from a page's elements alone (class words, which are features, take no
    part): what lies in its one article or main element is article, but for furniture elements in there, and all else is
    furniture. A page without such an element, or with several side by side, tells nothing."""
    label = np.full(len(page.nodes), -1)
    roots = [i for i, n in enumerate(page.nodes) if n.tag in ARTICLE_TAGS and not n.within]
    if len(roots) != 1:
        return label
    for i, n in enumerate(page.nodes):
        above = label[n.parent] if n.parent >= 0 else 0
        if i == roots[0]:
            label[i] = 1
        elif n.main:
            label[i] = -1  # holds the article besides other things
        elif page.furniture_tag(n) or not n.within:
            label[i] = 0
        else:
            label[i] = above
    return label


def _layout(rng: np.random.Generator) -> tuple[str, None]:
    """A page whose furniture elements carry ``data-f``, the article ``data-a`` as their label. Bodies, wrappers and
    articles often carry furniture words in their class, as real ones do."""
    def words(n: int) -> str:
        return " ".join("".join(rng.choice(list("abdeghilmnorstu"), rng.integers(2, 9)))
                        for _ in range(n))

    def sentences(n: int) -> str:
        return " ".join(words(int(rng.integers(3, 15))).capitalize() + "." for _ in range(n))

    def chance(p: float) -> bool:
        return rng.random() < p

    style = rng.choice(["semantic", "class", "id", "bare"])
    misnomers = ["no-sidebar", "page sidebar-right", "home search-results", "header-image", "has-comments", "with-ads",
                 "share-enabled", "widget", "related-wrapper", "form-post", "nav-open", "site", "wrapper", "container",
                 "single single-post", "menu-closed", "has-banner", "social-login"]

    def misnomer(p: float) -> str:
        return f' class="{rng.choice(misnomers)}"' if chance(p) else ""

    def box(tag: str, names: list[str], body: str, label: str, hint: bool = False) -> str:
        name = str(rng.choice(names))
        known = style == "semantic" and tag in BLOCKS and tag != "div"
        attr = ""
        if style in ("class", "id") or hint and not known:
            attr = f' {"id" if style == "id" else "class"}="{name}"'
        return f"<{tag if known else 'div'}{attr} data-{label}>{body}</{tag if known else 'div'}>"

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/x">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))
        return f"<ul>{items}</ul>" if chance(0.7) else re.sub("</?li>", " ", items)

    def article() -> str:
        out = [f"<h1>{words(int(rng.integers(2, 14)))}{'.' * chance(0.4)}</h1>"] if chance(0.85) else []
        if out and chance(0.25):
            line = f"<p>{words(int(rng.integers(1, 4)))}</p>" * chance(0.5)
            tag = "header" if style == "semantic" else "div"
            out[0] = f"<{tag}{misnomer(0.3)}>{out[0]}{line}</{tag}>"
        for _ in range(int(rng.integers(1, 3) if chance(0.25) else rng.integers(3, 18))):
            kind = rng.random()
            text = sentences(int(rng.integers(1, 9)))
            if kind < 0.72:
                if chance(0.2):
                    text += f' <a href="/y">{words(2)}</a> ' + sentences(1)
                if chance(0.2):
                    text = f"<b>{text}<br>"
                out.append(f"<p>{text}" + "</p>" * chance(0.8))
            elif kind < 0.80:
                out.append(f"<h2>{words(int(rng.integers(1, 7)))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(int(rng.integers(2, 12)))}.</li>"
                                            for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.90:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + f"<tr><td>{words(2)}</td><td>{words(1)}</td></tr>" * 3 + "</table>")
            elif kind < 0.97:
                out.append(f"<pre>{words(8)}</pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{words(6)}</figcaption></figure>")
        extra = []
        if chance(0.3):
            extra.append(box("aside", ["ad", "advert", "sponsored", "promo"],
                             f"<p>{sentences(int(rng.integers(1, 3)))}</p>", "f", True))
        if chance(0.2):
            extra.append(box("div", ["share", "social", "related"], links(4), "f", True))
        for e in extra:
            out.insert(int(rng.integers(0, len(out) + 1)), e)
        if chance(0.2):
            out.append(comments())
        return "".join(out)

    def comments() -> str:
        body = "".join(f"<div><b>{words(1)}</b><p>{sentences(int(rng.integers(1, 5)))}</p></div>"
                       for _ in range(int(rng.integers(1, 7))))
        return box(str(rng.choice(["section", "div", "aside"])), ["comments", "comment", "replies"],
                   f"<h3>{words(1)}</h3>{body}", "f", True)

    parts = []
    if chance(0.35):
        parts.append(box("div", ["cookie-notice", "cookie consent", "notice", "alert banner"],
                         f"<p>{sentences(int(rng.integers(1, 4)))}</p><button>{words(1)}</button>", "f", True))
    if chance(0.6):
        parts.append(box("header", ["header", "masthead", "banner"],
                         f"<div>{words(2)}</div><p>{words(5)}</p>", "f", True))
    if chance(0.85):
        parts.append(box("nav", ["nav", "menu", "navigation"], links(int(rng.integers(3, 12))), "f"))
    if chance(0.4):
        parts.append(box("div", ["ad", "ads", "advertisement", "sponsor"], sentences(1), "f", True))
    body = box("article", ["article", "post", "content", "entry", "story"], article(), "a")
    if chance(0.35):  # a class of the article itself that says something else
        body = re.sub(r'^<(\w+)(?: (?:class|id)="[^"]*")? data-a>', lambda m: f'<{m.group(1)}{misnomer(1)} data-a>', body)
    for _ in range(int(rng.integers(0, 3))):
        body = f"<div{misnomer(0.4)}>{body}</div>"
    if chance(0.4):
        side = box("aside", ["sidebar", "widget", "related"],
                   f"<h3>{words(2)}</h3>" + (links(5) if chance(0.6) else f"<p>{sentences(2)}</p>"), "f", True)
        body = side + body if chance(0.4) else body + side
    parts.append(body)
    if chance(0.3):
        parts.append(comments())
    if chance(0.3):
        parts.append("<form data-f><label>" + words(2) + "</label><input><button>" + words(1)
                     + "</button></form>")
    if chance(0.9):
        parts.append(box("footer", ["footer", "copyright"],
                         f"© {words(2)} · {sentences(1) if chance(0.6) else links(4)}", "f", chance(0.5)))
    whole = "".join(parts)
    if chance(0.3):
        whole = f"<div{misnomer(0.6)}>{whole}</div>"
    return f"<html><body{misnomer(0.5)}>" + whole + "</body></html>"


def _layout_labels(text: str) -> tuple[Page, np.ndarray]:
    marked = re.sub(r'(?: (?:class|id)="([^"]*)")? data-([af])>', r' class="\1 zz\2zz">', text)
    page = Page(marked)
    label = np.full(len(page.nodes), -1)
    for i, n in enumerate(page.nodes):
        above = label[n.parent] if n.parent >= 0 else -1
        label[i] = 0 if "zzfzz" in n.words or above == 0 else (1 if "zzazz" in n.words or above == 1 else -1)
        n.words = n.words - {"zzfzz", "zzazz"}
    return page, label


@lru_cache(maxsize=2)
def _layout_rows(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    found = [_layout_labels(_layout(rng)) for _ in range(n)]
    return (np.concatenate([features(p) for p, _ in found]),
            np.concatenate([label for _, label in found]))


def train(pages: DataFrame | None = None, html_col: str = "html", id_col: str = "page_id",
          sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUTS) -> Trees:
    """Fit the trees on generated layouts and a bounded sample of the pages."""
    x, y = _layout_rows(layouts)
    xs, ys = [x], [y]
    if pages is not None and sample_pages:
        rows = (pages.select(F.col(html_col).alias("html"),
                             F.xxhash64(F.col(id_col).cast("string")).alias("h"))
                .filter(F.length("html") <= SAMPLE_CHARS))
        # Numbers find the sample; only its pages are fetched (equal numbers: copies of an id).
        last = rows.select("h").orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
        chosen = [] if last is None else rows.filter(F.col("h") <= last).orderBy("h", "html").limit(sample_pages).collect()
        for r in chosen:
            page = Page(r["html"])
            xs.append(features(page))
            ys.append(semantic_labels(page))
    x, y = np.concatenate(xs), np.concatenate(ys)
    known = y >= 0
    x, y = x[known], y[known].astype(float)
    return fit_trees(x, y, 0.5 + x[:, 1] / 4)


def extract(html: str | None, trees: Trees) -> str:
    """Article text of one page."""
    page = Page(html or "")
    return article_text(page, trees.probability(features(page)))


def _extractor(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                b = batch.slice(at, BATCH_PAGES)
                pages = [Page(x.as_py() or "") for x in b.column("html")]
                p = trees.probability(np.concatenate([features(x) for x in pages]))
                ends = np.cumsum([len(x.nodes) for x in pages])
                text = [article_text(x, q) for x, q in zip(pages, np.split(p, ends[:-1]))]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``, one row per page."""
    shipped = pages.sparkSession.sparkContext.broadcast(trees)
    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html")).mapInArrow(
        _extractor(shipped), f"page_id {kind}, url string, text string, n_chars bigint")
