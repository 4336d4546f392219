"""Main text of web pages, by gradient-boosted trees over the nodes of the page's tree.

Every block element, form control and embedded element is a node, and every other one with a class, id or role. Trees
score the chance that a node lies in the article from its subtree's density of text, tags and links, the tokens of its
attributes and its ancestors', its depth, and how it compares with its siblings. What tokens of attributes say is
learned: a token and its first letters are hashed to ``BUCKETS`` cells, which hold the log odds that a training node
with such a token lies in the article. Decoding is hierarchical: going down the tree, a node is outside of the article,
in it, or in a part that is cut out of it, and what is cut out holds no article again; the states with the largest sum
of log chances win, so ancestors and descendants never contradict each other. Where that leaves nothing though some
node's chance is ``LEAST_CHANCE`` or more, the best states that enter the article somewhere win.

The trees are trained on made pages, whose layouts and labels ``page_maker`` draws from a seed; their number is
``TRAIN_PAGES``. Extraction is a map over pages and shuffles nothing.

Only what is never shown as text goes unconditionally: scripts, styles, templates, their fallbacks and the head.

Defined cases: a null html counts as empty and gives an empty text; a page without markup is one block and its text is
the article; repeated rows are each extracted. Broken markup is read in time linear in the page: a tag whose quotes
never close ends at the next ``>``, what follows a ``<`` that no ``>`` follows is text, and elements nest ``MAX_DEPTH``
deep, deeper ones count to the last of these. Columns in keep that clash with result columns are dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_maker
from .boosting import BoostedTrees
from .common import text_or_empty
from .encoders import slices

TRAIN_PAGES, SEED = 3000, 11
BUCKETS, LEAST_CHANCE, MAX_DEPTH, CHANGE = 4096, 0.35, 512, 0.7
MADE = ["text", "n_chars"]
# Fixed values of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style noscript template iframe head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Inline elements that are nodes whatever their attributes.
PARTS = frozenset("button select option textarea datalist label output math svg object canvas audio video".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "li", "dd", "dt", "figcaption"}
SIBLING_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|aria-label|itemprop|hidden|style)(?![^\s=])\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NONE = re.compile(r"display\s*:\s*none")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KINDS = {k: i for i, k in enumerate("html body div p article main section header footer nav aside form ul ol li h1 h2 h3 h4 table tr td blockquote pre figure figcaption dl dt dd address details span a ins button select label math svg".split(), 1)}


def cells(tokens: Iterable[str]) -> list[int]:
    """The cells of tokens and of their first four letters."""
    return [xxhash.xxh32_intdigest(t) % BUCKETS for x in tokens for t in ((x, x[:4]) if len(x) > 4 else (x,))]


class Node:
    __slots__ = ("cells", "depth", "hidden", "index", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, index: int, attrs: str):
        self.tag, self.parent, self.index = tag, parent, index
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = False
        self.cells: list[int] = []
        for name, value in _ATTR.findall(attrs) if attrs else ():
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name == "hidden" or (name == "style" and _NONE.search(value)):
                self.hidden = True
            elif name != "style":
                self.cells += cells(t.lower() for t in _TOKEN.findall(value))


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of each tag, with the contents of raw elements in it; comments
    and declarations have no name."""
    at, size, quotes = source.find("<"), len(source), True
    while at >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 2)
            end = end + 3 if end >= 0 else size
            yield at, end, "", False, ""
        elif source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at) + 1
            if not end:
                return
            yield at, end, "", False, ""
        else:
            closing = source.startswith("/", at + 1)
            m = _NAME.match(source, at + 1 + closing)
            if not m:
                at = source.find("<", at + 1)
                continue
            rest = _REST.match(source, m.end()) if quotes and not closing else None
            if not rest and not closing:
                quotes = False  # from here on some quote stays open: looking for its end again would take squared time
            end = rest.end() if rest else source.find(">", m.end()) + 1
            if not end:
                return
            tag, attrs = m[0].lower(), source[m.end() : end - 1]
            if tag in RAW and tag in DROPPED and not closing:
                stop = _RAW_END[tag].search(source, end)
                end = (source.find(">", stop.end()) + 1 or size) if stop else size
            yield at, end, tag, closing, attrs
        at = source.find("<", end)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str, bool] | None]]:
    """The page's nodes, and its texts in order as (node, text, in a link), with None where a block starts or ends."""
    root = Node("", None, 0, "")
    nodes, events, stack = [root], [], [root]
    opened: Counter[str] = Counter()
    link, at, drop = False, 0, None

    def text(a: int, b: int) -> None:
        if a < b and drop is None:
            t = source[a:b]
            events.append((stack[-1].index, html.unescape(t) if "&" in t else t, link))

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for start, end, tag, closing, attrs in tags(source):
        text(at, start)
        at = end
        if not tag:
            continue
        if drop is not None:
            if tag == drop[0]:
                drop = (tag, drop[1] + (-1 if closing else 1))
                if not drop[1]:
                    drop = None
            elif drop[0] == "head" and not closing and tag in BLOCKS:
                drop = None
            if drop is not None or closing:
                continue
        if tag in DROPPED:
            if not closing and tag not in RAW and not attrs.endswith("/"):
                drop = (tag, 1)
            continue
        if tag in ("br", "option"):
            events.append((stack[-1].index, " ", False))
            if tag == "br":
                continue
        if tag == "a":
            link = not closing
        block = tag in BLOCKS
        if closing:
            if opened[tag] > 0:
                i = len(stack) - 1
                while i and stack[i].tag != tag:
                    if not block and stack[i].tag in BLOCKS:
                        i = 0
                        break
                    i -= 1
                if i:
                    if block:
                        events.append(None)
                    close(i)
            continue
        if block:
            events.append(None)
            if tag in SIBLING_CLOSES and any(opened[x] > 0 for x in SIBLING_CLOSES[tag]):
                i = len(stack) - 1
                while i and stack[i].tag not in SIBLING_CLOSES[tag] and stack[i].tag not in STOPS.get(tag, ()):
                    i -= 1
                if i and stack[i].tag in SIBLING_CLOSES[tag]:
                    close(i)
            if tag in CLOSES_P and opened["p"] > 0:
                i = len(stack) - 1
                while i and stack[i].tag not in BLOCKS:
                    i -= 1
                if i and stack[i].tag == "p":
                    close(i)
            if tag in ("html", "body") and opened[tag] > 0:
                continue
        elif tag in VOID or (tag not in PARTS and not (attrs and _ATTR.search(attrs))):
            continue
        node = Node(tag, stack[-1], len(nodes), attrs)
        nodes.append(node)
        if tag not in VOID and not (attrs.endswith("/") and not block) and len(stack) < MAX_DEPTH:
            stack.append(node)
            opened[tag] += 1
    text(at, len(source))
    events.append(None)
    return nodes, events


def features(nodes: list[Node], events: list, odds: np.ndarray) -> np.ndarray:
    """A row for each node. odds: what each cell of attribute tokens says, 0 where it says nothing."""
    n = len(nodes)
    parent = np.array([x.parent.index if x.parent else -1 for x in nodes])
    own = np.zeros((n, 6))  # chars, link chars, words, sentence ends, commas, runs
    for e in events:
        if e:
            t = e[1].strip()
            if t:
                row = own[e[0]]
                row[0] += len(t)
                row[1] += len(t) * e[2]
                row[2] += t.count(" ") + 1
                row[3] += t.count(".") + t.count("?") + t.count("!")
                row[4] += t.count(",")
                row[5] += 1
    sub = np.concatenate([own, np.ones((n, 1))], 1)
    paragraphs, lists = np.array([float(x.tag == "p") for x in nodes]), np.array([float(x.tag == "li") for x in nodes])
    for i in range(n - 1, 0, -1):
        p = parent[i]
        sub[p] += sub[i]
        paragraphs[p] += paragraphs[i]
        lists[p] += lists[i]
    total = np.maximum(sub[0], 1)
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)
    order, before = np.zeros(n), np.zeros(n)
    seen = np.zeros(n)
    passed = 0.0
    least, most, up_least, up_most = (np.zeros(n) for _ in range(4))
    hidden = np.zeros(n)
    for i, x in enumerate(nodes):
        if x.cells:
            own_odds = odds[x.cells]
            least[i], most[i] = min(0.0, own_odds.min()), max(0.0, own_odds.max())
        up_least[i], up_most[i], hidden[i] = least[i], most[i], x.hidden
        if i:
            p = parent[i]
            order[i] = seen[p]
            seen[p] += 1
            up_least[i], up_most[i], hidden[i] = min(up_least[i], up_least[p]), max(up_most[i], up_most[p]), max(hidden[i], hidden[p])
        before[i] = passed
        passed += own[i, 0]
    apart = np.array([float(x.tag in ("nav", "aside", "footer", "form")) for x in nodes])
    main = np.array([float(x.tag in ("article", "main")) for x in nodes])
    up_apart, up_main = apart.copy(), main.copy()
    for i in range(1, n):
        up_apart[i] += up_apart[parent[i]]
        up_main[i] += up_main[parent[i]]
    # Siblings of the same tag and tokens, and the ones before and after.
    kin_of = np.unique([hash((p, x.tag, tuple(x.cells))) for p, x in zip(parent.tolist(), nodes, strict=True)], return_inverse=True)[1]
    kin = np.bincount(kin_of, sub[:, 0])[kin_of]
    kin_count = np.bincount(kin_of)[kin_of]
    prior, after = np.full(n, -1), np.full(n, -1)
    last: dict[int, int] = {}
    for i in range(1, n):
        p = int(parent[i])
        if p in last:
            prior[i], after[last[p]] = last[p], i
        last[p] = i
    beside = lambda at, v: np.where(at >= 0, v[at], -1.0)
    linked = sub[:, 1] / np.maximum(sub[:, 0], 1)
    chars = sub[:, 0]
    in_p = np.maximum(sub[up][:, 0], 1)
    mean = in_p / np.maximum(siblings[up], 1)
    kinds = np.array([KINDS.get(x.tag, 0) for x in nodes], float)
    tag_is = lambda *tags: np.array([float(x.tag in tags) for x in nodes])
    return np.stack([
        chars, chars / total[0], chars / sub[:, 6], sub[:, 1] / np.maximum(chars, 1), sub[:, 2] / np.maximum(sub[:, 5], 1), sub[:, 3] / np.maximum(sub[:, 2], 1), sub[:, 4] / np.maximum(sub[:, 2], 1), own[:, 0] / np.maximum(chars, 1),
        sub[:, 6], paragraphs, lists, np.array([float(x.depth) for x in nodes]), siblings[up], order, siblings, chars / in_p, chars / mean, before / total[0], least, most, up_least, up_most, up_least[up], up_most[up],
        apart, main, up_apart, up_main, kinds, tag_is("h1", "h2", "h3", "h4", "h5", "h6"), tag_is("header"), tag_is(*PARTS), kinds[up], sub[up][:, 1] / np.maximum(sub[up][:, 0], 1), sub[up][:, 0] / total[0], hidden, sub[:, 3], own[:, 0], sub[up][:, 6],
        kin / in_p, kin_count, beside(prior, chars), beside(after, chars), beside(prior, linked), beside(after, linked), beside(prior, up_least), beside(after, up_least), beside(prior, kinds), beside(after, kinds), chars / np.maximum(chars.max(initial=1, where=np.array([x.tag not in ("", "html", "body") for x in nodes])), 1),
    ], 1)


def decode(nodes: list[Node], chance: np.ndarray, some: np.ndarray | None = None) -> list[bool]:
    """Which nodes are in the article: the best of outside (0), in (1) and cut out of it (2) going down the tree. Few
    ancestors and descendants differ, so a change of state costs ``CHANGE``. some: one of these nodes must be in."""
    yes, no = np.log(np.clip(chance, 1e-6, 1)), np.log(np.clip(1 - chance, 1e-6, 1))
    best = np.stack([no, yes, no], 1).tolist()
    for i in range(len(nodes) - 1, 0, -1):
        a, b, c = best[i]
        up = best[nodes[i].parent.index]
        up[0] += max(a, b - CHANGE)
        up[1] += max(b, c - CHANGE)
        up[2] += c
    entry = {0} if best[0][1] > best[0][0] else {i for i in range(1, len(nodes)) if best[i][1] - CHANGE > best[i][0]}
    keep = [s == 1 for s in _down(nodes, best, entry)]
    if some is not None and len(some) and not any(keep[i] for i in some):
        # Nothing of it is in at best, so the best way in is the one entry that loses least.
        entry |= {max(some.tolist(), key=lambda i: best[i][1] - CHANGE * (i > 0) - best[i][0])}
        keep = [s == 1 for s in _down(nodes, best, entry)]
    return keep


def _down(nodes: list[Node], best: list[list[float]], entry: set[int]) -> list[int]:
    state = [0] * len(nodes)
    for i, x in enumerate(nodes):
        above = state[x.parent.index] if x.parent else 0
        state[i] = (1 if i in entry else 0) if above == 0 else (2 if best[i][2] - CHANGE > best[i][1] else 1) if above == 1 else 2
    return state


class Extractor:
    """Boosted trees and what attribute tokens say."""

    def __init__(self, trees: BoostedTrees, odds: np.ndarray):
        self.trees, self.odds = trees, odds

    def texts(self, sources: list[str]) -> list[str]:
        """The main text of each page."""
        parsed = [parse(s) for s in sources]
        rows = [features(*p, self.odds) for p in parsed]
        chance = self.trees.predict(np.concatenate(rows)) if rows else []
        out, at = [], 0
        for (nodes, events), x in zip(parsed, rows, strict=True):
            own = chance[at : at + len(x)]
            at += len(x)
            found = self._joined(events, [True] if len(nodes) == 1 else decode(nodes, own))
            if not found and own.max() >= LEAST_CHANCE:
                found = self._joined(events, decode(nodes, own, np.unique([e[0] for e in events if e and e[1].strip()])))
            out.append(found)
        return out

    @staticmethod
    def _joined(events: list, keep: list[bool]) -> str:
        blocks, held = [], []
        for e in events:
            if e is None:
                if held and (t := " ".join("".join(held).split())):
                    blocks.append(t)
                held = []
            elif keep[e[0]]:
                held.append(e[1])
        return "\n\n".join(blocks)


def labels(nodes: list[Node], events: list, marks) -> np.ndarray:
    """Whether most of a node's own text is the article's, or where it has none, of its subtree's."""
    own = np.zeros((len(nodes), 2))
    for e in events:
        if e and e[1].strip():
            own[e[0]] += [len(e[1].strip()), len(e[1].strip()) if marks(e[1]) else 0]
    inside = own.copy()
    for i in range(len(nodes) - 1, 0, -1):
        inside[nodes[i].parent.index] += inside[i]
    inside = np.where(own[:, :1] > 0, own, inside)
    return (inside[:, 1] * 2 > inside[:, 0]).astype(float)


def token_odds(nodes: Iterable[tuple[Node, float]], shrink: float = 4.0) -> np.ndarray:
    """Per cell the log odds that a node with such a token is in the article, beyond those of any node."""
    seen = np.zeros((BUCKETS, 2))
    both = np.zeros(2)
    for x, y in nodes:
        both[int(y)] += 1
        for c in set(x.cells):
            seen[c, int(y)] += 1
    share = both[1] / max(both.sum(), 1)
    return np.log((seen[:, 1] + shrink * share) / (seen[:, 0] + shrink * (1 - share))) - np.log(share / (1 - share))


def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> Extractor:
    """Trees fitted on made pages. What tokens say is learned from one half of them for the other half's features, so
    that trees don't trust it too much, and then from all."""
    made = [(*parse(source), marks) for source, marks in page_maker.pages(pages, seed)]
    ys = [labels(*x) for x in made]
    halves = [token_odds((n, y) for (nodes, _, _), own in list(zip(made, ys, strict=True))[k::2] for n, y in zip(nodes, own, strict=True)) for k in (0, 1)]
    xs = [features(nodes, events, halves[(i + 1) % 2]) for i, (nodes, events, _) in enumerate(made)]
    trees = BoostedTrees(trees=110, depth=5, rate=0.2, rows=0.5, features=0.7).fit(np.concatenate(xs), np.concatenate(ys))
    return Extractor(trees, token_odds((n, y) for (nodes, _, _), own in zip(made, ys, strict=True) for n, y in zip(nodes, own, strict=True)))


_model: Extractor | None = None


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, model: Extractor | None = None) -> DataFrame:
    """A row for each of pages: the columns in keep, ``text`` and ``n_chars``."""
    global _model
    if model is None:
        model = _model = _model or train()
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in MADE]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in slices(sources, 64):
                texts = shared.value.texts(sources[lo:hi])
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns[:-1]] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], *MADE])

    source = pages.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(html_col).alias("__q_html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
