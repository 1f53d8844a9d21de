"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A logistic classifier
(trained on blocks whose surroundings tell their kind) gives each block a cost of
being content and one of being boilerplate: the capacities to the two terminals.
Blocks next to each other, and neighbours below one parent, are tied by smoothness
edges that weaken with their distance in the document tree. The minimum cut, by
maximum flow, is the labelling of least cost. Blocks whose own evidence outweighs
all their edges are settled first, which is exact and leaves small networks.

The classifier is fitted on at most ``sample`` pages, those of the smallest hash
of their markup; every page is labelled.

Defined results for odd rows: null and empty markup, and pages without content,
give an empty text; null ids and urls are returned as they are; repeated rows
each get their own row; other columns pass through ``extract`` untouched (one
named like the result is replaced); an empty table gives an empty result; markup
that breaks off is read up to there; no block is dropped or cut for its length;
formulas, drawings' texts and what stands in for scripts or objects count as text
like any other, form controls and templates never do.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, split_batch

SAMPLE = 400
#: Smoothness between neighbours in the page, and between neighbours below one parent.
NEXT_TO, SAME_PARENT = 0.5, 0.5

# Element names of the HTML standard, by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped with all that they hold: scripts, styles, titles (of pages and drawings), form controls, markup that isn't shown.
RAW = frozenset("script style title textarea select datalist template iframe noframes noembed".split())
CLOSES = {k: frozenset({"p"}) for k in BLOCKS - {"head", "body", "html", "option", "optgroup"}} | {
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
CONTAINERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "p": ("div", "article", "section", "td", "th", "li", "body", "main")}
CHROME = frozenset("nav footer aside form button dialog menu search fieldset label head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination|pager|toolbar|tags|copyright)(?=$|[\s_-])",
    re.IGNORECASE,
)
CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story|text|body)(?=$|[\s_-])", re.IGNORECASE)

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Node:
    """An open element: what it and its ancestors say about text inside."""

    name: str
    parent: Node | None
    number: int
    depth: int
    article: bool
    chrome: bool
    named_chrome: bool
    named_content: bool


@dataclass
class Piece:
    """A block of text with the element it lies in."""

    text: str
    node: Node
    linked: int


def _child(parent: Node | None, name: str, attributes: str, number: int) -> Node:
    article, chrome = name in ("article", "main"), name in CHROME
    named_chrome = named_content = False
    inside = parent is not None and parent.article
    if name in ("header", "noscript") and not inside:
        chrome = True
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "role":
                chrome |= value.lower() in CHROME_ROLES
                article |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                chrome = True
            elif key in ("class", "id") and name not in ("html", "body"):
                named_chrome |= bool(CHROME_NAMES.search(value))
                named_content |= bool(CONTENT_NAMES.search(value))
    if parent is None:
        return Node(name, None, number, 0, article, chrome, named_chrome, named_content)
    return Node(
        name, parent, number, parent.depth + 1, article or inside, chrome or parent.chrome, named_chrome or parent.named_chrome, named_content or parent.named_content
    )


def pieces(markup: str) -> list[Piece]:
    """The blocks of text of a page, in order, white space reduced, character references decoded."""
    out: list[Piece] = []
    number = 0
    root = _child(None, "#", "", 0)
    node, block = root, root
    words: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal words
        if words:
            text = " ".join("".join(t for t, _ in words).split())
            if text:
                linked = sum(len(t) for t, in_link in words if in_link)
                out.append(Piece(text, block, min(linked, len(text))))
            words = []

    at, n, find = 0, len(markup), markup.find
    while at < n:
        lt = find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not words:
                block = node
            words.append((html.unescape(markup[at:lt]), links > 0))
        if lt == n:
            break
        follows = markup[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            end = find("-->", lt + 4) + 2 if markup.startswith("<!--", lt) else find(">", lt)
            if end < lt + 2:
                break
            at = end + 1
            continue
        tag = _TAG.match(markup, lt) or _LOOSE.match(markup, lt)
        if tag is None:
            if follows.isalpha() or follows == "/":  # a tag that never ends
                break
            if not words:
                block = node
            words.append(("<", links > 0))
            at = lt + 1
            continue
        at = tag.end()
        name = tag.group(2).lower()
        if tag.group(1):
            if name in BLOCKS:
                flush()
            open_ = node
            while open_ is not root and open_.name != name and not (name not in BLOCKS and open_.name in BLOCKS):
                open_ = open_.parent
            if open_.name == name and open_ is not root:
                shut = node
                while shut is not open_.parent:
                    links -= shut.name == "a"
                    shut = shut.parent
                node = open_.parent
            continue
        if name == "br" or name == "wbr" or name == "img":
            words.append((" " if name == "br" else "", False)) if words else None
            continue
        if name in BLOCKS:
            flush()
            closes, stops = CLOSES.get(name, ()), CONTAINERS.get(name, ())
            open_, shut_to = node, None
            while open_ is not root and open_.name not in stops:
                if open_.name in closes:
                    shut_to = open_.parent
                elif open_.name in BLOCKS and name not in CONTAINERS:
                    break
                open_ = open_.parent
            if shut_to is not None:
                shut = node
                while shut is not shut_to:
                    links -= shut.name == "a"
                    shut = shut.parent
                node = shut_to
        if name in VOID or tag.group(3).endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(markup, at)
            if end is None:
                break
            stop = find(">", end.start())
            if stop < 0:
                break
            at = stop + 1
            continue
        number += 1
        node = _child(node, name, tag.group(3), number)
        links += name == "a"
    flush()
    return out


N_FEATURES = 13
#: The features that tell a block's kind by its surroundings.
_SURROUNDINGS = slice(0, 4)


def describe(found: list[Piece]) -> np.ndarray:
    """A row of features for each block; the last one is constant."""
    out = np.zeros((len(found), N_FEATURES))
    for k, p in enumerate(found):
        text, node, n_words = p.text, p.node, p.text.count(" ") + 1
        out[k] = (
            node.article,
            node.chrome,
            node.named_chrome,
            node.named_content,
            p.linked / len(text),
            min(np.log1p(n_words), 5.0) / 5,
            n_words < 4,
            text[-1] in ".!?…:;\"'»”",
            min(text.count(",") / n_words, 0.3),
            node.name[0] == "h" and node.name[1:].isdigit(),
            node.name == "p",
            node.name in ("li", "td", "th", "dt", "dd"),
            1,
        )
    return out


#: Before any training: surroundings decide, then length and links.
PRIOR = np.array([5.0, -6.0, -6.0, 1.0, -3.0, 4.0, -0.5, 0.5, 1.0, 0.3, 0.5, -0.5, -1.5])


@dataclass
class Model:
    weights: np.ndarray

    def chances(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -12, 12)))


def train(features: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> Model:
    """Logistic regression towards PRIOR, on blocks that their surroundings label; each block
    counts twice, once with its surroundings hidden, so that the text's own features learn too."""
    chrome = (features[:, 1] > 0) | (features[:, 2] > 0)
    labelled = chrome | (features[:, 0] > 0)
    if not labelled.any():
        return Model(PRIOR.copy())
    x, y = features[labelled], (~chrome[labelled]).astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    bare = x.copy()
    bare[:, _SURROUNDINGS] = 0
    x, y, weight = np.concatenate([x, bare]), np.concatenate([y, y]), np.concatenate([weight, weight * 0.2])
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - y)) + penalty * (w - PRIOR))
    w[0], w[1], w[2] = max(w[0], PRIOR[0]), min(w[1], PRIOR[1]), min(w[2], PRIOR[2])
    return Model(w)


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the document tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Piece]) -> list[tuple[int, int, float]]:
    """Smoothness between blocks."""
    out, last = [], {}
    for k, p in enumerate(found):
        if k:
            out.append((k - 1, k, NEXT_TO / (1 + distance(found[k - 1].node, p.node))))
        parent = p.node.parent.number if p.node.parent is not None else 0
        if parent in last and last[parent] != k - 1:
            out.append((last[parent], k, SAME_PARENT / (1 + distance(found[last[parent]].node, p.node))))
        last[parent] = k
    return out


def minimum_cut(gain: np.ndarray, ties: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the blocks on the content side; ``gain`` is the cost of boilerplate minus that of content."""
    gain = gain.astype(float).copy()
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label = np.zeros(n, bool)
    settled = np.zeros(n, bool)
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if settled[k] or abs(gain[k]) <= sum(near[k].values()):
            continue
        settled[k], label[k] = True, gain[k] > 0
        for j, w in near[k].items():  # the tie becomes evidence of the neighbour
            gain[j] += w if label[k] else -w
            del near[j][k]
            queue.append(j)
        near[k] = {}
    rest = np.flatnonzero(~settled)
    if len(rest):
        label[rest] = _max_flow(rest.tolist(), gain, near)
    return label


def _max_flow(rest: list[int], gain: np.ndarray, near: list[dict[int, float]]) -> np.ndarray:
    """Dinic's maximum flow over the unsettled blocks; the source side is content."""
    place = {k: i + 2 for i, k in enumerate(rest)}
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for k in rest:
        a = place[k]
        room[0][a], room[a][0] = max(gain[k], 0.0), 0.0
        room[a][1], room[1][a] = max(-gain[k], 0.0), 0.0
        for j, w in near[k].items():
            room[a][place[j]] = w
    tiny = 1e-12
    while True:
        level, queue = {0: 0}, deque([0])
        while queue:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > tiny and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if 1 not in level:
            return np.array([place[k] in level for k in rest])
        left = [iter(list(r)) for r in room]
        path = [0]
        while path:
            a = path[-1]
            if a == 1:
                sent = min(room[x][y] for x, y in zip(path, path[1:], strict=False))
                for x, y in zip(path, path[1:], strict=False):
                    room[x][y] -= sent
                    room[y][x] = room[y].get(x, 0.0) + sent
                cut = next(i for i in range(len(path) - 1) if room[path[i]][path[i + 1]] <= tiny)
                path = path[: cut + 1]
                left[path[-1]] = iter(list(room[path[-1]]))
                continue
            for b in left[a]:
                if room[a][b] > tiny and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
            else:
                path.pop()


def main_text(markup: str | None, model: Model) -> str:
    """The content blocks of a page, joined by an empty line."""
    found = pieces(markup) if markup else []
    if not found:
        return ""
    p = model.chances(describe(found))
    content = minimum_cut(np.log(p) - np.log1p(-p), edges(found))
    return "\n\n".join(f.text for f, c in zip(found, content.tolist(), strict=True) if c)


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Model:
    """The classifier of at most ``sample`` pages; only sums of block features travel to the driver."""
    chosen = pages.select(F.col(html_col).alias("html")).where("html IS NOT NULL").orderBy(F.xxhash64("html"), "html").limit(sample)

    ship(pages.sparkSession)

    def rows(batches):
        for batch in batches:
            for markup in batch.column(0).to_pylist():
                kinds, counts = np.unique(np.round(describe(pieces(markup)), 2), axis=0, return_counts=True)
                if len(kinds):
                    yield pa.RecordBatch.from_pydict({"f": pa.array(list(kinds), pa.list_(pa.float64())), "n": pa.array(counts.astype(np.int64))})

    found = chosen.mapInArrow(rows, "f array<double>, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # of ``sample`` pages
    found.sort(key=lambda r: r["f"])
    if not found:
        return Model(PRIOR.copy())
    return train(np.repeat(np.array([r["f"] for r in found]), [r["n"] for r in found], axis=0))


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text_col``."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    plain = pages.drop(text_col) if text_col != html_col else pages
    at = plain.columns.index(html_col)
    schema = plain.withColumn(text_col, F.lit("")).schema if text_col != html_col else plain.schema
    names = [f.name for f in schema]

    def run(batches):
        for whole in batches:
            for batch in split_batch(whole):
                texts = pa.array([main_text(m, shared.value) for m in batch.column(at).to_pylist()], pa.string())
                columns = [*batch.columns, texts] if len(names) > batch.num_columns else [texts if k == at else c for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.mapInArrow(run, schema)
