"""Main-text extraction from HTML by minimum cut.

A page becomes a sequence of text blocks. A logistic classifier over length, links,
kind and neighbours of a block, the text its parent holds, and the names around it,
fitted on blocks that the elements of some pages label (article and main against
nav, footer and the like), gives the costs of calling it content or boilerplate:
terminal capacities. Such elements are nodes of the graph too, tied to the blocks
inside by less than what a block and its neighbours can weigh against them. Blocks
are tied to their neighbours in page order and to blocks of the same parent, the
weaker the farther apart in the DOM. The minimum cut is the cheapest labelling of all.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts

# Element names of the HTML standard, by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template iframe svg textarea datalist button title".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
LISTED = frozenset("ul ol dl menu li dd dt table thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first kind ends an open element of the second, up to the limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

# Elements and roles around an article, and of it.
AROUND_TAGS = frozenset("nav aside footer menu dialog search".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words in the names that sites give to what surrounds an article, and to the article.
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup "
    "promo promoted promotion recommended related reply replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription "
    "taboola toolbar topbar widget widgets alert warning search form header rail teaser sitemap aside".split()
)
ARTICLE_WORDS = frozenset("article articlebody content entry post story main text prose maincontent storybody".split())
# What makes a name say how something is, not what it is; and words that name a box of something.
STATE_WORDS = frozenset("with without no not has have is layout free required on off enabled disabled show hide open closed js".split())
BOX_WORDS = frozenset("area wrap wrapper container box section block inner outer holder group region zone list links item items bar panel column col row slot unit space placeholder".split())

#: Features of a block, and weights (log-odds of content) for tables without labelled blocks.
FEATURES = (
    "one", "log_length", "linked", "heading", "list_item", "table_cell", "no_stop", "log_before", "linked_before", "log_after", "linked_after",
    "crowd", "around_name", "article_name", "outside",
)
DEFAULT_WEIGHTS = (-0.8, 0.6, -3.0, 1.0, -0.4, -0.4, -0.4, 0.2, -0.5, 0.2, -0.5, 2.0, -9.0, 1.5, -2.5)
#: Of them, those of the text; their part of the log-odds is cut off at SURE.
OF_TEXT, SURE = 12, 3.0
#: The bound of what is fitted on: pages, and blocks of a page.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 40
#: Log-odds of an element that says article or not.
MARKED = 7.0
#: Ties of a block with its marked element, of such an element with the next outer one,
#: of blocks that follow each other, and of those that follow each other in one parent.
INSIDE, NESTED, NEXT, SAME = 3.5, 0.5, 1.5, 0.7
#: A part of the page's text from which a box is the page and no surrounding of anything.
MOST = 0.8

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    depth: int
    around: bool = False
    form: bool = False
    article: bool = False
    around_name: float = 0.0
    article_name: bool = False
    silent: bool = False
    link: bool = False
    heading: bool = False
    box: Node | None = None
    hub: Node | None = None
    odds: float = 0.0
    size: int = 0
    own: int = 0
    holds: bool = False
    titled: bool = False


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int
    size: int
    heading: bool = False


def name_says(value: str) -> tuple[float, bool]:
    """(how far a class or id says that it surrounds an article, 0 to 1, whether one says that it is of it).

    The last word of a compound counts that isn't a mere box; an earlier one half. A name of a state says nothing.
    """
    around, article = 0.0, False
    for name in value.split():
        words = _NAMES.findall(_CAMEL.sub(" ", name).lower())
        if not words or STATE_WORDS & set(words):
            continue
        while len(words) > 1 and words[-1] in BOX_WORDS:
            words.pop()
        article |= words[-1] in ARTICLE_WORDS
        around = max(around, 1.0 if words[-1] in AROUND_WORDS else 0.5 if words[-1] not in ARTICLE_WORDS and AROUND_WORDS & set(words) else 0.0)
    return around, article


def _element(tag: str, attrs: str, parent: Node | None) -> Node:
    node = Node(tag, parent, parent.depth + 1 if parent else 0)
    node.silent = tag in SILENT
    node.article, node.around, node.form = tag in ARTICLE_TAGS, tag in AROUND_TAGS, tag == "form"
    for m in _ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role":
            node.around |= value.lower() in AROUND_ROLES
            node.article |= value.lower() in ARTICLE_TAGS
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.silent |= name != "aria-hidden" and tag not in ("html", "body")
        elif name in ("class", "id") and tag not in ("html", "body"):
            around, article = name_says(value)
            node.around_name, node.article_name = max(node.around_name, around), node.article_name or article
    if node.around_name and node.article_name:
        node.around_name, node.article_name = 0.0, False  # says both: says nothing
    if parent is not None:
        node.silent |= parent.silent
        node.link = tag == "a" or parent.link
        node.heading = tag in HEADINGS or parent.heading
        node.box = node if tag in BLOCK else parent.box
    return node


class _Open:
    """The open elements, with the places of each tag and of block elements among them, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of that tag, or 0."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: text between the tags of block elements, with white space as single spaces."""
    root = Node("#", None, 0)
    root.box = root
    open_, found, made = _Open(root), [], [root]
    stack = open_.stack
    parts: list[str] = []
    linked, heading, owner = 0, False, None

    def end() -> None:
        nonlocal linked, heading, owner
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(owner or stack[-1], text, linked, len(text), heading))
            parts.clear()
        linked, heading, owner = 0, False, None

    def say(text: str) -> None:
        nonlocal linked, heading, owner
        top = stack[-1]
        if not text or top.silent:
            return
        text = html.unescape(text) if "&" in text else text
        if owner is None and not text.isspace():
            owner, heading = top.box, top.heading
        if top.link:
            linked += len(text.strip())
        parts.append(text)

    lost = 0
    while m := _MARK.search(page, lost):
        say(page[lost : m.start()])
        lost = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        if tag in BLOCK:
            end()
        if m[1] or m[4]:
            if at := open_.last(tag):
                open_.pop_to(at)
            elif tag == "p":
                end()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            # Its content is text up to its own end tag, whatever it looks like.
            closing = _raw_end(tag).search(page, lost)
            lost = closing.end() if closing else len(page)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK and tag != "body" and tag != "html" and open_.blocks and stack[open_.blocks[-1]].tag == "p":
            open_.pop_to(open_.blocks[-1])
        if tag in ENDS:
            closes, limits = ENDS[tag]
            limit = max(open_.last(t) for t in limits)
            first = [places[k] for t in closes if (places := open_.at.get(t)) and (k := bisect_right(places, limit)) < len(places)]
            if first:
                open_.pop_to(min(first))
        if tag == "body" and (at := open_.last("head")):
            open_.pop_to(at)
        attrs = m[3] or m[6] or ""
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        node = _element(tag, attrs, stack[-1])
        made.append(node)
        open_.push(node)
    say(page[lost:])
    end()
    _mark(made, found)
    return found


def _raw_end(tag: str, seen: dict[str, re.Pattern] = {}) -> re.Pattern:  # noqa: B006
    if tag not in seen:
        seen[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
    return seen[tag]


def _mark(made: list[Node], found: list[Block]) -> None:
    """For each element the innermost marked one it lies in, and the names that hold for it; made: parents before children.

    What holds the headline, an article or most of the page's text surrounds nothing,
    whatever its name; what surrounds articles stays so whatever lies in it.
    """
    for b in found:
        b.node.own += b.size
        b.node.size += b.size
        b.node.titled |= b.node.tag == "h1"
    for node in reversed(made):
        if (up := node.parent) is not None:
            up.size += node.size
            up.titled |= node.titled and not node.around
            # A comment or a menu in an article element is no article.
            up.holds |= node.holds and not node.around or node.article and not node.around_name
    total = max(made[0].size, 1)
    for node in made:
        up = node.parent
        if up is None:
            continue
        node.hub = up.hub
        inside = up.article
        node.article |= up.article  # from here on: whether it lies in an article
        outer = node.hub is not None and node.hub.odds < 0
        page = node.size >= MOST * total or node.holds
        if page or node.titled or outer:
            node.around_name = 0.0
        head = node.tag == "header" and not inside and not node.holds and not node.titled
        around = node.around and not (page and node.tag not in AROUND_TAGS) or node.form and not page and not node.titled or head
        opens = node.tag in ARTICLE_TAGS or node.article and not inside
        if not outer and (around or opens and not inside and not node.around_name):
            node.odds, node.hub = -MARKED if around else MARKED, node
        node.around_name = max(node.around_name, up.around_name)
        node.article_name = (node.article_name or up.article_name) and not node.around_name


def holder(node: Node) -> Node:
    """The box a block stands in: its parent, or what a list or a table in it stands in."""
    up = node.parent or node
    while up.tag in LISTED and up.parent is not None:
        up = up.parent
    return up


def features(found: list[Block]) -> np.ndarray:
    """(blocks, features), in the order of FEATURES."""
    n = len(found)
    size = np.array([b.size for b in found], float)
    long = np.log1p(size) - 3
    link = np.minimum(1.0, np.array([b.linked for b in found]) / size)
    tag = [b.node.tag for b in found]
    heading = np.array([b.heading for b in found])
    stop = np.array([b.text[-1] in ".!?:;\"'”’»…。！？" for b in found])
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = 1, long, link, heading
    out[:, 4], out[:, 5] = [t in ("li", "dt", "dd") for t in tag], [t in ("td", "th") for t in tag]
    out[:, 6] = ~stop & ~heading
    out[1:, 7], out[1:, 8], out[:-1, 9], out[:-1, 10] = long[:-1], link[:-1], long[1:], link[1:]
    # Unlinked text of the block's parent, as a part of the most that a parent has.
    plain: dict[int, float] = {}
    box = [id(holder(b.node)) for b in found]
    for k, s, x in zip(box, size, link):
        plain[k] = plain.get(k, 0.0) + s * (1 - x)
    most = max(plain.values(), default=0.0)
    out[:, 11] = [plain[k] / most if most > 0 else 1.0 for k in box]
    out[:, 12] = [b.node.around_name for b in found]
    out[:, 13] = [b.node.article_name for b in found]
    inside = np.array([b.node.hub is not None and b.node.hub.odds > 0 for b in found])
    out[:, 14] = ~inside & inside.any()
    return out


def own_odds(found: list[Block], weights=DEFAULT_WEIGHTS) -> np.ndarray:
    x, w = features(found), np.asarray(weights)
    return np.clip(x[:, :OF_TEXT] @ w[:OF_TEXT], -SURE, SURE) + x[:, OF_TEXT:] @ w[OF_TEXT:]


def weak_labels(found: list[Block]) -> np.ndarray:
    """1 in what is marked as article, -1 in what is marked as around one, else 0."""
    return np.array([0 if b.node.hub is None else int(np.sign(b.node.hub.odds)) for b in found])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps, both classes of the same weight, drawn to the default
    weights (ridge a block), which layouts that all look alike would else push too far; the default weights where a class has fewer than 30 blocks."""
    if min((y > 0).sum(), (y < 0).sum()) < 30:
        return np.array(DEFAULT_WEIGHTS)
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y)
    start = np.array(DEFAULT_WEIGHTS)
    w, ridge = start.copy(), ridge * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (each * ((y > 0) - p)) - ridge * (w - start)
        w = w + np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    return w


def learn(pages: DataFrame, page: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights fitted on the labelled blocks of at most `sample` different pages, chosen by hash of their content."""
    total = pages.count()
    share = min(1.0, 2 * sample / max(total, 1))
    some = pages.select(F.xxhash64(page).alias("h"), F.col(page).alias("html")).where(F.expr(f"html is not null and pmod(h, {1 << 31}) < {math.ceil(share * (1 << 31))}"))
    few = some.groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(sample)

    def rows(batches):
        for b in batches:
            got = []
            for t in texts(b, "html"):
                found = blocks(t.decode())
                if found:
                    x, y = features(found), weak_labels(found)
                    at = np.flatnonzero(y)
                    at = at[np.unique(np.linspace(0, len(at) - 1, min(SAMPLE_BLOCKS, len(at))).astype(int))] if len(at) else at
                    got.append(np.c_[y[at], x[at]])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(got)), pa.list_(pa.float64()))], ["row"])

    found = few.mapInArrow(rows, "row array<double>").collect()
    if not found:
        return np.array(DEFAULT_WEIGHTS)
    table = np.array(sorted(r.row for r in found))
    return fit(table[:, 1:], table[:, 0])


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, weight) between blocks."""
    out, last = [], {}
    for j, b in enumerate(found):
        if j:
            a, c, steps = found[j - 1].node, b.node, 0
            while a is not c:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
                steps += 1
            out.append((j - 1, j, NEXT / (1 + steps)))
        box = id(holder(b.node))
        if box in last:
            out.append((last[box], j, SAME))
        last[box] = j
    return out


def graph(found: list[Block], weights=DEFAULT_WEIGHTS) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(odds, edges) of the blocks and, after them, of the marked elements they lie in."""
    odds, edges = own_odds(found, weights).tolist(), ties(found)
    at: dict[int, int] = {}

    def place(hub: Node) -> int:
        if id(hub) not in at:
            at[id(hub)] = len(odds)
            odds.append(hub.odds)
            outer = hub.parent.hub if hub.parent is not None else None
            if outer is not None:
                edges.append((at[id(hub)], place(outer), NESTED))
        return at[id(hub)]

    for i, b in enumerate(found):
        if (hub := b.node.hub) is not None:
            edges.append((i, place(hub), INSIDE))
    return odds, edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: max(0, -odds) for True, max(0, odds) for False, the weight for an edge cut.

    Nodes whose own cost outweighs all their ties are settled first, which no
    minimum cut contradicts; maximum flow (Dinic) decides the others.
    """
    n = len(odds)
    pull, near = list(odds), [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    label: list[bool | None] = [None] * n
    force = [sum(w for _, w in x) for x in near]
    todo = [i for i in range(n) if abs(pull[i]) > force[i]]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                force[j] -= w
                if abs(pull[j]) > force[j] + 1e-12:
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        at = {i: k for k, i in enumerate(left)}
        for i, side in zip(left, _flow([pull[i] for i in left], [(at[i], at[j], w) for i, j, w in edges if i in at and j in at])):
            label[i] = side
    return [bool(x) for x in label]


def _flow(pull: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    n = len(pull)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(pull):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for i, j, w in edges:
        edge(i, j, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(head[a]):
                e = head[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def content_of(found: list[Block], weights=DEFAULT_WEIGHTS) -> list[bool]:
    """Whether each block is content. A page that says something has an article: where the cut leaves
    none, the costs of what nothing marks as around it are judged against the best of them."""
    odds, edges = graph(found, weights)
    label = minimum_cut(odds, edges)[: len(found)]
    if any(label):
        return label
    x = features(found)
    open_ = [i for i, b in enumerate(found) if (b.node.hub is None or b.node.hub.odds > 0) and not b.node.around_name and x[i, 2] < 0.5]
    if not open_:
        return label
    raised = 1 - max(odds[i] for i in open_)
    for i in open_:
        odds[i] += raised
    return minimum_cut(odds, edges)[: len(found)]


def main_text(page: str, weights=DEFAULT_WEIGHTS) -> str:
    """Content blocks joined by an empty line; empty if there are none."""
    found = blocks(page)
    return "\n\n".join(b.text for b, c in zip(found, content_of(found, weights)) if c) if found else ""


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None, weights=None) -> DataFrame:
    """pages with text and n_chars (code points). Null and empty pages, and pages without content, give an empty text.
    Rows are independent but for the weights, fitted on some of these pages where none are given; input columns named
    like a result are replaced."""
    weights = np.asarray(learn(pages, page) if weights is None else weights)

    def make():
        def fn(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [main_text(t.decode(), weights) for t in texts(batch, page)]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return fn

    return append_columns(pages, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op9_html_extraction."""
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", F.col("html")), keep=["page_id", "url"])
