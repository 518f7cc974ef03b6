"""Main text of HTML pages by minimum cut.

A page is cut into text blocks. Each block has a cost for being called boilerplate and one
for being called content (from the tags, classes, links, length and punctuation around it);
neighbouring blocks and blocks under one parent pay for being called differently. The
labelling of least total cost is a minimum cut, found by blocking flows over level graphs.
A list or table is a node of its own, with the cost of all its text and strong edges to its
items, so the cut decides them together. What an element's class, id or role says is evidence
of bounded weight; it is excused where the element holds an article of its own, or where the
page has no other prose.

Defined cases: null, empty and blank html give an empty text; text without tags is one
block; if nothing is content, what is neither marked nor mostly links is; unclosed, stray and cut-off tags and comments are tolerated; pages are rows of
their own, so repeated rows repeat; null ids and urls are kept; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape

from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import map_rows

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is text of its own kind even if they are never closed; others without an end are passed over.
SWALLOWS = frozenset("script style textarea title".split())
OPENS = BLOCK - {"p"}
CLOSES_P = BLOCK - {"option", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Costs (content is negative, boilerplate positive) of a block under such an element.
UNDER = {"nav": 8.0, "footer": 8.0, "aside": 7.0, "menu": 8.0, "dialog": 7.0, "button": 7.0, "select": 8.0, "header": 5.0, "article": -3.0, "main": -2.5}
#: Words of a class, id or role that mark boilerplate, and content.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments respond disqus cookie cookies consent footer header masthead menu nav navbar navigation navigationmenu notice alert popup modal promo promotion promoted related recommended share sharing sidebar side social sponsor sponsored subscribe newsletter signup login search toolbar widget widgets pagination pager copyright legal disclaimer complementary contentinfo".split())
#: Marks that an id inside an article means, words that say nothing beside a mark, and first words that turn it around.
SURE = frozenset("comment comments respond disqus sidebar share sharing related".split())
BESIDE = frozenset("site page main top bottom left right inner outer box list area block section wrapper wrap container global primary secondary thread".split())
TURNED = frozenset("no not non has with without hide is show".split())
#: Costs of an element, and all below it, whose name is a mark, and of one whose name has a mark among other words.
MARKED, HINTED = 5.0, 2.5
GOOD = frozenset("article content entry post story main body text".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
#: Attributes in order: a name, and a value in either kind of quotes or bare.
ATTRIBUTE = re.compile(r"([^\s/=\"'>][^\s/=>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Words from which a block counts as prose, and the share of the page's prose from which an element's name counts less.
PROSE, MOSTLY = 15, 0.7
SPLIT = re.compile(r"[^a-z]+")
#: Elements that hold items, and the items that share their cost; the weight of an edge between them.
HOLDERS = frozenset("ul ol dl table".split())
ITEMS = frozenset("li dt dd td th tr caption tbody thead tfoot".split())
TOGETHER = 4.0


def mark(value: str, sure: bool) -> float:
    """Cost of the names in a class, id or role; only marks in SURE count fully unless sure."""
    most = 0.0
    for name in value.split():
        words = [w for w in SPLIT.split(name) if w]
        if words and words[0] not in TURNED and not MARKS.isdisjoint(words):
            whole = all(w in MARKS or w in BESIDE for w in words) and (sure or not SURE.isdisjoint(words))
            most = max(most, MARKED if whole else HINTED)
    return most


class Node:
    __slots__ = ("tag", "parent", "cost", "own", "marked", "skip", "prose", "good", "articles")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.prose, self.marked, self.articles = tag, parent, 0, 0.0, 0
        self.good = tag in ("article", "main", "h1")
        self.skip = bool(parent and parent.skip)
        own, marked = UNDER.get(tag, 0.0), MARKED if tag == "form" else 0.0
        if tag == "header" and parent and parent.cost < 0:
            own = 0.0  # an article's own header holds its title
        if attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values).lower()
                if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "") or name == "aria-hidden" and value == "true":
                    self.skip = True
                elif name in ("class", "id", "role"):
                    if tag not in ("body", "html") and not (name == "id" and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6")):
                        marked = max(marked, mark(value, name != "id" or not parent or parent.cost >= -2))
                    if not GOOD.isdisjoint(SPLIT.split(value)):
                        self.good = True
                        own = own or -1.5
        self.own = marked
        before = parent.cost if parent else 0.0
        self.cost = max(before, own) if before > 3 or own > 3 else before + own


def weigh(nodes: list[Node]) -> None:
    """Set `marked` of every element (parents come first): the largest of its own mark and those of what it stands in.

    A mark is excused the more of the page's prose is under the element, but only if the element holds one article (a
    heading of the first level, or an unmarked element called so) or if no other prose of the page is unmarked.
    """
    free = nodes[0].prose
    for node in nodes[1:]:  # prose is an element's own yet, and `marked` only whether anything around is marked
        node.marked = max(node.own, node.parent.marked)
        free += 0 if node.marked or node.cost > 3 else node.prose
    for node in reversed(nodes[1:]):
        node.parent.prose += node.prose
        # one within the other are the same article
        node.parent.articles += 1 if node.good and not node.own else node.articles
    total = max(1, nodes[0].prose)
    for node in nodes[1:]:
        above = node.parent.marked
        excused = node.articles == 1 or free < PROSE
        own = node.own * min(1.0, (1 - node.prose / total) / (1 - MOSTLY)) if excused else node.own
        if node.tag in ("article", "main"):  # what it stands in does not make it boilerplate, unless it is marked too (a comment)
            node.marked = above if node.own else 0.0
        else:
            node.marked = max(own, above)


def end_of(html: str, tag: str, at: int) -> int:
    """Where the element that opens before `at` is over, elements of its kind inside it included; -1 if it never ends."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/>") or tag in SWALLOWS else 1
        if depth == 0:
            return m.end()
    return -1


def blocks(html: str) -> list[tuple[str, Node, int]]:
    """Text blocks in page order: text, element, characters inside links."""
    node = Node("", None, "")
    nodes, open_, endless = [node], Counter(), set()
    out: list[tuple[str, Node, int]] = []
    text: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined and not node.skip:
            out.append((joined, node, links))
            n = joined.count(" ") + 1
            if n >= PROSE and 2 * links < len(joined):
                node.prose += n
        text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            plain = unescape(raw) if "&" in raw else raw
            text.append(plain)
            if in_link:
                links += len(plain.strip())

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if open_[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                flush()
                leave(up.parent)
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = -1 if tag in endless else end_of(html, tag, at)
            if end >= 0:
                at = end
            elif tag in SWALLOWS:
                at = n
            else:
                endless.add(tag)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link += 1
        elif tag in BLOCK or tag == "button":
            flush()
            if tag in CLOSES_P and open_["p"]:
                up = node
                while up.tag not in OPENS and up.tag != "p" and up.parent:
                    up = up.parent
                if up.tag == "p":
                    leave(up.parent)
            if tag in ENDS:
                closes, scope = ENDS[tag]
                up = node
                while up.parent and up.tag not in closes and up.tag not in scope:
                    up = up.parent
                while up.tag in closes:
                    leave(up.parent)
                    up = node
            if tag not in VOID:
                node = Node(tag, node, m[3])
                nodes.append(node)
                open_[tag] += 1
    if at < n:
        add(html[at:])
    flush()
    weigh(nodes)
    return out


def cost(text: str, node: Node, links: int) -> float:
    """Log-odds that a block is boilerplate."""
    words, size = text.count(" ") + 1, max(1, len(text))
    if node.cost > 3:
        return node.cost
    z = 0.6 + node.cost + node.marked
    if 0 < node.marked <= HINTED:  # long prose outweighs a hint
        z -= min(2.0, max(0, words - 30) / 50)
    z += 3.0 * min(1.0, links / size) - min(2.5, words / 12)
    z -= 0.8 if text[-1] in ".!?\"'”»" else 0.0
    z -= {"p": 0.8, "h1": 2.0, "h2": 1.0, "h3": 0.8, "blockquote": 0.8, "pre": 0.8}.get(node.tag, 0.0)
    return z


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels of least cost: boilerplate costs, and edges that cost their weight if their ends differ.

    Blocking flows over level graphs, from all content blocks at once. As little flow fits
    through an edge, it is absorbed near by, so levels stay few whatever the page's length.
    """
    n, unit = len(costs), 1 << 20
    give, take = [max(0, round(-c * unit)) for c in costs], [max(0, round(c * unit)) for c in costs]
    near: list[list[int]] = [[] for _ in costs]
    to: list[int] = []
    room: list[int] = []  # of an arc; its reverse is the arc with the last bit turned
    for a, b, w in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += (b, a)
        room += (round(w * unit), round(w * unit))
    while True:
        sources = [i for i in range(n) if give[i]]
        level, line, depth = [-1] * n, sources, 0
        for i in line:
            level[i] = 0
        while line and not any(take[u] for u in line):
            depth, ahead = depth + 1, []
            for u in line:
                for e in near[u]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = depth
                        ahead.append(to[e])
            line = ahead
        if not line:
            return [x >= 0 for x in level]  # what the content side still reaches is content
        tried = [0] * n
        for start in sources:
            path: list[int] = []
            u = start
            while give[start]:
                if take[u]:
                    flow = min(give[start], take[u], *[room[e] for e in path])
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    give[start] -= flow
                    take[u] -= flow
                    path, u = [], start
                    continue
                while tried[u] < len(near[u]):
                    e = near[u][tried[u]]
                    if room[e] and level[to[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                    continue
                path.append(e)
                u = to[e]


def holder_of(node: Node) -> Node | None:
    """The list or table of an item whose text stands in it directly."""
    while node.tag in ITEMS:
        node = node.parent
        if node.tag in HOLDERS:
            return node
    return None


def label(found: list[tuple[str, Node, int]]) -> list[bool]:
    holders = [holder_of(node) for _, node, _ in found]
    costs, places, said = [], {}, {}
    for (text, node, links), held in zip(found, holders, strict=True):
        c = cost(text, node, links)
        if held is not None:
            # what an item says of itself counts only if it is marked; the rest goes to its list
            c = c if node.cost > 3 or node.marked > held.marked else 0.0
            told = said.setdefault(id(held), [held, 0, 0, 0])
            told[1:] = told[1] + text.count(" ") + 1, told[2] + len(text), told[3] + links
        costs.append(c)
    for key, (held, words, size, links) in said.items():
        places[key] = len(costs)
        z = 0.6 + held.cost + held.marked + 3.0 * min(1.0, links / size) - min(2.5, words / 12)
        costs.append(held.cost if held.cost > 3 else z)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, (_, node, _) in enumerate(found):
        held = holders[i]
        if held is not None:
            edges.append((i, places[id(held)], TOGETHER))
        if i:
            before = found[i - 1][1]
            apart = abs(before.cost + before.marked - node.cost - node.marked)
            edges.append((i - 1, i, 1.2 if before.parent is node.parent else 0.6 if apart < 3 else 0.2))
            # a list and the block before or behind it under the same parent
            for j, other, beside in ((i - 1, holders[i - 1], node), (i, held, before)):
                if other is not None and other.parent is beside.parent:
                    edges.append((places[id(other)], i if j < i else i - 1, 1.2))
        key = id(node.parent)
        if key in last and last[key] != i - 1:
            edges.append((last[key], i, 0.6))
        last[key] = i
    kept = minimum_cut(costs, edges)[: len(found)]
    return kept if any(kept) else [node.cost <= 3 and not node.marked and 2 * links < len(text) for text, node, links in found]


def main_text(html: str | None) -> str:
    found = blocks(html) if html else []
    return " ".join(text for (text, _, _), keep in zip(found, label(found), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (code points)."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def make() -> Callable:
        def step(cols: dict) -> dict:
            texts = [main_text(h) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_rows(rows, make, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
