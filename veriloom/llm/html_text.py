"""Main text of web pages by composite text density.

A page becomes a DOM tree. Every node has its characters C, tags T, link characters LC and link tags LT, and from
them a composite density: characters per tag times a logarithm whose base grows with the text in links, so that text
that is all links has density 0. The node
whose children's densities have the largest sum holds the article; the least density on its path up to the body is
the threshold that a part outside it must reach to belong to the article as well.

Elements that are by their tag, role or class no article (menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, styles, comments) are left out before densities are computed. A part that the page marks as
article or main only sets the borders of what density has found: it is taken where the densest node lies in it, or
where it holds most of that node's text; other marked parts join it by the threshold.

Defined cases: null or empty html gives the empty text; unclosed, misnested and stray tags are repaired; markup cut
off at the end is dropped; repeated rows are extracted each; an empty table gives no rows; only page_id, url and
html are read. Parsing takes time linear in the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPLIT = re.compile(r"[\s_\-]+")

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe object embed svg button select textarea menu dialog title canvas audio video".split())
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer comment comments disqus respond replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended widget toolbar pagination pager login alert disclaimer".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "strict", "held", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.kids = tag, parent, [], []
        self.noise = self.strict = self.held = False
        if parent is not None:
            self.held = parent.held or parent.tag in ("article", "main")
            parent.parts.append(self)
            parent.kids.append(self)


class Open:
    """The open elements, with the places of each tag among them, so that no rule searches the stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.others = [root], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)
            if node.tag != "p":
                self.others.append(k)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            gone = len(self.stack) - 1
            self.at[self.stack.pop().tag].pop()
            for some in (self.blocks, self.others):
                if some and some[-1] == gone:
                    some.pop()

    def last(self, tag: str) -> int:
        return (self.at.get(tag) or [0])[-1]

    def close(self, tag: str) -> None:
        """An end tag: the last open element of its name, which an inline one seeks within its block only."""
        if (k := self.last(tag)) and (tag in BLOCK or tag in CLOSES or not self.blocks or self.blocks[-1] <= k):
            self.pop_to(k)

    def imply(self, tag: str) -> None:
        """What a start tag ends: a paragraph before a block, items and cells before their like in one list or table."""
        if tag in BLOCK and (k := self.last("p")) and (not self.others or self.others[-1] < k):
            self.pop_to(k)
        if tag in CLOSES:
            scope = max(self.last(x) for x in SCOPE[tag])
            ended = [places[n] for x in CLOSES[tag] if (places := self.at.get(x)) and (n := bisect_right(places, scope)) < len(places)]
            if ended:
                self.pop_to(min(ended))


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents before their children."""
    root = Node("html", None)
    nodes, opened, last = [root], Open(root), 0
    scan, n = TOKEN.search, len(page)
    while m := scan(page, last):
        if m.start() > last:
            opened.stack[-1].parts.append(page[last : m.start()])
        last = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, rest = name.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            opened.close(tag)
            continue
        if tag in ("html", "body"):
            if tag == "html" or opened.last("body"):
                continue
            opened.pop_to(1)
        opened.imply(tag)
        node = Node(tag, opened.stack[-1])
        nodes.append(node)
        judge(node, rest)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, last)
            last = end.end() if end else n
        elif tag not in VOID and not (rest.endswith("/") and tag not in BLOCK and tag in ("path", "g", "use")):
            opened.push(node)
    if last < n:
        opened.stack[-1].parts.append(page[last:])
    return root, nodes


def judge(node: Node, rest: str) -> None:
    """Marks a node that is no article by its tag (strict) or by its attributes."""
    inside = node.parent
    if node.tag in NOISE_TAGS or inside.strict:
        node.strict = node.noise = True
        return
    words = set()
    if "=" in rest:
        for key, *value in ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(value).lower()
            if key in ("class", "id"):
                words.update(SPLIT.split(value))
            elif key == "role" and value.strip() in NOISE_ROLES or key == "aria-hidden" and value == "true":
                words.add("notice")
    if "hidden" in rest.lower().split():
        words.add("notice")
    if node.tag == "header" or "header" in words:
        node.noise = not node.held
        node.strict = node.noise and node.tag == "header"
    if words & NOISE_WORDS and node.tag not in ("body", "article", "main"):
        node.noise = True
    if node.tag == "article" and words & {"comment", "comments", "reply"}:
        node.noise = True


def spread_noise(nodes: list[Node]) -> None:
    """Noise holds for all that lies below; but a class alone never rules out a part that holds the article.

    The article may be a marked part with no less text than all that no class rules out, or where the first heading
    outside marked parts is.
    """
    marked, ruled, raw, live = set(), set(), {}, 0
    for node in nodes:
        if node.parent in marked or node.tag in ("article", "main") and not node.noise:
            marked.add(node)
        if node.noise or node.parent in ruled:
            ruled.add(node)
        raw[node] = 0 if node.strict else own_chars(node)
        live += 0 if node in ruled else raw[node]
    for node in reversed(nodes):
        if node.parent is not None:
            raw[node.parent] += raw[node]
    marks = [x for x in marked if x.parent not in marked or x.tag in ("article", "main")]
    marks = [x for x in marks if not x.noise and (x not in ruled or raw[x] >= live)]
    marks += [x for x in nodes if x.tag == "h1" and not x.noise and x not in marked][:1]
    holds = set()
    for node in marks:
        while (node := node.parent) is not None and node not in holds:
            holds.add(node)
    for node in nodes:
        if node in holds and not node.strict:
            node.noise = False
        elif node.parent is not None and node.parent.noise:
            node.noise = True


def own_chars(node: Node) -> int:
    return sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag times log(C/LC * T/LT) to the base ln(C/(C - LC) * LC + share * C + e).

    Counts of 0 in a denominator are 1; ``share`` is the body's part of characters in links. Text that is all links
    has density 0; without links the base still exceeds e's logarithm, as LC counts as 1.
    """
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(c / max(1, c - link_chars) * lc + share * c + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base))


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of each subtree, then densities and their sums."""
    for node in nodes:
        node.chars = 0 if node.noise else own_chars(node)
        node.tags = node.link_chars = node.link_tags = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None and not node.noise:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        if node.noise or not node.chars:
            node.density = 0.0
            continue
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(k.density for k in node.kids)


def article(root: Node, nodes: list[Node]) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    body = next((x for x in nodes if x.tag == "body"), root)
    inside = {body}
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
    live = [x for x in nodes if not x.noise and x.chars and x in inside]
    if not live:
        return []
    best = max(live, key=lambda x: (x.total, x.chars))
    if best.total <= 0:
        return [body]
    path = [best, *ancestors(best)]
    path = path[: path.index(body) + 1] if body in path else path
    least = min(x.density for x in path)
    marked = {x for x in live if x.tag in ("article", "main")}
    if marks := confirmed(best, path, marked, nodes):
        tops = outermost(marked - set(path), nodes)
        return outermost({*marks, *(x for x in tops if x.density >= least)}, nodes)
    chosen, on = {best}, set(path)
    for node in path[1:]:
        chosen.update(k for k in node.kids if k not in on and not k.noise and k.density >= least)
    return [x for x in nodes if x in chosen]


def confirmed(best: Node, path: list[Node], marked: set[Node], nodes: list[Node]) -> list[Node]:
    """Marked parts that density bears out: the least one around the densest node, or those with most of its text."""
    if around := next((x for x in path if x in marked), None):
        return [around]
    below = {best}
    for node in nodes:
        if node.parent in below:
            below.add(node)
    tops = outermost(marked & below, nodes)
    held = sum(x.chars - x.link_chars for x in tops)
    return tops if 2 * held > best.chars - best.link_chars else []


def outermost(some: set[Node], nodes: list[Node]) -> list[Node]:
    """Those that lie in no other one, in page order."""
    inside, out = set(), []
    for node in nodes:
        if node.parent in inside:
            inside.add(node)
        elif node in some:
            inside.add(node)
            out.append(node)
    return out


def ancestors(node: Node) -> list[Node]:
    out = []
    while (node := node.parent) is not None:
        out.append(node)
    return out


def render(top: Node) -> list[str]:
    """The subtree's blocks: white space is one space, references are decoded."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(line)).split()):
            blocks.append(text)
        line.clear()

    todo: list = [top]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif not item.noise:
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            elif item.tag in ("br", "td", "th"):
                line.append(" ")
            todo.extend(reversed(item.parts))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page, one line a block."""
    if not page:
        return ""
    root, nodes = parse(page)
    spread_noise(nodes)
    measure(nodes)
    return "\n".join(block for top in article(root, nodes) for block in render(top))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def work(batches):
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
