"""Operator 8: main text of web pages by composite text density.

A page becomes a tree of elements; what carries no article text by its element, role or visibility (menus, headers, footers,
controls, scripts) is left out.  Every node has its characters, tags, link characters and link tags; the composite density is
characters per tag, lowered by the share of links.  What a class or id marks as surroundings (sidebars, notices, adverts, reader
comments), and a form, is left out unless it holds the page's article or main element or, where there is none, the greatest sum
of densities on the page; within an article, unless it holds a third of its text.  The node with the greatest sum of its
children's densities is the core of the article; the article or main element around it is the article, or else the smallest
element that holds the core and all text at or above the least density on the core's path to the body, but for lists of links in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What is no element, or the beginning of a tag.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.DOTALL)
PLAIN = re.compile("[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are part of a text: the article is what holds them.
PARTS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hr center address".split())
#: Elements without article text.
NO_TEXT = frozenset("head script style title nav aside footer button select option textarea input label noscript template svg math canvas iframe object embed audio video map dialog menu fieldset xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what surrounds an article.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer
    gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related respond
    replies search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar tracking widget widgets""".split()
)
#: Words that say nothing beside a mark; beside any other word a mark is part of a name of something else.
GENERIC = frozenset(
    """area bar block body bottom box btn button buttons cell center col column container content footer fixed group head holder inner item items layer left link links list main message messages
    middle outer page panel placeholder post posts primary region right row secondary section side site slot small social sticky strip tag tags text title top unit wrap wrapper zone""".split()
)
#: Beside these, a mark tells of the layout of the element that has it.
BEFORE, AFTER = frozenset("no has with without".split()), frozenset("open closed free enabled disabled".split())
#: Marks of readers' comments.
REPLIES = frozenset("comment comments commentlist disqus replies respond".split())
#: Marks of what is no article, however much it holds.
SURE = REPLIES | frozenset("ad ads advert adverts advertisement advertising adsense consent cookie cookies gdpr newsletter paywall popup promo promoted promotion sponsor sponsored subscribe".split())
#: Within an article, a marked element with a smaller share of its unlinked characters is left out; up to half of them, if its density is low.
SMALL_SHARE = 1 / 3
#: An opening tag of the first kind ends an open element of the second, within the third.
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd tr td th".split())
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "marks", "real", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marks: frozenset[str] = frozenset()):
        self.tag, self.parent, self.dropped, self.marks, self.parts = tag, parent, dropped, marks, []  # parts: texts and nodes in order
        self.real = tag in ("article", "main") or parent is not None and parent.real  # within an article or main element
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marked(tag: str, attributes: str, parent: Node) -> tuple[bool, frozenset[str]]:
    """Whether the element has no article text in any case, and the marks of its class and id."""
    none: frozenset[str] = frozenset()
    if tag in NO_TEXT or tag == "header" and not parent.real:
        return True, none
    marks = {"form"} if tag == "form" else set()
    if not attributes or tag in ("html", "body", "main"):
        return False, frozenset(marks)
    got = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), a or b or c)
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return True, none
    if got.get("role", "").lower() in ROLES:
        return True, none
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{got.get('class', '')} {got.get('id', '')}").lower().split():
        words = re.findall("[a-z]+", name)
        here = {w for a, w, z in zip(["", *words], words, [*words[1:], ""], strict=False) if w in MARKS and a not in BEFORE and z not in AFTER}
        if all(w in MARKS or w in GENERIC or len(w) == 1 for w in words):
            marks |= here
    return False, frozenset(marks)


class Open:
    """The open elements, by depth and by name, so that the nearest of a name is known without a walk."""

    def __init__(self, root: Node):
        self.path, self.depths, self.solid = [root], {root.tag: [0]}, [0]  # solid: depths of elements that are not inline

    def push(self, node: Node) -> None:
        if node.tag not in INLINE:
            self.solid.append(len(self.path))
        self.depths.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Closes the element at that depth and all within it."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            if node.tag not in INLINE:
                self.solid.pop()

    def nearest(self, names) -> int:
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)


def _end_of_tag(page: str, at: int, quotes: bool) -> int:
    """The place of the bracket that ends a tag, not one within quotes; -1 if there is none."""
    while quotes:
        at = PLAIN.match(page, at).end()
        if at == len(page) or page[at] == ">":
            return at if at < len(page) else -1
        to = page.find(page[at], at + 1)
        if to < 0:
            return -1
        at = to + 1
    return page.find(">", at)


def parse(page: str) -> Node:
    """The tree, as lenient as browsers are: unclosed, misnested and unknown elements are taken as they come.

    Linear in the page: open elements are found by name, and once a tag's quotes do not close, quotes are ordinary characters.
    """
    root = Node("#root", None, False)
    held, at, low, quotes = Open(root), 0, None, True
    for_ever = len(page)
    while at < for_ever:
        m = TAG.search(page, at)
        if m is None:
            held.path[-1].parts.append(page[at:])
            break
        if m.start() > at:
            held.path[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        end = _end_of_tag(page, at, quotes)
        if end < 0 and quotes:
            quotes = False
            end = _end_of_tag(page, at, quotes)
        if end < 0:  # no tag ends after this place
            held.path[-1].parts.append(page[m.start() :])
            break
        tag, attributes = m[2].lower(), page[at:end]
        at = end + 1
        if m[1]:  # closes the nearest open element of that name, unless a scope lies between
            up = held.nearest([tag])
            scope = 0 if tag in ("tr", "table", "tbody", "thead", "tfoot", "div", "body", "html", "article", "section", "main") else held.nearest(("td", "th", "table"))
            if up and (up >= scope):
                held.cut(up)
            continue
        if tag in CLOSES_P and held.path[held.solid[-1]].tag == "p":
            held.cut(held.solid[-1])
        if tag in SAME:
            ends, within = SAME[tag]
            scope = held.nearest(within)
            up = held.nearest(("tr",)) if tag == "tr" else 0
            up = up if up > scope else held.nearest(ends)
            if up > scope:
                held.cut(up)
        here = held.path[-1]
        dropped, marks = _marked(tag, attributes, here)
        node = Node(tag, here, here.dropped or dropped, marks)
        here.parts.append(node)
        if tag in RAW:
            low = low or page.lower()
            to = low.find(f"</{tag}", at) if len(low) == len(page) else re.compile(f"</{tag}", re.I).search(page, at)
            to = to if isinstance(to, int) else (to.start() if to else -1)
            at = for_ever if to < 0 else to  # its closing tag then closes nothing
            if to >= 0:
                end = page.find(">", to)
                at = for_ever if end < 0 else end + 1
        elif tag not in VOID and not (attributes.endswith("/") and tag in INLINE):  # browsers ignore the slash of block elements
            held.push(node)
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes in page order, dropped subtrees left out; without recursion, so depth is no limit."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped)
    return out


def measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        linked = node.tag == "a"
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif not x.dropped:
                node.chars += x.chars
                node.tags += 1 + x.tags
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if linked:
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    top = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = top.link_chars / top.chars if top.chars else 0.0
    for node in nodes:
        if not node.chars:
            continue
        plain, tags = node.chars / max(1, node.tags), max(1, node.tags)
        base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
        ratio = node.chars / max(1, node.link_chars) * tags / max(1, node.link_tags)
        node.density = max(0.0, plain * math.log(max(ratio, 1.0)) / max(base, 1.0)) if ratio > 1 else 0.0
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.dropped)


def drop_marked(root: Node) -> None:
    """Leave out marked elements, but none that holds the article.

    Where the page has an article or main element with text, it is the article: marked elements beside it go whatever they hold, marked
    ones within it by their share.  Elsewhere the greatest sum of densities decides among the unmarked elements together and each
    marked one; marks that are sure never win against unmarked text.
    """
    nodes = _walk(root)
    marked = [n for n in nodes if n.marks]
    if not marked:
        return
    measure(nodes)
    holders: set[int] = set()
    for n in nodes:
        if n.tag in ("article", "main") and n.chars and not n.marks & REPLIES:  # not one reader's comment
            while n is not None and id(n) not in holders:
                holders.add(id(n))
                n = n.parent
    if holders:
        around: dict[int, Node] = {id(root): root}
        for n in nodes:
            if n.parent is not None:
                up = n.parent
                around[id(n)] = up if up.tag in ("article", "main") else around[id(up)]
        for n in marked:
            whole = around[id(n)]
            if whole.tag not in ("article", "main"):
                n.dropped = id(n) not in holders
            elif n.tag in PARTS and not n.marks - REPLIES or id(n) in holders and n.tag != "article":
                continue
            else:
                share = (n.chars - n.link_chars) / max(1, whole.chars - whole.link_chars)
                n.dropped = share < SMALL_SHARE or share <= 0.5 and n.density < whole.density
    else:
        for n in marked:
            n.dropped = True

        def weight(top: Node) -> tuple[float, int]:
            within = _walk(top)
            for n in within:
                n.clear()
            measure(within)
            return max(n.total for n in within), top.chars - top.link_chars

        best, most = None, (True, *weight(root))
        plain = most[2] > 0
        for n in marked:
            now = (not n.marks & SURE, *weight(n))
            if now > most and (now[0] and now[1] > 0 if plain else now[2] > 0):
                best, most = n, now
            elif best is None and not plain and now[2] > 0:
                best, most = n, now
        while best is not None:
            best.dropped, best = False, best.parent
    for n in nodes:
        n.clear()


def article(root: Node) -> Node:
    drop_marked(root)
    nodes = _walk(root)
    measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    within = _walk(body)
    core = max(within, key=lambda n: n.total)  # the first of equals in page order
    ancestors, up = [], core
    while up is not None:
        ancestors.append(up)
        if up is body:
            break
        up = up.parent
    around = [i for i, n in enumerate(ancestors) if n.tag in ("article", "main")]
    if around:
        return ancestors[around[-1]]
    holders = [n for n in within if n.tag in ("article", "main") and n.chars and not n.marks & REPLIES]
    if holders:  # the core is around them: beside an article there is only what surrounds it
        return max(holders, key=lambda n: n.chars - n.link_chars) if len({id(n) for n in holders if not (n.parent and n.parent.real)}) == 1 else core
    # the smallest subtree with the core and every text-bearing node at or above the least density on the core's path
    least = min(n.density for n in [*ancestors, body])
    place, highest, seen = {id(n): i for i, n in enumerate(ancestors)}, 0, set()
    for n in within:
        if n is not body and n.density > 0 and n.density >= least and n.chars and any(isinstance(x, str) and x.strip() for x in n.parts):
            up = n
            while up is not None and id(up) not in place and id(up) not in seen:
                seen.add(id(up))
                up = up.parent
            if up is not None and id(up) in place:
                highest = max(highest, place[id(up)])
    while highest + 1 < len(ancestors) and ancestors[highest].tag in PARTS:
        highest += 1
    for n in ancestors[1 : highest + 1]:  # lists of links between what was joined are menus
        for x in n.parts:
            if isinstance(x, Node) and id(x) not in seen and id(x) not in place and x.tag not in PARTS - {"ul", "ol", "table"} and 2 * x.link_chars > x.chars:
                x.dropped = True
    return ancestors[highest]


def blocks(root: Node) -> list[str]:
    """Texts of the block elements in page order, character references decoded, white space inside each made one space."""
    out, held, stack = [], [], [(root, 0)]

    def cut():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

    while stack:
        node, at = stack.pop()
        if at == 0 and node.tag not in INLINE:
            cut()
        while at < len(node.parts):
            x = node.parts[at]
            at += 1
            if isinstance(x, str):
                held.append(x)
            elif x.tag == "br":
                held.append(" ")
            elif not x.dropped:
                stack.append((node, at))
                stack.append((x, 0))
                break
            elif x.tag not in INLINE:
                cut()
        else:
            if node.tag not in INLINE:
                cut()
    cut()
    return out


def main_text(page: str) -> str:
    return "\n\n".join(blocks(article(parse(page)))) if page else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; text is empty where the page is null, empty or has no article.

    One narrow stage: a null id or url stays null, repeated rows give repeated results, further columns are not read, an empty
    table gives an empty result.  Bytes that are no UTF-8 count as U+FFFD, in the url as in the page.  Time and memory are linear
    in a page, however it is broken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 200):
            found = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), common.valid(F.col(url_col)).alias("url"), common.valid(F.coalesce(F.col(html_col), F.lit(""))).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
