"""Main text of web pages by tree scoring.

Parts that are no content by their tag, role, class or id are cut first.  Each
paragraph then passes points, for its length and commas, to its ancestors, less
with every level; a container's points are discounted by the share of its text
inside links.  The best container stays, with those siblings that score enough
or are paragraphs of their own.

Defined results: a null or empty html has an empty text; markup that is broken
or never closed is read as far as it goes; of containers of equal score the first
is the best; a long page is read whole, in time in proportion to its length; equal
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.plans.staging import spread

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]++)))?+")
#: Attributes that tell what a part is.
TELLING = frozenset("class id role hidden aria-hidden style".split())

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
NO_CONTENT = frozenset("nav footer aside form button select input label fieldset dialog menu head audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_BESIDE = frozenset("p pre blockquote ul ol dl table figure".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I) for tag in RAW}
# What a start tag closes, up to which ancestors.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Parts of class names and ids of what is no content; of reader comments; what turns them round in front; titles of articles.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored sponsors promo promos promoted promotion outbrain taboola nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars aside widget widgets footer foot header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay subscribe "
    "subscription newsletter signup login signin paywall share sharing social follow related recommended recommendations recommendation pagination pager paging tags search toolbar copyright legal form forms".split()
)
COMMENTS = frozenset("comment comments commentlist commenting respond reply replies disqus discussion".split())
TURNED = frozenset("has with without no not is".split())
TITLED = frozenset("article post entry content story title".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry)(?:$|[\s_-])", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Links and their share of the text from which on a list or a division is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "th": -5.0}


class Node:
    __slots__ = ("tag", "names", "parent", "items", "cut", "score", "length", "linked", "links")

    def __init__(self, tag: str, names: str, parent: Node | None, cut: bool) -> None:
        self.tag, self.names, self.parent, self.cut = tag, names, parent, cut
        self.items: list = []  # strings and nodes
        self.score = 0.0
        self.length = self.linked = self.links = 0


def _attributes(text: str) -> dict[str, str]:
    """The telling attributes of a start tag, of equal ones the first; the others' names and values are passed over whole."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text or ""):
        if (name := m[1].lower()) in TELLING:
            out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def _unlikely(names: str, only_comments: bool) -> bool:
    """Whether a class or an id names no content."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not parts or parts[0] in TURNED:
            continue
        found = COMMENTS.intersection(parts) or not only_comments and UNLIKELY.intersection(parts)
        if found and not (found == {"header"} and TITLED.intersection(parts)):
            return True
    return False


def _is_cut(tag: str, own: dict[str, str], inside_article: bool) -> bool:
    if tag in NO_CONTENT or tag == "header" and not inside_article:
        return True
    if not own or tag in ("body", "html"):
        return False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    names = f"{own.get('class', '')} {own.get('id', '')}"
    return bool(names.strip()) and _unlikely(names, tag in ("article", "main"))


def tree(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its elements in order."""
    root = Node("#root", "", None, False)
    nodes, at, here = [root], 0, root
    opened: Counter[str] = Counter()  # elements from the root to here, by tag

    def leave(to: Node) -> Node:
        """``to``, an ancestor, after closing all below it."""
        node = here
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return to

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            if at < len(html):
                here.items.append(html[at:])
            return root, nodes
        if m.start() > at:
            here.items.append(html[at : m.start()])
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = leave(node.parent)
            elif tag == "br":
                here.items.append(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style", "textarea", "title", "iframe", "noscript"):
                end = _RAW_ENDS[tag].search(html, at)
                at = end.end() if end else len(html)
            continue
        closing, within = CLOSES.get(tag, (frozenset(), frozenset()))
        if tag in BLOCK and (opened["p"] > 0 or any(opened[t] > 0 for t in closing)):
            node = to = here
            left = opened["p"] + sum(opened[t] for t in closing)
            while left and node.tag not in within and (node.tag == "p" or node.tag in closing or node.tag not in BLOCK):
                if node.tag == "p" or node.tag in closing:
                    to, left = node.parent, left - 1
                    if node.tag in closing:
                        break
                node = node.parent
            here = leave(to)
        if tag in VOID:
            here.items.append(Node("hr", "", here, True) if tag == "hr" else " ")
            continue
        own = _attributes(m[3])
        inside = opened["article"] > 0 or opened["main"] > 0
        node = Node(tag, f"{own.get('class', '')} {own.get('id', '')}", here, _is_cut(tag, own, inside))
        here.items.append(node)
        nodes.append(node)
        if not m[3].endswith("/") or tag in BLOCK:
            here = node
            opened[tag] += 1


def _blocks(tops: list[Node]) -> list[str]:
    """The texts of the blocks below ``tops``, in order."""
    out, run = [], []

    def close() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.cut:
                if x.tag in BLOCK:
                    close()
            else:
                block = x.tag in BLOCK
                if block:
                    close()
                    todo.append(None)
                todo.extend(reversed(x.items))
        close()
    return out


def _told(node: Node) -> bool:
    """Whether a part holds a paragraph, list or table, or whole sentences of its own."""
    todo, own = [node], []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            own.append(x)
        elif not x.cut:
            if x.tag in KEPT_BESIDE:
                return True
            todo.extend(x.items)
    return bool(re.search(r"[.!?:][\"')\]]*\s*$", unescape("".join(reversed(own))).strip()))


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by blank lines."""
    if not html:
        return ""
    root, nodes = tree(html)
    inside_cut: set[int] = set()
    live = []
    for n in nodes:  # parents come before children
        if n.cut or n.parent is not None and id(n.parent) in inside_cut:
            inside_cut.add(id(n))
        else:
            live.append(n)
    for n in reversed(live):
        for x in n.items:
            if isinstance(x, str):
                n.length += len(x)
            elif id(x) not in inside_cut:
                n.length += x.length
                n.linked += x.length if x.tag == "a" else x.linked
                n.links += 1 if x.tag == "a" else x.links
        if n.tag in ("ul", "ol", "div", "table") and n.links >= MENU_LINKS and n.linked > MENU_SHARE * n.length:
            n.cut = True
            inside_cut.add(id(n))
    for n in live:
        if n.parent is not None and id(n.parent) in inside_cut:
            inside_cut.add(id(n))
    scored: dict[int, Node] = {}
    for n in live:
        if id(n) in inside_cut:
            continue
        paragraph = n.tag in PARAGRAPHS or n.tag in ("div", "section") and any(isinstance(x, str) and x.strip() for x in n.items)
        if not paragraph or not n.length:
            continue
        commas = sum(x.count(",") for x in n.items if isinstance(x, str))
        points = (1 + commas + min(n.length / 100, 3)) * (1 - n.linked / n.length)
        up = n if n.tag in ("div", "section") else n.parent
        level = 0
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            up, level = up.parent, level + 1
    best, most = root, 0.0
    for n in scored.values():
        n.score += BONUS.get(n.tag, 0) + (25 if LIKELY.search(n.names) else 0)
        n.score *= 1 - n.linked / max(n.length, 1)
        if n.score > most and n.tag not in ("#root", "html", "body"):
            best, most = n, n.score
    if best is root:
        return "\n\n".join(_blocks([root]))
    keep = []
    for x in best.parent.items:
        if x is best:
            keep.append(x)
        elif isinstance(x, Node) and id(x) not in inside_cut and x.length:
            density = x.linked / x.length
            same = 0.2 * most if x.names.strip() and x.names == best.names else 0
            if x.tag in ("div", "section", "article") and density < 0.25 and _told(x):
                keep.append(x)
            elif x.score + same >= max(10, 0.2 * most) or (x.tag in KEPT_BESIDE or x.tag in HEADINGS) and density < 0.25:
                keep.append(x)
    return "\n\n".join(_blocks(keep))


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        out = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([given.schema["page_id"], given.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return spread(given).mapInArrow(_extract, schema)
