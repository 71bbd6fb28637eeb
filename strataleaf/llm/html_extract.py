"""HTML extraction by composite text density.

A page becomes a tree of elements, without scripts, navigation, footers and form
controls. Each node has a density: characters per tag, adjusted by the share of
its characters and tags that belong to links (Sun et al., 2011). The sum of its
children's densities is a node's score. The subtree of the largest score holds
the main text; the least density on the path from the body to it is the threshold
that neighbours must pass to be joined to it, one level up: subtrees of similar
score, headings and paragraphs. The blocks of these are the result.

Forms and elements that a whole class or id name marks as menus, notices,
adverts, reader comments and the like, or whose heading says that comments
follow, count nothing in this - unless they hold the page's main heading, or the
largest of them holds most of the text that there is, as wrappers do. Elements
called article or main have no privilege.

Defined results: a null, empty or textless page gives an empty string and 0;
broken markup is read as browsers do for unclosed paragraphs, items and cells;
pages of any length are read whole; repeated rows stay repeated; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.frames import slices

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = RAW | frozenset("head nav footer aside button select option input label legend svg math canvas object applet audio video map menu dialog datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An element's opening ends these open ones, unless one of the barriers lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_BARRIERS = frozenset("table td th button object article section div main body li blockquote figure dd".split())
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption dd dt li".split()) | frozenset(["p", "li", "dd", "dt"])
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole class or id names of what does not belong to an article; ones for reader comments apart.
NAMED = re.compile(
    r"(?i)(?:ads?|advert\w*|adsense|ad[_-]\w+|banner|sponsor\w*|promo\w*|cookies?(?:[_-]\w+)*|consent(?:[_-]\w+)*|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|"
    r"(?:main|top|site|side|page)?[_-]?(?:nav|menu|navigation|header|footer|sidebar)|breadcrumbs?|widgets?|masthead|topbar|toolbar|foot|copyright|disqus|"
    r"share|sharing|social(?:[_-]\w+)?|related(?:[_-]\w+)?|recommended|newsletter(?:[_-]\w+)?|subscribe|subscription|signup|login|search(?:[_-]?form)?|pagination|pager|tags|skip-link|skip)"
)
COMMENTS = re.compile(r"(?i)(?:(?:user|reader|post)[_-]?)?(?:comments?|commentlist|comment[_-]\w+|replies|respond)(?:[_-](?:area|list|section|thread|wrapper))?|disqus_thread")
#: A heading that reader comments follow.
COMMENTS_HEADING = re.compile(r"(?i)\W*(?:\d+\s+|reader |user |leave an? |post an? )?(?:comments?|responses?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?)\b\W*(?:\(?\d+\)?\W*)?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Neighbours of the main subtree that belong to it, if dense enough.
FLOW = HEADINGS | frozenset("p blockquote pre figure ul ol dl table hgroup header".split())
#: A marked element is a wrapper if the text outside such elements is less than this share of its own.
OUTSIDE = 0.25
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from behind a tag's name on, as browsers read them; whether it closes itself; the place behind the tag (-1: the page ends in it)."""
    out: dict[str, str] = {}
    n = len(html)
    while True:
        begin = at
        at = _GAP.match(html, at).end()
        if at >= n:
            return out, False, -1
        if html[at] == ">":
            return out, html[at - 1] == "/" and at > begin, at + 1
        m = _KEY.match(html, at)
        key, at, value = m[0].lower(), m.end(), ""
        if (eq := _EQUALS.match(html, at)) is not None:
            at = eq.end()
            if at < n and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return out, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                m = _BARE.match(html, at)
                value, at = m[0], m.end()
        out.setdefault(key, value)


class Node:
    __slots__ = ("block", "chars", "children", "density", "dropped", "link_chars", "link_tags", "mark", "name", "parent", "score", "tags")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False):
        self.name, self.parent, self.dropped = name, parent, dropped
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0
        self.block = name in BLOCKS
        self.mark = ""  # "named" or "comments" where the element says that it is no article


def _unwanted(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element goes whatever it holds."""
    if name in DROPPED:
        return True
    if name == "header" and not in_article:  # a page's header; an article's own may hold its title
        return True
    if name in ("html", "body", "article", "main"):
        return False
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or attributes.get("role", "").lower() in ROLES
        or _HIDDEN.search(attributes.get("style", "")) is not None
    )


def _mark(name: str, attributes: dict[str, str]) -> str:
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if name not in ("html", "body", "main") and name not in FLOW | {"td", "li"}:
        if any(COMMENTS.fullmatch(x) for x in names):
            return "comments"
        if name == "form" or any(NAMED.fullmatch(x) for x in names):
            return "named"
    return ""


def parse(html: str) -> Node:
    """The tree of a page; unwanted elements are marked and keep no text."""
    root = here = Node("html", None)
    at, n = 0, len(html)

    def add(text: str) -> None:
        if text and not here.dropped:
            here.children.append(unescape(text) if "&" in text else text)

    def close(names: frozenset[str], barriers: frozenset[str]) -> None:
        nonlocal here
        up = here
        while up.parent is not None and up.name not in barriers:
            if up.name in names:
                leave(up)
                return
            up = up.parent

    opened: Counter[str] = Counter()

    def leave(node: Node) -> None:
        """Closes the open elements up to this one."""
        nonlocal here
        while here is not node.parent:
            opened[here.name] -= 1
            here = here.parent

    while at < n:
        sign = html.find("<", at)
        if sign < 0:
            add(html[at:])
            break
        add(html[at:sign])
        at = sign + 1
        c = html[at : at + 1]
        if c == "!" or c == "?" or (c == "/" and not html[at + 1 : at + 2].isalpha()):
            if html.startswith("!--", at):
                end, skip = html.find("-->", at + 3), 3
            elif html.startswith("![CDATA[", at):
                end, skip = html.find("]]>", at), 3
                add(html[at + 8 : end] if end >= 0 else html[at + 8 :])
            else:
                end, skip = html.find(">", at), 1
            at = n if end < 0 else end + skip
            continue
        closing = c == "/"
        if not closing and not (c.isascii() and c.isalpha()):
            add("<")
            continue
        m = _NAME.match(html, at + closing)
        name = m[0].lower()
        attributes, alone, at = _attributes(html, m.end())
        if at < 0:
            break
        if closing:
            if opened[name] > 0:
                up = here
                while up.name != name:
                    up = up.parent
                leave(up)
            continue
        if name in ("html", "body"):
            if name == "body" and here is root:
                node = Node(name, root)
                root.children.append(node)
                here = node
            continue
        if name in ENDS_P and opened["p"] > 0:
            close(frozenset(["p"]), P_BARRIERS)
        if name in ENDS and any(opened[x] > 0 for x in ENDS[name][0]):
            close(*ENDS[name])
        dropped = here.dropped or _unwanted(name, attributes, opened["article"] + opened["main"] > 0)
        node = Node(name, here, dropped)
        here.children.append(node)
        if not dropped:
            node.mark = _mark(name, attributes)
        if name in RAW:
            end = re.compile(rf"(?i)</{name}(?=[\s/>])").search(html, at)
            at = n if end is None or html.find(">", end.end()) < 0 else html.find(">", end.end()) + 1
        elif name not in VOID and not alone:
            here = node
            opened[name] += 1
    _judge(root)
    return root


def _text(node: Node, most: int = 200) -> str:
    """The first characters of a subtree."""
    out, stack, n = [], [node], 0
    while stack and n <= most:
        x = stack.pop()
        n += 1
        if isinstance(x, str):
            out.append(x)
            n += len(x)
        elif not x.dropped:
            stack += reversed(x.children)
    return " ".join("".join(out).split())


def _judge(root: Node) -> None:
    """Drops marked elements, and what a heading calls reader comments, but for those that hold the main text."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    for node in order:
        if node.name in HEADINGS and node.name != "h1" and node.parent is not None and not node.mark and COMMENTS_HEADING.fullmatch(_text(node)):
            mine = [c for c in node.parent.children if isinstance(c, Node) or c.strip()]
            if mine[0] is node and node.parent.name not in ("html", "body", "main"):
                node.parent.mark = "comments"
            else:
                for c in mine[mine.index(node) :]:
                    if isinstance(c, Node):
                        c.mark = "comments"
    # Characters outside links: all, and those that no marked element below holds; whether the main heading is inside.
    plain, clear, titled = {}, {}, {}
    for node in reversed(order):
        p = k = 0
        t = node.name in ("h1", "main")
        for c in node.children:
            if isinstance(c, str):
                size = 0 if node.name == "a" else len(c) - c.count(" ") - c.count("\n")
                p, k = p + size, k + size
            elif not c.dropped:
                p, t = p + plain[c], t or titled[c]
                k += 0 if c.mark else clear[c]
        plain[node], clear[node], titled[node] = (0, 0, t) if node.name == "a" else (p, k, t)
    named = [x for x in order if x.mark == "named"]
    largest = max(named, key=lambda x: plain[x], default=None)
    wrappers, up = set(), largest  # what is around the largest stays with it
    while up is not None and clear[root] <= OUTSIDE * plain[largest]:
        wrappers.add(up)
        up = up.parent
    for node in order:
        if node.mark and not titled[node] and (node.mark == "comments" or node not in wrappers):
            node.dropped = True


def measure(root: Node) -> Node:
    """Fills in counts, densities and scores, bottom up; returns the body."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    for node in reversed(order):
        link = node.name == "a"
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ") - c.count("\n")
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.name == "a")
                node.block |= c.block
        if link:
            node.link_chars = node.chars
    body = next((c for c in root.children if isinstance(c, Node) and c.name == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if node.chars:
            tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
            node.density = node.chars / tags * max(0.0, math.log(max(1.0, node.chars / links * tags / link_tags))) / max(0.1, math.log(base))
    for node in order:
        # Inline elements are part of their block's text.
        node.score = sum(c.density for c in node.children if isinstance(c, Node) and not c.dropped and c.block)
    return body


def main_subtree(root: Node) -> Node:
    body = measure(root)
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.score > best.score or node.score == best.score and node is not body and best is body:
            best = node
        stack += [c for c in node.children if isinstance(c, Node) and not c.dropped]
    while best is not body and best.name not in BLOCKS and best.parent is not None:
        best = best.parent
    kept: dict[Node, list[Node]] = {}
    path, up = [], best
    while up is not None and up is not body.parent:
        path.append(up)
        up = up.parent
    thresholds, least = {}, math.inf
    for node in reversed(path):
        thresholds[node] = least = min(least, node.density)
    while best is not body and best.parent is not None:
        threshold = thresholds[best]
        around = [c for c in best.parent.children if isinstance(c, Node) and not c.dropped and c.chars and c is not best]
        near = [c for c in around if c.density >= threshold and (c.score >= best.score / 2 or c.name in FLOW)]
        if not near:
            if len([c for c in around if c.block]) or any(isinstance(c, str) and c.strip() for c in best.parent.children):
                break
        kept[best.parent] = [c for c in around if c.block and c not in near]
        best = best.parent
    for thin in kept.values():  # what did not pass stays out
        for c in thin:
            c.dropped = True
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.name in ("br", "wbr"):
            run.append(" " if x.name == "br" else "")
        elif not x.dropped:
            if x.name in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    return "\n\n".join(blocks(main_subtree(parse(html)))) if html else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
