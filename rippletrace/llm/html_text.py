"""Main-text extraction by tree scoring.

A page becomes a light tree of elements. Every paragraph-like block earns points for its
length and commas and passes them to its ancestors, halved at each level; a container's
points are discounted by its link density and by what its tag and names say. The best
container and those of its siblings that score alike are kept, and inside them the
blocks that are navigation, notices, adverts, forms, comments or mostly links go.

A name or a form alone does not condemn what holds the page's text: such an element is
pardoned if it has most of the page's points and the main heading, or if little is left
without it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import chunked, session

# Element names of the HTML standard by the role they have here.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROP = {
    "nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas",
    "object", "audio", "video", "figure", "head", "fieldset", "input", "map",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "figcaption", "dt", "dd"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in class, id and role that mark an element as not the article, also as part of a longer name ...
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|popup|modal|"
    r"newsletter|subscri\w*|signup|sidebar\w*|widget\w*|related|recommend\w*|sharing|"
    r"social|nav\w*|menu\w*|breadcrumb\w*|pager|pagination|header|masthead|topbar|footer|"
    r"comment\w*|disqus|login|toolbar|paywall|contentinfo|navigation|(?:post|entry|article)[_-]meta)(?:$|[\s_-])",
    re.I,
)
# ... and words of many meanings, which only count as the whole name of a container that has no good name.
VAGUE_WORDS = re.compile(
    r"(?:^|\s)(?:notice\w*|overlay|side|rail|teaser\w*|share|foot|copyright|legal|respond|replies|reply|reactions|discussion|"
    r"form|search|hidden|skip|meta|byline|tags|disclaimer|alert|warning|complementary|dialog)(?:$|\s)",
    re.I,
)
CONTAINER = {"div", "section", "ul", "ol", "dl", "table", "center", "details", "search"}
GOOD_WORDS = re.compile(
    r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry|hentry|main|page|post\w*|text|story|blog)(?:$|[\s_-])", re.I
)
# a quote opens a value only after an equals sign; possessive, so that nothing is ever read twice
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+(?:\"|$)|=\s*+'[^']*+(?:'|$)|=)*+)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
SPACE = re.compile(r"\s+")
#: Kinds of bad elements: by a name or as a form, which can be pardoned, and by tag or hidden.
SOFT, HARD = 1, 2
CHUNK = 4 << 20
#: Less than this share of a page's points is little; so many points can be a page's text without a main heading.
LITTLE, ENOUGH = 0.1, 5.0


class Node:
    """An element, what its place in the tree says (kept at its making, so that no text walks up), and sums over its subtree."""

    __slots__ = (
        "bad", "chars", "children", "depth", "heading", "lead", "link", "linked", "lost", "names", "number", "own", "owner", "parent",
        "points", "story", "suspect", "tag", "worst",
    )

    def __init__(self, tag: str, names: str, parent: Node | None, bad: int, number: int = 0) -> None:
        self.tag, self.names, self.parent, self.bad, self.number = tag, names, parent, bad, number
        self.children: list[Node] = []
        self.own = self.points = 0.0
        self.chars = self.link = 0
        block = tag in BLOCK or parent is None
        self.depth: int = 0 if parent is None else parent.depth + 1
        self.owner: Node = self if block else parent.owner  # the nearest block
        self.worst: int = max(bad, parent.worst) if parent else bad
        self.suspect: Node | None = self if bad else parent.suspect if parent else None  # the nearest bad element
        self.lost: bool = bool(parent and parent.lost) or bool(bad and not block)  # inside a bad inline element
        self.linked: bool = tag == "a" or bool(parent and parent.linked)
        self.heading: bool = tag in HEADING or bool(parent and parent.heading)
        self.story: bool = tag in {"article", "main"} or bool(parent and parent.story)
        self.lead: int = self.depth if tag in {"h1", "main"} else parent.lead if parent else -1  # depth of the main heading


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def weight(text: str, links: int, heading: bool) -> float:
    """Points of a text block."""
    points = 0.0 if heading else 1 + text.count(",") + min(len(text) / 100, 3)
    return points * (1 - min(1.0, links / len(text)))


class Doubt:
    """Points of the texts that soft elements took, in all and by element, and the elements with a main heading."""

    def __init__(self) -> None:
        self.total = 0.0
        self.points: dict[int, float] = {}
        self.headed: set[int] = set()

    def add(self, top: Node, points: float) -> None:
        self.total += points
        e = top.suspect
        while e is not None:
            self.points[e.number] = self.points.get(e.number, 0.0) + points
            if top.lead >= e.depth:
                self.headed.add(e.number)
            e = e.parent.suspect if e.parent else None

    def pardoned(self, clean: float) -> set[int]:
        """Numbers of the elements to take back next, outermost first, given the points of what is left without any."""
        whole = clean + self.total
        little = clean < LITTLE * whole
        most = {
            k
            for k, p in self.points.items()
            if p > whole / 2 and (k in self.headed or (little and p >= ENOUGH))
        }
        if most:
            top = max(self.points[k] for k in most)
            return {k for k in most if self.points[k] == top}
        return set(self.points) if little and whole >= ENOUGH else set()


def parsed(page: str, pardoned: set[int] | frozenset[int] = frozenset()) -> tuple[list[Node], list[tuple[Node, str, int, bool]], Doubt]:
    """The elements in page order, the text blocks in page order: (block element, text, characters in links, heading), and what soft elements took."""
    root = Node("#root", "", None, 0)
    doubt, number = Doubt(), 0
    stack, nodes = [root], [root]
    opened: dict[str, int] = {}  # open elements by tag: what is not open is not looked for
    blocks: list[tuple[Node, str, int, bool]] = []
    held: list[str] = []
    linked: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                top = stack[-1]
                links = len(SPACE.sub(" ", "".join(linked)).strip())
                if not top.worst:
                    blocks.append((top.owner, text, links, top.heading))
                elif top.worst == SOFT:
                    doubt.add(top, weight(text, links, top.heading))
            held.clear()
            linked.clear()

    def text_of(part: str) -> None:
        part = html.unescape(part) if "&" in part else part
        top = stack[-1]
        if top.lost:
            lost = SPACE.sub(" ", part).strip()
            if lost and top.worst == SOFT:
                doubt.add(top, weight(lost, len(lost) if top.linked else 0, top.heading))
            return
        held.append(part)
        if top.linked:
            linked.append(part)

    def close_to(index: int) -> None:
        if stack[-1].owner.depth >= index:
            flush()
        for e in stack[index:]:
            opened[e.tag] -= 1
        del stack[index:]

    def close_open(tags: set[str], fence: set[str]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in fence:
                return
            if stack[i].tag in tags:
                close_to(i)
                if not any(opened.get(t) for t in tags):
                    return

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text_of(page[at:])
            break
        if m.start() > at:
            text_of(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text_of(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened.get("p"):
                flush()
            elif tag == "br":
                held.append(" ")
            elif opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close_to(i)
                        break
                    if stack[i].tag in {"td", "th", "table"} and tag not in {"table", "tr", "tbody", "thead", "body", "html", "tfoot"}:
                        break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
                close_open({"p"}, {"table", "td", "th", "button"})
            held.append(" ")
            if linked:
                linked.append(" ")
            continue
        raw = m[3]
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end:
                close = page.find(">", end.start())
                at = close + 1 if close >= 0 else n
            else:
                at = n if tag in {"script", "style", "title", "textarea"} else at
            continue
        if tag in CLOSES_P:
            flush()
            close_open({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSED_BY_SAME:
            close_open(*CLOSED_BY_SAME[tag])
        if tag in BLOCK:
            flush()
        if tag == "a":
            close_open({"a"}, {"table", "td", "th"})
        names, named, bad = "", False, tag in DROP and tag != "form"
        if raw.strip(" /"):
            a = attributes(raw)
            names = " ".join(a.get(k, "") for k in ("class", "id", "role")).strip()
            bad = (
                bad
                or "hidden" in a
                or a.get("aria-hidden", "").lower() == "true"
                or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
            )
            vague = tag in CONTAINER and VAGUE_WORDS.search(names) and not GOOD_WORDS.search(names)
            named = bool(tag not in {"html", "body", "article", "main"} and (vague or BAD_WORDS.search(names)))
        if tag == "header" and stack[-1].story:
            bad = False  # an article's own heading
        if tag == "figure" and not named:
            bad = False
        number += 1
        soft = (named or tag == "form") and number not in pardoned
        node = Node(tag, names, stack[-1], HARD if bad else SOFT if soft else 0, number)
        stack[-1].children.append(node)
        nodes.append(node)
        if not raw.rstrip().endswith("/") or tag in BLOCK or tag == "a":
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return nodes, blocks, doubt


def extract(page: str | None) -> str:
    """Main text of one page; empty for null, empty or text-free pages."""
    if not page:
        return ""
    nodes, blocks, doubt = parsed(page)
    back: set[int] = set()
    while doubt.points:
        more = doubt.pardoned(sum(weight(text, links, heading) for _, text, links, heading in blocks))
        if not more:
            break
        back |= more
        nodes, blocks, doubt = parsed(page, back)
    if not blocks:
        return ""
    root = nodes[0]
    for owner, text, links, heading in blocks:
        owner.own += weight(text, links, heading)
        owner.chars += len(text)
        owner.link += links
    for node in reversed(nodes[1:]):  # children before parents
        node.parent.points += node.own + node.points / 2
        node.parent.chars += node.chars
        node.parent.link += node.link
    root.points += root.own

    def score(node: Node) -> float:
        s = node.points * (1 - min(1.0, node.link / node.chars)) if node.chars else 0.0
        if node.tag in {"article", "main"}:
            s = s * 1.5 + 5
        elif GOOD_WORDS.search(node.names):
            s = s * 1.25 + 2
        return s

    containers, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.chars:
            containers.append(node)
            queue += reversed(node.children)
    best = max((e for e in containers if e.tag != "#root" or len(containers) == 1), key=score, default=root)
    kept = {id(best)}
    bar = max(5.0, 0.25 * score(best))
    for sibling in best.parent.children if best.parent is not None else ():
        if sibling is not best and sibling.chars and not sibling.bad:
            density = sibling.link / sibling.chars
            if score(sibling) >= bar or (sibling.tag == best.tag == "p" and density < 0.25):
                kept.add(id(sibling))
    if best.tag == "p" and best.parent is not None:
        kept.add(id(best.parent))
    inside: dict[int, bool] = {}
    for node in nodes:  # parents before children
        inside[id(node)] = id(node) in kept or (node.parent is not None and inside[id(node.parent)])
    out = []
    for owner, text, links, heading in blocks:
        if not inside[id(owner)]:
            continue
        if links > 0.8 * len(text) and not heading:
            around = owner.parent if owner.tag in {"li", "td"} and owner.parent is not None else owner
            if owner.tag in {"li", "div", "ul", "td", "section"} and around.link > 0.8 * around.chars:
                continue
        out.append(text)
    return "\n\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """Main text of each row: page_id, url, text (empty if none), n_chars (code points).

    Null or empty html gives empty text; repeated rows give repeated rows; an empty table
    gives an empty result. Whole pages are read whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "html", CHUNK):
            found = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    session(pages.sparkSession)
    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
