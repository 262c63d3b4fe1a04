"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Elements that never hold the article (scripts, navigation,
forms, adverts, comments, ... by tag, role, class or id) are cut off; those named so by class or id
are spared if they hold the main element or most of the prose, and names count for nothing if little
text is left by them. Each block of text passes
points for its length and commas to its ancestors, less the further up; points are scaled by
1 - link density. The best container, widened to an article or main element around it or out of the
table or list that it is part of, is kept with what stands beside it or beside an element around it
and scores near it or reads like prose. Blocks are joined in page order. Time is in proportion to the
page and its depth of inline markup, however deep its blocks are nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

MARKUP = re.compile(
    r"<!--(?:.*?(?:-->|--!>)|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*+)(>|\Z)|<[!?/](?:[^>]*(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Tags that end svg and math without an end tag, unless they stand in a part for foreign markup.
BREAKOUT = re.compile(r"<(?:article|main|section|blockquote|body|center|d[dlt]|div|h[1-6]|li|menu|ol|p|pre|table|ul)(?=[\s/>])", re.I)
FOREIGN = re.compile(r"<(?:foreignobject|desc|annotation-xml|mtext)(?=[\s/>])", re.I)
#: A slash at the end that belongs to an attribute's value.
UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")
SPACES = re.compile("[ \t\n\r\f\v\x85\xa0  -     　]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template plaintext svg math".split())
#: Of these, elements with markup inside: they may close themselves, or go without an end tag.
OPEN = frozenset("noscript template svg math".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: A start tag of the left kind closes an open element of the right kinds, up to the nearest of the last.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: What ends the scope in which a start tag closes an open paragraph.
P_SCOPE = frozenset("html body td th table caption button object article aside section div main nav header footer blockquote li dd".split())

DROP_TAGS = frozenset(
    "script style noscript template head title nav footer aside form button input select textarea iframe object embed svg math canvas"
    " audio video dialog menu label fieldset map".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert".split())
LAYOUT = (
    r"(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer\w*"
    r"|masthead|site-?header|page-?header|top-?bar|sidebar\w*|side|rail|widget\w*|related\w*|recommend\w*|share|sharing|social\w*"
    r"|comments?|comment-?list|commentlist|respond|replies|disqus\w*|discussion|newsletter|subscri\w*|signup|sign-?up|login"
    r"|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|disclaimer|legal|copyright|skip\w*|hidden|toolbar|tags?|tagcloud|outbrain|taboola)"
    r"(?=$|[\s_-])"
)
#: Words that name parts of an article as well: inside one they name no layout.
OF_ARTICLES = re.compile(
    r"(?:^|(?<=[\s_-]))(?:related-?work\w*|side|respond|replies|discussions?|legal|tags?|alert(?!s?(?:$|[\s_-]))\w*|disclaimer|skip\w*|rail)(?=$|[\s_-])", re.I
)
UNLIKELY = re.compile(r"(?:^|[\s_-])" + LAYOUT, re.I)
#: As a whole class name or the head of one, such a word names the element; elsewhere it may only describe it.
NAMED = re.compile(r"(?:^|\s)(?!side-by|legal-)" + LAYOUT, re.I)
#: A text of under TINY characters gives way to one without the filter of names that is LONGER times as long.
TINY, LONGER = 140, 5
HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
POINTS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0}


NOTHING: list[float] = []


class Node:
    __slots__ = ("tag", "parent", "attrs", "start", "points", "passed", "chars", "linked", "drop", "name", "holds", "block", "inside", "scored", "kept")

    def __init__(self, tag: str, parent: Node | None, attrs: str, start: int = 0):
        self.tag, self.parent, self.attrs, self.start = tag, parent, attrs, start
        #: Points, and those of blocks 0, 1, 2, 3 and more levels below, before they are shared out.
        self.points, self.passed = 0.0, NOTHING
        self.chars, self.linked, self.scored, self.kept = 0, 0, False, False
        #: The nearest block element, and whether an article or main element is around.
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.inside = bool(parent and (parent.inside or parent.tag in ("article", "main")))
        #: The class and id, if they name it as no part of the article, and which of article and main it holds.
        self.name, self.holds = "", set()
        self.drop = bool(parent and parent.drop) or self._unwanted()
        if not self.drop and tag in ("article", "main"):
            for node in self.above():
                if tag in node.holds:
                    break
                node.holds.add(tag)

    def _unwanted(self) -> bool:
        if self.tag in DROP_TAGS:
            return True
        if not self.attrs or self.tag in ("html", "body", "article", "main"):
            return False
        found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(self.attrs)}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in DROP_ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return True
        names = " ".join([found.get("class", ""), found.get("id", "")])
        # an element named header outside of articles heads the page
        heads = self.tag != "header" and HEADER.search(names) and not self.inside
        if self.inside:
            names = OF_ARTICLES.sub("", names)
        if names.strip() and (UNLIKELY.search(names) or heads):
            self.name = names
        return False

    def outside(self) -> bool:
        """A header that heads the page, not an article."""
        return self.tag == "header" and not any(a.tag in ("article", "main", "section") for a in self.above())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


Blocks = list[tuple[Node, str, int]]


def end_of_raw(page: str, tag: str, at: int, limit: int) -> re.Match | None:
    """The end tag of an element whose content isn't read; svg and math may hold their like."""
    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
    if tag not in ("svg", "math"):
        return end.search(page, at, limit)
    depth, found = 1, None
    for m in re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)([^>]*)(?:>|\Z)", re.I).finditer(page, at, limit):
        if m.group(1):
            depth, found = depth - 1, m
            if not depth:
                break
        elif not m.group(2).endswith("/"):
            depth += 1
    return found


def parse(page: str, spared: set[int] | None = None) -> tuple[Blocks, list[Node], list[Node]]:
    """(element, text, characters in links) of every block outside dropped elements, in order; the named elements; all.

    Named elements are dropped but for those that start at ``spared``; without it, all are kept.
    """
    root = Node("#root", None, "")
    named: list[Node] = []
    nodes = [root]
    stack, blocks = [root], []
    open_: Counter = Counter()
    parts: list[str] = []
    owner, linked, links = root, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACES.sub(" ", "".join(parts)).strip(" ")
            if text:
                blocks.append((owner, text, linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal owner, linked
        node = stack[-1]
        if not raw or node.drop:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            owner = node.block
        parts.append(text)
        if links:
            linked += len(text.strip())

    def close_to(depth: int) -> None:
        """Closes the elements from this depth on."""
        nonlocal links
        for node in stack[depth:]:
            if node.tag in BLOCK:
                flush()
            links -= node.tag == "a"
            open_[node.tag] -= 1
        del stack[depth:]

    def close(kinds, scope) -> bool:
        """Closes the nearest element of these kinds within the scope, if there is one."""
        if not any(open_[k] for k in kinds):
            return False
        for depth in range(len(stack) - 1, 0, -1):
            tag = stack[depth].tag
            if tag in kinds:
                close_to(depth)
                return True
            if tag in scope:
                return False
        return False

    at, closed_in = 0, len(page)
    endless: set[str] = set()
    while True:
        m = MARKUP.search(page, at)
        if not m:
            rest = page[at:]
            # a tag that the page's end cuts off is no text
            add(rest)
            break
        add(page[at : m.start()])
        at = m.end()
        end, name, attrs, last = m.groups()
        if name is None:
            continue
        if not last:
            break
        tag = name.lower()
        if end:
            if open_[tag] and (tag in BLOCK or tag in ("a", "b", "i") or any(n.tag == tag for n in stack[-8:])):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_to(depth)
                        break
                    # an inline end tag doesn't close a block
                    if tag not in BLOCK and stack[depth].tag in BLOCK:
                        break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            if not stack[-1].drop:
                flush()
            close({"p"}, P_SCOPE)
            if tag in HEADINGS:
                close(HEADINGS, P_SCOPE)
        if tag in CLOSES:
            while close(*CLOSES[tag]):
                pass
        if tag == "a" and links:
            close({"a"}, BLOCK)
        if tag in VOID:
            continue
        if tag in ("svg", "math") and attrs.endswith("/") and not UNQUOTED.search(attrs):
            continue
        if tag in RAW:
            out = BREAKOUT.search(page, at) if tag in ("svg", "math") and at < closed_in else None
            if out is None and tag in ("svg", "math"):
                closed_in = min(closed_in, at)
            if out and FOREIGN.search(page, at, out.start()):
                out = None
            stop = None if tag in endless else end_of_raw(page, tag, at, out.start() if out else len(page))
            if out and not stop:
                at = out.start()
            elif stop:
                at = stop.end()
            elif tag in OPEN:
                endless.add(tag)
            else:
                at = len(page)
            continue
        if attrs.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        node = Node(tag, stack[-1], attrs, m.start())
        nodes.append(node)
        if not node.drop and node.outside():
            node.drop = True
        elif not node.drop and node.name:
            named.append(node)
            node.drop = spared is not None and node.start not in spared
        stack.append(node)
        open_[tag] += 1
        links += tag == "a"
    flush()
    return blocks, named, nodes


def weigh(blocks: Blocks, nodes: list[Node]) -> None:
    """Characters, and those in links, of every element with all that it holds."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked


def main_text(page: str) -> str:
    """The article's text; empty if the page has none."""
    blocks, named, nodes = parse(page)
    weigh(blocks, nodes)
    if not named:
        return best_text(blocks, nodes)
    prose = lambda node: node.chars - node.linked
    total = prose(nodes[0])
    spared = {
        node.start
        for node in named
        if "main" in node.holds or 2 * prose(node) > total and ("article" in node.holds or not NAMED.search(node.name))
    }
    if all(n.tag in BLOCK for n in named):
        # a block element's text is in blocks of its own: they go, and the rest is as it is
        left, rest = without(blocks, nodes, {id(n) for n in named if n.start not in spared})
    else:
        left, _, rest = parse(page, spared)
    weigh(left, rest)
    text = best_text(left, rest)
    if len(text) < TINY:
        blocks, _, nodes = parse(page)
        weigh(blocks, nodes)
        if len(whole := best_text(blocks, nodes)) >= max(1, LONGER * len(text)):
            return whole
    return text


def without(blocks: Blocks, nodes: list[Node], gone: set[int]) -> tuple[Blocks, list[Node]]:
    """The blocks and elements outside the elements in ``gone``, with nothing weighed."""
    for node in nodes:
        node.chars, node.linked = 0, 0
        if id(node) in gone or node.parent is not None and node.parent.drop:
            node.drop = True
    return [b for b in blocks if not b[0].drop], [n for n in nodes if not n.drop]


#: What a block's points are divided by for the element that holds it, and those 1, 2, 3 and more levels above.
SHARES = (1, 2, 6, 9, 12)
#: Parts of tables and lists are not articles by themselves.
PARTS = frozenset("td th tr tbody thead tfoot table caption li ul ol dd dt dl p pre blockquote figure figcaption".split())


def best_text(blocks: Blocks, nodes: list[Node]) -> str:
    """The text of the best container and what belongs to it."""
    if not blocks:
        return ""
    for owner, text, linked in blocks:
        prose = 1.0 + text.count(",") + text.count("،") + text.count("，") + min(len(text) / 100, 3.0)
        holder = owner if owner.tag in POINTS else owner.parent or owner
        if not holder.scored:
            holder.passed = [0.0] * 5
        holder.passed[0] += prose * (1 - min(1.0, linked / len(text)))
        holder.scored = True
    # elements come before what they hold
    for node in reversed(nodes[1:]):
        above = node.parent
        if node.scored:
            if not above.scored:
                above.scored, above.passed = True, [0.0] * 5
            for k in range(4):
                above.passed[k + 1] += node.passed[k]
            above.passed[4] += node.passed[4]
    candidates = [n for n in nodes if n.scored and n.tag not in ("#root", "html")]
    if not candidates:
        return "\n".join(text for _, text, _ in blocks)
    for node in candidates:
        node.points = POINTS.get(node.tag, 0.0) + sum(p / s for p, s in zip(node.passed, SHARES, strict=True))

    def worth(node: Node) -> float:
        return node.points * (1 - node.density())

    best = max(candidates, key=worth)
    least = 0.2 * worth(best)
    while best.tag in PARTS and best.parent is not None and best.parent.tag not in ("#root", "html"):
        best = best.parent
    for node in (best, *best.above()):
        if node.tag in ("article", "main") and node.density() < 0.5:
            best = node
            break
    around = {id(n) for n in best.above()} if best.tag not in ("body", "main") else set()
    best.kept = True
    for node in nodes[1:]:
        if node.parent.kept:
            node.kept = True
        elif id(node.parent) in around and node.density() < 0.25 and id(node) not in around:
            if best.tag == "article":
                node.kept = node.parent is best.parent and node.tag == "article" and worth(node) >= max(10.0, least)
            else:
                node.kept = node.scored and worth(node) >= least or node.tag in PARTS - {"p"}
    kept = []
    for owner, text, linked in blocks:
        beside = best.tag not in ("article", "main", "body") and (id(owner.parent) in around or id(owner) in around)
        if owner.kept or beside and _like_prose(owner, text, linked):
            kept.append(text)
    return "\n".join(kept)


def _like_prose(owner: Node, text: str, linked: int) -> bool:
    """A paragraph or heading beside the best container, or text that stands bare around it."""
    if owner.tag in HEADINGS:
        return linked < 0.3 * len(text)
    return len(text) > 80 and linked < 0.25 * len(text) or linked == 0 and bool(re.search(r"[.!?]$", text))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages; null and empty pages give empty texts.

    Rows that repeat a page, and rows with a null page_id, stay; columns beside these are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [main_text(x) for x in texts(batch.column("html"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
