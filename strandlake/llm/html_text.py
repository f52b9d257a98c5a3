"""HTML extraction by composite text density.

A page becomes a tree of elements with, for each, its characters, link characters,
tags and link tags. An element's composite density is its characters for each tag,
scaled down by the share of its text that stands in links; its density sum is the
sum of its children's densities. From the element with the greatest density sum the
path to the body gives the threshold, the least number of characters outside links
for each tag on it; the composite density itself grows with the size of a block, so
that small blocks would not reach that of the body around them. Each block at or above
the threshold marks the block of greatest density sum within it, and the marked
blocks are the page's content. Densities leave out elements that are no running text
by HTML itself: menus, footers, sidebars, forms, scripts, ...

Two additions, as densities alone lose short blocks and keep long adverts:

- Beside the path from a marked block to the body, blocks are taken too if they are
  text by name (headings, paragraphs, lists, quotes, ...) and not mostly links, if
  they hold a heading, if they end a sentence and share a parent below the body with
  the marked block, or if they stand in the page's ``article`` or ``main``. A
  marked block apart from the densest is content only if it is or holds such text.
- A block with a class or id made of words for adverts, notices, comments and the
  like alone is left out before densities are summed, unless it holds the page's
  first heading, ``main`` or ``article`` (comments can be articles), all its text, or
  the page's greatest density sum although such blocks count ``SUSPECT_PART`` of
  theirs (and no ``article`` or ``main`` stands outside them). The last doesn't save
  adverts and notices about cookies by name, and comments.
  Words for headers and notices don't count inside ``article`` and ``main``. A
  ``header`` outside these is left out unless it alone has the page's ``h1`` and is no
  child of the body.

Defined results: a null or empty page gives the empty string; a page without
markup is its own text; unclosed and stray tags are repaired as browsers do for
paragraphs, list items, table cells and options; blocks of equal density sum go to
the first of the page; repeated rows are judged one by one; an empty table gives an
empty table; columns named as the output's are replaced. A page is held whole, about
a kilobyte for each of its tags, in time linear in its size.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.textblocks import lean
from strandlake.storage import spread

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
ESCAPABLE_RAW = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
LEFT_OUT = frozenset(
    "script style noscript template iframe noembed noframes head title nav footer aside form button select option input "
    "textarea label fieldset menu dialog svg canvas object embed audio video map".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPE = frozenset("ul ol dl table td th select body html article section main div".split())
ENDS_P = BLOCK - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre ul ol dl li dd dt figure figcaption table caption address summary details center".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies".split())
PLACE_WORDS = frozenset("header masthead topbar banner notice notices alert copyright".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer cookie cookies consent popup modal newsletter subscribe subscription signup login share sharing social "
    "related recommended widget widgets toolbar pagination pager skip".split()
)
NEUTRAL_WORDS = frozenset(
    "site page global main post posts list item items box block wrapper wrap container section area bar links link buttons button top bottom "
    "left right primary secondary inner outer content group unit slot thread form text message".split()
)
#: Words that name nothing but adverts and notices about cookies: such blocks stay out, however dense they are.
NEVER_CONTENT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent".split())
#: What a block's density sum counts if its class or id says it is none of the content.
SUSPECT_PART = 0.25
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: A quote delimits a value only right after "=".
_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"</?([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s\"'>][^\s>]*+)?|[^=>])*+)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")
_SENTENCE, _RIGHTS = re.compile(r"\w[.!?…。！？][\"')\]»”]*$"), re.compile(r"(?i)©|\bcopyright\b|all rights reserved")


#: What tells content: the name itself, "heading" or "text" for a block of that kind that is not mostly links.
_TELLING = frozenset("article main h1 heading text".split())


class Node:
    __slots__ = ("name", "parts", "left_out", "suspect", "up", "chars", "link_chars", "tags", "link_tags", "density", "total", "inside")

    def __init__(self, name: str, up: Node | None, left_out: bool = False, suspect: str = ""):
        self.name, self.up, self.left_out, self.suspect = name, up, left_out, suspect
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside: set[str] = set()  # which of _TELLING stand in it


def _by_class(value: str, inside_article: bool) -> str:
    """``comments``, ``advert`` or ``other`` for a class or id with a token made of such words and neutral ones, else nothing."""
    for token in value.split():
        words = set(_WORD.findall(token))
        if words & COMMENT_WORDS and words <= COMMENT_WORDS | NEUTRAL_WORDS | BOILERPLATE_WORDS:
            return "comments"
        if words & NEVER_CONTENT and words <= BOILERPLATE_WORDS | PLACE_WORDS | NEUTRAL_WORDS:
            return "advert"
        known = BOILERPLATE_WORDS if inside_article else BOILERPLATE_WORDS | PLACE_WORDS
        if words & known and words <= known | NEUTRAL_WORDS:
            return "other"
    return ""


def _judged(name: str, attributes: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is no running text by HTML itself, and what its class or id makes it look like."""
    if name in LEFT_OUT:
        return True, ""
    if name == "header" and not inside_article:
        return False, "header"
    if not attributes or name in ("html", "body", "article", "main"):
        return False, ""
    suspect = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True, ""
        if key in ("class", "id") and suspect not in ("comments", "advert"):
            suspect = _by_class(value, inside_article) or suspect
    return False, suspect


def parse(page: str) -> Node:
    """The element tree of a page; the root stands for the document."""
    root = Node("#root", None)
    here, at, end = root, 0, len(page)
    opened: Counter[str] = Counter()  # elements around ``here`` by name
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            here.parts.append(html.unescape(page[at:]))
            break
        m = _TAG.match(page, lt)
        if lt > at:
            here.parts.append(html.unescape(page[at:lt]))
        if not m:  # a "<" that starts no tag is text
            here.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[1].lower() if m[1] else None
        if name is None:
            if m[0].startswith("<![CDATA["):
                here.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if page[lt + 1] == "/":
            if opened[name]:
                while here.name != name:
                    opened[here.name] -= 1
                    here = here.up
                opened[name] -= 1
                here = here.up
            elif name == "p":
                here.parts.append(Node("p", here))
            continue
        wanted = CLOSES.get(name, frozenset())
        if (name in ENDS_P and opened["p"]) or any(opened[x] for x in wanted):
            node = here
            while node is not root and node.name not in wanted and not (node.name == "p" and name in ENDS_P):
                if node.name in SCOPE and node.name not in wanted:
                    node = root
                    break
                node = node.up
            if node is not root:
                top = node.up
                while top.name in wanted:  # a row closes its cell and the row before
                    top = top.up
                while here is not top:
                    opened[here.name] -= 1
                    here = here.up
        node = Node(name, here, *_judged(name, m[2], opened["article"] + opened["main"] > 0))
        here.parts.append(node)
        if name in VOID:
            continue
        if name in RAW or name in ESCAPABLE_RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : close.start() if close else end]
            node.parts.append(html.unescape(body) if name in ESCAPABLE_RAW else body)
            at = close.end() if close else end
            continue
        if m[2].endswith("/") and name in ("svg", "path", "rect", "circle"):
            continue
        opened[name] += 1
        here = node
    return root


def _measure(root: Node) -> list[Node]:
    """Fill in counts from the leaves up; returns block elements in page order.

    Inline elements count as tags of the block they stand in. A block's own inline
    text takes part in its density sum as one more child.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        stack += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.left_out]
    own = {}
    for node in reversed(order):
        mine = Node(node.name, None)
        for x in node.parts:
            if isinstance(x, str):
                mine.chars += len(_SPACE.sub(" ", x).strip())
            elif not x.left_out:
                for into in (node,) if x.name in BLOCK else (mine,):
                    into.chars += x.chars
                    into.link_chars += x.link_chars
                    into.tags += x.tags + 1
                    into.link_tags += x.link_tags + (x.name == "a")
        node.chars += mine.chars
        node.link_chars += mine.link_chars
        node.tags += mine.tags
        node.link_tags += mine.link_tags
        if node.name == "a":
            node.link_chars = node.chars
        own[node] = mine
        node.inside = set().union(*(x.inside for x in _children(node))) if node.parts else set()
        if node.name in ("article", "main", "h1"):
            node.inside.add(node.name)
        if node.name in TEXT_BLOCKS and node.chars and not _linked(node):
            node.inside |= {"heading", "text"} if node.name in HEADINGS else {"text"}
    body = next((x for x in order if x.name == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    blocks = [x for x in order if x is root or x.name in BLOCK]
    for node in blocks:
        node.density = _density(node, ratio)
    for node in blocks:
        node.total = _density(own[node], ratio) + sum(
            x.density for x in node.parts if isinstance(x, Node) and not x.left_out and x.name in BLOCK
        )
    return blocks


def _density(node: Node, body_ratio: float) -> float:
    """Characters per tag, on a logarithm whose base grows with the share of link text."""
    if not node.chars:
        return 0.0
    tags, links = max(1, node.tags), max(1, node.link_tags)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * node.link_chars + body_ratio * node.chars + math.e)
    inner = node.chars / max(1, node.link_chars) * tags / links
    return max(0.0, node.chars / tags * math.log(max(1.0, inner)) / max(1.0, math.log(max(math.e, base))))


def _linked(node: Node) -> bool:
    """Whether most of an element's characters stand in links."""
    return node.link_chars * 2 > node.chars


def _plainness(node: Node) -> float:
    """Characters outside links for each tag."""
    return (node.chars - node.link_chars) / max(1, node.tags)


def _children(node: Node) -> list[Node]:
    return [x for x in node.parts if isinstance(x, Node) and not x.left_out]


def _around(node: Node) -> Iterator[Node]:
    """A node and what stands around it, outwards."""
    while node is not None:
        yield node
        node = node.up


def _strongest_suspect(blocks: list[Node]) -> tuple[float, set[Node]]:
    """The part of the greatest density sum within suspects that counts, and the suspects around that block.

    Nothing, if ``article`` or ``main`` stands outside all suspects, as it is the content then.
    """
    found: tuple[float, set[Node]] = (0.0, set())
    for node in blocks:
        around = {x for x in _around(node) if x.suspect not in ("", "header")}
        if not around and node.name in ("article", "main"):
            return 0.0, set()
        if around and all(x.suspect == "other" for x in around) and node.total * SUSPECT_PART > found[0]:
            found = node.total * SUSPECT_PART, around
    return found


def _leave_out_suspects(root: Node, blocks: list[Node]) -> bool:
    """Leave out what looks like adverts, notices or comments by class, and headers of the page."""
    some = False
    heads = [x for x in blocks if x.suspect == "header"]
    titled = sum(x.name == "h1" for x in blocks) > sum(x.name == "h1" and any(y in heads for y in _around(x)) for x in blocks)
    for head in heads:
        if titled or "h1" not in head.inside or head.up.name in ("body", "html", "#root"):
            head.left_out = some = True
    for kinds, content in ((("advert", "other"), {"article", "main", "h1"}), (("comments",), {"main", "h1"})):
        stack, left = [root], root.chars
        while stack:
            node = stack.pop()
            if node.suspect in kinds and not node.inside & content and node.chars < left:
                node.left_out = some = True
                left -= node.chars
            else:
                stack += reversed(_children(node))
    return some


def marked_blocks(blocks: list[Node]) -> list[Node]:
    """For each block at or above the body path's threshold, the block of greatest density sum within it."""
    best = max(blocks, key=lambda x: x.total)
    path = _path(best)
    threshold = min(map(_plainness, path))
    densest: dict[Node, Node] = {}
    for node in reversed(blocks):  # from the leaves up
        within = densest.get(node)
        own = node if within is None or node.total >= within.total else within
        densest[node] = own
        up = node.up
        while up is not None and up.name not in BLOCK and up.up is not None:
            up = up.up
        if up is not None and (up not in densest or own.total >= densest[up].total):
            densest[up] = own
    return list(dict.fromkeys(densest[x] for x in blocks if x.chars and _plainness(x) >= threshold))


def _path(node: Node) -> list[Node]:
    """A node and what stands around it, to the body (the whole page without one around it)."""
    path = [node]
    while path[-1].name != "body" and path[-1].up is not None:
        path.append(path[-1].up)
    return path


def _chosen(blocks: list[Node]) -> set[Node | tuple[Node, int]]:
    """What is kept: whole subtrees, and runs of inline parts (node, index) of their ancestors."""
    kept: set = set()
    seen: set[Node] = set()
    best = max(blocks, key=lambda x: x.total)
    for marked in marked_blocks(blocks):
        if marked is not best and "text" not in marked.inside:
            continue
        kept.add(marked)
        under = marked
        while under.up is not None and under.name != "body" and under.up not in seen:
            node = under.up
            seen.add(node)
            whole = node.name in ("article", "main")
            for i, x in enumerate(node.parts):
                if isinstance(x, str) or x.name not in BLOCK:
                    if (whole or (node is marked.up and node.name != "body" and node.up is not None)) and not (isinstance(x, Node) and x.name == "a"):
                        kept.add((node, i))
                elif x is not under and not x.left_out and x.chars and not _linked(x) and (
                    whole or x.name in TEXT_BLOCKS or "heading" in x.inside or (under is marked and node.name not in ("body", "#root") and _says_something(x))
                ):
                    kept.add(x)
            under = node
    return kept


def _says_something(block: Node) -> bool:
    """Whether a block without inner blocks holds a sentence that is no notice of rights."""
    if any(x.name in BLOCK for x in _children(block)):
        return False
    said = " ".join(_texts(block, {block}))
    return bool(_SENTENCE.search(said)) and not _RIGHTS.search(said)


def _texts(root: Node, kept: set) -> list[str]:
    """Texts of the kept blocks in page order, white space collapsed."""
    out, run = [], []

    def close():
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list = [(root, root in kept)]
    while stack:
        x, taken = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if taken:
                run.append(x)
        elif not x.left_out:
            if x.name in BLOCK:
                close()
                stack.append((None, False))
            taken = taken or x in kept
            stack += [(y, taken or (x, i) in kept) for i, y in reversed([*enumerate(x.parts)])]
    close()
    return out


def main_text(page: str | None) -> str:
    """The running text of a page."""
    if not page:
        return ""
    root = parse(page)
    blocks = _measure(root)
    strength, around = _strongest_suspect(blocks)
    if _leave_out_suspects(root, blocks):
        blocks = _measure(root)
        if strength > max(x.total for x in blocks):  # what looked like none of the content is the page's
            for node in around:
                node.left_out = False
            blocks = _measure(root)
    return " ".join(_texts(root, _chosen(blocks)))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without its markup, plus the main text of each page and its n_chars."""
    kept = [f for f in pages.schema.fields if f.name.lower() not in (html_col.lower(), text_col.lower(), "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
                columns = {f.name: batch.column(f.name) for f in kept}
                columns |= {text_col: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text_col}` string", "n_chars long"]
    return pages.mapInArrow(lean(run), ", ".join(schema))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
