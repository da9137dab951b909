"""Operator 6: main text of web pages by a site style tree.

Pages are parsed into blocks, each with its path of block elements (tag and first class). The pages of one host are merged into a style tree
by counting, for each path, in how many pages it is, how its contents spread over them, and how its branch is built in them. A node's importance
comes from

* content importance: the entropy of its contents over the host's distinct pages, against that of as many different ones, and
* presentation importance: the entropy of its branch's build (the paths of the blocks in it) over the pages, likewise, and
* its marks: an element is **plainly** furniture if its tag, role, class or id says menu, header, footer, sidebar, notice, advert, form or reader
  comments; it is **doubtful** if such a word is only a part of a name (``form-group``, ``content-related``).

Cut are plainly marked branches, doubtful ones (of nested ones the outermost and the innermost count) of one build on all the host's pages (presentation importance below ``LEAST``), and nodes of the same
contents on all of them (content importance below ``LEAST``). A node in fewer than ``MIN_PAGES`` of the host's distinct pages proves nothing: there
only plain marks count. What an ``article`` or ``main`` element holds is judged by what lies within it, and pages that have one are read nowhere
else. Character references are decoded, white space in a block becomes one space, and blocks are joined in page order by one space.

A page is scanned once, in time linear in its length: a tag ends at the first ``>`` outside of a quoted value, and what is open when the page ends (a
tag, a quote, a comment, a title or script) ends with it and is no text, as in the HTML standard.

Cases: null or empty html gives an empty text; pages without a host are one site each; equal pages count once in the tree; repeated rows
come back as often; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, stage

MIN_PAGES, LEAST = 20, 0.1

# HTML's element names by what they do to text, and words of classes and ids that name page furniture.
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "head", "object", "canvas", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
FURNITURE_TAGS = {"nav", "footer", "header", "aside", "form", "button", "select", "option", "textarea", "input", "label", "fieldset", "menu", "dialog"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
FURNITURE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
    "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
# Words that often name layout or a subject when they are a part of a name, and words of names that hold what such words only describe.
DOUBTFUL_WORDS = {"form", "related", "recommended", "social", "search", "header", "notice", "alert", "disclaimer", "discussion", "responses", "share", "promotion", "promo", "widget", "widgets"}
CONTENT_WORDS = {"article", "body", "content", "entry", "main", "page", "post", "science", "story", "text", "title", "policy"}
# What a part of furniture is called after it: an advert's slot, a list of comments.
PART_WORDS = {"area", "bar", "block", "box", "container", "inner", "item", "items", "left", "link", "links", "list", "outer", "overlay", "right", "section", "slot", "top", "bottom", "unit", "wrap", "wrapper"}
MAIN = {"article", "main"}
_CLOSED_BY = {"p": INLINE | {"p"}, "li": INLINE | {"li", "p"}, "dt": INLINE | {"dt", "dd", "p"}, "dd": INLINE | {"dt", "dd", "p"}, "tr": INLINE | {"tr", "td", "th", "p"}, "td": INLINE | {"td", "th", "p"}, "th": INLINE | {"td", "th", "p"}, "option": {"option"}}
_VALUE = r"""=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+"""  # an equals sign, and a quoted value if there is one
_PIECE = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_VALUE}|[^>=])*+)(>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
PLAIN, DOUBTFUL = 2, 1
# Classes that name an element of content, whatever its other classes say.
CONTENT_NAMES = {"article", "post", "entry", "story", "content", "main"}


def mark_of_name(name: str) -> int:
    """How plainly one class or id says that its element is furniture: ``PLAIN``, ``DOUBTFUL`` or 0."""
    parts = [w.lower() for w in _NAME.findall(name)]
    if not FURNITURE_WORDS.intersection(parts):
        return 0
    whole, last = name.lower() in FURNITURE_WORDS or "".join(parts) in FURNITURE_WORDS, parts[-1]
    if whole or parts[0] in ("related", "recommended", "sponsored"):
        return PLAIN
    named = [w for w in parts if w in FURNITURE_WORDS]
    sure = [w for w in named if w not in DOUBTFUL_WORDS]
    content = CONTENT_WORDS.intersection(parts)
    if last in sure or (sure and last in PART_WORDS) or len(named) > 1:
        return PLAIN
    if last in named or last in PART_WORDS:
        return DOUBTFUL if content - {"page", "main"} or last in ("related", "science") else PLAIN
    return DOUBTFUL


class _Element:
    __slots__ = ("tag", "path", "mark", "main", "doubt")

    def __init__(self, tag: str, attributes: str, above: _Element | None):
        known: dict[str, str] = {}
        if attributes.strip(" /\n\t"):
            for m in _ATTRIBUTE.finditer(attributes):
                known.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        self.tag, role = tag, known.get("role", "").lower()
        own_main = tag in MAIN or role == "main"
        shown = "hidden" not in known and "display:none" not in known.get("style", "").replace(" ", "").lower() and known.get("aria-hidden") != "true"
        if own_main:
            mark = 0
        elif not shown or tag in HIDDEN or tag in FURNITURE_TAGS or role in FURNITURE_ROLES:
            mark = PLAIN
        else:
            mark = max((mark_of_name(name) for key in ("class", "id") for name in known.get(key, "").split()), default=0)
            if mark == PLAIN and CONTENT_NAMES.intersection(known.get("class", "").lower().split()):
                mark = DOUBTFUL
        style = tag + "".join("." + c for c in known.get("class", "").split()[:1])
        self.path = above.path if above and tag in INLINE and not mark else _digest(f"{above.path if above else 0}>{style}")
        self.mark = mark
        self.main = own_main or bool(above and above.main)
        # Within a main element the marks outside of it do not count.
        plain_above, doubt_above = (False, ()) if own_main or above is None else (above.mark == PLAIN, above.doubt)
        if plain_above:
            self.mark = PLAIN
        self.doubt = (*doubt_above[:1], self.path) if mark == DOUBTFUL else doubt_above


class Block:
    """Text of a page, with the path of its element; ``doubt`` are the paths of doubtful elements around it."""

    __slots__ = ("path", "text", "plain", "main", "doubt")

    def __init__(self, path: int, text: str, plain: bool, main: bool, doubt: tuple[int, ...]):
        self.path, self.text, self.plain, self.main, self.doubt = path, text, plain, main, doubt


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[_Element] = []
    held: list[str] = []
    open_tags: list[Counter] = [Counter()]  # open elements by tag: those outside of main elements, then those within each

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            top = stack[-1] if stack else None
            out.append(Block(top.path, text, top.mark == PLAIN, top.main, top.doubt) if top else Block(0, text, False, False, ()))

    def pop(depth: int) -> None:
        if any(e.tag not in INLINE or e.mark for e in stack[depth:]):
            flush()
        for e in reversed(stack[depth:]):
            if e.tag in MAIN:
                open_tags.pop()
            open_tags[-1][e.tag] -= 1
        del stack[depth:]

    at = 0
    while True:
        found = _PIECE.search(page, at)
        held.append(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found[3] or "").lower()
        if found[1] is not None:
            held.append(html.escape(found[1]))
        elif not tag or not found[5]:
            continue
        elif found[2]:
            if open_tags[-1][tag] or (tag in MAIN or tag in ("body", "html")) and any(c[tag] for c in open_tags):
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                pop(depth)
            elif tag not in INLINE:
                flush()
        elif tag in _ENDS:
            if not found[4].rstrip().endswith("/") or tag in ("textarea", "title"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            if tag not in INLINE:
                flush()
        elif tag in VOID:
            if tag not in INLINE:
                flush()
        else:
            closed = _CLOSED_BY.get(tag, () if tag in INLINE else INLINE | {"p"})
            depth = len(stack)
            while depth and stack[depth - 1].tag in closed and not (stack[depth - 1].mark and stack[depth - 1].tag in INLINE):
                depth -= 1
            if tag not in INLINE:
                flush()
                pop(depth)
            element = _Element(tag, found[4], stack[-1] if stack else None)
            if tag in INLINE and element.mark and not (stack and stack[-1].mark == PLAIN):
                flush()
            stack.append(element)
            open_tags[-1][tag] += 1
            if tag in MAIN:
                open_tags.append(Counter())
            if found[4].endswith("/"):
                pop(len(stack) - 1)
    flush()
    return out


def main_text(page: str | None, low: set[int]) -> str:
    """The page without its plain furniture and the branches of low importance."""
    found = blocks(page or "")
    if any(b.main for b in found):
        found = [b for b in found if b.main]
    return " ".join(b.text for b in found if not b.plain and b.path not in low and not any(-d in low for d in b.doubt))


def _nodes(page: str) -> Iterator[tuple[int, int]]:
    """Of each node outside plain furniture, its number and a digest of what the page has there: contents under the path, builds of doubtful branches
    under its negative."""
    texts: dict[int, list[str]] = {}
    builds: dict[int, list[str]] = {}
    for b in blocks(page):
        if not b.plain:
            texts.setdefault(b.path, []).append(b.text)
            for d in b.doubt:
                builds.setdefault(-d, []).append(str(b.path))
    for found in (texts, builds):
        for node, parts in found.items():
            yield node, _digest("\n".join(parts))


def low_branches(pages: DataFrame) -> DataFrame:
    """Of ``host, html``: the nodes of each host whose importance is below the least (by content, or negative ones by presentation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "html"):
            hosts, nodes, contents, copies = [], [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                whole = _digest(page)
                for node, content in _nodes(page):
                    hosts.append(host)
                    nodes.append(node)
                    contents.append(content)
                    copies.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(contents, pa.int64()), pa.array(copies, pa.int64())], ["host", "path", "content", "page"])

    seen = pages.where("host is not null and html is not null").mapInArrow(run, "host string, path long, content long, page long").distinct()
    spread = seen.groupBy("host", "path", "content").agg(F.count("*").alias("n")).groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = 1 - F.col("s") / (F.col("m") * F.log("m"))
    return spread.where(F.col("m") >= MIN_PAGES).where(entropy < LEAST).select("host", "path")


def _digest(text: str) -> int:
    """A positive number of 63 bits."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 | 1


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.when(host != "", host).alias("host"))
    low = stage(low_branches(pages.select("host", "html")), "low_branches")
    by_host = low.groupBy("host").agg(F.collect_list("path").alias("low"))  # one site's low nodes; each is in MIN_PAGES pages at least
    inner = pages.join(by_host, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "html"):
            texts = [main_text(page, set(low or ())) for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return inner.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
