"""Main text of web pages by tree scoring.

A page becomes a tree. What is never the article is cut out: scripts, styles, navigation, page headers and
footers, asides, forms, and hidden elements. Elements whose class, id or role names them as menu, advert,
notice, sidebar or reader comments are passed over. Each paragraph that is left gives points for its length and its
commas to its ancestors, fewer with each step up; a container's points are discounted by the share of its text that
is link text. The best container grows to the article or main element that it stands in, else to its
parents as long as what they hold besides is text with few links; siblings that are plain text blocks or score well, and
bare text between them, are kept with it.

Inside what is kept, names count for less, since articles have section headers, discussions and notices of their
own: a paragraph or heading goes only if its whole class names an advert, a menu or the like; a container goes if a
word of its name says so, and with a weaker word (header, notice, discussion, ...) only if its text is mostly links or
it holds form fields. A list of links goes only where nothing of the article stands before it.

Blocks come in page order, one per line; a line break element is white space.

Defined results: null, empty and text-free pages give an empty text; a page without
paragraphs gives its body text; unclosed and stray tags are repaired as browsers do
for paragraphs, lists and tables; repeated rows are extracted each, an empty table
gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object embed svg "
    "canvas dialog menu audio video".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split())
#: Opening one of these closes an open one of the second kind, up to the third.
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li".split())
#: Words of names that say what an element is wherever it stands.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion nav navbar "
    "navigation menu submenu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar sidebar cookie "
    "cookies consent gdpr popup modal overlay newsletter paywall social share sharing related recommended "
    "recommendations comment comments disqus".split())
#: Words that articles use of their own parts as well.
WEAK = frozenset(
    "banner header side aside rail notice notices alert subscribe signup login widget replies respond discussion disclaimer "
    "contentinfo complementary search dialog hidden".split())
UNLIKELY = STRONG | WEAK
#: Elements of an article that hold text, not parts of a page.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd pre blockquote figcaption caption".split())
FIELDS = frozenset("form input button select textarea".split())
LIKELY = frozenset("article body content main entry post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NEVER_CUT = frozenset(("html", "body", "article", "main", "#root"))
#: A sibling is kept from this share of the best score.
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text", "linked", "points", "passed")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.text = self.linked = 0
        self.points = 0.0
        #: Passed over when the container is looked for.
        self.passed = False


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that is inside the nearest of ``until``."""
        node, found = self.at, None
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self.at = found.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SAME:
            self._close(*SAME[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            # A stray inline or paragraph end tag closes nothing outside its block.
            if (tag in INLINE or tag == "p") and node.tag not in INLINE:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _tokens(node: Node) -> set[str]:
    named = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}"
    return {m.lower() for m in _WORDS.findall(named)}


def _post_order(root: Node) -> list[Node]:
    """Every element after its descendants."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return out[::-1]


def _measure(root: Node) -> None:
    for node in _post_order(root):
        node.text = node.linked = 0
        for c in node.children:
            if isinstance(c, Node):
                node.text += c.text
                node.linked += c.linked
            else:
                node.text += len("".join(c.split()))
        if node.tag == "a":
            node.linked = node.text


def _is_cut(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in CUT or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.IGNORECASE):
        return True
    return node.tag not in _NEVER_CUT and (attrs.get("role") or "").lower() in ROLES


def _is_passed(node: Node, page_text: int) -> bool:
    tokens = _tokens(node)
    if node.tag in _NEVER_CUT:
        # A comment may be marked up as an article of its own.
        return node.tag == "article" and bool(tokens & {"comment", "comments", "reply", "replies"})
    return bool(tokens & UNLIKELY) and not (tokens & LIKELY and 2 * node.text > page_text)


def _prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        kept: list[Node | str] = []
        for c in node.children:
            if isinstance(c, Node):
                if c.tag == "header":
                    # The header of an article holds its heading; other headers go.
                    c.children = [x for x in _post_order(c)[::-1] if x.tag in HEADINGS] if inside else []
                elif _is_cut(c):
                    # What stood on either side of it stays apart.
                    kept.append(" ")
                    # Of a form, that it is there still tells what its container is.
                    kept += [Node(c.tag, {"hidden": None}, node)] if c.tag in FIELDS else []
                    continue
                c.passed = node.passed or _is_passed(c, root.text)
                stack.append((c, inside))
            kept.append(c)
        node.children = kept


def _is_part(node: Node, holder: Node) -> bool:
    """Whether an element inside the article belongs to it."""
    if "hidden" in node.attrs:
        return False
    if not node.passed:
        return True
    names = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}".lower().split()
    if node.tag in TEXTS or node.tag in INLINE:
        return not STRONG.intersection(names)
    tokens = _tokens(node)
    if node.tag == "article" and tokens & {"comment", "comments", "reply", "replies"}:
        return False
    if tokens & STRONG:
        # A wrapper that holds the article is named after something else it does.
        return 2 * node.text > holder.text and not STRONG.intersection(names)
    if tokens & WEAK:
        return 2 * node.linked < max(node.text, 1) and not any(x.tag in FIELDS for x in _post_order(node))
    return True


def _has_blocks(node: Node) -> bool:
    return any(isinstance(c, Node) and c.tag not in INLINE for c in node.children)


def _text(node: Node) -> str:
    parts, stack = [], [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
        else:
            stack.extend(reversed(c.children))
    return " ".join("".join(parts).split())


def _score(root: Node) -> None:
    for node in _post_order(root):
        if node.text and not node.passed and (
                node.tag in PARAGRAPHS or node.tag in ("div", "section", "article")) and not _has_blocks(node):
            text = _text(node)
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - node.linked / node.text)
            step, up = 1, node.parent if node.tag in PARAGRAPHS else node
            while up is not None and step <= 4:
                up.points += points / step
                step, up = step + 1, up.parent


def _final(node: Node) -> float:
    if not node.text:
        return 0.0
    bonus = {"article": 2.0, "main": 1.5, "body": 0.8, "html": 0.5, "#root": 0.4}.get(node.tag, 1.0)
    if _tokens(node) & LIKELY:
        bonus *= 1.25
    return node.points * bonus * (1 - node.linked / node.text)


def _link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "p", "section") and node.text > 0 and node.linked >= 0.9 * node.text and (
        sum(x.tag == "a" for x in _post_order(node)) >= 3)


def _blocks(roots: list[Node | str], holder: Node) -> list[str]:
    """Text between block borders, white space made single."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        parts.clear()
        if line:
            out.append(line)

    stack: list[Node | str | None] = [*reversed(roots)]
    while stack:
        c = stack.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            parts.append(c)
        elif c.tag in ("br", "wbr"):
            parts.append(" " if c.tag == "br" else "")
        elif not _is_part(c, holder) or (not out and not "".join(parts).strip() and _link_list(c)):
            parts.append(" ")
        else:
            if c.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(c.children))
    flush()
    return out


def _few_links(c: Node | str) -> bool:
    return isinstance(c, str) or c.passed or 2 * c.linked <= c.text


def _grown(best: Node) -> Node:
    """The article or main element around the container, else its farthest parent that holds nothing but text with few links."""
    up = best
    while up.parent is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up.tag in ("article", "main"):
        return up
    while best.parent is not None and best.tag != "body" and all(_few_links(c) for c in best.parent.children if c is not best):
        best = best.parent
    return best


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    _measure(root)
    _prune(root)
    _measure(root)
    _score(root)
    nodes = _post_order(root)[::-1]
    best = max((n for n in nodes if not n.passed), key=_final)
    if best.points <= 0:
        bodies = [n for n in nodes if n.tag == "body"]
        return "\n".join(_blocks(bodies[:1] or [root], root))
    best = _grown(best)
    if best.parent is None or best.tag in ("body", "html", "article", "main"):
        return "\n".join(_blocks([best], best))
    limit, own = SIBLING_SHARE * _final(best), best.attrs.get("class")
    keep: list[Node | str] = []
    for c in best.parent.children:
        if isinstance(c, str) or c is best or c.tag in INLINE:
            keep.append(c)
        elif c.text and not c.passed and _few_links(c):
            plain = c.tag in TEXTS or c.tag in ("table", "ul", "ol", "dl", "figure")
            alike = own is not None and c.attrs.get("class") == own and c.tag == best.tag
            if plain or alike or _final(c) >= max(limit, 1):
                keep.append(c)
    return "\n".join(_blocks(keep, best))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars: one row per row."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    schema = T.StructType([
        T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_url", rows.schema["_url"].dataType),
        T.StructField("text", T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())],
                names=["_id", "_url", "text"])

    return rows.mapInArrow(extract, schema).select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
