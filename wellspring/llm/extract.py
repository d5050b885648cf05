"""HTML main-text extraction with per-host template removal.

Every page is parsed into an element tree, in time linear in its length. All its block subtrees are hashed (tag,
class, id, role and text), Spark counts for each host in how many distinct surroundings
(hash of the parent) a subtree occurs, and subtrees recurring in at least ``SHARE`` of the host's
distinct page contents (and ``MIN_CONTEXTS``), or outside articles in ``MANY`` surroundings whatever the share (a
passage that many articles quote is no template), are deleted as site template, with lists and tables of which two thirds of the text is such. Counting distinct surroundings rather
than pages keeps the paragraphs of an article that is merely copied many times; distinct contents are the
same unit. Headings, articles and main elements are never template by themselves.

What the counts leave and is still furniture by meaning (menus, page headers and footers, sidebars, notices,
adverts, forms, scripts, readers' comments, whose text differs on every page) goes by tag, role and class words.

Defined results: null, empty or text-free html gives an empty string; broken markup is closed at
its end; pages without a host keep all their subtrees; very long pages are parsed one at a time; repeated rows are
extracted one by one and equal counts need no order; an empty table gives an empty result; extra columns are kept by
``extract``, but for those named like its own (text, n_chars, n_template), which its own replace.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Set

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, urls

MIN_CONTEXTS, SHARE, MANY = 5, 0.3, 1000

# Element names by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROP = {"script", "style", "noscript", "template", "head", "title", "nav", "aside", "footer", "form", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "dialog", "menu", "audio", "video", "noembed", "noframes", "math"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
LISTS = {"ul", "ol", "nav", "menu", "dl", "table", "tbody", "tr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_TEMPLATE = HEADINGS | {"article", "main", "body", "html", "#root"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}
WORDS = {"nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "popup", "modal", "overlay", "comment", "comments", "commentlist", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "copyright", "login"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
NEGATED = {"no", "has", "with", "without", "not"}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|<[!?/][^>]*(?:>|\Z)|([^<]+)|(<)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
P_STOPS = {"button", "table", "td", "th", "div", "article", "section", "li"}
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# A start tag closes open elements of these names, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.hash = tag, attrs, [], 0
        self.holds = False  # an article or main element below it


class Open:
    """The open elements, and where in their stack each name stands, so that every tag costs its own pops only."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], defaultdict(list), [0]

    def push(self, n: Node) -> None:
        self.at[n.tag].append(len(self.stack))
        if n.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(n)
        if n.tag in ("article", "main"):
            for up in reversed(self.stack[:-1]):
                if up.holds:
                    break
                up.holds = True

    def cut(self, i: int) -> None:
        """Close the elements from position i on."""
        while len(self.stack) > i:
            n = self.stack.pop()
            self.at[n.tag].pop()
            if n.tag in BLOCK:
                self.blocks.pop()

    def last(self, names: Iterable[str]) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def close(self, names: set[str], stops: set[str]) -> None:
        if (i := self.last(names)) > self.last(stops):
            self.cut(i)

    def end(self, tag: str) -> None:
        i = self.last((tag,))
        if i and (tag in BLOCK or i > self.blocks[-1]):  # an inline end tag closes no block
            self.cut(i)


def parse(page: str) -> Node:
    """An element tree; broken markup is repaired as far as text order needs."""
    root = Node("#root")
    now, at, n = Open(root), 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        text = m[7] or m[8]
        if text:
            now.stack[-1].kids.append(html.unescape(text))
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            now.end(tag)
            continue
        if tag in BLOCK:
            now.close({"p"}, P_STOPS)
        if tag in CLOSES:
            now.close(*CLOSES[tag])
        node = Node(tag, m[3] or m[6] or "")
        now.stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end is None:
                at = n
            else:
                if tag not in DROP:
                    node.kids.append(html.unescape(page[at : end.start()]))
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        now.push(node)
    return root


def _labels(attrs: str) -> tuple[set[str], dict[str, str]]:
    a = {}
    for k, x, y, z in ATTR.findall(attrs):
        a.setdefault(k.lower(), html.unescape(x or y or z))
    names = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", f"{a.get('class', '')} | {a.get('id', '')}").lower()
    words = re.findall(r"[a-z0-9]+|\|| +", names)
    words = [w for w in words if w.strip()]
    return {w for before, w in zip(["", *words], words) if before not in NEGATED}, a


def _boilerplate(n: Node, in_article: bool) -> str:
    """"" for content; "firm" for boilerplate; "soft" for what is boilerplate unless it holds the article."""
    if n.tag in DROP or n.tag == "article" and in_article:
        return "firm"  # an article within an article is a reader's comment
    if n.tag == "header" and not in_article:
        return "soft"
    if not n.attrs or not TELLING.search(n.attrs):
        return ""
    words, a = _labels(n.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return "firm"
    if n.tag in HEADINGS or n.tag in ("body", "html", "main"):
        return ""
    if words & COMMENT_WORDS:
        return "firm"
    if n.tag == "article":
        return ""
    return "soft" if a.get("role", "").lower() in ROLES or words & WORDS or "header" in words and not in_article else ""


def _prune(root: Node) -> dict[str, list[Node]]:
    """Cut boilerplate out of the tree; the outermost articles, main elements and bodies that remain."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        kids = []
        for k in n.kids:
            if isinstance(k, Node):
                kind = _boilerplate(k, inside)
                if kind == "firm" or kind and (inside or not k.holds):
                    continue
                if k.tag == "article":
                    found["article"].append(k)
                elif k.tag == "main" or 'role="main"' in k.attrs:
                    found["main"].append(k)
                elif k.tag == "body":
                    found["body"].append(k)
                todo.append((k, inside or k.tag == "article"))
            kids.append(k)
        n.kids = kids
    return found


def _order(root: Node, nodes: list[Node]) -> list[Node]:
    """nodes in page order."""
    want, out, todo = set(map(id, nodes)), [], [root]
    while todo:
        n = todo.pop()
        if id(n) in want:
            out.append(n)
            continue
        todo.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out


def content(page: str | None, template: Set[int] = frozenset()) -> tuple[list[Node], int]:
    """The roots of a page's main content (its articles, else main elements, else body, else everything), and the
    number of subtrees deleted as template."""
    root = parse(page or "")
    gone = without_template(root, template) if template else 0
    found = _prune(root)
    for kind in ("article", "main", "body"):
        if found[kind]:
            return _order(root, found[kind]), gone
    return [root], gone


def _walk(n: Node) -> list[Node]:
    """Elements below and including n, children before parents."""
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(k for k in x.kids if isinstance(k, Node))
    return out[::-1]


def hash_subtrees(root: Node) -> None:
    """Hashes of tag, naming attributes and content, white space alike."""
    for n in _walk(root):
        body = "\x01".join(f"\x02{k.hash}" if isinstance(k, Node) else " ".join(k.split()) for k in n.kids)
        named = " ".join(map("=".join, NAMED.findall(n.attrs))) if n.attrs else ""
        n.hash = xxhash.xxh64_intdigest(f"{n.tag}\x03{named}\x03{body}".encode("utf-8", "surrogatepass")) - 2**63


def could_be_template(n: Node) -> bool:
    return n.tag in BLOCK and n.tag not in NEVER_TEMPLATE and not n.holds


def candidates(root: Node) -> dict[tuple[int, int], bool]:
    """(hash, parent's hash) of every block subtree of the page that is not empty and could be template: is it in an article?"""
    hash_subtrees(root)
    out, todo = {}, [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        for k in n.kids:
            if isinstance(k, Node):
                todo.append((k, inside))
                if k.kids and could_be_template(k):
                    out[k.hash, n.hash] = inside
    return out


def without_template(root: Node, template: Set[int]) -> int:
    """Delete template subtrees, and lists and tables of which they make two thirds of the text; how many went."""
    hash_subtrees(root)
    gone = 0
    kept: dict[int, tuple[int, int]] = {}  # element: characters in all, and of deleted subtrees
    for n in _walk(root):
        all_, cut, kids = 0, 0, []
        for k in n.kids:
            if isinstance(k, str):
                all_ += len(k.strip())
                kids.append(k)
                continue
            a, c = kept.pop(id(k))
            whole = could_be_template(k) and (k.hash in template or k.tag in LISTS and c > 0 and 3 * c >= 2 * a)
            all_, cut, gone = all_ + a, cut + (a if whole else c), gone + whole
            kids.append(" " if whole else k)
        n.kids = kids
        kept[id(n)] = (all_, cut)
    return gone


def text_of(roots: list[Node]) -> str:
    """Blocks in page order, one per line."""
    lines: list[str] = []
    now: list[str] = []

    def flush() -> None:
        line = " ".join("".join(now).split())
        now.clear()
        if line:
            lines.append(line)

    for r in roots:
        todo: list = [r]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag == "br" or x.tag in ("td", "th"):
                now.append(" ")
                todo.extend([" ", *reversed(x.kids)] if x.kids else [])
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo.extend(reversed(x.kids))
            else:
                todo.extend(reversed(x.kids))
        flush()
    return "\n".join(lines)


def templates(pages: DataFrame, host: str, html_col: str, min_contexts: int = MIN_CONTEXTS, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(host, template array<bigint>): hashes of subtrees recurring across many pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hs, pa.int64()), pa.array(ps, pa.int64()), pa.array(ins, pa.bool_())], names=["host", "h", "p", "inside"])

        hosts, hs, ps, ins = [], [], [], []
        for b in batches:
            for h, page in zip(b.column(0), b.column(1)):
                root = parse(page.as_py() or "")
                own = candidates(root)
                # the page's content itself, with no h: one such row for every distinct content
                hosts += [h.as_py()] * (len(own) + 1)
                hs += [x for x, _ in own] + [None]
                ps += [p for _, p in own] + [root.hash]
                ins += [*own.values(), False]
                if len(hs) > 100_000:
                    yield out()
                    hosts, hs, ps, ins = [], [], [], []
        yield out()

    own = pages.filter(F.col(host) != "").select(F.col(host).alias("host"), F.col(html_col).alias("html"))
    subtrees = own.mapInArrow(run, "host string, h bigint, p bigint, inside boolean").groupBy("host", "h", "p").agg(F.max("inside").alias("inside"))
    all_ = scratch.table(subtrees.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.max("inside").alias("inside")).filter(F.col("h").isNull() | (F.col("n") >= min_contexts)), "contexts")
    counts = all_.filter(F.col("h").isNull()).select(F.col("host").alias("chost"), F.col("n").alias("pages"))
    often = all_.filter(F.col("h").isNotNull()).join(counts, F.col("host") == F.col("chost")).filter((F.col("n") >= share * F.col("pages")) | ((F.col("n") >= many) & ~F.col("inside")))
    # at most (subtrees of a page) / share hashes a host, and those met in `many` surroundings
    return scratch.table(often.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("template")), "templates")


OWN = ("text", "n_chars", "n_template")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", **kw) -> DataFrame:
    """pages with ``text``, ``n_chars`` and ``n_template`` (subtrees deleted as template) in place of the html column."""
    cols = [c for c in pages.columns if c != html_col and c not in OWN]
    base = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)], urls.parts(F.col(f"`{url_col}`"))[0].alias("_host"), F.col(f"`{html_col}`").alias("_html"))
    t = templates(base, "_host", "_html", **kw)
    joined = base.join(scratch.small(t, 10_000), F.col("_host") == F.col("host"), "left").drop("host", "_host")
    n = len(cols)
    out_schema = T.StructType([T.StructField(f"_c{i}", pages.schema[c].dataType, True) for i, c in enumerate(cols)] + list(scratch.schema("text string, n_chars bigint, n_template bigint").fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, sets = to_arrow_schema(out_schema), {}
        for b in batches:
            out, gone = [], []
            for page, ts in zip(b.column(n), b.column(n + 1)):
                key = ts.as_py() or ()
                key = tuple(key)
                if key not in sets:
                    sets.clear()
                    sets[key] = frozenset(key)
                roots, g = content(page.as_py(), sets[key])
                out.append(text_of(roots)), gone.append(g)
            yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    return joined.mapInArrow(run, out_schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], *OWN)


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole pages."""
    return extract(scratch.docs_of(spark, sf_dir, "pages").select("page_id", "url", "html"))
