"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree: a node is a path of elements, each with its tag and its
classes. Over all pages of the host two importances are computed for a node. Presentation: the entropy of
its children's layout. Content: one less the mean entropy of its texts, where a text that all pages share
has entropy one. A node's measured importance is shrunk towards its prior with the weight of ``PRIOR_PAGES`` pages,
so one page says little and there is no least number of pages. A branch is as important as its most important
node, and a branch below ``LEAST`` is template: it is removed from every page.

The prior is one, except in branches whose element is called a header or masthead inside an article: there it is
zero, and only their entropies keep them. Elements whose tag or role says that they are no content, or that have a
class or id made of nothing but such names (``cookie-banner``, ``site-nav``; not ``has-sidebar`` or
``ad-hoc-report``), are removed whatever their entropy, because adverts and comments change from page to page as
articles do. An article inside such an element is read all the same, and where a page names its article, only
that is read. Text elements inside an article stay even if they repeat; elsewhere they are judged like any other.
Elements on the same path are one node, so a notice in a paragraph beside paragraphs of content stays with them.

Cases: null or empty html has no text, n_chars 0. Truncated pages and unclosed elements are read to their end; after a
quotation mark that is never closed, quotation marks no longer hide a ``>``. A null url belongs to the host without
a name. Repeated rows are extracted alike; pages that are all equal keep their article, and nothing if they
have none and are many. Deeper than ``DEPTH`` elements, a node counts as its ancestor at that depth, and below
``NESTED`` open elements a new one takes the place of the innermost. Nothing is cut off, and the work is
linear in the length of a page.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import batch, staged
from sitehex.operators.atscale import broadcast_bounded

LEAST = 0.25
PRIOR_PAGES = 1.5
DEPTH = 32
NESTED = 512

NO_ELEMENT = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
TOKEN = re.compile(NO_ELEMENT + r"|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
UNQUOTED_TOKEN = re.compile(NO_ELEMENT + r"|<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)(>?)", re.S)
#: A whole attribute, so that nothing is read out of the middle of a name or a value.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
URL_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: A new element of the first kind ends an open one of the second, up to an enclosing element of the third.
ENDS = {
    "li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))),
    "th": ("td th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",))),
}
P_SCOPE = frozenset("article aside body button div footer header li main nav section table td th".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span blockquote pre li dd dt td th tr table tbody ul ol code br".split())
OUT_TAGS = frozenset(
    "nav footer aside form button select input label fieldset menu dialog svg canvas object applet audio video map head".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices "
    "alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus footer header masthead related "
    "recommended share sharing social newsletter subscribe subscription signup login popup modal overlay pagination pager "
    "widget toolbar copyright disclaimer".split()
)
#: Words beside those names that change nothing: ``site-header``, ``ad-box-2``, ``left_sidebar``.
SIDE_NAMES = frozenset(
    "site page main global top bottom left right upper lower box block wrap wrapper container inner outer area section bar list "
    "item items slot unit panel region zone content links link text form".split()
)
#: Inside an article these name its own head as often as a template: entropies decide.
DOUBTFUL_NAMES = frozenset("header masthead".split())
ARTICLE = frozenset(("article", "main"))


@functools.lru_cache(1 << 12)
def named(value: str) -> tuple[bool, bool]:
    """Whether one class or id is made of template names, and whether of doubtful ones alone."""
    parts = {x for x in re.split(r"[_-]+", value) if x and not x.isdigit()}
    telling = parts & OUT_NAMES
    return bool(telling) and parts <= OUT_NAMES | SIDE_NAMES, bool(telling) and telling <= DOUBTFUL_NAMES

#: Kinds of nodes: judged from a prior of one, kept always, judged from a prior of zero.
NEUTRAL, TEXT, DOUBTFUL = range(3)


def host_of(url: str | None) -> str:
    found = URL_HOST.match(url or "")
    return found[1].lower() if found else ""


@dataclass
class Element:
    tag: str
    path: tuple[int, ...]
    out: bool  # removed whatever the tree says
    article: bool
    doubtful: tuple[int, ...]  # nodes of the path that stay only if the tree says so


ROOT = Element("", (), False, False, ())


class Page:
    """One pass over a page's tokens: its nodes for the site tree, and its blocks of text with the element they stand in."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, Element]] = []
        self.children: dict[tuple[int, ...], list[str]] = {}
        self.texts: dict[tuple[int, ...], list[str]] = {}
        self.kinds: dict[tuple[int, ...], int] = {}
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.piece: list[str] = []
        self._read(source)

    def _end_block(self) -> None:
        text = " ".join("".join(self.piece).split())
        self.piece = []
        if text:
            here = self.stack[-1] if self.stack else ROOT
            self.blocks.append((text, here))
            self.texts.setdefault(here.path, []).append(text)

    def _say(self, text: str) -> None:
        if text:
            self.piece.append(html.unescape(text) if "&" in text else text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._end_block()
            self._close_upto(("p",), P_SCOPE)
        if tag in ENDS:
            ended, scope = ENDS[tag]
            self._close_upto(tuple(ended.split()), scope)
        label, names, role, hidden = tag, [], "", False
        for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                role = value.strip()
            elif name in ("class", "id"):
                names += map(named, value.split())
                label += "." + value if name == "class" else ""
            elif name in ("hidden", "aria-hidden"):
                hidden |= name == "hidden" or value == "true"
        above = self.stack[-1] if self.stack else ROOT
        names = [] if tag in ("html", "body") or tag in ARTICLE and not above.article else [x for x in names if x[0]]
        own = tag in ARTICLE or role in ("main", "article")
        article = above.article or own
        doubt = above.article and bool(names) and all(x[1] for x in names)
        out = hidden or tag in OUT_TAGS or role in OUT_ROLES or (bool(names) and not doubt) or (tag == "header" and not article)
        out = out or (above.out and not (own and not above.article))
        kind = TEXT if article and tag in TEXT_TAGS and not above.doubtful and not doubt else NEUTRAL
        path, doubtful = above.path, above.doubtful
        if len(path) < DEPTH or out != above.out or doubt:
            node = xxhash.xxh3_64_intdigest(repr((path[-1:], label, article, out, doubt))) - (1 << 63)
            path = (*path, node)
            doubtful = (*doubtful, node) if doubt or doubtful else doubtful
            self.kinds[path] = DOUBTFUL if doubtful else TEXT if own or tag in ("html", "body") else kind
        self.children.setdefault(above.path, []).append(label)
        self.children.setdefault(path, [])
        if len(self.stack) == NESTED:
            self.open[self.stack.pop().tag] -= 1
        self.stack.append(Element(tag, path, out, article, doubtful))
        self.open[tag] += 1

    def _cut(self, at: int) -> None:
        for element in self.stack[at:]:
            self.open[element.tag] -= 1
        del self.stack[at:]

    def _close_upto(self, tags: tuple[str, ...], scope: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in tags:
                self._end_block()
                self._cut(i)
                return
            if self.stack[i].tag in scope:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_block()
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return  # an inline end tag doesn't close a block

    def _read(self, source: str) -> None:
        at, token = 0, TOKEN
        while found := token.search(source, at):
            if found[2] and not found[4] and token is TOKEN:
                token = UNQUOTED_TOKEN  # a quotation mark is never closed
                continue
            self._say(source[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if tag and not found[4]:
                self._say(found[0])  # text that only begins like an element
            elif not tag:
                continue
            elif found[1]:
                self._close(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag == "br":
                self._say(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._end_block()
            elif not found[3].endswith("/") or tag in BLOCK:
                self._open(tag, found[3])
        self._say(source[at:])
        self._end_block()

    def nodes(self) -> list[tuple[tuple[int, ...], int, int, int]]:
        """Path, hash of the children's layout, hash of the text, and kind of every node."""
        layout = lambda labels: "|".join(x for i, x in enumerate(labels) if not i or labels[i - 1] != x)
        return [
            (p, xxhash.xxh3_64_intdigest(layout(c)) - (1 << 63),
             xxhash.xxh3_64_intdigest("\n".join(self.texts[p]).encode("utf-8", "surrogatepass")) - (1 << 63) if p in self.texts else 0,
             self.kinds.get(p, TEXT))
            for p, c in self.children.items() if p
        ]

    def text(self, turned: frozenset[int] | set[int]) -> str:
        """The kept blocks; ``turned`` holds the nodes for which the tree decides against their prior."""
        kept = [
            (text, e) for text, e in self.blocks
            if not e.out and all(n in turned for n in e.doubtful)
            and not (turned and any(n in turned and n not in e.doubtful for n in e.path))
        ]
        if any(e.article for _, e in kept):
            kept = [b for b in kept if b[1].article]
        return "\n\n".join(text for text, _ in kept)


def style_nodes(pages: DataFrame) -> DataFrame:
    """site, path, layout, content, kind of every node of every page (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            site, path, layout, content, kinds = [], [], [], [], []
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not source:
                    continue
                here = host_of(url)
                for p, shape, text, kind in Page(source).nodes():
                    site.append(here)
                    path.append(p)
                    layout.append(shape)
                    content.append(text)
                    kinds.append(kind)
            yield batch([
                ("site", pa.array(site, pa.string())), ("path", pa.array(path, pa.list_(pa.int64()))),
                ("layout", pa.array(layout, pa.int64())), ("content", pa.array(content, pa.int64())),
                ("kind", pa.array(kinds, pa.int32())),
            ])

    schema = "site string, path array<bigint>, layout bigint, content bigint, kind int"
    return pages.select("url", "html").mapInArrow(run, schema)


def site_tree(pages: DataFrame, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """site, node, pages, importance, belief, kind: the merged tree of every host.

    The importance of a node is that of the most important node of its branch, as measured; its belief is the same of
    importances shrunk towards their priors, and decides.
    """
    nodes = style_nodes(pages)
    features = F.array(
        F.struct(F.lit(0).alias("feature"), F.col("layout").alias("value")),
        F.struct(F.lit(1).alias("feature"), F.col("content").alias("value")),
    )
    counted = (
        nodes.select("site", "path", "kind", F.explode(features).alias("f"))
        .groupBy("site", "path", "f.feature", "f.value").agg(F.count("*").alias("k"), F.max("kind").alias("kind"))
    )
    empty = (F.col("feature") == 1) & (F.col("value") == 0)  # nodes without text of their own say nothing by it
    stats = counted.groupBy("site", "path").agg(
        F.sum(F.when(F.col("feature") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("feature") == 0, F.col("k") * F.log(F.col("k")))).alias("layout_klogk"),
        F.avg(F.when((F.col("feature") == 1) & ~empty, F.log(F.col("k")))).alias("text_logk"),
        F.max("kind").alias("kind"),
    )
    m = F.greatest(F.log(F.col("m").cast("double")), F.lit(1e-9))
    presentation = 1 - F.col("layout_klogk") / (F.col("m") * m)
    content = F.coalesce(1 - F.col("text_logk") / m, F.lit(0.0))
    prior = F.when(F.col("kind") == DOUBTFUL, 0.0).otherwise(1.0)
    own = F.greatest(presentation, content)
    shrunk = (F.col("m") * own + prior_pages * prior) / (F.col("m") + prior_pages)
    scored = stats.select("site", "path", "m", "kind", own.alias("own"), shrunk.alias("shrunk"))
    branches = scored.select(
        "site", F.explode(F.transform("path", lambda n, i: F.struct(n.alias("node"), (i == F.size("path") - 1).alias("end")))).alias("x"),
        "m", "own", "shrunk", "kind",
    )
    return branches.groupBy("site", F.col("x.node").alias("node")).agg(
        F.max(F.when(F.col("x.end"), F.col("m"))).alias("pages"),
        F.max("own").alias("importance"),
        F.max("shrunk").alias("belief"),
        F.max(F.when(F.col("x.end"), F.col("kind"))).alias("kind"),
    )


EXTRACTED = "page_id bigint, url string, text string, n_chars bigint"


def main_text(pages: DataFrame, least: float = LEAST, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    low = F.col("belief") < least
    against = F.when(F.col("kind") == NEUTRAL, low).when(F.col("kind") == DOUBTFUL, ~low).otherwise(False)
    turned = staged(
        site_tree(pages, prior_pages).where(against).groupBy("site").agg(F.collect_set("node").alias("turned")), "style-tree"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                Page(source).text(set(nodes or ())) if source else ""
                for source, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield batch([
                ("page_id", b.column(0)), ("url", b.column(1)), ("text", pa.array(found, pa.string())),
                ("n_chars", pa.array(map(len, found), pa.int64())),
            ])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), URL_HOST.pattern, 1))
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("site"))
    known = narrow.join(broadcast_bounded(turned, turned.agg(F.sum(F.size("turned"))).first()[0] or 0), "site", "left")
    return known.select("page_id", "url", "html", "turned").mapInArrow(run, EXTRACTED)
