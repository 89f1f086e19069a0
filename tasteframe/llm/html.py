"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path (tags with their class words). A node's presentation importance is the
entropy of its child sequences over the host's pages, its content importance falls with the entropy of each of its
texts over those pages: what all pages share says nothing about one. What few pages share says less than what many do,
so content counts as if UNSEEN more pages differed. Nodes of low importance go, and so do single texts of low importance
at other nodes, inside article and main too. The roles that a page states - article and main, or a class word such as
"ad" - are what holds first: text outside them or under such a word goes, unless nothing else is left. A word does not
rule out the element that holds most of the main text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import fresh, slices, table, written

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul br option".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas nav aside footer form button select textarea datalist dialog menu audio video map".split()
)
#: Class, id and role words of what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo widget related "
    "recommended share sharing social newsletter subscribe subscription signup login search comment comments reply replies disqus respond "
    "copyright legal disclaimer pagination pager toolbar skip teaser teasers".split()
)
#: Those that also name layouts, not only what stands in them.
LAYOUTS = frozenset("banner nav navbar navigation menu header masthead sidebar aside widget related search toolbar social share sharing".split())
#: A class word that begins so tells what a page has or lacks, not what the element is.
MODIFIERS = frozenset("no not non has with without".split())
#: Elements that are one text: inside main, a mark that is a part of a longer class word does not rule them out.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
MAIN = frozenset(("article", "main"))
#: An element of the first kind ends an open one of the second kind.
CLOSES_P = BLOCKS - {"br", "option", "body", "html", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}
#: Pages that are counted as different beside those seen, and the importance below which a node goes.
UNSEEN, LEAST_IMPORTANCE = 2, 0.3


def _marks(tag: str, names: str, main: bool) -> set[str]:
    """The marks among an element's class, id and role words."""
    parts = [re.findall("[a-z]+", name) for name in names.split()]
    if main and tag in TEXTS:
        parts = [p for p in parts if len(p) == 1]
    return {word for p in parts if p and p[0] not in MODIFIERS for word in p} & MARKS - ({"header", "masthead"} if main else set())


@dataclass
class Marked:
    """An element that a word may rule out: the one around it, whether it stands in a main element and has only words
    that also name layouts; then, of what stands in it, the length of all text and of main text, and whether a main
    element without a mark of its own is there."""

    around: int
    inside: bool
    layout: bool
    size: int = 0
    main_size: int = 0
    holds: bool = False


class Page(HTMLParser):
    """One page's blocks of text in order, (path, text, inside main), those that only a class, id or role word rules
    out, (path, text), and the child sequences of all nodes that may hold text. A path is the hash of its parent's and
    of the element's tag and class words, so that it is short at any depth."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        # an open element: tag, its path, the path of its block, dropped, the marked element around it (-1: none), inside main, tags of its children
        self.stack: list[tuple[str, str, str, bool, int, bool, list[str]]] = [("", "", "", False, -1, False, [])]
        self.marked: list[Marked] = []
        self.stated = self.clear = False  # has a main element, and one that no word rules out
        self.runs: list[list[tuple[str, str, int, bool]]] = []
        self.run: list[tuple[str, str, int, bool]] = []
        self.shapes: list[tuple[str, str]] = []
        self.feed(html)
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.blocks: list[tuple[str, str, bool]] = []
        self.doubtful: list[tuple[str, str]] = []
        self._judge()

    def _flush(self) -> None:
        if self.run:
            self.runs.append(self.run)
            self.run = []

    def _pop(self) -> None:
        _, path, _, dropped, _, _, children = self.stack.pop()
        if not dropped:
            self.shapes.append((path, ",".join(children)))

    def _judge(self) -> None:
        """Part the text into what counts and what words rule out. Spared is the element with more than half of the main
        text, if a main element without a mark is in it or nowhere else; and, on a page without main elements, one
        with more than half of all text whose words may name a layout."""
        size = main_size = 0
        for run in self.runs:
            for _, data, mark, main in run:
                n = len(data) - data.count(" ") - data.count("\n")
                size, main_size = size + n, main_size + n * main
                if mark >= 0:
                    self.marked[mark].size += n
                    self.marked[mark].main_size += n * main
        for m in reversed(self.marked):  # an element comes after those around it
            if m.around >= 0:
                around = self.marked[m.around]
                around.size, around.main_size, around.holds = around.size + m.size, around.main_size + m.main_size, around.holds or m.holds
        free: list[bool] = []
        for m in self.marked:
            if self.stated:
                spared = not m.inside and 2 * m.main_size > main_size and ((m.holds and m.layout) or not self.clear)
            else:
                spared = m.layout and 2 * m.size > size
            free.append(spared and (m.around < 0 or free[m.around]))
        for run in self.runs:
            kept = [(path, data, main) for path, data, mark, main in run if mark < 0 or free[mark]]
            words = "".join(data for _, data, _ in kept).split()
            if words:
                self.blocks.append((kept[0][0], " ".join(words), kept[0][2]))
            if len(kept) < len(run):
                out = [(path, data) for path, data, mark, _ in run if mark >= 0 and not free[mark]]
                words = "".join(data for _, data in out).split()
                if words:
                    self.doubtful.append((out[0][0], " ".join(words)))
        self.runs = []

    def _end(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """End the innermost open element of these tags, unless one of the scope stands between."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if tag in CLOSES_P:
                self._end(("p",), ("article", "section", "div", "td", "th", "button", "li"))
            if tag in SAME:
                self._end(SAME[tag], SCOPE.get(tag, ()))
        if tag in VOID:
            return
        given = dict(attrs)
        names = " ".join(given.get(k) or "" for k in ("class", "id", "role")).lower()
        _, path, block_path, dropped, mark, main, children = self.stack[-1]
        hidden = "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        dropped = dropped or tag in DROPPED or hidden or (tag == "header" and not main)
        is_main = tag in MAIN or given.get("role") == "main"
        marks = _marks(tag, names, main) if not dropped and tag not in ("html", "body") else set()
        if is_main and not dropped:
            self.stated = True
            if not marks and mark >= 0:
                self.marked[mark].holds = True
            self.clear = self.clear or (not marks and mark < 0)
        if marks:
            self.marked.append(Marked(mark, main, marks <= LAYOUTS))
            mark = len(self.marked) - 1
        children.append(tag)
        path = xxhash.xxh3_64_hexdigest(f"{path}/{tag}{''.join('.' + w for w in sorted(set(re.findall('[a-z]+', names))))}".encode("utf-8", "replace"))
        self.stack.append((tag, path, path if block else block_path, dropped, mark, main or is_main, []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        # a stray end tag of something inside does not end what encloses it
        self._end((tag,), () if tag in ("html", "body", "article", "main") else ("article", "main", "body"))

    def handle_data(self, data: str) -> None:
        _, _, path, dropped, mark, main, _ = self.stack[-1]
        if not dropped:
            self.run.append((path, data, mark, main))

    def unknown_decl(self, data: str) -> None:
        """A CDATA section or the like is markup."""


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _features(page: Page) -> set[tuple[str, str, int]]:
    """What a page adds to its host's tree: (path, kind, number)."""
    own = {(path, "text", _number(text)) for path, text, _ in page.blocks}
    own |= {(path, kind, number) for path, text in page.doubtful for kind, number in (("text", _number(text)), ("word", 0))}
    own |= {(path, "shape", _number(shape)) for path, shape in page.shapes}
    return own | {(path, "node", 0) for path, _, _ in own}


def _feature_counts(pages: DataFrame, html: str, host: str) -> DataFrame:
    """host, path, kind, feature and on how many of the host's distinct pages (n) it stands. Pages of a host that have
    the same nodes and texts are one page, whatever else their html holds: copies do not make a text furniture. Pages
    are told apart by (host, hash) and features summed by all four, so that no host gathers in one task."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                hashes, found = [], []
                for source in part.column(1).to_pylist():
                    own = sorted(_features(Page(source)))
                    hashes.append(_number("\n".join(f"{path} {kind} {number}" for path, kind, number in own)))
                    found.append([{"path": path, "kind": kind, "feature": number} for path, kind, number in own])
                kind = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("feature", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, type=pa.int64()), pa.array(found, type=kind)], names=["host", "page", "found"])

    rows = pages.where(F.col(host) != "").select(F.col(host).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    distinct = rows.mapInArrow(features, "host string, page long, found array<struct<path string, kind string, feature long>>").dropDuplicates(["host", "page"])
    return distinct.select("host", F.explode("found").alias("f")).groupBy("host", "f.path", "f.kind", "f.feature").agg(F.count(F.lit(1)).alias("n"))


def style_tree(counts: DataFrame) -> DataFrame:
    """The merged tree of each host from its feature counts: host, path, distinct pages that have the node, whether a class, id or
    role word rules it out (worded), its texts with repeats (texts), presentation and content importance (0 to 1), and
    importance, their weighted sum. Counts have no nulls; a host with one page has content importance 1 throughout."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "path").agg(
        of("node", n).alias("pages"), of("text", n).alias("texts"), of("text", n * F.log(n)).alias("shared"), of("shape", n).alias("shapes"), of("shape", n * F.log(n)).alias("alike"), of("word", n).alias("words")
    )
    log = F.log(F.greatest("pages", F.lit(2.0)))
    return sums.select(
        "host",
        "path",
        "pages",
        (F.col("words") > 0).alias("worded"),
        "texts",
        F.when(F.col("texts") > 0, 1 - F.col("pages") / (F.col("pages") + UNSEEN) * F.col("shared") / F.col("texts") / log).otherwise(0.0).alias("content"),
        F.when(F.col("shapes") > 0, (F.log("shapes") - F.col("alike") / F.col("shapes")) / log).otherwise(0.0).alias("presentation"),
    ).withColumn("importance", 0.9 * F.col("content") + 0.1 * F.col("presentation"))


def verdicts(pages: DataFrame, html: str, host: str) -> DataFrame:
    """What the trees decide of nodes that hold text: host, kind, path, feature. Kinds: node (of low importance), text (one
    of low importance at another node, whose number is feature), word (a node that a word rules out and the tree does
    not). Null html counts as a page without text, a null or empty host has no tree; importance equal to the limit stays."""
    counts = written(_feature_counts(pages, html, host), "features")
    tree = style_tree(counts).where("texts > 0")
    low = F.col("importance") < LEAST_IMPORTANCE
    nodes = tree.where((low & ~F.col("worded")) | (~low & F.col("worded"))).select("host", F.when(low, "node").otherwise("word").alias("kind"), "path", F.lit(0).cast("long").alias("feature"))
    texts = counts.where((F.col("kind") == "text") & (F.col("n") > 1)).join(tree.where(~low), ["host", "path"])
    texts = texts.where(1 - F.col("pages") / (F.col("pages") + UNSEEN) * F.log(F.col("n").cast("double")) / F.log("pages") < LEAST_IMPORTANCE)
    return written(nodes.unionByName(texts.select("host", "kind", "path", "feature")), "verdicts")


def main_text(page: Page, told: set[tuple[str, str, int]]) -> list[str]:
    """The page's main blocks, by the roles that it states and what its host's tree tells (kind, path, feature)."""
    stated = any(main for *_, main in page.blocks)
    blocks = [(path, text) for path, text, main in page.blocks if main or not stated]
    kept = [text for path, text in blocks if ("node", path, 0) not in told and ("text", path, _number(text)) not in told] if told else [text for _, text in blocks]
    if kept:
        return kept
    return [text for _, text in blocks] if stated else [text for path, text in page.doubtful if ("word", path, 0) in told]


def extract(pages: DataFrame, html: str = "html", url: str = "url", out: str = "text", most_broadcast: int = 20_000) -> DataFrame:
    """pages with the main text of each, its blocks joined by a line feed; a column named as `out` is replaced.

    A page with article or main elements (or role=main) gets what stands in them; any other page gets its whole body.
    Dropped everywhere: elements that hold no text or whose tag, class, id or role names a menu, header, footer,
    sidebar, notice, advert, form, teaser, share box or reader comment (a header inside an article stays), and hidden
    ones. Class, id and role words do not rule out the element with most of the main text (see Page).
    Of what is left, in main elements or not, those nodes and texts go whose importance in the host's style tree is low.
    If that leaves nothing, a page with main elements keeps what stands in them, and any other page gets the nodes
    that only a class, id or role word rules out and that are important in the tree. Null, empty or
    broken html gives what text there is, "" at least; a page without a host has no style tree. Equal rows stay rows.
    """
    columns = [c for c in pages.columns if c != out]
    host, noise = fresh(pages, "host_", "noise_")
    own = pages.select(*columns, F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\w[\w+.-]*://([^/?#]*)", 1)).alias(host))
    found = verdicts(own, html, host)
    small = found.limit(most_broadcast + 1).count() <= most_broadcast
    low = found.groupBy("host").agg(F.collect_list(F.struct("kind", "path", "feature")).alias("found")).select(F.col("host").alias(host), F.col("found").alias(noise))
    joined = own.join(F.broadcast(low) if small else low, host, "left")
    schema = pages.select(*columns).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                texts = []
                for source, found in zip(part.column(html).to_pylist(), part.column(noise).to_pylist(), strict=True):
                    told = {(x["kind"], x["path"], x["feature"]) for x in found or ()}
                    texts.append("\n".join(main_text(Page(source or ""), told)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, type=pa.string())], names=[*columns, out])

    return joined.mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
