"""Main text of web pages by the style tree of their site.

Each page becomes its blocks, with the branches of the page's tree above each:
elements that hold blocks, by the path of tags and class names that leads to
them. Merged over all pages of a host these are the nodes of its style tree. A
node's presentation importance is the entropy, in base of its pages, of the
sequences of children that it has; its content importance is one less the mean
entropy of its blocks over its pages; both count as (1 - DECAY^l) and DECAY^l,
l the number of sequences. A block that is no part of a named main element is
also a node of its own, by its text. A branch counts for its importance times
the weight of its name, and is removed where that is under LOW. Names are known
for what pages share: menus, headers, adverts, comments. Their weight is under
LOW, so no entropy can save them and they go while the page is read; the main
element itself has importance 1, and where a page has one, all else of it goes.
A site of a few pages shows nothing about its other branches, which stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedseek.llm.common import stored

#: Importance under which a branch goes, share of the content for each further sequence of children, pages that a site needs to be judged.
LOW, DECAY, PAGES = 0.3, 0.9, 5

#: HTML's elements without content, those that end a paragraph, and those that the next of their kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
ENDS = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "option": ("option", {"select", "datalist"}), "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "tbody": ("tbody thead tfoot tr td th", {"table"}), "tfoot": ("tbody thead tr td th", {"table"}),
}
COMMENT_END = re.compile(r"--!?>")
#: Elements that hold running text: not branches unless they have a class.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody thead tfoot caption figcaption hgroup address center".split())

#: Elements, roles and class names of what isn't the text. A class name is known as a whole, by its last part, or by its first if that is in LEADING.
ASIDE = frozenset(
    "head title script style template noscript nav footer aside form iframe object svg canvas audio video select option button textarea input label fieldset legend dialog menu search map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
LEADING = frozenset(
    "ad ads advert adverts advertisement announcement banner breadcrumb breadcrumbs comment comments consent cookie footer gdpr login menu modal nav navbar newsletter notice pagination popup "
    "promo related share sidebar signup social sponsor sponsored subscribe trending widget".split()
)
NAMES = LEADING | frozenset(
    "advertising alert announcements commentlist copyright disclaimer discussion disqus feedback header legal masthead navigation notices notification overlay pager rail "
    "recommendations recommended replies reply respond search searchbox sharing skip sponsors subscription teaser teasers toolbar topbar widgets".split()
)
#: First parts of names that say something about the element's surroundings, or that make a header one of the text.
ABOUT, OWN = frozenset("has no with without is show hide".split()), frozenset("article post entry story content".split())
MAIN = frozenset("articlebody article-body article-content article-text entry-content post-content post-body story-body main-content maincontent".split())
COMMENTS = frozenset("comment comments reply replies".split())


def _set_aside(name: str) -> bool:
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not parts or parts[0] in ABOUT or (len(parts) > 1 and parts[-1] == "header" and parts[0] in OWN):
        return False
    return name in NAMES or parts[-1] in NAMES or parts[0] in LEADING


def _key(*parts: object) -> int:
    """64 bits, signed."""
    x = xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


class Element:
    """An open element. cut: it or one above is no part of the text; main: 2 in an article, 1 in another main element; branches: keys of the branches from there on; key: of its path."""

    __slots__ = ("branches", "cut", "key", "kids", "main", "tag")

    def __init__(self, tag: str, cut: bool, main: int, key: int, branches: tuple[int, ...], kids: list[str] | None):
        self.tag, self.cut, self.main, self.key, self.branches, self.kids = tag, cut, main, key, branches, kids


class Page(HTMLParser):
    """blocks: (text, main, key of the innermost branch, branches, whether a first heading) in page order; styles: for each branch the children of each of its elements."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, tuple[int, ...], bool]] = []
        self.styles: dict[int, list[list[str]]] = {}
        self.stack = [Element("", False, 0, 0, (), None)]
        self.held: list[str] = []
        html = html or ""
        last = html.rfind("<")
        if last > html.rfind(">") and re.match(r"<[/!?a-zA-Z]", html[last : last + 2]):
            html = html[:last]  # a tag that the end cuts
        self.feed(html)
        self.close()
        self._flush()

    def parse_comment(self, i: int, report: bool = True) -> int:
        """Where the comment at i ends; one without an end takes all that follows."""
        end = COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def _flush(self) -> None:
        text, self.held = " ".join("".join(self.held).split()), []
        top = self.stack[-1]
        if text and not top.cut:
            self.blocks.append((text, top.main, top.branches[-1] if top.branches else 0, top.branches, any(e.tag == "h1" for e in self.stack[-3:])))

    def _pop(self, to: int) -> None:
        if any(e.tag in BLOCK for e in self.stack[to:]):
            self._flush()
        del self.stack[to:]

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Ends what is open of tags, up to the innermost of until."""
        last = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in until:
                break
            if self.stack[i].tag in tags:
                last = i
        if last is not None:
            self._pop(last)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.held.append(" ")
        if tag in BLOCK:
            self._flush()
            self._close({"p"}, {"button", "table", "td", "th", "caption", "object"})
            if tag in ENDS:
                self._close(set(ENDS[tag][0].split()), ENDS[tag][1])
        if tag in VOID:
            return
        above = self.stack[-1]
        if above.cut:
            self.stack.append(Element(tag, True, above.main, 0, (), None))
            return
        own = {k: (v or "").lower() for k, v in attrs}
        names = f"{own.get('class', '')} {own.get('id', '')}".split()
        main = 2 if tag == "article" or own.get("role") == "article" or own.get("itemprop") == "articlebody" or MAIN.intersection(names) else 1 if tag == "main" or own.get("role") == "main" else 0
        if main:
            cut = any(COMMENTS.intersection(re.split(r"[-_]+", n)) for n in names)
        else:
            cut = tag in ASIDE or tag == "header" and not above.main or own.get("role") in ROLES or any(map(_set_aside, names)) or "hidden" in own or own.get("aria-hidden") == "true"
        # a branch: an element of the page's layout, or any with a class
        classes = sorted(own.get("class", "").split())
        label = ".".join([tag, *classes])
        if tag in BLOCK and above.kids is not None and above.kids[-1:] != [label]:
            above.kids.append(label)
        key, branches, kids = _key(above.key, label), above.branches, above.kids
        if main > above.main:
            branches, kids = (), None
        elif not cut and tag in BLOCK and (tag not in PROSE or classes):
            branches, kids = (*branches, key), []
            self.styles.setdefault(key, []).append(kids)
        self.stack.append(Element(tag, cut, max(main, above.main), key, branches, kids))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.held.append(" ")
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return  # an inline element that a block has ended

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].cut:
            self.held.append(data)


Seen = tuple[int, int, int]


def read(html: str | None) -> tuple[list[tuple[str, list[int]]], list[Seen]]:
    """Blocks of a page that no name sets aside, each with the nodes that could remove it; what the page shows of each branch: (branch, 0, sequence of children) and (branch, 1, block)."""
    page = Page(html)
    main = max((m for _, m, *_ in page.blocks), default=0)
    kept = [b for b in page.blocks if b[1] == main or (b[1] and b[4])]
    blocks, seen = [], set()
    for text, _, inner, branches, _ in kept:
        own = _key(inner, text)
        blocks.append((text, list(branches) if main else [*branches, own]))
        for x in branches:
            seen.add((x, 1, _key(x, text)))
            seen.add((x, 0, _key(*page.styles[x])))
        if not main and not branches:
            seen |= {(0, 1, own), (0, 0, 0)}
    return blocks, sorted(seen)


def host(url: str | None) -> str | None:
    found = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return found[1].lower() if found else None


READ = "page_id bigint, url string, k bigint, host string, text string, content bigint, blocks array<struct<text:string,nodes:array<bigint>>>, seen array<struct<node:bigint,kind:bigint,variant:bigint>>"
_ARROW = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("nodes", pa.list_(pa.int64()))])), pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int64()), ("variant", pa.int64())])))
#: Characters of pages that are worked on at once.
CHUNK = 8 << 20


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages whose text is settled have it; of others the blocks, and what they show of their branches."""
    names = ("page_id", "url", "k", "host", "text", "content", "blocks", "seen")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=list(names))

    rows, size = [], 0
    for batch in batches:
        for page_id, url, html, k in zip(*(batch.column(i) for i in range(4)), strict=True):
            blocks, seen = read(html.as_py())
            at, text = host(url.as_py()), "\n\n".join(t for t, _ in blocks)
            settled = at is None or not any(nodes for _, nodes in blocks)
            more = (None, None) if settled else ([{"text": t, "nodes": n} for t, n in blocks], [{"node": a, "kind": b, "variant": c} for a, b, c in seen])
            rows.append((page_id.as_py(), url.as_py(), k.as_py(), at, text if settled else None, _key(text), *more))
            size += len(text)
            if size > CHUNK or len(rows) >= 2000:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def importance(pages: DataFrame, decay: float = DECAY, least: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """Of pages as _read has them: (host, node, importance) of branches, (host, node, importance) of blocks.

    Pages with the same text on a host count once. Sums for each sequence and
    block come before those for a branch, so a host of any size is many keys.
    """
    one = pages.where(F.col("seen").isNotNull()).dropDuplicates(["host", "content"])
    seen = one.select("host", F.explode("seen").alias("x")).select("host", "x.node", "x.kind", "x.variant").groupBy("host", "node", "kind", "variant").agg(F.count("*").alias("n"))
    seen = stored(seen)
    style, nlogn = F.col("kind") == 0, F.col("n") * F.log("n")
    total = lambda when, x: F.sum(F.when(when, x))
    branch = seen.groupBy("host", "node").agg(
        total(style, F.col("n")).alias("m"), F.count_if(style).alias("l"), total(style, nlogn).alias("of_styles"), total(~style, F.col("n")).alias("blocks"), total(~style, nlogn).alias("of_blocks")
    )
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)))
    presentation, content = 1 - F.col("of_styles") / (F.col("m") * log_m), 1 - F.col("of_blocks") / (F.col("blocks") * log_m)
    share = F.pow(F.lit(decay), F.col("l"))
    judged = F.when(F.col("m") < least, 1.0).otherwise(F.round((1 - share) * presentation + share * content, 9))
    branch = stored(branch.withColumn("importance", judged).select("host", "node", "m", "importance"))
    shown = branch.where(F.col("m") >= least).select("host", "node", "m")
    block = seen.where(~style).join(shown, ["host", "node"]).select("host", F.col("variant").alias("node"), F.round(1 - F.log("n") / F.log("m"), 9).alias("importance"))
    return branch.select("host", "node", "importance"), block


def extracted(pages: DataFrame, low: float = LOW, decay: float = DECAY, least: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html).

    text: the blocks of the main text, each with runs of white space as one
    blank, joined by an empty line; empty for a null or empty html and where
    nothing is left. A page whose url names no host is a site of its own. Rows
    that repeat a page have the same text and count once in the tree. Pages are
    read whole, broken ones as browsers do: what is open at the end ends there.
    Other columns are not looked at.
    """
    rows = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("k"))
    found = stored(rows.mapInArrow(_read, READ))
    settled = found.where(F.col("blocks").isNull()).select("page_id", "url", "text")
    others = found.where(F.col("blocks").isNotNull())
    branch, block = importance(others, decay, least)
    gone = stored(branch.unionByName(block).where(F.col("importance") < low).select("host", "node").distinct())
    nodes = others.select("page_id", "k", "host", F.explode(F.array_distinct(F.flatten("blocks.nodes"))).alias("node"))
    cut = nodes.join(gone, ["host", "node"]).groupBy("page_id", "k").agg(F.collect_set("node").alias("cut")).toDF("own", "own_k", "cut")
    joined = others.join(cut, (F.col("k") == F.col("own_k")) & F.col("page_id").eqNullSafe(F.col("own")), "left")
    left = F.filter("blocks", lambda b: F.col("cut").isNull() | ~F.arrays_overlap(b["nodes"], F.col("cut")))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n")
    return settled.unionByName(joined.select("page_id", "url", text.alias("text"))).withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
