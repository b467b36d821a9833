"""Main text of web pages by structure and by differencing pages of nearest URL.

A page is cut into lines (blocks) with a zone: dropped by structure (elements such as nav, header, footer, aside, form, script; and elements whose role, class or id
says nothing but advert, notice, side bar, comments or the like), inside an article or main element, or neither. End tags that HTML lets a page leave out are implied.

Pages of a host are sorted by URL path, and each is paired with the neighbour whose path shares the longer beginning (ties: the one before). The lines of both, but
for those dropped by structure, are aligned by a longest common subsequence. A neighbour that shares over ``MIRROR`` of the page's text is a mirror: it tells nothing
about the frame, and the other neighbour is taken. The shared lines of all pairs are pooled by host, and delete:

* lines outside articles, wherever a page of the host has one that some pair shares: the site's frame. So a mirrored page loses its frame, too;
* lines inside articles only if ``SURE_PAIRS`` pairs or more share them and these are ``SURE_SHARE`` of all pairs of the host: a line such as "Share this article".
  Copies of an article under neighbouring URLs, and passages that articles share, are text and stay.

All other lines outside the dropped structure are the main text, in page order. A page that is alone on its host, or has mirrors only, is left to structure and to what the host's
other pairs tell.

Pages are sorted by a range shuffle of keys and line hashes only, so a host with a third of all pages is spread over many tasks; pages at
the edges of a partition (two each) find their neighbours in a window over these edges alone. Pooled lines are counted in the tasks before they are shuffled.

Nulls: a null html is empty and gives the empty text; a null url has an empty host and path. Repeated rows and equal URLs are neighbours like any other, in the order of
the written table; equal pages are mirrors. Very long pages are read whole, in time linear in their length but for the alignment, which takes lines squared / 64. An empty
table gives an empty result.
"""

from __future__ import annotations

import html as markup
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

MIRROR = 0.5
#: Pairs of a host that must share a line inside articles, and their share of the host's pairs, before it is deleted.
SURE_PAIRS, SURE_SHARE = 8, 0.75
#: Elements whose content is never main text, elements that don't end a line, elements without content.
DROPPED = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea head title menu dialog canvas object audio video map datalist".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements whose start ends an open paragraph, by HTML's rules.
ENDS_P = frozenset("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
#: An element's start ends the open elements named, down to the nearest of the others, by HTML's rules.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Elements through which no paragraph is ended from inside.
BARRIER = frozenset("table td th caption html template object button".split())
#: Words of a class, id or role that mark what is not main text, and words that say nothing beside them.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert sidebar sidebars aside comment comments discussion replies "
    "reply footer header masthead nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager "
    "copyright disclaimer legal search searchbox complementary contentinfo".split()
)
NEUTRAL = frozenset("area bar block bottom box button buttons col column container content form global group holder inner item items left links list main outer page panel posts primary reader right row secondary section site slot text top user visitor wrap wrapper".split())
START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
#: What ends a tag, or begins a quoted value in it.
INSIDE = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
STRUCTURE, ARTICLE, OTHER = 0, 1, 2


def marked(attributes: str) -> bool:
    """Whether a class, id or role says that an element is not main text, and nothing else: "ad-banner" does, "legal-analysis" doesn't."""
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
            if any(w in MARKED for w in words) and all(w in MARKED or w in NEUTRAL for w in words):
                return True
    return False


class Open:
    """The open elements, with the number of those that drop their content and of articles. Every step takes constant time, spread over the page."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bool, bool]] = []  # name, drops, is an article
        self.at: dict[str, list[int]] = defaultdict(list)  # positions by name
        self.blocks: list[int] = []  # positions of elements that aren't inline
        self.dropping = self.articles = 0

    def push(self, name: str, drops: bool) -> None:
        article = name in ("article", "main")
        self.at[name].append(len(self.names))
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.names.append((name, drops, article))
        self.dropping += drops
        self.articles += article

    def pop_to(self, size: int) -> None:
        while len(self.names) > size:
            name, drops, article = self.names.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.dropping -= drops
            self.articles -= article

    def last(self, names: frozenset[str] | set[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def start(self, name: str, drops: bool) -> None:
        if name in IMPLIED:
            ended, down_to = IMPLIED[name]
            while (i := self.last(ended)) > self.last(down_to):
                self.pop_to(i)
        if name in ENDS_P and self.at.get("p") and self.at["p"][-1] > self.last(BARRIER):
            self.pop_to(self.at["p"][-1])
        if name not in VOID:
            self.push(name, drops)

    def end(self, name: str) -> None:
        if not self.at.get(name):
            return
        i = self.at[name][-1]
        if name in INLINE and self.blocks and i < self.blocks[-1]:
            return  # an inline element left open outside this block
        if name == "p" and i < self.last(BARRIER):
            return
        self.pop_to(i)


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page with their zones, in page order, white space made single and trimmed."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    stack, at = Open(), 0
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            out.append((text, STRUCTURE if stack.dropping else ARTICLE if stack.articles else OTHER))
        words.clear()

    def tag_end(i: int) -> int:
        """The position behind the tag that is open at ``i``; 0 if it isn't closed."""
        first = i
        while i <= last_end and (m := INSIDE.search(page, i)):
            i = m.end()
            if not m[1]:
                return i
            if last_quote[m[1]] >= i:
                i = page.index(m[1], i) + 1
        return page.find(">", first) + 1

    while m := START.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            words.append(markup.unescape(piece) if "&" in piece else piece)
        if m[1]:
            stop = page.find("-->", m.end())
            at = stop + 3 if stop >= 0 else len(page)
            continue
        at = tag_end(m.end()) if m.end() <= last_end else 0
        if not at:  # no tag is closed any more: the rest is no text
            at = len(page)
            break
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if name not in INLINE or stack.dropping:
                flush()
            stack.end(name)
            continue
        drops = name in DROPPED
        attributes = page[m.end() : at - 1]
        if not drops and attributes and name not in VOID and name not in ("html", "body", "main"):
            drops = marked(attributes)
        if name not in INLINE or drops:
            flush()
        if name in RAW:
            stop = re.compile(rf"</{name}[\s>/]", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 or len(page) if stop else len(page)
            continue
        stack.start(name, drops)
    if at < len(page):
        words.append(markup.unescape(page[at:]))
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence of ``a`` and ``b``, by bit-parallel rows."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    row, full, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append(i)
    return out[::-1]


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, mark, url, host, path, and the lines outside the dropped structure: their texts, whether inside an article, hashes and lengths."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    known = F.instr(url, "://") > 0
    part = lambda i: F.when(known, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)).otherwise(F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.monotonically_increasing_id().alias("mark"), F.col("url").cast("string"), F.lower(part(1)).alias("host"), part(2).alias("path"), F.col("html").cast("string"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page in common.texts_of(batch.column(5)):
            lines = [(t, z == ARTICLE) for t, z in lines_of(page) if z != STRUCTURE]
            out.append(([t for t, _ in lines], [z for _, z in lines], [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t, _ in lines], [len(t) for t, _ in lines]))
        kinds = (pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds))], names=["page_id", "mark", "url", "host", "path", "lines", "inside", "hashes", "sizes"])

    return common.map_batches(rows, run, "page_id long, mark long, url string, host string, path string, lines array<string>, inside array<boolean>, hashes array<long>, sizes array<long>")


def aligned(own: dict, before: dict | None, after: dict | None) -> tuple[int, set[int]] | None:
    """The partner's mark and the hashes of the shared lines, of the nearest neighbour that is no mirror; None if there is none."""
    others = [(shared_prefix(own["path"], x["path"]), x) for x in (before, after) if x is not None and x["host"] == own["host"]]
    for _, partner in sorted(others, key=lambda x: -x[0]):
        shared = common_lines(own["hashes"], partner["hashes"])
        if sum(own["sizes"][i] for i in shared) <= MIRROR * sum(own["sizes"]):
            return partner["mark"], {own["hashes"][i] for i in shared}
    return None


def pairs_of(keys: DataFrame) -> DataFrame:
    """host and shared (hashes) of every page that a neighbour tells something about, the pages sorted by host, path and mark.

    Pages are aligned where they are sorted, so only what pairs share is kept; the pages at the edges of a partition go on with their lines to meet their neighbours.
    """
    names, kinds = ["mark", "host", "path", "hashes", "sizes"], [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    page, shared = pa.struct(list(zip(names, kinds))), pa.list_(pa.int64())
    dealt = keys.select(*names).repartitionByRange("host", "path", "mark").sortWithinPartitions("host", "path", "mark")

    def told(own: dict, before: dict | None, after: dict | None) -> list[tuple]:
        found = aligned(own, before, after) if own["hashes"] else None
        return [(own["host"], sorted(found[1]))] if found else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None

        def rows(inner: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*[(*r, None, None, None) for r in inner], *[(None, None, *r) for r in edges])) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), shared, page, page, page))], names=["host", "shared", "own", "before", "after"])

        for batch in it:
            inner, edges = [], []
            for values in zip(*(batch.column(i).to_pylist() for i in range(5))):
                after = dict(zip(names, values))
                if now is not None and before is None:
                    edges.append((now, None, after))
                elif now is not None:
                    inner += told(now, before, after)
                before, now = now, after
            yield rows(inner, edges)
        if now is not None:
            yield rows([], [(now, before, None)])

    def edge_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [r for triple in zip(*(batch.column(i).to_pylist() for i in range(3))) for r in told(*triple)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 2, (pa.string(), shared))], names=["host", "shared"])

    struct = "struct<mark:long,host:string,path:string,hashes:array<long>,sizes:array<long>>"
    found = common.cut_lineage(keys.sparkSession, dealt.mapInArrow(run, f"host string, shared array<long>, own {struct}, before {struct}, after {struct}"))
    order = Window.orderBy("own.host", "own.path", "own.mark")  # over two rows a partition
    edges = found.where("own is not null").select("own", F.coalesce("before", F.lag("own").over(order)).alias("before"), F.coalesce("after", F.lead("own").over(order)).alias("after"))
    return found.where("own is null").select("host", "shared").unionByName(common.map_batches(edges, edge_pairs, "host string, shared array<long>"))


def frames(keys: DataFrame) -> DataFrame:
    """host, hash, pairs that share the line and pairs of the host, of every line that some pair shares."""
    pairs = pairs_of(keys)
    lines = pairs.select("host", F.explode("shared").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("pairs"))
    return lines.join(pairs.groupBy("host").agg(F.count("*").alias("all_pairs")), "host")


def deleted_lines(rows: DataFrame) -> DataFrame:
    """mark and deleted (positions among the lines) of the pages that lose lines by differencing."""
    frame = common.cut_lineage(rows.sparkSession, frames(rows))
    sure = (F.col("pairs") >= SURE_PAIRS) & (F.col("pairs") >= SURE_SHARE * F.col("all_pairs"))
    own = rows.select("mark", "host", F.posexplode(F.arrays_zip("hashes", "inside")).alias("pos", "line")).select("mark", "host", "pos", F.col("line.hashes").alias("hash"), F.col("line.inside").alias("inside"))
    return own.join(frame, ["host", "hash"]).where(~F.col("inside") | sure).groupBy("mark").agg(F.collect_set("pos").alias("deleted"))


def main_text(spark: SparkSession, pages: DataFrame, differencing: bool = True) -> DataFrame:
    """page_id, url, text and n_deleted (lines that differencing took away) of every page."""
    common.prepare(spark)
    rows = common.written(spark, parsed(pages), "pages")
    if not differencing:
        return rows.select("page_id", "url", F.array_join("lines", " ").alias("text"), F.lit(0).cast("long").alias("n_deleted"))
    # as a table its size is known: Spark sends a small one whole, and shuffles the texts only beside a larger one
    gone = common.written(spark, deleted_lines(rows).withColumnRenamed("mark", "_mark"), "deleted-lines")
    left = F.filter("lines", lambda _, i: ~F.coalesce(F.array_contains("deleted", i), F.lit(False)))
    out = rows.join(gone, F.col("mark") == F.col("_mark"), "left")
    return out.select("page_id", "url", F.array_join(left, " ").alias("text"), F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark, common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")
