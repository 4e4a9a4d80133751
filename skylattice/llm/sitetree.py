"""Main text of web pages by site style trees.

Every page becomes a list of nodes: its elements with the path of presentations (tag and class) from
the root, and its text blocks. The pages of one host are merged into a style tree by that path. A
presentation node is important if the pages present its children in different ways; a content node
(a path with text) is important if its texts differ between pages: both by entropy over the host's
pages, between 0 (the same on every page) and 1. Pages of equal nodes count once there, so copies of a
page don't weigh. Branches whose every part has low importance are noise. A page loses those of its
blocks in them whose own text is on many of the host's distinct pages; a text that few share stays,
whatever the others have at its path. Markup that can hold no main text (scripts, forms, menus and the
like, by tag, role or a class word) is cut first, for a host with few pages shows no entropy. A page
that would lose all its blocks keeps them.

The merge is a sum over (host, path, form): no page list of a host is ever gathered. Pages meet the
noise branches of their host, then its cut texts, by broadcast if these are few bytes in all, counted
first, else by a join in which the pages of a host are dealt over ``SALTS`` parts. A host has few cut
texts: each is on more than a fixed power of the pages of its path.

Null html gives an empty text; a page without an article takes its whole body less the noise; null
urls form one host. Unclosed, crossed and unknown tags never fail. Repeated rows stay rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.session import materialize, ship_package

#: Importance below which a node of a style tree is noise, and the least pages of a host that can say so.
LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 8
SALTS = 16
#: Size of all cut branches up to which they are broadcast; larger ones meet their pages in a salted join.
BROADCAST_BYTES = 8 << 20

# How HTML elements behave.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr img br".split()
)
_NOISE_TAGS = frozenset("nav header footer aside form script style noscript button select textarea input iframe template dialog menu head title svg".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice popup modal newsletter subscribe nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments reply replies discussion share sharing social "
    "related recommended widget pagination pager login signup search toolbar skip".split()
)
# A new block of these kinds ends an open one of the same kind.
_CLOSES = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)

# Quotes count only behind an equals sign; anywhere else, as in title=it's, they are characters like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*))*+)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_CLASS_WORD = re.compile(r"[a-z]+")


def _presentation(tag: str, attributes: str) -> tuple[str, bool]:
    """The node's presentation (tag and class) and whether its markup says that it is noise."""
    if not attributes.strip():
        return tag, tag in _NOISE_TAGS
    own = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes)}
    style = own.get("class", "")
    words = {w for key in ("class", "id") for w in _CLASS_WORD.findall(own.get(key, "").lower())}
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
    noise = tag in _NOISE_TAGS or own.get("role", "").lower() in _NOISE_ROLES or hidden or (bool(words & _NOISE_WORDS) and tag not in ("html", "body", "main", "article"))
    return f"{tag}.{style}" if style else tag, noise


class Page:
    """A page's nodes. blocks: (path, text) of text blocks outside marked noise, in order; an entry of paths for every element path."""

    def __init__(self, text: str):
        self.blocks: list[tuple[str, str]] = []
        self.forms: list[tuple[str, str]] = []  # path and the presentations of its children, in order
        self._stack: list[list] = []  # tag, path, noise, article, distinct children
        self._open: list[str] = []
        self._inline = 0
        self.has_article = False
        self._articles: list[bool] = []
        self._parse(text)

    def _flush(self) -> None:
        if self._open:
            whole = _SPACE.sub(" ", entities.unescape("".join(self._open))).strip()
            self._open = []
            if whole:
                block = next((e for e in reversed(self._stack) if e[0] not in _INLINE), None)
                self.blocks.append((block[1] if block else "", whole))
                self._articles.append(bool(block and block[3]))

    def _close(self) -> None:
        tag, path, noise, _, children = self._stack.pop()
        if not noise and children:
            self.forms.append((path, ">".join(children)))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._end("p", within=("article", "section", "div", "td", "li", "body"), quiet=True)
        elif tag in _CLOSES:
            for other in _CLOSES[tag].split():
                self._end(other, within=("ul", "ol", "dl", "table", "select"), quiet=True)
        if tag not in _INLINE:
            self._flush()
        elif tag == "br":
            self._text(" ")
        if tag in _VOID:
            return
        style, noise = _presentation(tag, attributes)
        above = self._stack[-1] if self._stack else None
        if above is not None:
            if not above[4] or above[4][-1] != style:
                above[4].append(style)  # siblings of one presentation are one
            noise = noise or above[2]
        path = f"{above[1]}/{style}" if above else style
        if tag in _INLINE:
            path = above[1] if above else ""
        article = (above[3] if above else False) or tag in ("article", "main")
        self.has_article = self.has_article or (tag in ("article", "main") and not noise)
        self._stack.append([tag, path, noise, article, []])

    def _end(self, tag: str, within: tuple[str, ...] = (), quiet: bool = False) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                if tag not in _INLINE:
                    self._flush()
                    while len(self._stack) > k:
                        self._close()
                else:
                    self._stack.pop(k)
                return
            if self._stack[k][0] in within or (tag in _INLINE and self._stack[k][0] not in _INLINE):
                return
        if not quiet and tag == "p":
            self._flush()

    def _text(self, raw: str) -> None:
        if not (self._stack and self._stack[-1][2]):
            self._open.append(raw)

    def _parse(self, text: str) -> None:
        at, n = 0, len(text)
        while at < n:
            token = _TOKEN.search(text, at)
            if token is None:
                break
            if token.start() > at:
                self._text(text[at : token.start()])
            at = token.end()
            tag = token[2]
            if tag is None:
                if token[0].startswith("<![CDATA["):
                    self._text(entities_escape(token[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if token[1]:
                self._end(tag)
                continue
            if tag in _RAW:
                close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(text, at)
                at = close.end() if close else n
                if tag not in _INLINE:
                    self._flush()
                continue
            self._start(tag, token[3])
        if at < n:
            self._text(text[at:])
        self._flush()
        while self._stack:
            self._close()
        if self.has_article:
            self.blocks = [b for b, inside in zip(self.blocks, self._articles, strict=True) if inside]


def entities_escape(text: str) -> str:
    return text.replace("&", "&amp;")


def host_of(url):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


_NODE = T.StructType([T.StructField("path", T.StringType()), T.StructField("form", T.LongType()), T.StructField("is_text", T.BooleanType())])
_BLOCK = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parsed(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without html, with _host, _blocks (path, text), _nodes (path, form, is_text), one node for each path, and _page, their hash."""
    ship_package(pages.sparkSession)
    others = [c for c in pages.columns if c != html]
    rows = pages.select(*others, host_of(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    schema = T.StructType([*rows.drop("_html").schema.fields, T.StructField("_blocks", T.ArrayType(_BLOCK)), T.StructField("_nodes", T.ArrayType(_NODE)), T.StructField("_page", T.LongType())])
    blocks_type = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    nodes_type = pa.list_(pa.struct([("path", pa.string()), ("form", pa.int64()), ("is_text", pa.bool_())]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                blocks, nodes, hashes = [], [], []
                for text in batch.column("_html").to_pylist():
                    page = Page(text or "")
                    blocks.append([{"path": p, "text": t} for p, t in page.blocks])
                    forms: dict[tuple[str, bool], list[str]] = {}
                    for path, form in page.forms:
                        forms.setdefault((path, False), []).append(form)
                    for path, text_ in page.blocks:
                        forms.setdefault((path, True), []).append(text_)
                    nodes.append([{"path": p, "form": _hash("\0".join(f)), "is_text": is_text} for (p, is_text), f in forms.items()])
                    hashes.append(_hash("\0".join(x for pair in (*page.forms, ("", ""), *page.blocks) for x in pair)))
                kept = [batch.column(c) for c in schema.names[:-3]]
                made = [pa.array(blocks, blocks_type), pa.array(nodes, nodes_type), pa.array(hashes, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return rows.mapInArrow(kernel, schema)


def style_tree(parsed_pages: DataFrame) -> DataFrame:
    """host, path, is_text, pages, importance: the merged nodes of every host.

    Importance is the entropy of the forms that the pages give the node, as a share of its maximum;
    the forms of one node are summed by (host, path, form) first, so a common one is one row.
    """
    nodes = parsed_pages.select(F.col("_host").alias("host"), F.explode_outer("_nodes").alias("node")).filter("node IS NOT NULL")
    forms = nodes.groupBy("host", "node.path", "node.is_text", "node.form").agg(F.count(F.lit(1)).alias("n"))
    merged = forms.groupBy("host", "path", "is_text").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("weighted")
    )
    entropy = F.log2("pages") - F.col("weighted") / F.col("pages")
    return merged.select(
        "host", "path", "is_text", "pages", F.when(F.col("pages") > 1, entropy / F.log2("pages")).otherwise(1.0).alias("importance")
    )


def distinct_pages(parsed_pages: DataFrame, column: str) -> DataFrame:
    """_host and ``column`` of one page of each content on each host."""
    return parsed_pages.groupBy("_host", "_page").agg(F.first(column).alias(column)).drop("_page")


def noise_branches(tree: DataFrame) -> DataFrame:
    """host, noise (path, pages): paths with text whose contents and presentation are both of low importance on the host's many pages."""
    nodes = tree.filter(F.col("pages") >= LEAST_PAGES).groupBy("host", "path")
    text_pages = F.max(F.when(F.col("is_text"), F.col("pages"))).alias("pages")
    low = nodes.agg(F.max("importance").alias("importance"), text_pages).filter(
        F.col("pages").isNotNull() & (F.col("importance") < LEAST_IMPORTANCE)
    )
    return low.groupBy("host").agg(F.collect_list(F.struct("path", "pages")).alias("noise"))


def _meet(pages: DataFrame, hosts: DataFrame, size: Column) -> DataFrame:
    """``pages`` with the row of their host in ``hosts``, if any; size: the bytes of a row of ``hosts``."""
    if (hosts.agg(F.sum(size)).head()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(hosts), "_host", "left")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["_host", "_salt"], "left").drop("_salt")


def _key(block: Column) -> Column:
    return F.xxhash64(block["path"], block["text"])


def cut_texts(parsed_pages: DataFrame, noise: DataFrame) -> DataFrame:
    """_host, cut: keys of the blocks in noise branches that are on many distinct pages of their host.

    Entropy is the mean of what the single texts tell, the log of the share of pages without them; a text
    is cut if its own part of the maximum is low too: if n of the path's N pages have it, 1 - log n / log N.
    """
    size = F.octet_length("_host") + F.aggregate("noise", F.lit(0), lambda acc, x: acc + F.octet_length(x["path"]) + 8)
    met = _meet(parsed_pages.select("_host", "_page", "_blocks"), noise, size).filter("noise IS NOT NULL")
    of_path = F.map_from_entries("noise")
    within = F.transform(F.filter("_blocks", lambda b: F.map_contains_key(of_path, b["path"])), lambda b: F.struct(_key(b).alias("key"), of_path[b["path"]].alias("pages")))
    own = met.select("_host", "_page", F.array_distinct(within).alias("own")).filter(F.size("own") > 0)
    counted = distinct_pages(own, "own").select("_host", F.explode("own").alias("x")).groupBy("_host", "x.key", "x.pages").agg(F.count(F.lit(1)).alias("n"))
    many = F.log("n") > (1 - LEAST_IMPORTANCE) * F.log("pages")
    return counted.filter(many).groupBy("_host").agg(F.collect_set("key").alias("cut"))


def extracted(pages: DataFrame, *, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without html, with the main ``text`` and its length in characters, ``n_chars``."""
    if clash := {text, "n_chars", "_host", "_blocks", "_nodes", "_page"} & (set(pages.columns) - {html}):
        raise ValueError(f"columns {sorted(clash)} are there already")
    read = materialize(parsed(pages, url=url, html=html))
    noise = materialize(noise_branches(style_tree(distinct_pages(read, "_nodes"))).withColumnRenamed("host", "_host"))
    cut = materialize(cut_texts(read, noise))
    joined = _meet(read.drop("_nodes", "_page"), cut, F.octet_length("_host") + 8 * F.size("cut"))
    cut_keys = F.coalesce("cut", F.array().cast("array<long>"))
    left = joined.withColumn("_left", F.filter("_blocks", lambda b: ~F.array_contains(cut_keys, _key(b))))
    # A page whose every text is on many others is no frame of theirs: it stays as it is.
    kept = F.when(F.size("_left") > 0, F.col("_left")).otherwise(F.col("_blocks"))
    whole = left.withColumn("_text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n"))
    others = [c for c in pages.columns if c != html]
    return whole.select(*others, F.col("_text").alias(text), F.length("_text").cast("long").alias("n_chars"))
