"""Main text of web pages by the style trees of their sites.

The DOMs of a host are merged: element nodes with the same path of tags and classes are one node of its style tree.
A node's importance is the entropy, over the pages that have it, of its contents and of its presentation
(the sequence of its child tags), each scaled to 0 to 1. Branches of low importance, which say the same on
many pages, are removed from each page, inside and outside of article and main elements alike; what lies in
these weighs MAIN_WEIGHT times as much. Pages of a host with the same blocks count once, so copies of a page
do not make its text unimportant. Roles weigh in before that: navigation, forms, adverts and the like have none,
whatever the tree says. Forms and elements that have such a role only by a word of class, id or role are plain
containers if they hold more than half of a page's text and of the text of its main elements; html, body, main
and article have no role by words.
"""

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspan.llm.cluster import checkpoint

# Elements and words of class, id and role by what they are for.
DROPPED = set("head script style noscript template iframe object embed svg canvas math audio video map button select option textarea input datalist nav footer aside dialog menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = set("nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar widget related ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login search form comment comments disqus respond share sharing social pagination pager copyright contentinfo complementary dialog".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
MAIN = {"article", "main"}
NEVER_NOISE = {"html", "body", *MAIN}
MAIN_WEIGHT = 2.0
_MODULUS, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51  # of the hash of a sequence


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _attributes(raw: str) -> tuple[str, set[str], bool]:
    """(class, words of class, id and role, hidden)"""
    style, words, hidden = "", set(), False
    for name, *values in _ATTRIBUTE.findall(raw):
        value = next(filter(None, values), "").lower()
        name = name.lower()
        hidden |= name == "hidden"
        words.update(_WORDS.findall(value))
        if name == "class":
            style = ".".join(sorted(value.split()))
    return style, words, hidden


class Page:
    """Blocks of a page, and its element nodes by path, whatever their depth; memory is in proportion to the page.

    blocks: (innermost open element or -1, text). nodes: path -> [texts' hash, child tags' hash]. main: the paths of
    main elements and of all elements in them.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str]] = []
        self.nodes: dict[int, list[int]] = {}
        self.main: set[int] = set()
        self._elements: list[list[int]] = []  # parent or -1, path, first block, end of its blocks
        self._noise: set[int] = set()  # elements with a role by words, and forms
        self._content: set[int] = set()  # main elements without such words, and all elements in them
        self._stack: list[tuple[str, int, bool]] = []  # tag, element, dropped from here on
        self._count: Counter[str] = Counter()  # of the tags of the stack
        self._main = 0
        self._text: list[tuple[int, str]] = []  # innermost open element or -1, text
        self._spoken: list[tuple[int, list[tuple[int, str]]]] = []  # blocks before their roles are known
        self._parse(html)
        self._flush()
        self._pop(0)
        self._settle()
        self._add_texts()

    def _flush(self) -> None:
        if any(not t.isspace() for _, t in self._text):
            self._spoken.append((self._stack[-1][1] if self._stack else -1, self._text))
            self._text = []
        self._text.clear()

    def _holders(self) -> set[int]:
        """Those of _noise that hold more than half of the text, and of that of main elements if there is any."""
        own, main = ([0] * (len(self._elements) + 1) for _ in range(2))  # the last: outside of all elements
        for _, pieces in self._spoken:
            for e, text in pieces:
                n = len(text.strip())
                own[e] += n
                main[e] += n if e in self._content else 0
        whole, of_main = sum(own), sum(main)
        for e in range(len(self._elements) - 1, -1, -1):
            own[self._elements[e][0]] += own[e]
            main[self._elements[e][0]] += main[e]
        return {e for e in self._noise if 2 * own[e] > whole and (2 * main[e] > of_main or not of_main)}

    def _settle(self) -> None:
        """Blocks without the text of elements whose role has no importance; elements' blocks are numbered anew."""
        noise = self._noise - self._holders() if self._noise else set()
        dropped: list[bool] = []  # by element
        for e, (parent, *_) in enumerate(self._elements):
            dropped.append(e in noise or (parent >= 0 and dropped[parent]))
        at = [0]
        for element, pieces in self._spoken:
            if text := " ".join("".join(t for e, t in pieces if e < 0 or not dropped[e]).split()):
                self.blocks.append((element, text))
            at.append(len(self.blocks))
        for x in self._elements:
            x[2:] = at[x[2]], at[x[3]]

    def _pop(self, at: int) -> None:
        for tag, element, _ in self._stack[at:]:
            self._elements[element][3] = len(self._spoken)
            self._count[tag] -= 1
        del self._stack[at:]

    def _add_texts(self) -> None:
        """The hash of the blocks of each node's elements, one after another, from those of the blocks up to each."""
        upto, power = [0], [1]
        for _, text in self.blocks:
            upto.append((upto[-1] * _BASE + _hash(text)) % _MODULUS)
            power.append(power[-1] * _BASE % _MODULUS)
        for _, path, first, end in self._elements:
            node = self.nodes[path]
            node[0] = ((node[0] - upto[first]) * power[end - first] + upto[end]) % _MODULUS

    def _open(self, tag: str, raw: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close("p")
        if tag in CLOSES and any(self._count[t] for t in CLOSES[tag]) and (at := next((i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] in CLOSES[tag]), -1)) >= 0:
            if not any(t in ("ul", "ol", "dl", "table") for t, _, _ in self._stack[at:]):
                self._close(self._stack[at][0])
        if tag == "br":
            self._text.append((self._stack[-1][1] if self._stack else -1, " "))
        _, parent, dropped = self._stack[-1] if self._stack else ("", -1, False)
        above = self._elements[parent][1] if parent >= 0 else 0
        if parent >= 0:
            self.nodes[above][1] = (self.nodes[above][1] * _BASE + _hash(tag)) % _MODULUS
        if tag in VOID:
            return
        style, words, hidden = _attributes(raw) if raw else ("", set(), False)
        inside = self._main > 0
        noise = tag in DROPPED or hidden or (not inside and tag == "header")
        by_words = bool(words & NOISE) or (not inside and "header" in words)
        path = _hash(f"{above}>{tag}.{style}")
        self.nodes.setdefault(path, [0, 0])
        element = len(self._elements)
        self._stack.append((tag, element, dropped or noise))
        if tag == "form" or (by_words and tag not in NEVER_NOISE):
            self._noise.add(element)
        if parent in self._content or (tag in MAIN and not by_words):
            self._content.add(element)
        self._elements.append([parent, path, len(self._spoken), 0])
        self._count[tag] += 1
        if tag in MAIN and not (dropped or noise):
            self._main += 1
        if self._main:
            self.main.add(path)

    def _close(self, tag: str) -> None:
        if not self._count[tag]:
            return
        at = next(i for i in range(len(self._stack) - 1, -1, -1) if self._stack[i][0] == tag)
        if any(t in BLOCKS for t, _, _ in self._stack[at:]):
            self._flush()
        for t, _, dropped in self._stack[at:]:
            self._main -= t in MAIN and not dropped
        self._pop(at)

    def _say(self, raw: str) -> None:
        if not self._stack:
            self._text.append((-1, unescape(raw) if "&" in raw else raw))
        elif not self._stack[-1][2]:
            self._text.append((self._stack[-1][1], unescape(raw) if "&" in raw else raw))

    def _parse(self, html: str) -> None:
        at = 0
        while m := _TAG.search(html, at):
            self._say(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        if not re.match(r"<[a-zA-Z/!?]", html[at:]):
            self._say(html[at:])

    def main_text(self, unimportant: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks outside unimportant branches."""
        out: list[bool] = []  # by element
        for parent, path, _, _ in self._elements:
            out.append(path in unimportant or (parent >= 0 and out[parent]))
        return "\n".join(t for e, t in self.blocks if e < 0 or not out[e])

    def digest(self) -> int:
        """Of the texts of all blocks: the same for copies of a page."""
        return _hash("\n".join(t for _, t in self.blocks))


def host_of(url: F.Column) -> F.Column:
    """The host of a url, lower case; null without one."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), F.lit("")))


def style_trees(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, pages (how many have the node), importance from 0 to 1, of every node of every host's style tree.

    Pages of a host with the same blocks count once. Rows are dealt by host, path and value, so a host of a third of
    all pages is many small counts. Null urls and pages take no part.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("main", pa.bool_()), ("kind", pa.int8()), ("value", pa.int64()), ("page", pa.int64())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, rows = batch.column(0).to_pylist(), ([], [], [], [], [], [])
            for host, text in zip(hosts, batch.column(1), strict=True):
                page = Page(text.as_py())
                digest = page.digest()
                for path, values in page.nodes.items():
                    for kind, value in enumerate(values):
                        for column, x in zip(rows, (host, path, path in page.main, kind, value, digest), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)

    source = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).where("host is not null and html is not null")
    found = source.mapInArrow(nodes, "host string, path long, main boolean, kind byte, value long, page long")
    values = found.groupBy("host", "path", "kind", "value").agg(F.count_distinct("page").alias("n"), F.max("main").alias("main"))
    kinds = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.max("main").alias("main"))
    entropy = F.when(F.col("pages") > 1, (F.ln("pages") - F.col("s") / F.col("pages")) / F.ln("pages")).otherwise(1.0)
    weighed = F.when(F.col("main"), F.least(F.lit(1.0), MAIN_WEIGHT * entropy)).otherwise(entropy)
    return kinds.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(weighed).alias("importance"))


def extract(pages: DataFrame, min_pages: int = 8, least: float = 0.2, broadcast_rows: int = 200_000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points), a row for each row of pages; a null page is empty.

    Nodes that min_pages different pages of a host or more have, with an importance under `least`, are removed. The list of
    them is broadcast up to broadcast_rows rows, beyond that joined by host.
    """
    low = checkpoint(style_trees(pages, url, html).where((F.col("pages") >= min_pages) & (F.col("importance") < least)).select("host", "path"))
    by_host = low.groupBy("host").agg(F.collect_list("path").alias("low")).withColumnRenamed("host", "__host")
    if low.count() <= broadcast_rows:
        by_host = F.broadcast(by_host)
    id_kind = pages.schema[page_id].dataType.simpleString()
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    joined = source.join(by_host, host_of(F.col("url")) == F.col("__host"), "left").select("page_id", "url", "html", "low")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(h).main_text(set(low or ())) if h else "" for h, low in zip((x.as_py() for x in batch.column(2)), (x.as_py() for x in batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(texts, f"page_id {id_kind}, url string, text string, n_chars long")
