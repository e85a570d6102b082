"""Main texts of web pages by templates that are deduced from each host's pages (equivalence classes of tokens).

A page is read to elements and blocks of text. Its tokens are the elements, told apart by their path of
tags and names, and the texts of blocks with their path. Over the pages of a host a token has an occurrence
vector, its count on each page; vectors are compared by two sums of hashes of (page, count), so they are
never put together, and a host with a third of all pages is summed up in all tasks first. Tokens with equal
vectors that stand on at least `SUPPORT` of the host's pages are an equivalence class. On a page, a class is
valid if its tokens stand in the class' order there and, but for the root (the largest class of tokens that
stand once on every page), if all lie between the same two of the root's. Valid classes are the template;
what lies between its tokens is the slots' content. Slots in menus, headers, footers, sidebars, notices,
adverts, forms and comments, by element, role or name, are left out. Of the rest, those in the article (or
else in the main part, or in a part named as content) make the text; a page without such a part gives all
rest but slots whose text on the host is mostly links. Texts of valid classes are template, so they
are left out too, if the host has `LEAST` different pages and the page has other text in the same part.

Pages of hosts with few pages have no template texts and are read by their own structure alone.
A host's template holds at most 1 / SUPPORT times the tokens of its average page.

Defined results: null and empty pages give an empty text; ids and urls may be null or repeat, every row
gives a row; pages without a host are one host; an empty table gives none; other columns are ignored. A comment,
script or style that isn't closed reaches to the end of the page; a tag that isn't closed is text.
White space is what Unicode calls so, no-break spaces too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, table, written

SUPPORT = 0.9
LEAST = 4
CLASS_SIZE = 3
LINKS = 0.5

# HTML elements, and names by which pages mark their parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
END = {t: re.compile(f"</{t}", re.IGNORECASE) for t in RAW}
CLOSES = {k: (set(a.split()), set(b.split())) for k, (a, b) in CLOSES.items()}
ASIDE = set("nav footer aside form button select option input dialog menu svg object canvas audio video head fieldset datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs topbar masthead footer sidebar aside widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist reply replies respond disqus discussion newsletter subscribe subscription signup login search pagination pager toolbar copyright skip hidden".split()
)
HEADS = {"header", "head"}
OPPOSITE = {"with", "has", "no", "without"}
OTHER_ARTICLE = set("comment comments reply related recommended ad ads advert sponsored promo teaser".split())
CONTENT = set("article content main post entry story articlebody maincontent".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z]+")
UPPER = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A quote that is left open reaches to the page's end; after so many, tags end at the next bracket.
QUOTES = 16
MARKED = ("class", "id", "role", "itemprop", "hidden", "style", "aria")

#: How deep in the article a block is: in an article, in the main part, in a part named as content, in none.
ARTICLE, MAIN, NAMED, NONE = 3, 2, 1, 0
TOKENS = "host string, token long, is_text boolean, page long, n long, first long, chars long, links long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """blocks: (text, path, part, aside, place, link characters); tokens: token -> [is text, count, first place, characters, link characters]."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, int, bool, int, int]] = []
        self.tokens: dict[int, list] = {}
        self._stack: list[tuple[str, int, int, bool]] = [("", 0, NONE, False)]  # tag, path, part, aside
        self._opened: Counter[str] = Counter()
        self._text: list[str] = []
        self._links, self._in_link, self._place = 0, False, 0
        self._read(html)
        self._end_block()

    def _token(self, token: int, is_text: bool) -> list:
        held = self.tokens.setdefault(token, [is_text, 0, self._place, 0, 0])
        held[1] += 1
        return held

    def _end_block(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            _, path, part, aside = self._stack[-1]
            self._place += 1
            self.blocks.append((text, path, part, aside, self._place, self._links))
            self._token(xxhash.xxh64_intdigest(text, seed=path), True)
            if path in self.tokens:
                self.tokens[path][3] += len(text)
                self.tokens[path][4] += self._links
        self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if stack[-1][0] == "p":
            self._pop(len(stack) - 1)
        if tag in CLOSES:
            same, bounds = CLOSES[tag]
            k = len(stack) - 1 if any(self._opened[t] for t in same) else 0
            while k and stack[k][0] not in bounds:
                if stack[k][0] in same:
                    self._pop(k)
                k -= 1
        _, path, part, aside = stack[-1]
        label, names, hidden = tag, (), False
        if attributes and any(m in attributes for m in MARKED):
            found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
            marks = " ".join(found.get(a, "") for a in ("class", "id", "itemprop"))
            names = NAME.findall(UPPER.sub(" ", marks).lower())
            label = " ".join((tag, *names))
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or found.get("role", "").lower() in ROLES
            if found.get("role", "").lower() == "main":
                part = max(part, MAIN)
        names = set(names)
        if tag == "article":
            aside = aside or hidden or not names.isdisjoint(OTHER_ARTICLE)
            part = ARTICLE
        elif tag not in ("main", "body", "html"):
            named = not names.isdisjoint(NAMES) and names.isdisjoint(OPPOSITE)
            head = part < ARTICLE and (tag == "header" or not names.isdisjoint(HEADS))
            aside = aside or hidden or tag in ASIDE or named or head
            if not names.isdisjoint(CONTENT):
                part = max(part, NAMED)
        elif tag == "main":
            part = max(part, MAIN)
        path = xxhash.xxh64_intdigest(label, seed=path)
        self._place += 1
        self._token(path, False)
        stack.append((tag, path, part, aside))
        self._opened[tag] += 1

    def _pop(self, to: int) -> None:
        for x in self._stack[to:]:
            self._opened[x[0]] -= 1
        del self._stack[to:]

    def _close(self, tag: str) -> None:
        k = len(self._stack) - 1
        if self._opened[tag]:
            while self._stack[k][0] != tag:
                k -= 1
            self._pop(k)

    def _say(self, text: str) -> None:
        if text:
            text = unescape(text)
            self._text.append(text)
            if self._in_link:
                self._links += len(text)

    def _read(self, html: str) -> None:
        at, size, failed, last = 0, len(html), 0, html.rfind(">")
        while at < size:
            start = html.find("<", at)
            if start < 0 or start > last and html[start + 1 : start + 2] != "!":
                break
            after = html[start + 1 : start + 2]
            if after == "!" or after == "?":
                self._say(html[at:start])
                comment = html.startswith("<!--", start)
                end = html.find("-->", start + 4) if comment else html.find(">", start)
                if end < 0:
                    return
                at = end + (3 if comment else 1)
                continue
            found = None
            if after == "/" or after.isascii() and after.isalpha():
                found = TAG.match(html, start) if failed < QUOTES else None
                if found is None:
                    failed += 1
                    found = BARE.match(html, start)
            if found is None:
                self._say(html[at : start + 1])
                at = start + 1
                continue
            self._say(html[at:start])
            at = found.end()
            closing, tag = found[1], found[2].lower()
            if tag in RAW:
                if not closing:
                    end = END[tag].search(html, at)
                    if end is None:
                        return
                    at = html.find(">", end.end()) + 1 or size
            elif tag in INLINE:
                if tag == "a":
                    self._in_link = not closing
            elif tag == "br" or tag == "img":
                self._text.append(" ")
            else:
                self._end_block()
                if tag not in VOID:
                    self._close(tag) if closing else self._open(tag, found[3])
        self._say(html[at:])


def tokens(pages: DataFrame) -> DataFrame:
    """The tokens of each page (host, html), one row each."""
    rows = pages.select("host", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                out: list[list] = [[] for _ in range(8)]
                for host, html in zip(b.column(0)[start : start + 256].to_pylist(), b.column(1)[start : start + 256].to_pylist(), strict=True):
                    if html:
                        page = signed(xxhash.xxh64_intdigest(html))
                        for token, (is_text, n, first, chars, links) in Page(html).tokens.items():
                            for column, v in zip(out, (host, signed(token), is_text, page, n, first, chars, links), strict=True):
                                column.append(v)
                kinds = (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in TOKENS.split(", ")])

    return rows.mapInArrow(run, TOKENS)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def deduce(pages: DataFrame) -> DataFrame:
    """(host, template): the tokens of each host's classes as (token, is_text, first, class, root), and its link slots as tokens without a class."""
    found = tokens(pages)
    # 31 bits of each hash, so that sums over 2 ** 32 pages fit
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "page", "n").bitwiseAND(F.lit((1 << 31) - 1)))
    by_token = found.groupBy("host", "token").agg(
        F.max("is_text").alias("is_text"), F.count("*").alias("support"), F.sum("n").alias("n"), F.avg("first").alias("first"),
        part(1).alias("v1"), part(2).alias("v2"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
    )
    by_token = written(by_token, "page-tokens")  # read several times below
    filled = pages.where(F.length("html") > 0)
    hosts = filled.groupBy("host").agg(F.count("*").alias("pages"), F.approx_count_distinct(F.xxhash64("html")).alias("distinct"))
    hosts = written(hosts, "page-hosts")
    rows = by_token.join(hosts, "host").where((F.col("support") >= SUPPORT * F.col("pages")) | (F.col("links") > LINKS * F.col("chars")))
    often = (F.col("support") >= SUPPORT * F.col("pages")) & (F.col("distinct") >= LEAST)
    sizes = rows.where(often).groupBy("host", "v1", "v2").agg(F.count("*").alias("size"), (F.min("n") == F.min("pages")).alias("once"), F.first("support").alias("on"), F.first("pages").alias("of"))
    sizes = sizes.where(F.col("size") >= CLASS_SIZE)
    sizes = sizes.withColumn("once", F.col("once") & (F.col("on") == F.col("of"))).drop("on", "of")
    largest = sizes.where("once").groupBy("host").agg(F.max(F.struct("size", "v1", "v2")).alias("root"))
    sizes = sizes.join(largest, "host", "left")
    root = F.coalesce((F.col("root.v1") == F.col("v1")) & (F.col("root.v2") == F.col("v2")), F.lit(False))
    sizes = sizes.select("host", "v1", "v2", F.xxhash64("v1", "v2").alias("class"), root.alias("is_root"))
    rows = rows.join(sizes, ["host", "v1", "v2"], "left")
    in_class = F.col("class").isNotNull() & often
    link_slot = ~F.col("is_text") & (F.col("links") > LINKS * F.col("chars"))
    rows = rows.where(in_class | link_slot)
    one = F.struct("token", "is_text", "first", F.when(in_class, F.col("class")).alias("class"), F.coalesce("is_root", F.lit(False)).alias("root"), link_slot.alias("links"))
    return rows.groupBy("host").agg(F.collect_list(one).alias("template"))


def template_texts(page: Page, template: list[dict]) -> set[int]:
    """The text tokens of the template's classes that are valid on the page."""
    places = {t: held[2] for t, held in page.tokens.items()}
    classes: dict[int, list[dict]] = {}
    for x in template:
        if x["class"] is not None and x["token"] % (1 << 64) in places:
            classes.setdefault(x["class"], []).append(x)
    root: list[int] = []
    out: set[int] = set()
    for _, members in sorted(classes.items(), key=lambda c: (not c[1][0]["root"], c[0])):
        members.sort(key=lambda x: (x["first"], x["token"]))
        at = [places[x["token"] % (1 << 64)] for x in members]
        ordered = all(a <= b for a, b in zip(at, at[1:], strict=False))
        nested = not root or bisect_right(root, at[0]) == bisect_right(root, at[-1])
        if ordered and (nested or members[0]["root"]):
            out |= {x["token"] % (1 << 64) for x in members if x["is_text"]}
            root = at if members[0]["root"] else root
    return out


def main_blocks(page: Page, template: list[dict]) -> list[str]:
    """The page's blocks of main text."""
    rest = [b for b in page.blocks if not b[3]]
    if not rest:
        return []
    part = max(b[2] for b in rest)
    mine = [b for b in rest if b[2] == part]
    if part == NONE:
        menus = {x["token"] % (1 << 64) for x in template if x["links"]}
        mine = [b for b in mine if b[1] not in menus and b[5] <= LINKS * len(b[0])] or mine
    fixed = template_texts(page, template)
    own = [b for b in mine if xxhash.xxh64_intdigest(b[0], seed=b[1]) not in fixed]
    return [b[0] for b in own or mine]


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every row: its main text, the blocks joined by a space."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    known = written(deduce(rows), "templates")
    left, right = dealt(rows, known, "host", "id", counted=rows.select("host"))
    joined = left.join(right, ["host", "_salt"], "left").select("id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i in range(b.num_rows):
                html = b.column(2)[i].as_py()
                texts.append(" ".join(main_blocks(Page(html), b.column(3)[i].as_py() or [])) if html else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
