"""Main text of web pages, with site template removal.

A page is read into blocks of text, each under the elements around it. All
element subtrees outside articles are hashed, and Spark counts on how many pages
of a host each hash occurs; blocks in a subtree that recurs on many pages of its
host are template. How many doesn't depend on the size of the host. A page is a
url here (a row, where it has none), so a page that was read often isn't taken
for a template of itself. What recurs inside an article or main element stays: a
site may show one article under many addresses.

A block goes for the first of these reasons that holds: ``template`` (its subtree
recurs), ``structure`` (tags and roles: menus, headers, footers, sidebars,
forms, scripts, styles), ``words`` (names of classes and ids: notices, adverts,
comments), ``outside`` (the page has an article or main element, and the block
isn't in it). ``decisions`` counts them. A page's text can depend on template
counts only where it has no such element, so just the blocks of those pages are
exchanged to meet their host's recurring hashes; html never is.

Of each subtree, no more pages than decide are listed before they are shuffled,
so a host with a third of all pages is no hot spot. Reading a page takes time in
proportion to its length, however broken it is.

Defined results: null or empty html gives an empty text; markup cut off at the
end of a page is no text, nor is what follows a tag that never ends; a quote that
never closes is one of its tag's characters; unclosed elements end with their
parent or the page; repeated rows give equal rows; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import checkpoint

#: A subtree is template if it is on so many pages of its host, whatever their share.
MIN_PAGES = 8

BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul option select".split())
DROPPED = frozenset("head title nav header footer aside form script style noscript template iframe svg math button select option textarea input label object embed canvas audio video dialog menu".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: An open element of these is closed by the start of one of those.
_P_ENDS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|sidenav|menu|nav|navbar|navigation|breadcrumbs?|toolbar|footer|header|masthead|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|widget|pagination|pager|skip)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>\x00]*)|(!--)|[!?/])")
#: The rest of a tag: quotes count after "=" only. Possessive, so that nothing is tried twice.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}


#: Why a block goes.
KEPT, TEMPLATE, STRUCTURE, WORDS, OUTSIDE = "kept", "template", "structure", "words", "outside"


@dataclass
class Element:
    tag: str
    number: int
    why: str  #: STRUCTURE or WORDS if that takes it out, else KEPT
    main: bool
    text: list[str] = field(default_factory=list)  #: text and hashes of inner elements, for the hash


@dataclass
class Page:
    """Blocks and elements in page order; an element's parent is before it, -1 for none."""

    texts: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)  #: each block's innermost element
    why: list[str] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    marks: set[int] = field(default_factory=set)  #: hashes of all subtrees outside articles
    has_main: bool = False

    def decide(self, recurring: set[int] | frozenset[int] = frozenset()) -> list[str]:
        """For each block, KEPT or why it goes."""
        bad: list[bool] = []
        if recurring:
            for up, h in zip(self.parents, self.hashes):
                bad.append(h in recurring or up >= 0 and bad[up])
        out = []
        for at, why, main in zip(self.at, self.why, self.main):
            if bad and not main and at >= 0 and bad[at]:
                out.append(TEMPLATE)
            elif why != KEPT:
                out.append(why)
            else:
                out.append(OUTSIDE if self.has_main and not main else KEPT)
        return out

    def text(self, recurring: set[int] | frozenset[int] = frozenset()) -> str:
        return join([t for t, d in zip(self.texts, self.decide(recurring)) if d == KEPT])

    @property
    def unsure(self) -> bool:
        """Whether the text may depend on what recurs."""
        return not self.has_main and KEPT in self.why


def _boilerplate(tag: str, attrs: str, words: bool) -> str:
    if tag in DROPPED:
        return STRUCTURE
    if not attrs:
        return KEPT
    for name, a, b, c in ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return STRUCTURE
        if words and name in ("class", "id") and tag not in ("html", "body", "article", "main") and BOILERPLATE.search(value):
            return WORDS
    return KEPT


def parse(source: str | None, words: bool = True) -> Page:
    """``words``: whether names of classes and ids count."""
    s = source or ""
    page = Page()
    stack: list[Element] = [Element("", -1, KEPT, False)]
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    pending: list[str] = []
    skipped, depth, level = "", 0, 0  # an inline element that is boilerplate, how often it is open, and the stack's height at its start

    def flush() -> None:
        if not pending:
            return
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            top = stack[-1]
            top.text.append(text)
            page.texts.append(text)
            page.at.append(top.number)
            page.why.append(top.why)
            page.main.append(top.main)

    def close() -> None:
        e = stack.pop()
        open_at[e.tag].pop()
        value = int.from_bytes(hashlib.blake2b("\x00".join([e.tag, *e.text]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
        page.hashes[e.number] = value
        if e.text:
            stack[-1].text.append(str(value))
            if not e.main and e.tag not in ("html", "body"):
                page.marks.add(value)

    def open_(tag: str, attrs: str) -> None:
        up = stack[-1]
        why = up.why if up.why != KEPT else WORDS if depth else _boilerplate(tag, attrs, words)
        main = up.main or tag in MAIN or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I) is not None
        page.has_main |= main and why == KEPT
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, len(page.hashes), why, main))
        page.parents.append(up.number)
        page.hashes.append(0)

    at = 0
    while True:
        m = MARKUP.search(s, at)
        if not depth and (m.start() if m else len(s)) > at:
            pending.append(html.unescape(s[at : m.start() if m else len(s)]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            end = COMMENT_END.search(s, at) if m[3] else None
            at = end.end() if end else len(s) if m[3] else s.find(">", at) + 1 or len(s)
            continue
        rest = REST.match(s, at)
        if rest is None:
            break
        at = rest.end()
        tag, attrs = m[2].lower(), rest[1]
        if m[1]:
            if tag in BLOCKS:
                flush()
                places = open_at.get(tag)
                wall = 0 if tag in ("html", "body", "article") else max((x[-1] for x in (open_at.get("article"), open_at.get("body")) if x), default=0)
                if places and places[-1] >= wall:
                    to = places[-1]
                    while len(stack) > to:
                        close()
                    if depth and len(stack) < level:
                        depth = 0
            elif tag == "br":
                pending.append(" ")
            elif depth and tag == skipped:
                depth -= 1
            continue
        if tag in RAW:
            at = ENDS[tag].search(s, at).start()
        elif tag in BLOCKS:
            flush()
            closes = _CLOSES.get(tag)
            if tag in _P_ENDS and stack[-1].tag == "p":
                close()
            while closes and stack[-1].tag in closes:
                close()
            if depth and len(stack) < level:
                depth = 0
            if tag not in VOID:
                open_(tag, attrs)
        elif tag in VOID:
            if tag == "br":
                pending.append(" ")
        elif depth:
            depth += tag == skipped
        elif not attrs.rstrip().endswith("/") and _boilerplate(tag, attrs, words) != KEPT:
            skipped, depth, level = tag, 1, len(stack)
    flush()
    while len(stack) > 1:
        close()
    return page


def join(blocks: list[str]) -> str:
    return "\n\n".join(blocks)


def _host(url: str | None) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


_PAGE = ["page_id long", "url string", "texts array<string>", "at array<int>", "parents array<int>", "hashes array<long>", "key binary"]
_SURVEY = ", ".join(["host string", "mark long", "on array<long>", *_PAGE])
_KINDS = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
_NAMES = [c.split()[0] for c in _SURVEY.split(", ")]
STEP = 256


def _parsed(batches: Iterator[pa.RecordBatch], words: bool = True) -> Iterator[tuple[pa.RecordBatch, list[str], list[Page]]]:
    """A few hundred pages at a time, with their urls."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            yield part, part.column("url").to_pylist(), [parse(x, words) for x in part.column("html").to_pylist()]


def _page(page_id: int | None, url: str | None, source: str | None) -> int:
    """A number for the page that a row is of."""
    return int.from_bytes(hashlib.blake2b(repr(url or (page_id, source)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _survey(batches: Iterator[pa.RecordBatch], most: int, words: bool = True) -> Iterator[pa.RecordBatch]:
    """The pages that each (host, mark) is on, as far as `most` of a few hundred; and the blocks of pages that need them."""
    for part, urls, pages in _parsed(batches, words):
        sources, ids = part.column("html").to_pylist(), part.column("page_id").to_pylist()
        on: dict[tuple[str, int], set[int]] = {}
        for i, u, y, x in zip(ids, urls, sources, pages):
            host, page = _host(u), _page(i, u, y)
            for m in x.marks:
                seen = on.setdefault((host, m), set())
                if len(seen) < most:
                    seen.add(page)
        rows = [(h, m, list(seen), *[None] * 7) for (h, m), seen in on.items()]
        for i, u, y, x in zip(ids, urls, sources, pages):
            if x.unsure:
                own = [k for k, why in enumerate(x.why) if why == KEPT]
                rows.append((_host(u), None, None, i, u, [x.texts[k] for k in own], [x.at[k] for k in own], x.parents, x.hashes, hashlib.md5(repr((u, y)).encode("utf-8", "surrogatepass")).digest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, pages in _parsed(batches):
        texts = pa.array([None if x.unsure else x.text() for x in pages], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of surveyed pages without the blocks under their bad marks."""
    for batch in batches:
        out = []
        for texts, at, parents, hashes, bad in zip(*(batch.column(c).to_pylist() for c in ("texts", "at", "parents", "hashes", "bad"))):
            n = len(texts)
            out.append(Page(texts, at, [KEPT] * n, [False] * n, parents, hashes).text(set(bad or ())))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _recurring(survey: DataFrame, min_pages: int) -> DataFrame:
    on = survey.where(F.col("key").isNull()).select("host", "mark", F.explode("on").alias("page")).distinct()
    return on.groupBy("host", "mark").count().where(F.col("count") >= min_pages).select("host", "mark")


def _slim(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, mark) of the subtrees that recur on many pages of their host."""
    return _recurring(_slim(pages).mapInArrow(lambda batches: _survey(batches, min_pages), _SURVEY), min_pages)


def decisions(pages: DataFrame, min_pages: int = MIN_PAGES, words: bool = True) -> DataFrame:
    """(decision, blocks): how many blocks of all pages stay, and for which reason the others go; ``words``: whether names of classes and ids count."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, urls, parsed in _parsed(batches, words):
            rows = [(_host(u), uuid.uuid4().bytes, x.has_main, x.at, x.why, x.main, x.parents, x.hashes) for u, x in zip(urls, parsed)]
            kinds = (pa.string(), pa.binary(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["host", "page", "has_main", *cols])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for has_main, bad, *own in zip(*(b.column(c).to_pylist() for c in ("has_main", "bad", *cols))):
                n.update(Page([], *own, set(), has_main).decide(set(bad or ())))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["decision", "blocks"])

    cols = ("at", "why", "main", "parents", "hashes")
    kind = "host string, page binary, has_main boolean, at array<int>, why array<string>, main array<boolean>, parents array<int>, hashes array<long>"
    rows = checkpoint(_slim(pages).mapInArrow(whole, kind))
    near = rows.select("host", "page", F.explode(F.array_distinct("hashes")).alias("mark"))
    bad = near.join(templates(pages, min_pages), ["host", "mark"]).groupBy("page").agg(F.collect_set("mark").alias("bad"))
    return rows.join(bad, "page", "left").mapInArrow(count, "decision string, blocks long").groupBy("decision").agg(F.sum("blocks").alias("blocks"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are parsed twice: for the counts, written with the blocks of pages that
    depend on them, and for the texts of all others.
    """
    pages = _slim(pages)
    survey = checkpoint(pages.mapInArrow(lambda batches: _survey(batches, min_pages), _SURVEY))
    sure = pages.mapInArrow(_sure, "page_id long, url string, text string").where(F.col("text").isNotNull())
    unsure = survey.where(F.col("key").isNotNull()).drop("mark", "on")
    near = unsure.select("key", "host", F.explode(F.array_distinct("hashes")).alias("mark")).distinct()
    bad = near.join(_recurring(survey, min_pages), ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("bad"))
    rest = unsure.join(bad, "key", "left").mapInArrow(_without, "page_id long, url string, text string")
    return sure.unionAll(rest).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
