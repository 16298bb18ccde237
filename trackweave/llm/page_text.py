"""The main text of web pages: markup read into blocks, boilerplate found as text that a host repeats.

*Blocks.* A page becomes its blocks of text in page order (what stands between tags of block
elements; character references decoded, white space turned into one space). Elements that
hold no text to read (scripts, styles, heads, templates) give none. The markup says of a
block that it is the article's (in ``article`` or an article body), that it is chrome (in menus, headers,
footers, asides, forms, or elements whose class, id or role names an advert, notice, side bar,
comment and the like), or nothing.

*Repeats.* The pages of a host are concatenated as streams of words, with a mark between blocks, and
their suffix array is built. Its suffixes are put in order by their first ``LEAST_RUN`` words and marks, which is as
far as the question goes: every word of a longer repeated substring lies in a repeated one of that length.
Substrings that stand in two or more distinct pages (of distinct text) cover the host's boilerplate; a
block all of whose words are covered is repeated, and what is left are the runs that only one page has.

*Main text.* Where the markup names an article, its blocks are the text but for its notices: blocks that more than half of the
articles of the host hold, and no fewer than ``NOTICED``. Other repeats stay, as documents that
share passages or are copies of each other must stay whole; so does an article with more words in such
blocks than in others. Notices are counted over all pages of the host, each text once. Else the text is what
is neither chrome nor repeated nor mostly links; where a page has nothing else (all of it
stands on other pages too), the repeated blocks stay that the fewest pages share.

A host may hold any share of the pages: its pages are dealt over salts by a digest of
their html, one for each ``SALTED`` pages; the counts that set the salts are those of the hosts
above one in ``HOSTS`` of all pages, so at most ``HOSTS`` of them reach the driver. A task
walks over its pages in the order of host and digest and closes a suffix array at
``SHELF`` to twice as many words, so memory follows that figure and the longest page. Pages of different
shelves do not meet there. So pages whose text the repeats decide, as the markup names no article, are decided
apart: each of their runs of ``LEAST_RUN`` words and marks is counted over all pages of the host, by
a join on hashes. A bitmap of fixed size spares the join most other runs and loses none. Only ``n_repeated`` of pages
with a named article, whose text needs the notices alone, is that of the page's shelf.

Null html is an empty page, and an empty page has an empty text. Rows without url, and urls without
``://``, are pages of one host without name. Repeated pages are kept; pages of equal text
count once among those that repeat something. Whole pages are read, of any length. An empty
table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackweave.llm import words
from trackweave.llm.suffix_tree import _bitmap, _marked
from trackweave.session import cut_lineage

LEAST_RUN = 6
NOTICED = 8
SHELF = 1 << 18
SALTED = 1 << 9
HOSTS = 1 << 12
MARK = np.uint64(0x9E3779B97F4A7C15)  # stands before each block
_RUN = words.odd_numbers(LEAST_RUN, 3)
#: a block is mostly links above this share of its characters
LINKED = 0.6

# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
TEXTLESS = frozenset(
    "head title script style noscript template svg math canvas iframe object audio video map select option "
    "textarea button noembed noframes xmp datalist dialog".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset("nav aside footer form menu".split())
ROOTS = frozenset("html body main".split())
FOREIGN = frozenset("svg math".split())
BOUNDS = frozenset("article body table td th".split())
# items, which other items end them, and the lists beyond which they do not
ITEMS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}

# fixed values: words in a class, id or role that name what stands around the article
CHROME_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert alerts announcement banner banners "
    "breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login "
    "masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall "
    "popup privacy promo promos promotion recommended related reply replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
# the header of an article holds its title
OF_ARTICLES = frozenset("banner header".split())
# names such as has-sidebar say what stands beside the element
BESIDE = frozenset("has is layout no with without".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ARTICLE_WORDS = frozenset(["articlebody"])

ARTICLE, PLAIN, AROUND = 2, 1, 0

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|)[^>=]*)*)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


class Element(NamedTuple):
    """An open element; what holds for an element holds for all inside it."""

    name: str
    textless: bool = False
    around: bool = False
    article: bool = False
    main: bool = False
    link: bool = False


OUTSIDE = Element("")


@dataclass
class Page:
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters inside links
    mains: list[bool] = field(default_factory=list)


_HINTS = re.compile(r"class|\bid|role|itemprop|hidden", re.I)


def _hints(attributes: str) -> tuple[set[str], str, bool]:
    """The words of class and id, the role, and whether the element is hidden."""
    found, role, hidden = set(), "", False
    if not attributes or not _HINTS.search(attributes):
        return found, role, hidden
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for part in value.split():
                some = [w.lower() for w in _WORDS.findall(part)]
                if some and some[0] not in BESIDE:
                    found.update(some)
        elif name == "itemprop":
            found.update(v.lower() for v in value.split())
        elif name == "role":
            role = value.lower().strip()
        elif name == "hidden" and value.lower() not in ("false", "until-found"):
            hidden = True
    return found, role, hidden


class Reader:
    """Walks over the tags of one page and gathers its blocks."""

    def __init__(self) -> None:
        self.page = Page()
        self.open: list[Element] = [OUTSIDE]
        self.held: list[str] = []
        self.linked = 0

    def text(self, raw: str) -> None:
        here = self.open[-1]
        if not here.textless:
            self.held.append(raw)
            if here.link:
                self.linked += len(raw)

    def block(self) -> None:
        """Closes the block that is open."""
        if not self.held:
            return
        text = " ".join(html.unescape("".join(self.held)).split())
        if text:
            here, page = self.open[-1], self.page
            page.texts.append(text)
            page.kinds.append(AROUND if here.around else ARTICLE if here.article else PLAIN)
            page.links.append(min(len(text), self.linked))
            page.mains.append(here.main)
        self.held, self.linked = [], 0

    def start(self, name: str, attributes: str, alone: bool) -> None:
        if name == "br":
            self.held.append(" ")
        elif name not in INLINE:
            self.block()
            if self.open[-1].name == "p":
                self.open.pop()
            self.implied(name)
        if name in VOID or (alone and name in FOREIGN):
            return
        found, role, hidden = _hints(attributes)
        here = self.open[-1]
        article = name == "article" or role == "article" or not found.isdisjoint(ARTICLE_WORDS)
        if here.article or article:
            found = found - OF_ARTICLES
        around = name in CHROME or (name == "header" and not here.article) or role in CHROME_ROLES
        around = (around or not found.isdisjoint(CHROME_WORDS)) and name not in ROOTS
        textless = name in TEXTLESS or hidden
        if (around or textless) and name in INLINE:
            self.block()
        self.open.append(
            Element(
                name,
                here.textless or textless,
                here.around or around,
                here.article or article,
                here.main or name == "main" or role == "main",
                here.link or name == "a",
            )
        )

    def implied(self, name: str) -> None:
        """Ends the item that a new item of the same list ends."""
        like, lists = ITEMS.get(name, ((), ()))
        if not like:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in lists:
                return
            if self.open[i].name in like:
                del self.open[i:]
                return

    def end(self, name: str) -> None:
        inline = name in INLINE
        if not inline:
            self.block()
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i]
            if here.name == name:
                if inline and any(e.name not in INLINE for e in self.open[i + 1 :]):
                    del self.open[i]  # blocks inside it go on
                    return
                if inline and (here.around, here.textless) != (self.open[i - 1].around, self.open[i - 1].textless):
                    self.block()
                del self.open[i:]
                return
            if inline and here.name in BOUNDS:
                return


def read(text: str) -> Page:
    """The blocks of a page with what the markup says of them."""
    reader, at, n = Reader(), 0, len(text)
    for_raw: str | None = None
    while at < n:
        if for_raw:
            end = re.compile(rf"</{for_raw}(?=[\s/>]|\Z)", re.I).search(text, at)
            at, for_raw = (end.start() if end else n), None
            continue
        tag = _TAG.search(text, at)
        if tag is None:
            reader.text(text[at:])
            break
        if tag.start() > at:
            reader.text(text[at : tag.start()])
        at = tag.end()
        name = tag.group(2)
        if name is None:
            if tag.group().startswith("<![CDATA["):
                reader.text(html.escape(re.sub(r"\]\]>\Z", "", tag.group()[9:])))
            continue
        name = name.lower()
        if tag.group(1):
            reader.end(name)
        else:
            reader.start(name, tag.group(3), tag.group(3).endswith("/"))
            if name in RAW:
                for_raw = name
    reader.block()
    return reader.page


def suffix_array(stream: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)``: the places of a stream in the order of the first ``depth`` numbers from there, and
    the rank of each place; places that agree so far share a rank. The length that ranks know doubles each time."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(stream), dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(stream) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(key)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        known += step
    return order, rank


def covered(stream: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """For each place of the stream, how many pages hold the substring of ``least`` numbers around it that most
    pages hold; 0 if only one does.

    ``stream`` ends each page with a number of its own, so no common substring crosses pages.
    """
    n = len(stream)
    if n <= least:
        return np.zeros(n, dtype=np.int64)
    order, rank = suffix_array(stream, least)
    of, ranks = page[order], rank[order]
    # places are in order within a rank, and so are pages
    fresh = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (of[1:] != of[:-1])])
    holders = np.bincount(ranks, weights=fresh).astype(np.int64)[rank]
    holders[holders < 2] = 0
    out = holders.copy()
    for back in range(1, least):
        out[back:] = np.maximum(out[back:], holders[:-back])
    return out


def mostly_links(page: Page, i: int) -> bool:
    return page.links[i] > LINKED * len(page.texts[i])


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def main_blocks(page: Page, shared: list[int], notices: Collection[int] = ()) -> list[int]:
    """The blocks that make the main text; ``shared`` is by how many pages each is repeated, or 0, and ``notices``
    are the hashes of what most articles of the host hold."""
    every = range(len(page.texts))
    article = [i for i in every if page.kinds[i] == ARTICLE]
    if article:
        own = [i for i in article if _hash(page.texts[i]) not in notices] if notices else article
        size = [page.texts[i].count(" ") + 1 for i in article]
        return own if 2 * sum(page.texts[i].count(" ") + 1 for i in own) >= sum(size) else article
    plain = [i for i in every if page.kinds[i] == PLAIN]
    if any(page.mains[i] for i in plain):
        plain = [i for i in plain if page.mains[i]]
    plain = [i for i in plain if not mostly_links(page, i)]
    own = [i for i in plain if not shared[i]]
    if own or not plain:
        return own
    fewest = min(shared[i] for i in plain)
    return [i for i in plain if shared[i] <= fewest]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, size, at = batch.column("html"), 0, 0
        held: list[tuple] = []
        for i in range(batch.num_rows):
            page = read(column[i].as_py() or "")
            held.append((page.texts, bytes(page.kinds), page.links, page.mains))
            size += sum(map(len, page.texts))
            if size > words.PIECE or i + 1 == batch.num_rows:
                some = batch.slice(at, len(held)).drop_columns(["html"])
                texts, kinds, links, mains = zip(*held)
                some = some.append_column("texts", pa.array(texts, pa.list_(pa.string())))
                some = some.append_column("kinds", pa.array(kinds, pa.binary()))
                some = some.append_column("links", pa.array(links, pa.list_(pa.int32())))
                some = some.append_column("mains", pa.array(mains, pa.list_(pa.bool_())))
                yield some.append_column("named", pa.array([ARTICLE in k or not k for k in kinds], pa.bool_()))
                held, size, at = [], 0, i + 1


def _article_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(hosted, digest, block)``: the blocks of each article, and one row without block for the article itself."""
    for batch in batches:
        column, host = batch.column("html"), batch.column("hosted")
        hosted, digest, block = [], [], []
        for i in range(batch.num_rows):
            page = read(column[i].as_py() or "")
            found = {_hash(t) for t, kind in zip(page.texts, page.kinds) if kind == ARTICLE}
            if found:
                some = [None, *found]
                hosted += [host[i].as_py()] * len(some)
                digest += [_hash("\n".join(page.texts))] * len(some)
                block += some
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (hosted, digest, block)], names=["hosted", "digest", "block"])


def host_notices(rows: DataFrame) -> DataFrame:
    """``(hosted, notices)``: of hosts that have any, the hashes of the blocks that most of their articles hold."""
    blocks = rows.select("hosted", "html").mapInArrow(_article_blocks, "hosted long, digest long, block long").distinct()
    counts = cut_lineage(blocks.groupBy("hosted", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= NOTICED))
    articles = counts.where("block IS NULL").select("hosted", F.col("n").alias("articles"))
    often = counts.where("block IS NOT NULL").join(articles, "hosted").where("2 * n > articles")
    return cut_lineage(often.groupBy("hosted").agg(F.collect_list("block").alias("notices")))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    name = F.regexp_extract(F.coalesce(after, F.lit("")), "^[^/?#]*", 0)
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hashed(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words of all blocks, hashes of the words, and the first block of each page."""
    counts, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for _, some in words.word_pieces(pa.array([t for p in pages for t in p.texts], pa.string())):
        counts.append(some.counts())
        hashes.append(some.hashes(words.IDENTITY))
    ends = np.concatenate([[0], np.cumsum([len(p.texts) for p in pages])]).astype(np.int64)
    return np.concatenate(counts), np.concatenate(hashes), ends


def _decision(row: dict, page: Page, shared: np.ndarray) -> tuple:
    """``(page_id, url, text, blocks, repeated blocks)`` of a page."""
    kept = main_blocks(page, shared.tolist(), row.get("notices") or ())
    return row["page_id"], row["url"], "\n".join(page.texts[k] for k in kept), len(shared), int((shared > 0).sum())


def _streams(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(stream, block, first, ends)``: word hashes with a mark before each block, the block of each place, and
    the first place and block of each page."""
    counts, hashes, ends = _hashed(pages)
    block = np.repeat(np.arange(len(counts)), counts + 1)
    return np.insert(hashes, np.cumsum(counts) - counts, MARK), block, np.searchsorted(block, ends), ends


def _runs(stream: np.ndarray, first: np.ndarray, host: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place, page, key)`` of all runs of ``LEAST_RUN`` numbers inside a page; keys are of one host."""
    n = max(0, len(stream) - LEAST_RUN + 1)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.flatnonzero(of[:n] == of[len(of) - n :])
    key = np.zeros(len(place), dtype=np.uint64)
    for j in range(LEAST_RUN):
        key += stream[place + j] * _RUN[j]
    return place, of[place], words.mix(words.mix(key) ^ words.mix(host)[of[place]])


def _held(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[dict], list[Page], np.ndarray]]:
    """Rows, pages and hosts of some pages at a time."""
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            rows.append({c: batch.column(c)[i].as_py() for c in ("hosted", "texts", "kinds", "links", "mains", *columns)})
            size += sum(map(len, rows[-1]["texts"]))
            if size > words.PIECE or i + 1 == batch.num_rows:
                pages = [Page(r["texts"], list(r["kinds"]), r["links"], r["mains"]) for r in rows]
                yield rows, pages, np.array([r["hosted"] for r in rows], dtype=np.int64).view(np.uint64)
                rows, size = [], 0


def _asked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(hosted, draw, place, key)`` of every run of the pages."""
    for rows, pages, host in _held(batches, ["draw"]):
        stream, _, first, _ = _streams(pages)
        place, of, key = _runs(stream, first, host)
        draw = np.array([r["draw"] for r in rows], dtype=np.int64)
        yield pa.RecordBatch.from_pydict(
            {"hosted": host.view(np.int64)[of], "draw": draw[of], "place": (place - first[of]).astype(np.int32), "key": key.view(np.int64)}
        )


def _known_runs(sent):
    """``(key, digest)``: each run of the pages that the bitmap lets pass, once for each text."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pages, host in _held(batches, []):
            stream, _, first, _ = _streams(pages)
            _, of, key = _runs(stream, first, host)
            at = np.arange(len(stream)) - np.repeat(first[:-1], np.diff(first))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(stream + words.mix(at.astype(np.uint64))), dtype=np.uint64)])
            digest = sums[first[1:]] - sums[first[:-1]]
            some = np.flatnonzero(_marked(sent.value, key))
            both = np.unique(np.column_stack([key[some], digest[of[some]]]), axis=0).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": both[:, 0].copy(), "digest": both[:, 1].copy()})

    return known


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages' texts by ``shared``, the places of their repeated runs and how many texts hold each."""
    for batch in batches:
        kind = batch.schema.field("page_id").type
        for rows, pages, _ in _held(iter([batch]), ["page_id", "url", "shared"]):
            stream, block, first, ends = _streams(pages)
            held = np.zeros(len(stream), dtype=np.int64)
            for i, row in enumerate(rows):
                for run in row["shared"] or ():
                    part = slice(first[i] + run["place"], first[i] + run["place"] + LEAST_RUN)
                    held[part] = np.maximum(held[part], run["n"])
            held[np.searchsorted(block, np.arange(ends[-1]))] = np.iinfo(np.int64).max  # marks are no words
            least = np.minimum.reduceat(held, np.searchsorted(block, np.arange(ends[-1])))
            yield _given([(*_decision(r, p, least[ends[i] : ends[i + 1]]), False) for i, (r, p) in enumerate(zip(rows, pages))], kind)


@dataclass
class Shelf:
    """Pages of one host whose suffix array is built together."""

    host: str = ""
    rows: list[dict] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    words: int = 0

    def add(self, row: dict, size: int) -> None:
        self.rows.append(row)
        self.sizes.append(size)
        self.words += size

    def closed(self) -> "Shelf":
        """The first pages of an overfull shelf, up to ``SHELF`` words; they leave this one."""
        n = max(1, int(np.searchsorted(np.cumsum(self.sizes), SHELF, side="right")))
        first = Shelf(self.host, self.rows[:n], self.sizes[:n], sum(self.sizes[:n]))
        self.rows, self.sizes, self.words = self.rows[n:], self.sizes[n:], self.words - first.words
        return first

    def results(self) -> Iterator[tuple]:
        """``(page_id, url, text, blocks, repeated blocks, named)`` of each page."""
        pages = [Page(r["texts"], list(r["kinds"]), r["links"], r["mains"]) for r in self.rows]
        counts, hashes, ends = _hashed(pages)
        shared = self._shared(counts, hashes, ends)
        for i, (row, page) in enumerate(zip(self.rows, pages)):
            yield *_decision(row, page, shared[ends[i] : ends[i + 1]]), row["named"]

    @staticmethod
    def _shared(counts: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each block, the least number of pages that repeat a word of it, taking pages of equal text as one."""
        pages = len(ends) - 1
        # words as numbers from 1, a mark (0) before each block, a number of its own after each page
        cuts = np.cumsum(counts) - counts
        stream = np.insert(np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1, cuts, 0)
        block = np.repeat(np.arange(len(counts)), counts + 1)
        bounds = np.searchsorted(block, ends)
        first: dict[bytes, int] = {}
        same = [first.setdefault(stream[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
        own = np.array(sorted(first.values()))
        text = np.concatenate([stream[bounds[i] : bounds[i + 1]] for i in own])
        sizes = (bounds[1:] - bounds[:-1])[own]
        joined = np.insert(text, np.cumsum(sizes), len(hashes) + 1 + np.arange(len(own)))
        held = covered(joined, np.repeat(np.arange(len(own)), sizes + 1), LEAST_RUN)
        begin = dict(zip(own.tolist(), (np.cumsum(sizes + 1) - sizes - 1).tolist()))
        whole = np.concatenate([held[begin[same[i]] : begin[same[i]] + bounds[i + 1] - bounds[i]] for i in range(pages)])
        if not len(counts):
            return np.zeros(0, dtype=np.int64)
        whole[stream == 0] = len(own) + 1  # marks are no words
        return np.minimum.reduceat(whole, np.searchsorted(block, np.arange(len(counts))))


def _given(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, urls, texts, blocks, repeated, named = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind),
            pa.array(urls, pa.string()),
            pa.array(texts, pa.string()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(blocks, pa.int32()),
            pa.array(repeated, pa.int32()),
            pa.array(named, pa.bool_()),
        ],
        names=["page_id", "url", "text", "n_chars", "n_blocks", "n_repeated", "named"],
    )


def _shelves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks over pages in the order of their host; a shelf closes at a new host or when it is overfull."""
    shelf, kind = Shelf(), None
    for batch in batches:
        kind = batch.schema.field("page_id").type
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("host", "page_id", "url", "texts", "kinds", "links", "mains", "named", "notices")}
            if shelf.rows and row["host"] != shelf.host:
                yield _given(list(shelf.results()), kind)
                shelf = Shelf()
            shelf.host = row["host"]
            shelf.add(row, sum(t.count(" ") + 1 for t in row["texts"]))
            if shelf.words > 2 * SHELF:
                yield _given(list(shelf.closed().results()), kind)
    if shelf.rows:
        yield _given(list(shelf.results()), kind)


def large_hosts(pages: DataFrame) -> dict[str, int]:
    """Hosts with more than a ``HOSTS``-th of all pages and with several salts, and their number of pages."""
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = pages.count()
    return {h: n for h, n in counts.where(F.col("n") > max(SALTED, total // HOSTS)).collect()}


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks, n_repeated)`` of every page."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(markup).alias("html")
    )
    large = large_hosts(rows.select("host"))
    salts = F.lit(1)
    for name, n in large.items():
        salts = F.when(F.col("host") == name, n // SALTED + 1).otherwise(salts)
    draw = F.xxhash64("html")
    rows = rows.select(
        "page_id", "url", "host", F.xxhash64("host").alias("hosted"), draw.alias("draw"), F.pmod(draw, salts).cast("int").alias("salt"), "html"
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    blocks = rows.mapInArrow(
        _blocks,
        f"page_id {kind}, url string, host string, hosted long, draw long, salt int, "
        "texts array<string>, kinds binary, links array<int>, mains array<boolean>, named boolean",
    )
    result = f"page_id {kind}, url string, text string, n_chars long, n_blocks int, n_repeated int, named boolean"
    notices = host_notices(rows)
    noted = blocks.withColumn("notices", F.lit(None).cast("array<long>")) if notices.isEmpty() else blocks.join(notices, "hosted", "left")
    dealt = noted.repartition("host", "salt").sortWithinPartitions("host", "salt", "draw", "page_id")
    out = dealt.mapInArrow(_shelves, result)
    asked = cut_lineage(blocks.where("NOT named").drop("host", "salt"))
    if not asked.isEmpty():
        out = out.where("named").unionByName(decided(blocks, asked, result))
    return out.drop("named")


def decided(blocks: DataFrame, asked: DataFrame, result: str) -> DataFrame:
    """The pages of ``asked`` with their text by what the pages of their host, ``blocks``, repeat."""
    once = asked.dropDuplicates(["hosted", "draw"])
    runs = cut_lineage(once.mapInArrow(_asked_runs, "hosted long, draw long, place int, key long"))
    sent = asked.sparkSession.sparkContext.broadcast(_bitmap(runs.select("key")))
    known = blocks.mapInArrow(_known_runs(sent), "key long, digest long").distinct()
    holders = known.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    shared = runs.join(holders, "key").groupBy("hosted", "draw").agg(F.collect_list(F.struct("place", "n")).alias("shared"))
    return asked.join(shared, ["hosted", "draw"], "left").mapInArrow(_decided, result)
