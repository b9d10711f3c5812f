"""HTML extraction with templates from equivalence classes of tokens.

A page's tokens are its structural tags and its texts, each with the path it
stands at.  Over the pages of a host, a token's
occurrence vector (how often it occurs in each page) is kept as an
order-free fingerprint, a sum over the pages, so vectors aggregate with partial
sums and no host is ever gathered.  Tokens of equal vectors form a class; a class is valid if it
has several tokens and occurs in half of the host's pages or more.  The tokens of
the valid classes are the host's template (a token's path says where it nests);
what is left of a page are its slots, each named by the innermost template
element around it.  A text inside articles is of the template only if three
different articles hold it, so that copies of an article keep their text.

The host's main region is the smallest container of the template, once on a
page, that holds REGION_SHARE of all its pages' slot text.  The main text of a
page is what the slots in the main region hold, without the template's texts.
Tags help where the template cannot tell: with ``hints`` (the default), slots in
article or main elements come before others, and elements that are menus,
headers, footers, sidebars, notices, adverts or reader comments by tag or role
hold no slots.  Classes and ids only say what an element may be: their words
(and a form's tag) count neither for the whole page, nor for an element that holds an
article, nor, on a page without articles, for one that holds most of the text;
inside articles, and for paragraphs and the like, a class must be such a word
as a whole (``ad``, not ``ad-hoc``).  A page without slot text (all of it is of the
template) keeps the texts of its article, or else all.

Templates meet pages by host and a salt of the page, so a host with a third of
all pages is spread over many tasks; pages travel compressed.

Defined cases: null html is empty and gives empty text; a null or odd url has
no host and no template; repeated rows give repeated results, and count as so
many pages of their host (what one page alone holds is never of the template); an empty table gives an empty result; other columns
are not read.  Work is linear in a page's length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table, unpack

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
MAIN = frozenset("article main".split())
BOILER = frozenset("head nav header footer aside script style noscript template iframe svg button select option menu dialog textarea title object canvas audio video".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: An opening tag ends an open one of these, if it is the innermost.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
PARTS = re.compile(r"[^a-z0-9]+")

#: Elements that are blocks of text or parts of lists and tables, no regions of a page.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address summary".split())

#: Elements that are the page.
WHOLE = frozenset(("html", "body"))

DOCUMENT = 0
#: The share of the text in a host's template that its main region holds.
REGION_SHARE = 0.8
SALTS = 64
#: Different articles that hold a text of the template.
LEAST_ARTICLES = 3
#: The mark of what stands outside articles: as many articles as may be asked for.
ANY = -1


def host(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower() if m else None


_paths: dict[tuple[int, str], int] = {}


def _below(path: int, name: str) -> int:
    """The token of an element called name at a path."""
    key = (path, name)
    if (known := _paths.get(key)) is None:
        if len(_paths) > 100_000:
            _paths.clear()
        known = _paths[key] = xxhash.xxh64_intdigest(name, path & 0xFFFFFFFFFFFFFFFF) & 0x7FFFFFFFFFFFFFFF or 1
    return known


def _said(attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """Classes as a name; whether roles and hiding speak of something beside the article; whether they speak of the article; whether a class is a word for something beside it; whether part of one is."""
    name, bad, main, word, part = "", False, False, False, False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden":
            bad = True
        elif key == "aria-hidden":
            bad = bad or value == "true"
        elif key == "role":
            bad, main = bad or value in BOILER_ROLES, main or value in ("main", "article")
        elif key == "itemprop":
            main = main or value == "articlebody"
        else:
            name += f".{value}"
            word = word or bool(BOILER_WORDS.intersection(value.split()))
            part = part or bool(BOILER_WORDS.intersection(PARTS.split(value)))
    return name, bad, main, word, part


class Page:
    """The blocks of a page, in order, and its elements."""

    def __init__(self, source: str | None, hints: bool = True):
        #: (text, inside an article, token of the text at its path, innermost element)
        self.blocks: list[tuple[str, bool, int, int]] = []
        #: (token, the element around it, whether it may be a region), outer ones first
        self.elements: list[tuple[int, int, bool]] = [(DOCUMENT, -1, True)]
        self._hints = hints
        self._stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        self._open: dict[str, int] = {}
        self._text: list[str] = []
        #: Elements that may stand beside the article, and those that are articles or the like.
        self._beside: set[int] = set()
        self._articles: set[int] = set()
        self._read(source or "")
        if self._beside:
            self._leave_out()

    def _leave_out(self) -> None:
        """Drop the blocks of elements that stand beside the article, if any block stays."""
        n = len(self.elements)
        below, whole = [0] * n, 0
        for text, _, _, at in self.blocks:
            below[at] += len(text)
            whole += len(text)
        articles = self._articles - self._beside
        holds = [i in articles for i in range(n)]
        for i in range(n - 1, 0, -1):
            around = self.elements[i][1]
            below[around] += below[i]
            holds[around] = holds[around] or holds[i]
        out = [False] * n
        for i in range(1, n):
            kept = holds[i] or not articles and 2 * below[i] > whole
            out[i] = out[self.elements[i][1]] or i in self._beside and not kept
        self.blocks = [b for b in self.blocks if not out[b[3]]] or self.blocks

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(html.unescape("".join(self._text)).split())
        self._text.clear()
        if text:
            _, _, main, at = self._stack[-1]
            self.blocks.append((text, main, _text_token(self.elements[at][0], text), at))

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        search, text = TAG.search, self._text
        while at < n:
            m = search(source, at)
            end = m.start() if m else n
            if end > at and not self._stack[-1][1]:
                text.append(source[at:end])
            if not m:
                break
            at = m.end()
            close, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                continue
            self._flush()
            if close:
                self._end(tag)
                continue
            self._begin(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(source, at).start()
                at = stop  # their content is no text
        self._flush()

    def _begin(self, tag: str, rest: str) -> None:
        stack = self._stack
        if stack[-1][0] == "p":
            self._pop()
        while stack[-1][0] in ENDS.get(tag, ()):
            self._pop()
        name, bad, main, word, part = _said(rest) if "=" in rest or "hidden" in rest else ("", False, False, False, False)
        _, was_bad, was_main, at = stack[-1]
        beside = self._hints and tag not in WHOLE and (word or tag == "form" or part and not was_main and tag not in TEXT_BLOCKS)
        article = self._hints and (main or tag in MAIN)
        main = self._hints and was_main or article
        whole = tag in WHOLE
        # an article's own header holds its title
        bad = self._hints and (was_bad or bad and not whole or tag in BOILER and not (tag == "header" and was_main))
        if beside:
            self._beside.add(len(self.elements))
        if article:
            self._articles.add(len(self.elements))
        self.elements.append((_below(self.elements[at][0], tag + name), at, tag not in TEXT_BLOCKS))
        if tag not in VOID:
            stack.append((tag, bad, main, len(self.elements) - 1))
            self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> None:
        tag = self._stack.pop()[0]
        self._open[tag] -= 1

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            while self._stack[-1][0] != tag:
                self._pop()
            self._pop()

    def tokens(self) -> dict[int, int]:
        """How often each token occurs: elements and texts."""
        found: dict[int, int] = {}
        for token, _, _ in self.elements:
            found[token] = found.get(token, 0) + 1
        for _, _, token, _ in self.blocks:
            found[token] = found.get(token, 0) + 1
        return found

    def masses(self) -> dict[int, int]:
        """The characters below each token of a possible region."""
        below = [0] * len(self.elements)
        for text, _, _, at in self.blocks:
            below[at] += len(text)
        for i in range(len(below) - 1, 0, -1):
            below[self.elements[i][1]] += below[i]
        found: dict[int, int] = {}
        for (token, _, region), n in zip(self.elements, below, strict=True):
            if region:
                found[token] = found.get(token, 0) + n
        return found

    def articles(self) -> dict[int, int]:
        """The tokens of the texts, each with the mark of the article it stands in: ANY outside articles."""
        inside = [token for _, main, token, _ in self.blocks if main]
        mark = _article_mark(xxhash.xxh64_intdigest(np.array(inside, dtype=np.int64).tobytes()))
        found = dict.fromkeys(inside, mark)
        found.update((token, ANY) for _, main, token, _ in self.blocks if not main)
        return found

    def main_text(self, template: frozenset[int] | set[int], region: int = DOCUMENT) -> tuple[str, int]:
        """The text of the slots in the main region and how many slots held it."""
        slot, held = [DOCUMENT], [region == DOCUMENT]
        for token, around, _ in self.elements[1:]:
            slot.append(token if token in template else slot[around])
            held.append(held[around] or token == region)
        free = [b for b in self.blocks if b[2] not in template]
        mine = [b for b in free if held[b[3]]]
        inside = [b for b in free if b[1]]
        chosen = [b for b in mine if b[1]] or inside or mine or free or [b for b in self.blocks if b[1]] or self.blocks
        return "\n\n".join(b[0] for b in chosen), len({slot[b[3]] for b in chosen})


def _text_token(path: int, text: str) -> int:
    """Negative, as tokens of elements are positive."""
    return -(xxhash.xxh64_intdigest(text, path & 0xFFFFFFFFFFFFFFFF) & 0x7FFFFFFFFFFFFFFF) - 1


def _article_mark(h: int) -> int:
    """One bit in each of eight bytes, by an article's hash; marks are joined by or."""
    mark = 0
    for i in range(8):
        mark |= 1 << (8 * i + (h >> (3 * i) & 7))
    return mark - (1 << 64) if mark >> 63 else mark


def _least_articles(marks: Column) -> Column:
    """How many different articles the joined marks stand for: eight at most, and never more than there are."""
    return F.greatest(*(F.bit_count(F.shiftrightunsigned(marks, 8 * i).bitwiseAND(F.lit(255))) for i in range(8)))


PROFILE = ("one", "two", "n", "times", "articles", "mass", "low", "high")


def _profiles(pages: DataFrame, hints: bool = True) -> DataFrame:
    """host, token and, combined within a batch: one and two (sums of parts of its occurrence vector), n: pages with the token, times: how often it occurs, articles: marks of the articles it stands in, mass: characters below it, low and high: the first and last of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for page_id, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if (name := host(url)) is None:
                    continue
                page = Page(source, hints)
                counts, articles, masses = page.tokens(), page.articles(), page.masses()
                marks = mix(mix(np.fromiter(counts.values(), dtype=np.uint64)) + np.uint64((page_id or 0) % (1 << 64)))
                ones, twos = (marks >> np.uint64(32)).tolist(), (marks & np.uint64(0xFFFFFFFF)).tolist()
                for (token, times), one, two in zip(counts.items(), ones, twos, strict=True):
                    have = seen.setdefault((name, token), [0, 0, 0, 0, 0, 0, page_id or 0, page_id or 0])
                    have[0] += one
                    have[1] += two
                    have[2] += 1
                    have[3] += times
                    have[4] |= articles.get(token, ANY)
                    have[5] += masses.get(token, 0)
                    have[6] = min(have[6], page_id or 0)
                    have[7] = max(have[7], page_id or 0)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int64()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(len(PROFILE)))], names=["host", "token", *PROFILE])

    return pages.mapInArrow(run, f"host string, token long, {', '.join(f'{c} long' for c in PROFILE)}")


def templates(pages: DataFrame, least_share: float = 0.5, least_pages: int = 2, hints: bool = True) -> DataFrame:
    """host, template array<long> (the tokens of the valid classes), region (the main region's token), of each host with several pages."""
    how = dict.fromkeys(PROFILE, F.sum) | {"articles": F.bit_or, "low": F.min, "high": F.max}
    tokens = _profiles(pages, hints).groupBy("host", "token").agg(*(f(c).alias(c) for c, f in how.items()))
    sizes = pages.select(_host(F.col("url")).alias("host")).where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    common = tokens.where((F.col("n") >= least_pages) & (F.col("low") < F.col("high")) & (_least_articles(F.col("articles")) >= LEAST_ARTICLES)).join(sizes, "host").where(F.col("n") >= F.col("pages") * least_share)
    member = F.struct("token", (F.col("n") == F.col("times")).alias("once"), "mass")
    classes = common.groupBy("host", "one", "two", "n").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    found = classes.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("members"))
    whole = F.array_max(F.transform("members", lambda m: m["mass"]))
    regions = F.filter("members", lambda m: m["once"] & (m["mass"] > 0) & (m["mass"] >= whole * REGION_SHARE))
    smallest = F.try_element_at(F.array_sort(F.transform(regions, lambda m: F.struct(m["mass"].alias("mass"), m["token"].alias("token")))), F.lit(1))["token"]
    return found.select("host", F.transform("members", lambda m: m["token"]).alias("template"), F.coalesce(smallest, F.lit(DOCUMENT).cast("long")).alias("region"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", hints: bool = True) -> DataFrame:
    """page_id, url, text, n_slots: the main text of each page; blocks are parted by an empty line."""
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            urls = batch.column("url").to_pylist()
            salts = [None if i is None else i % SALTS for i in batch.column("page_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([host(u) for u in urls], pa.string()), pa.array([s or 0 for s in salts], pa.int32()), pa.array([press((x or "").encode()) for x in batch.column("html").to_pylist()], pa.binary())], names=["page_id", "url", "host", "salt", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(unpack(part.column("packed")), part.column("template").to_pylist(), part.column("region").to_pylist(), strict=True)
                found = [Page(x.decode(), hints).main_text(set(t or ()), r or DOCUMENT) for x, t, r in rows]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], names=["page_id", "url", "text", "n_slots"])

    packed = pages.mapInArrow(pack, "page_id long, url string, host string, salt int, packed binary")
    # a template goes only where pages of its host are
    salts = pages.select(_host(F.col("url")).alias("host"), F.coalesce(F.pmod("page_id", F.lit(SALTS)), F.lit(0)).cast("int").alias("salt")).where("host IS NOT NULL")
    sent = salts.distinct().groupBy("host").agg(F.collect_list("salt").alias("salts")).join(templates(pages, hints=hints), "host").select("host", "template", "region", F.explode("salts").alias("salt"))
    return packed.join(sent, ["host", "salt"], "left").select("page_id", "url", "packed", "template", "region").mapInArrow(run, "page_id long, url string, text string, n_slots long")


def _host(url):
    """The same as host(), as an expression."""
    found = F.lower(F.regexp_extract(url, HOST.pattern, 1))
    return F.when(found != "", found)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_slots")
