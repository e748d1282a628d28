"""HTML extraction: element subtrees are hashed, counted per host, and deleted where they recur across a host's pages.

A page is read once: a tokenizer and the usual rules of implied ends give its blocks of text in order and, for each
element around blocks, a hash of its whole subtree and the range of blocks that it covers. Spark counts, per host, on
how many different pages a hash stands. Pages that share title and first heading are one there, so copies of an article
don't make it a template. A subtree on at least PAGES pages and SHARE of a host's pages is a template; so a host has at
most 1 / SHARE times the subtrees of a mean page, however many pages it has. Hosts' templates are joined to the pages,
salted, so that a host with a third of all pages is spread.

Templates are deleted from a page first (in an article or main element only beyond INSIDE, and never what contains one).
Then go elements whose tag, role or name says that they are no part of the article, and what is left outside the article
or main elements; where there is none, what is left outside the smallest container of nearly all prose.

Defined results: null and empty html give an empty text; markup that isn't closed or nested rightly is read as browsers
do in the main; repeated rows return each; a page without an address belongs to the host "", like others; an empty table
gives an empty result; texts of any length are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, staged

#: A template stands on so many different pages of its host, and on this part of them; inside of an article on that part.
PAGES, SHARE, INSIDE = 3, 0.3, 0.6
#: Part of the prose that a container must hold to be the article of a page that marks none.
NEARLY = 0.9
SALTS = 16

# Elements of the HTML standard by their kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title head html".split())
CLOSES_P = BLOCKS - frozenset("body html caption col colgroup tbody td tfoot th thead tr option optgroup legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start of the first closes open ones of the second, unless one of the third is between.
SIBLINGS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot caption", "table"),
    "thead": ("tr td th thead tbody tfoot caption", "table"),
    "tfoot": ("tr td th thead tbody tfoot caption", "table"),
}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
WALLS = frozenset("html body table td th caption template".split())
BUTTON = WALLS | {"button"}

# What is no part of an article: elements, roles, and first or last words of names in class and id.
APART = frozenset("nav footer aside menu search form dialog template noscript svg canvas object audio video select button datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu submenu breadcrumb breadcrumbs crumbs "
    "pagination pager header masthead topbar toolbar footer colophon copyright legal disclaimer sidebar sidebars aside rail widget widgets related recommended recommendations trending popular "
    "newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay toast share sharing social "
    "comment comments commentlist disqus respond replies reply discussion form search skip hidden".split()
)
DENIED = frozenset("has no not with without is".split())
HEADS = frozenset("header masthead banner".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WANTED = re.compile(r"class|id\b|role|hidden|display", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}

PLAIN, ARTICLE, MAIN, H1, APART_KIND, HEAD_KIND, BOX = range(7)
_BOXES = frozenset("div section body center td table tbody tr main html span form".split())


@dataclass(slots=True)
class Open:
    """An element that isn't closed: what it holds so far, as hashed bytes, and its first block."""

    tag: str
    first: int
    kind: int
    content: list[bytes]
    muted: bool = False


@dataclass(slots=True)
class Page:
    """Blocks of text with the characters of theirs in links; elements as (hash, first block, end, kind), inner ones first."""

    title: str = ""
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    elements: list[tuple[int, int, int, int]] = field(default_factory=list)


def _names_apart(value: str) -> str | None:
    """The word of a class or id by which its element is no part of the article, if there is one."""
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and words[0] not in DENIED:
            for w in (words[0], words[-1]):
                if w in NAMES:
                    return w
    return None


def _kind(tag: str, attributes: str) -> tuple[int, bool]:
    """Kind of an element, and whether it is hidden from view."""
    kind = ARTICLE if tag == "article" else MAIN if tag == "main" else H1 if tag == "h1" else HEAD_KIND if tag == "header" else APART_KIND if tag in APART else BOX if tag in _BOXES else PLAIN
    if not attributes or not _WANTED.search(attributes):
        return kind, False
    hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name == "role":
            role = value.strip().lower()
            if role in ("main", "article"):
                kind = MAIN if role == "main" else ARTICLE
            elif role in ROLES and kind not in (MAIN, ARTICLE, H1):
                kind = HEAD_KIND if role == "banner" else APART_KIND
        elif name in ("class", "id") and tag not in HEADINGS and tag not in ("html", "body", "main"):
            if word := _names_apart(value):
                kind = HEAD_KIND if word in HEADS and kind != APART_KIND else APART_KIND
    return (APART_KIND if hidden and tag not in ("html", "body") else kind), hidden


def parse(source: str) -> Page:
    """Blocks and elements of a page."""
    page = Page()
    stack = [Open("html", 0, PLAIN, [])]
    pieces: list[str] = []
    open_tags: Counter[str] = Counter()
    linked = depth = muted = 0
    title = True
    digest = lambda parts: int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.texts.append(text)
                page.links.append(min(linked, len(text)))
                stack[-1].content.append(text.encode("utf-8", "replace"))
            linked = 0

    def close() -> None:
        nonlocal depth, muted
        if stack[-1].tag in BLOCKS:
            flush()
        e = stack.pop()
        open_tags[e.tag] -= 1
        depth -= e.tag == "a"
        muted -= e.muted
        parent = stack[-1].content
        if e.tag not in BLOCKS and e.kind == PLAIN:
            parent.extend(e.content)
        elif e.content:
            h = digest([e.tag.encode(), *e.content])
            parent.append(h.to_bytes(8, "little", signed=True))
            if len(page.texts) > e.first:
                page.elements.append((h, e.first, len(page.texts), e.kind))

    def close_to(i: int) -> None:
        while len(stack) > i:
            close()

    def find(tags: Collection[str], walls: frozenset[str]) -> int:
        if not any(open_tags[t] for t in tags):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in walls:
                break
        return 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        if stack[-1].tag == "head" and not text.isspace():
            close()
        if not muted:
            pieces.append(text)
            if depth > 0:
                linked += len(text.strip())

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag == "br":
                flush()
            if tag in HEADINGS:
                i = find(HEADINGS, WALLS)
            elif tag in ("html", "body", "br"):
                i = 0
            else:
                i = find((tag,), WALLS - {tag} if tag in WALLS else WALLS)
            if not i:
                continue
            if tag in BLOCKS or all(e.tag not in BLOCKS for e in stack[i + 1 :]):
                close_to(i)
            else:  # blocks stand inside: the end holds for the element alone
                e = stack.pop(i)
                open_tags[tag] -= 1
                depth -= e.tag == "a"
                muted -= e.muted
                stack[i - 1].content.extend(e.content)
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close()
        if tag in RAW:
            stop = _ENDS[tag].search(source, at)
            raw, at = source[at : stop.start() if stop else end], (source.find(">", stop.start()) + 1 or end) if stop else end
            if tag == "title" and title:
                page.title, title = " ".join(entities.unescape(raw).split()), False
            elif tag == "xmp":
                say(raw.replace("&", "&amp;"))
            continue
        if tag in BLOCKS or tag == "br":
            flush()
        if tag in CLOSES_P and (i := find(("p",), BUTTON)):
            close_to(i)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close()
        if tag in SIBLINGS and (i := find(*SIBLINGS[tag])):
            while i and stack[i - 1].tag in SIBLINGS[tag][0]:
                i -= 1
            close_to(i)
        if tag == "a" and (i := find(("a",), BLOCKS)):
            close_to(i)
        if tag in VOID or tag == "html" or tag == "body" and open_tags[tag]:
            continue
        kind, hidden = _kind(tag, m[3])
        inline = tag not in BLOCKS
        mute = inline and (hidden or kind == APART_KIND)
        stack.append(Open(tag, len(page.texts), PLAIN if inline and kind not in (APART_KIND, HEAD_KIND) else kind, [], mute))
        open_tags[tag] += 1
        depth += tag == "a"
        muted += mute
        if inline and kind == HEAD_KIND:
            stack[-1].kind = PLAIN
        if m[3].endswith("/") and tag in ("svg", "path", "math"):
            close()
    flush()
    close_to(1)
    flush()
    return page


def _first_heading(page: Page) -> str:
    return next((page.texts[a] for _, a, _, kind in page.elements if kind == H1), "")


def prune(page: Page) -> Page:
    """The page without elements that are no part of its article by what they say themselves.

    Hashes of all elements stay, those of such elements without blocks.
    """
    keepers = [(a, b) for _, a, b, kind in page.elements if kind in (ARTICLE, MAIN)]
    title = page.title.lower()
    said = [a for _, a, _, kind in page.elements if kind == H1 and page.texts[a] and title.startswith(page.texts[a].lower())]
    total = sum(map(len, page.texts)) - sum(page.links)

    def apart(a: int, b: int, kind: int) -> bool:
        if kind not in (APART_KIND, HEAD_KIND) or any(a <= c and d <= b for c, d in keepers):
            return False
        if kind == HEAD_KIND:
            inside = any(c <= a and b <= d for c, d in keepers)
            return not (any(a <= h < b for h in said) and (inside or not keepers)) and not inside
        return True

    gone = [False] * len(page.texts)
    for _, a, b, kind in page.elements:
        if apart(a, b, kind):
            gone[a:b] = [True] * (b - a)
    if total and not keepers and all(g or 2 * n > len(t) for g, t, n in zip(gone, page.texts, page.links, strict=True)):
        # Nothing is left: names of elements around the whole page say nothing.
        gone = [False] * len(page.texts)
        for _, a, b, kind in page.elements:
            if apart(a, b, kind) and 2 * (sum(map(len, page.texts[a:b])) - sum(page.links[a:b])) < total:
                gone[a:b] = [True] * (b - a)
    place, kept = [0], 0
    for g in gone:
        kept += not g
        place.append(kept)
    out = Page(page.title, [t for t, g in zip(page.texts, gone, strict=True) if not g], [n for n, g in zip(page.links, gone, strict=True) if not g])
    out.elements = [(h, place[a], place[b], kind) for h, a, b, kind in page.elements]
    return out


def main_text(page: Page, site: set[int], inside: set[int] = frozenset()) -> str:
    """Text of the article of a pruned page, without the site's templates: those of ``inside`` go from articles, too."""
    keepers = [(a, b) for _, a, b, kind in page.elements if kind in (ARTICLE, MAIN)]
    within = lambda a, b, spans: any(c <= a and b <= d for c, d in spans)
    gone = [False] * len(page.texts)
    for h, a, b, kind in page.elements:
        if h in site and kind not in (ARTICLE, MAIN) and not any(a <= c and d <= b for c, d in keepers) and (h in inside or not within(a, b, keepers)):
            gone[a:b] = [True] * (b - a)
    articles = [(a, b) for _, a, b, kind in page.elements if kind == ARTICLE and a < b]
    spans = articles or [(a, b) for _, a, b, kind in page.elements if kind == MAIN and a < b]
    if not spans and keepers:
        return ""
    if not spans:
        prose = [0 if g or 2 * n > len(t) else len(t) for t, n, g in zip(page.texts, page.links, gone, strict=True)]
        sums = [0]
        for n in prose:
            sums.append(sums[-1] + n)
        spans = [(0, len(prose))]
        for _, a, b, kind in page.elements:  # inner ones first
            if kind == BOX and sums[-1] and sums[b] - sums[a] >= NEARLY * sums[-1]:
                spans = [(a, b)]
                break
        gone = [g or not n for g, n in zip(gone, prose, strict=True)]
    title = page.title.lower()
    wanted = [any(a <= i < b for a, b in spans) for i in range(len(gone))]
    for _, a, b, kind in page.elements:
        if kind == H1 and a < b and title.startswith(page.texts[a].lower()):
            wanted[a:b] = [True] * (b - a)
    return " ".join(t for t, w, g in zip(page.texts, wanted, gone, strict=True) if w and not g)


BLOCKS_OF = "page_id {kind}, url string, host long, page long, title string, texts array<string>, links array<int>, hashes array<long>, starts array<int>, ends array<int>, kinds array<tinyint>"


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            whole = parse(source)
            page = prune(whole)
            named = whole.title + "\n" + _first_heading(whole)
            rows = (_key(host), _key(named if len(named) > 1 else source), page.title, page.texts, page.links)
            hashes, starts, ends, kinds = zip(*page.elements, strict=True) if page.elements else ((), (), (), ())
            for column, v in zip(out, (*rows, list(hashes), list(starts), list(ends), list(kinds)), strict=True):
                column.append(v)
        i64, i32 = pa.int64(), pa.int32()
        kinds = [i64, i64, pa.string(), pa.list_(pa.string()), pa.list_(i32), pa.list_(i64), pa.list_(i32), pa.list_(i32), pa.list_(pa.int8())]
        names = ["page_id", "url", "host", "page", "title", "texts", "links", "hashes", "starts", "ends", "kinds"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Each page (page_id, url, html) as blocks, links and hashed elements; host and page are hashes of names."""
    address = F.coalesce(pages["url"].cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", pages["url"].cast("string").alias("url"), host.alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(_read_pages, BLOCKS_OF.format(kind=pages.schema["page_id"].dataType.simpleString()))


def site_templates(blocks: DataFrame) -> DataFrame:
    """host, hash, the pages that hold it and their share of the host's: subtrees that recur across many pages of a host."""
    each = blocks.select("host", "page", F.explode(F.array_distinct("hashes")).alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("pages"))
    hosts = blocks.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("of"))
    many = each.filter(F.col("pages") >= PAGES).join(hosts, "host")
    return many.select("host", "hash", "pages", (F.col("pages") / F.col("of")).alias("share")).filter(F.col("share") >= SHARE)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page (page_id, url, html)."""
    small_batches(pages.sparkSession, 500)
    blocks = staged(page_blocks(pages), "blocks", codec="zstd")
    sites = site_templates(blocks).groupBy("host").agg(F.collect_list(F.struct("hash", "share")).alias("site"))
    # Written first, so that its size is known before the join is planned: pages move only if it is too large to broadcast.
    salted = staged(sites.select("host", "site", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "sites")
    with_salt = blocks.withColumn("salt", F.pmod(F.xxhash64("page_id", "page"), F.lit(SALTS)).cast("int"))
    both = with_salt.join(salted, ["host", "salt"], "left").select(
        "page_id", "url", "title", "texts", "links", "hashes", "starts", "ends", "kinds", F.transform("site", lambda s: s["hash"]).alias("site"),
        F.transform(F.filter("site", lambda s: s["share"] >= INSIDE), lambda s: s["hash"]).alias("inside"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for title, said, links, hashes, starts, ends, kinds, site, inside in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                page = Page(title, said, links, list(zip(hashes, starts, ends, kinds, strict=True)))
                texts.append(main_text(page, set(site or ()), set(inside or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(work, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
