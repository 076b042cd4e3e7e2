"""Main text of web pages: markup proposes, the page's host decides what is boilerplate.

Every page is cut into blocks of text. What is inside menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments goes by markup; the other blocks are inside the page's article, or open where a page has none. Then
the host's pages are held against each other, pages of equal blocks counting as one:

* an open block loses the runs of at least ``REPEAT`` tokens that another page of the host has too;
* a block inside an article goes as a whole if it has at least ``LONG`` tokens and at least ``LEAST_PAGES`` pages of the host and
  ``MOST_SHARE`` of all of them have it, as they do cookie bars and footers that markup doesn't tell. Passages that some
  articles share stay, and so do headings and short steps however many share them.

The host is looked at whole, whatever its size. Windows of ``REPEAT`` tokens and blocks travel as 128-bit digests of host
and tokens with the digest of their page and are folded map-side, so that a large host is no group of its own.
``repeated_runs`` is the rule for runs by a suffix array, for pages that fit in memory.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import slices
from strandloom.session import materialize

REPEAT, FLUSH_WINDOWS = 8, 50_000
LONG, LEAST_PAGES, MOST_SHARE = 10, 5, 0.5

# Elements by their role in HTML.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select textarea input option label fieldset menu dialog iframe object embed svg canvas audio video map".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Elements that a start tag of the same group ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("table ul ol dl menu select article section div body main td th".split())
# Words that name, in a class, id or role, what isn't the article; the second ones only on containers.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer colophon sidebar aside cookie cookies consent gdpr"
    " popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies responses user-reviews reader-reviews customer-reviews sharing social pagination pager toolbar skip contentinfo complementary dialog byline-links".split()
)
CONTAINER_MARKS = frozenset("widget widgets related recommended trending popular notice notices share search form copyright legal disclaimer alert tags".split())
# Those of them that may name a part of an article.
OF_ARTICLES = frozenset("popular notice notices copyright legal disclaimer alert tags".split())
# Words that may stand beside those in one name without changing its sense.
BESIDE = frozenset(
    "site page global main top bottom left right header head box bar block list lists item items area section wrapper wrap container content inner outer link links button buttons panel slot unit group icons icon"
    " menu text message primary secondary post posts article articles story stories entry body the of and by us media user users reader readers customer customers visitor visitors reviews".split()
)
CONTAINERS = frozenset("div section ul ol dl table center details article".split())
PAGE_HEADER = frozenset("site page global main top".split())
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?])")
IN_TAG = re.compile(r"((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")


def _names_boilerplate(value: str, container: bool, inside: bool) -> bool:
    """Whether one of the names in ``value`` is made of words that mark boilerplate, and of others that may stand beside them."""
    told = (CONTAINER_MARKS - OF_ARTICLES if inside else CONTAINER_MARKS) if container else frozenset()
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_\d:.]+|side-bar", name) if w]
        mark = name in MARKS or any(w in MARKS or w in told for w in words)
        if mark and all(w in MARKS or w in CONTAINER_MARKS or w in BESIDE for w in words):
            return True
        if not inside and words and words[-1] in ("header", "masthead") and all(w in PAGE_HEADER for w in words[:-1]):
            return True
    return False


def _marked(element: str, attributes: str, inside: bool) -> bool:
    """Whether an element's attributes mark it; an article's own header (``inside``) is part of it."""
    if not attributes or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label", "itemprop") and _names_boilerplate(value, element in CONTAINERS, inside):
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def tags_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of a page's tags in order; name is empty for comments and the like.

    A quotation mark counts in a tag only as a value's. Where quotation marks leave a tag without an end, they stop
    counting for the rest of the page; a last tag without any end takes what is left. The caller may send the place to
    go on from. Takes time in proportion to the page.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (tag := OPENING.search(page, at)) is not None:
        slash, name = tag.groups()
        if name is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(tag.group(), ">")
            found = page.find(close, tag.end())
            end = len(page) if found < 0 else found + len(close)
            sent = yield tag.start(), end, "", "", tag.group()
        elif tag.end() > last + 1 or last < 0:
            sent = yield tag.start(), (end := len(page)), "", "", ""
        else:
            rest = IN_TAG.match(page, tag.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else max(page.find(">", tag.end()) + 1, tag.end())
            sent = yield tag.start(), end, slash, name.lower(), page[tag.end() : end - 1]
        at = end if sent is None else sent


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(place, text) of a page's blocks in order; place is ``article``, ``open`` (markup doesn't tell) or ``out``."""
    found: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, each with whether it is dropped
    opened: Counter[str] = Counter()
    places: dict[str, list[int]] = defaultdict(list)  # where open inline elements of a name stand in the stack
    outer: list[int] = []  # where its other elements stand
    dropped = articles = 0

    def flush() -> None:
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if joined:
            found.append(("out" if dropped else "article" if articles else "open", joined))

    def leave(n: int) -> None:
        nonlocal dropped, articles
        while len(stack) > n:
            name, out = stack.pop()
            opened[name] -= 1
            (places[name] if name in INLINE else outer).pop()
            if name not in INLINE or out:
                flush()
            dropped -= out
            articles -= name in ("article", "main")

    def handle(name: str, closing: str, attributes: str, at: int) -> int | None:
        """Open or close an element; the place to go on from, if it isn't the tag's end."""
        nonlocal dropped, articles
        if closing:
            if name in INLINE:
                if places[name] and places[name][-1] > (outer[-1] if outer else -1):
                    leave(places[name][-1])
                return None
            if not opened[name]:
                flush()
                return None
            leave(next(k for k in reversed(outer) if stack[k][0] == name))
            return None
        if name in CLOSES_P and outer and stack[outer[-1]][0] == "p":
            leave(outer[-1])
        if name in SIBLINGS and any(opened[sibling] for sibling in SIBLINGS[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SIBLINGS[name]:
                    leave(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if name in VOID or attributes.endswith("/") and name not in CLOSES_P:
            if name in ("br", "wbr"):
                text.append(" " if name == "br" else "")
            elif name not in INLINE:
                flush()
            return None
        # an article's own header holds its headline; an article may be a reader's comment
        out = name in DROPPED and not (name == "header" and articles and not dropped) or _marked(name, attributes, articles > 0)
        if name in ("html", "body", "main"):
            out = False
        if name not in INLINE or out:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            return end.end() if end else len(page)
        (places[name] if name in INLINE else outer).append(len(stack))
        stack.append((name, out))
        opened[name] += 1
        dropped += out
        articles += name in ("article", "main")
        return None

    tags, at = tags_of(page), 0
    tag = next(tags, None)
    while tag is not None:
        start, end, closing, name, attributes = tag
        text.append(page[at:start])
        at, resume = end, None
        if name:
            resume = handle(name, closing, attributes, end)
            at = end if resume is None else resume
        elif attributes == "<![CDATA[":
            text.append(html.escape(page[start + 9 : end].removesuffix("]]>")))
        try:
            tag = tags.send(resume)
        except StopIteration:
            tag = None
    text.append(page[at:])
    leave(0)
    flush()
    return found


def repeated_runs(tokens: np.ndarray, page: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """Which tokens lie in a run of ``length`` tokens that another page has too.

    The suffixes of the concatenated streams are ordered by their first ``length`` tokens by prefix doubling; equal
    ranks are neighbours in the array. Runs don't cross from a page to the next.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < length:
        return covered
    rank, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while span < length:
        step = min(span, length - span)
        pair = rank[: len(rank) - step] * np.int64(n + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    starts = np.flatnonzero(page[: len(rank)] == page[length - 1 :])
    rank, owner = rank[starts], page[starts]
    if not len(starts):
        return covered
    low = np.full(rank.max() + 1, np.iinfo(np.int64).max)
    high = np.full(rank.max() + 1, -1)
    np.minimum.at(low, rank, owner)
    np.maximum.at(high, rank, owner)
    marks = np.zeros(n + 1, np.int64)
    shared = starts[low[rank] != high[rank]]
    np.add.at(marks, shared, 1)
    np.add.at(marks, shared + length, -1)
    return np.cumsum(marks[:n]) > 0


PARSED = "page_id long, url string, host string, content binary, blocks array<struct<place string, body string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("place", pa.string()), ("body", pa.string())]))
    for batch in batches:
        for part in slices(batch, "html"):
            settled = [_settled(blocks_of(h)) for h in part.column("html").to_pylist()]
            content = [hashlib.blake2b("\n".join([host, *(t for _, t in blocks)]).encode(), digest_size=16).digest() for host, blocks in zip(part.column("host").to_pylist(), settled, strict=True)]
            parsed = [[{"place": p, "body": t} for p, t in blocks] for blocks in settled]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), pa.array(content, pa.binary()), pa.array(parsed, kind)], ["page_id", "url", "host", "content", "blocks"])


def _settled(blocks: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Blocks that aren't out; on a page with an article only the article's."""
    has_article = any(place == "article" for place, _ in blocks)
    return [b for b in blocks if b[0] == "article" or b[0] == "open" and not has_article]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, at, digest) of every window of ``REPEAT`` tokens of a page's blocks, one after the other."""
    contents, ats, digests = [], [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(ats, pa.int32()), pa.array(digests, pa.binary())], ["content", "at", "digest"])
        for column in (contents, ats, digests):
            column.clear()
        return out

    for batch in batches:
        for content, host, blocks in zip(*(batch.column(c) for c in ("content", "host", "blocks")), strict=True):
            of_host = hashlib.blake2b(host.as_py().encode() + b"\n", digest_size=16)
            words = [w.encode() for block in blocks.as_py() for w in block["body"].split(" ")]
            for at in range(len(words) - REPEAT + 1):
                window = of_host.copy()
                window.update(b" ".join(words[at : at + REPEAT]))
                contents.append(content.as_py())
                ats.append(at)
                digests.append(window.digest())
                if len(ats) >= FLUSH_WINDOWS:
                    yield flush()
    yield flush()


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open blocks without the windows that begin at one of ``starts``."""
    for batch in batches:
        texts = []
        for blocks, starts in zip(batch.column("blocks").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            words = [block["body"].split(" ") for block in blocks]
            covered = np.zeros(sum(map(len, words)), bool)
            for at in starts or ():
                covered[at : at + REPEAT] = True
            texts.append(" ".join(w for w, c in zip((w for block in words for w in block), covered, strict=True) if not c))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _usual_blocks(blocks: DataFrame) -> DataFrame:
    """(content, usual): of pages with articles, the places of blocks that most pages of the host have.

    Both tables are written before they are joined, so that the planner knows their sizes and moves whichever is small.
    """
    hosts = blocks.select(F.xxhash64("host").alias("of_host"), "host", "content", "blocks")
    pages = hosts.select("of_host", "content").distinct().groupBy("of_host").agg(F.count(F.lit(1)).alias("pages"))
    long = lambda b: F.size(F.split(b["body"], " ")) >= LONG
    bodies = F.transform("blocks", lambda b: F.when(long(b), F.unhex(F.md5(F.concat_ws("\n", "host", b["body"])))))
    places = hosts.select("of_host", "content", F.posexplode(bodies).alias("at", "digest")).where("digest IS NOT NULL")
    counts = places.select("digest", "content", "of_host").distinct().groupBy("digest", "of_host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    usual = materialize(counts.join(pages, "of_host").where(F.col("n") >= MOST_SHARE * F.col("pages")).select("digest"), "usual-blocks")
    return materialize(places.join(usual, "digest", "left_semi").groupBy("content").agg(F.collect_set("at").alias("usual")), "usual-places")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Defined results: null, empty and blank html gives an empty text; pages with a null url share one host; repeated rows
    and pages of equal blocks count as one page of their host and are returned each, alike; an empty table gives no rows;
    other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    blocks = materialize(rows.mapInArrow(_parse, PARSED), "page-blocks")
    is_open = F.exists("blocks", lambda b: b["place"] == "open")

    told = blocks.where(~is_open)
    usual = F.coalesce("usual", F.array().cast("array<int>"))
    unusual = F.filter("blocks", lambda b, at: ~F.array_contains(usual, at))
    settled = told.join(_usual_blocks(told), "content", "left").select("page_id", "url", F.array_join(F.transform(unusual, lambda b: b["body"]), " ").alias("text"))

    unsettled = blocks.where(is_open)
    windows = unsettled.select("content", "host", "blocks").mapInArrow(_windows, "content binary, at int, digest binary")
    ends = windows.groupBy("digest").agg(F.min("content").alias("first"), F.max("content").alias("last"))
    shared = ends.where("first <> last").select("digest")
    # a window that many pages have makes one skewed key of the larger side, which adaptive execution deals out
    starts = windows.join(shared.hint("merge"), "digest", "left_semi").groupBy("content").agg(F.collect_set("at").alias("starts"))
    unique = unsettled.join(starts, "content", "left").select("page_id", "url", "blocks", "starts").mapInArrow(_unique_runs, "page_id long, url string, text string")
    return settled.unionByName(unique).withColumn("n_chars", F.char_length("text").cast("long"))
