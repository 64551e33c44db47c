"""Main text of web pages: a host suffix array over token streams, with what the markup says of each block.

Every page's stream holds all its visible blocks, a sign before each. Suffixes are named by their first RUN tokens
(prefix doubling, names in place of ranks), which is as deep as the array matters, and sorted, so that equal runs of a
host meet and the distinct pages that hold them are counted. Equal pages of a host count once. One task sorts a host that
fits it. A larger one is never split into parts that are judged apart: its names are dealt to buckets by their low bits
and sorted there; a run that all its pages hold is one entry for each chunk of pages, not for each page.

A block that other pages of its host repeat is boilerplate, unless it is part of a repeated stretch of LONG tokens that
is not on most pages: a copy or a shared passage is text. What is left are the unique runs. The markup decides what
repetition cannot: where a page has an article or main element, the rest of the page isn't its text, and there only
blocks go that most of the host's pages repeat. Menus, footers, asides, forms, adverts and comments go by their kind
unless they would take most of the text with them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written
from lattica.llm.near_dup import Shingler

RUN = 6
#: Distinct pages that make a run boilerplate; those that do in an article, at least, if they are the larger part of the host.
MIN_PAGES, MOST_PAGES = 2, 5
#: Tokens of a repeated stretch that is a copy or a passage, and of one that goes out of the middle of a block.
LONG, PART = 50, 20
#: Bytes of html of a host that one task sorts; beyond it, tokens of the pages that are dealt and judged together, and of a bucket.
HOST_BYTES, CHUNK, BUCKET = 16_000_000, 1_000_000, 1_000_000
BROADCAST_ROWS = 100_000

SCHEMA = "page_id long, url string, text string, n_chars long"
ARTICLE, OPEN, JUNK = 0, 1, 2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
RAW_END = {t: re.compile(rf"(?i)</{t}(?=[\s/>])[^>]*>|\Z") for t in RAW}
GONE = frozenset("head button select dialog svg math canvas object audio video map datalist input".split())
FIRM_TAGS = frozenset("nav footer aside menu header".split())
READER, FIRM, SOFT = "reader", "firm", "soft"
JUNK_TAGS = frozenset("nav footer aside menu form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th img wbr".split()) - {"wbr"}
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Class or id words: those that say it as the first or last word of a name, and those that do as the whole name.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr newsletter breadcrumb breadcrumbs disqus comments".split())
WEAK = frozenset("sponsor promo promotion banner sidebar menu nav navbar navigation footer masthead notice notices popup modal overlay subscribe subscription signup share sharing social related recommended comment reply replies respond pagination pager toolbar skip login search widget".split())
REMARKS = frozenset("comment comments reply replies".split())
NAMED = frozenset("div section aside ul ol table span article li header".split())
WORDS = re.compile(r"[a-z0-9]+")


def junk(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its kind. Inside an article its header is the title's."""
    if tag in JUNK_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag in NAMED:
            for part in value.split():
                words = WORDS.findall(part)
                if words and (REMARKS & {words[0], part} if tag == "article" else part in WEAK or words[0] in STRONG or words[-1] in STRONG):
                    return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """The visible text blocks of a page in order, each with its kind: ARTICLE, OPEN or JUNK. Linear in the page's length."""
    found: list[tuple[str, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    open_: list[list] = []  # junk elements around: tag, depth of its name, number
    marks: list[str] = []  # of each junk element: READER's, FIRM or SOFT
    inside, gone, depth, at, end = 0, "", 0, 0, len(page)

    def text(piece: str) -> None:
        parts.append(html.unescape(piece) if "&" in piece else piece)

    def close() -> None:
        if parts:
            block = " ".join("".join(parts).split())
            parts.clear()
            if block:
                found.append((block, inside > 0, tuple(e[2] for e in open_)))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            if not gone:
                text(page[at:])
            break
        if not gone and m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = (m[1] or m[4]) == "/"
        if gone:
            if tag in RAW and not closing:
                at = RAW_END[tag].search(page, at).end()
            elif tag == gone:
                depth += -1 if closing else 1
                if depth == 0:
                    gone = ""
            continue
        if not closing and tag in RAW:
            at = RAW_END[tag].search(page, at).end()
            continue
        attributes = m[3] or m[6] or ""
        opens = not closing and tag not in VOID
        is_junk = opens and len(open_) < 8 and junk(tag, attributes, inside > 0)
        if tag in BLOCK or is_junk:
            close()
        elif tag in SPACED:
            parts.append(" ")
        if opens and tag in GONE:
            gone, depth = tag, 1
            continue
        for i, e in enumerate(open_):
            if e[0] == tag:
                e[1] += -1 if closing else opens
                if not e[1]:
                    close()
                    del open_[i:]
                    break
        if is_junk:
            open_.append([tag, 1, len(marks)])
            marks.append(READER if tag == "article" else FIRM if tag in FIRM_TAGS else SOFT)
        if tag in MAIN:
            inside = max(0, inside - 1) if closing else inside + 1
    close()
    for _, _, i in open_:  # never closed, so what it holds is uncertain
        marks[i] = SOFT
    return judged(found, marks)


def judged(found: list[tuple[str, bool, tuple[int, ...]]], marks: list[str]) -> list[tuple[str, int]]:
    """Blocks (text, whether in an article, junk elements around) with their kinds. A junk element that holds the only article isn't junk, nor is a soft one that holds most of the words that are left to judge; a reader's article is."""
    told = any(own and not around for _, own, around in found)
    void: set[int] = set()
    if not told and any(own and not any(marks[i] == READER for i in around) for _, own, around in found):
        void |= {i for _, own, around in found if own and not any(marks[i] == READER for i in around) for i in around}
        told = True
    sizes = [b.count(" ") + 1 for b, _, _ in found]
    mine = [k for k, (_, own, _) in enumerate(found) if own or not told]
    total = sum(sizes[k] for k in mine)
    held: dict[int, int] = {}
    for k in mine:
        for i in found[k][2]:
            held[i] = held.get(i, 0) + sizes[k]
    void |= {i for i, n in held.items() if 2 * n > total and marks[i] == SOFT}
    return [(b, JUNK if not set(around) <= void else ARTICLE if own else JUNK if told else OPEN) for b, own, around in found]


SIGN = np.uint64(0x9E3779B97F4A7C15)
NAMER = Shingler()


def stream(texts: list[str]) -> np.ndarray:
    """Token names of the blocks, a sign before each."""
    if not texts:
        return np.empty(0, np.uint64)
    sizes = np.array([t.count(" ") + 1 for t in texts])
    return np.insert(NAMER.words("\n".join(texts)), np.cumsum(sizes) - sizes, SIGN)


def named(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(29))) * Shingler.MIX + y
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def suffixes(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """Of each suffix with at least `run` tokens, the name of its first `run`, by prefix doubling."""
    if len(tokens) < run:
        return np.empty(0, np.uint64)
    name, have = named(tokens, np.full(len(tokens), SIGN)), 1
    while have < run:  # the last step overlaps so that it ends at run exactly
        step = min(have, run - have)
        name = named(name[: len(name) - step], name[step:])
        have += step
    return name


def hashed(text: str) -> np.uint64:
    return NAMER.words(text.replace(" ", "_") or "_")[0] if text.strip() else SIGN


def spread(tokens: int, times: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token the largest of the times of the runs that cover it."""
    out = np.zeros(tokens, np.int64)
    for i in range(run if len(times) else 0):
        np.maximum(out[i : i + len(times)], times, out=out[i : i + len(times)])
    return out


def stretches(mask: np.ndarray) -> np.ndarray:
    """For each token the length of the stretch of mask that it is in, 0 outside."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(mask), np.int64)
    out[mask] = np.repeat(b - a, b - a)
    return out


def main_text(page: list[tuple[str, int]], times: np.ndarray, pages: int, run: int = RUN) -> str:
    """The text of a page, given how many distinct pages of its host, of `pages`, hold each of its runs."""
    told = any(kind == ARTICLE for _, kind in page)
    wanted = ARTICLE if told else OPEN
    most = max(MOST_PAGES, pages // 2 + 1)
    held = spread(sum(b.count(" ") + 2 for b, _ in page), times, run)
    often = held >= most
    gone = often if told else held >= MIN_PAGES
    if not told:  # a long stretch is a copy or a passage, unless most pages have it
        gone = gone & ((stretches(gone) < LONG) | often)
    kept, left, all_, at = [], 0, 0, 0
    for b, kind in page:
        w = b.split(" ")
        mask = gone[at + 1 : at + 1 + len(w)]
        at += 1 + len(w)
        if kind != wanted:
            continue
        all_ += len(w)
        if mask.all() and (not told or len(w) < LONG):
            continue
        left += len(w)
        if not told and mask.any() and (out := mask & (stretches(mask) >= PART)).any():
            b = " ".join(x for x, g in zip(w, out) if not g)
        kept.append(b)
    if told and 2 * left < all_:  # most of an article repeats: a host of copies
        kept = [b for b, kind in page if kind == wanted]
    return "\n".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def packed(texts: list[str], kinds: bytes) -> bytes:
    """Blocks and kinds of a page for its way through a shuffle."""
    raw = kinds + "\n".join(["", *texts]).encode("utf-8", "surrogatepass")
    return len(kinds).to_bytes(4, "big") + len(raw).to_bytes(5, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[list[str], bytes]:
    n = int.from_bytes(blob[:4], "big")
    raw = pa.decompress(blob[9:], int.from_bytes(blob[4:9], "big"), codec="zstd", asbytes=True)
    return raw[n:].decode("utf-8", "surrogatepass").split("\n")[1:], raw[:n]


def parsed(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row, page_id, url, host, content (name of its blocks), chunk, n (tokens), blob (its blocks and kinds) of every page; a chunk has about so many tokens, or one page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            found = [blocks(h or "") for h in batch.column(3).to_pylist()]
            chunks, contents, sizes = [], [], []
            for f in found:
                sizes.append(sum(b.count(" ") + 2 for b, _ in f))
                tokens += sizes[-1]
                if tokens > chunk:
                    part, tokens = part + 1, 0
                chunks.append(part)
                x = stream([b for b, _ in f])
                with np.errstate(over="ignore"):
                    contents.append(int(named(x, np.arange(len(x), dtype=np.uint64) * SIGN).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2), pa.array(contents, pa.int64()), pa.array(chunks, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([packed([b for b, _ in f], bytes(k for _, k in f)) for f in found], pa.binary()),
                ],
                names=["page_id", "url", "host", "content", "chunk", "n", "blob"],
            )

    out = pages.mapInArrow(run, "page_id long, url string, host string, content long, chunk long, n long, blob binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def repeats(rows: DataFrame, run: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """chunk, names, times: for each chunk of rows the runs that at least MIN_PAGES distinct pages of a host hold, and for each of its hosts how many pages it has. A chunk has several rows."""
    first = rows.groupBy("host", "content").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    few = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 << max(3, total // bucket).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        now = None

        def out() -> pa.RecordBatch:
            x, n = np.concatenate(names), np.concatenate(counts)
            names.clear(), counts.clear()
            x, i = np.unique(x, return_inverse=True)
            n = np.bincount(i, weights=n, minlength=len(x)).astype(np.uint32)
            low = (x & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(low, kind="stable")
            ends = np.searchsorted(low[order], np.arange(buckets + 1))
            full = np.flatnonzero(ends[1:] > ends[:-1])
            cut = [order[ends[k] : ends[k + 1]] for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([now] * len(full), pa.int64()), pa.array([x[c].tobytes() for c in cut], pa.binary()), pa.array([n[c].tobytes() for c in cut], pa.binary())], names=["bucket", "chunk", "names", "times"])

        for batch in batches:
            for chunk, host, blob, one in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if chunk != now and names:
                    yield out()
                now, h = chunk, hashed(host)
                x = np.unique(suffixes(stream(unpacked(blob)[0]), run))
                names.append(np.append(named(x, np.full(len(x), h)), named(h[None], h[None])))
                counts.append(np.full(len(x) + 1, int(bool(one))))
        if names:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
        n = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint32)
        x, i = np.unique(np.concatenate(raw), return_inverse=True)
        times = np.bincount(i, weights=n, minlength=len(x)).astype(np.int64)[i]
        ends = np.cumsum([0, *map(len, raw)])
        good = [times[a:b] >= MIN_PAGES for a, b in zip(ends[:-1], ends[1:])]
        return pa.table({"chunk": table.column("chunk"), "names": pa.array([r[g].tobytes() for r, g in zip(raw, good)], pa.binary()), "times": pa.array([times[a:b][g].tobytes() for a, b, g in zip(ends[:-1], ends[1:], good)], pa.binary())})

    dealt = rows.select("row", "chunk", "host", "blob").join(F.broadcast(first) if few else first, "row", "left").select("chunk", "host", "blob", "first")
    dealt = dealt.mapInArrow(deal, "bucket int, chunk long, names binary, times binary")
    return dealt.groupBy("bucket").applyInArrow(lambda t: meet(t), "chunk long, names binary, times binary").where(F.length("names") > 0)


def small_hosts(pages: DataFrame, run: int = RUN) -> DataFrame:
    """extract for pages (page_id, url, host, html) of hosts that fit one task each: the array of a host is sorted there."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h or "") for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2), pa.array([packed([b for b, _ in f], bytes(k for _, k in f)) for f in found], pa.binary())], names=["page_id", "url", "host", "blob"])

    def judge(table: pa.Table) -> pa.Table:
        order: dict[bytes, int] = {}
        which = [order.setdefault(b, len(order)) for b in table.column("blob").to_pylist()]  # equal pages are judged once
        own = [unpacked(b) for b in order]
        names = [suffixes(stream(t), run) for t, _ in own]
        x, i = np.unique(np.concatenate(names), return_inverse=True)
        page = np.repeat(np.arange(len(own)), [len(n) for n in names])
        first = np.unique(i * len(own) + page) // len(own)  # a page counts once for each of its runs
        times = np.bincount(first, minlength=len(x))[i]
        ends = np.cumsum([0, *map(len, names)])
        texts = [main_text(list(zip(t, kinds)), times[a:b], len(own), run) for (t, kinds), a, b in zip(own, ends[:-1], ends[1:])]
        text = [texts[k] for k in which]
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return pages.mapInArrow(parse, "page_id long, url string, host string, blob binary").groupBy("host").applyInArrow(lambda t: judge(t), SCHEMA)


def large_hosts(pages: DataFrame, run: int = RUN, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """extract for pages (page_id, url, host, html) of any hosts: the array is distributed."""
    rows = written(parsed(pages, chunk), "pages")
    found = written(repeats(rows, run, bucket), "repeats")

    def judge(pages: pa.Table, found: pa.Table) -> pa.Table:
        names, times = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind) for c, kind in (("names", np.uint64), ("times", np.int64)))
        names, at = np.unique(names, return_index=True)
        times = times[at]

        def look(x: np.ndarray) -> np.ndarray:
            if not len(names):
                return np.zeros(len(x), np.int64)
            i = np.minimum(np.searchsorted(names, x), len(names) - 1)
            return np.where(names[i] == x, times[i], 0)

        texts = []
        for host, blob in zip(*(pages.column(c).to_pylist() for c in ("host", "blob"))):
            (own, kinds), h = unpacked(blob), hashed(host)
            x = suffixes(stream(own), run)
            texts.append(main_text(list(zip(own, kinds)), look(named(x, np.full(len(x), h))), int(look(named(h[None], h[None]))[0]), run))
        return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    left = rows.select("chunk", "page_id", "url", "host", "blob")
    return left.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda p, f: judge(p, f), SCHEMA)


def extract(pages: DataFrame, run: int = RUN, host_bytes: int = HOST_BYTES, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """page_id, url, text, n_chars of every row; null html counts as empty, a page without text has ''. Repeated rows are pages each, null urls make one host.

    A host of at most host_bytes of html is one task's; the array of a larger one is distributed, with the same result.
    """
    three = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    large = written(three.groupBy("host").agg(F.sum(F.octet_length(F.col("html").cast("string"))).alias("n")).where(F.col("n") > host_bytes).select("host"), "hosts")
    n = large.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return small_hosts(three, run)
    names = F.broadcast(large) if n <= BROADCAST_ROWS else large
    return small_hosts(three.join(names, "host", "left_anti").select(*three.columns), run).unionByName(large_hosts(three.join(names, "host", "left_semi").select(*three.columns), run, chunk, bucket))
