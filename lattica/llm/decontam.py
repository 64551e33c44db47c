"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document is contaminated by an item if some stretch of its words is within k = floor((1 - similarity) * n) word edits
of the item's n words. Windows of the item's size are embedded by random walks (Chakraborty, Goldenberg and Koucky,
2016): the walk copies the word at its pointer and lets a random bit of (step, word) decide whether the pointer moves
on, so that few edits become few differing places. Tables of sampled places, over several walks, make an LSH: a window
that shares a table with the item is a candidate, and candidates are verified by exact edit distance.

Only windows that can match are embedded: k edits leave at least n - q + 1 - k q of an item's q-grams in place, so a
window with fewer hits is out for certain. This bound loses nothing. The LSH has its target recall for items of some
hundred words; longer walks drift apart. So it sets the order: what it proposes is verified first, then what it doesn't.

Items are used in blocks of at most BLOCK_WORDS words, and a pass over the documents is made for each block; so what is
sent to the executors is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

SIMILARITY = 0.8
WALKS, TABLES, SAMPLED, SEED = 8, 48, 3, 10_007
BLOCK_WORDS = 400_000
#: Steps of walks that are held at a time.
WALK_CELLS = 4_000_000

SCHEMA = "doc_id long, item_id long, start long, end long, distance int, similarity double"
TOKENS = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


def gram_size(n: int) -> int:
    """The longest q up to 3 for which an item of n words keeps a q-gram under floor(n / 5) edits."""
    return 1 if n == 1 else 2 if n in (2, 5) else 3


def _scores(item: list[int], text: list[int], anchored: bool) -> Iterator[int]:
    """For each place in text the fewest edits from item to a stretch that ends there, or, if anchored, to all of text up to there. Columns are bit vectors (Myers, 1999; Hyyrö, 2003), so a text costs its length times n / 64."""
    n = len(item)
    at: dict[int, int] = {}
    for i, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << n - 1
    up, down, score, first = full, 0, n, int(anchored)
    for y in text:
        same = at.get(y, 0)
        vertical = same | down
        across = ((same & up) + up & full ^ up) | same
        more, fewer = down | full ^ (across | up), up & across
        score += bool(more & last) - bool(fewer & last)
        more, fewer = (more << 1 | first) & full, fewer << 1 & full
        up, down = fewer | full ^ (vertical | more), more & vertical
        yield score


def substring_distance(item: list[int], text: list[int], most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of text with the fewest edits from item, the first to end, the latest to start; distance most + 1 if none is within most."""
    d, end = min(((s, j) for j, s in enumerate(_scores(item, text, False), 1)), default=(len(item), 0))
    if d > most:
        return most + 1, 0, 0
    if d == len(item):
        return d, 0, 0
    back = _scores(item[::-1], text[end - 1 :: -1] if end else [], True)
    return d, end - next(j for j, s in enumerate(back, 1) if s == d), end


class Embedding:
    """WALKS random walks and, for each, TABLES sets of SAMPLED places, all decided by the seed. Places are shares of the walk's length 2 n, in which it reads n words on average."""

    def __init__(self, walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED, seed: int = SEED) -> None:
        self.rng, self.walks, self.tables, self.sampled, self.seed = np.random.default_rng(seed), walks, tables, sampled, seed
        self.places = self.rng.random((walks, tables, sampled))

    def embed(self, windows: np.ndarray, end: int) -> np.ndarray:
        """windows: (m, n) word ids. (m, walks, tables, sampled) word ids at the sampled places; `end` beyond the last word. Walks are held for some windows at a time, WALK_CELLS steps or one window."""
        each = max(1, WALK_CELLS // (2 * windows.shape[1] * self.walks))
        return np.concatenate([self._embed(windows[i : i + each], end) for i in range(0, len(windows), each)])

    def _embed(self, windows: np.ndarray, end: int) -> np.ndarray:
        m, n = windows.shape
        length = 2 * n
        padded = np.concatenate([windows, np.full((m, 1), end, np.int64)], axis=1)
        at = np.zeros((m, self.walks), np.int64)
        out = np.empty((m, self.walks, length), np.int64)
        rows = np.arange(m)[:, None]
        walk = np.arange(1, self.walks + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                x = padded[rows, at]
                out[:, :, j] = x
                h = (x.astype(np.uint64) + np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15) ^ (walk * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j) * np.uint64(0x165667B19E3779F9))
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at = np.minimum(at + ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64), n)
        place = np.minimum((self.places * length).astype(np.int64), length - 1)
        return out[:, np.arange(self.walks)[:, None, None], place]

    def candidates(self, item: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which windows agree with the embedded item in all places of at least one table."""
        same = self.embed(windows, -4) == item
        return same.all(axis=3).any(axis=(1, 2))


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, embedding: Embedding | None = None) -> None:
        self.embedding = embedding or Embedding()
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int, int, int]] = []
        self.by: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.embedded: dict[int, np.ndarray] = {}
        for item_id, text in items:
            w = words(text or "")
            n = len(w)
            if not n:
                continue
            k, q = int((1 - similarity) * n + 1e-9), gram_size(n)
            for i in range(n - q + 1):
                self.by[q][tuple(w[i : i + q])].append((len(self.items), i))
            self.items.append((item_id, np.array([self.ids.setdefault(x, len(self.ids)) for x in w], np.int64), k, q, max(1, n - q + 1 - k * q)))
        self.known = {q: frozenset(x) for q, x in self.by.items()}

    def search(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, end, distance, similarity) of each item found, its best stretch, in words of the text."""
        w = words(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for q, known in self.known.items():
            if known.isdisjoint(zip(*(w[i:] for i in range(q)))):
                continue
            by = self.by[q]
            for at, x in enumerate(zip(*(w[i:] for i in range(q)))):
                if x in known:
                    for item, i in by[x]:
                        hits[item].append((at, at - i))
        ids: np.ndarray | None = None
        found = []
        for item, pairs in hits.items():
            item_id, own, k, q, least = self.items[item]
            n = len(own)
            if len(pairs) < least:
                continue
            at = [p for p, _ in pairs]
            # A matching stretch has at most n + k words, so its hits lie within n + k - q of each other.
            good = [i for i in range(len(at) - least + 1) if at[i + least - 1] - at[i] <= n + k - q]
            if not good:
                continue
            near = sorted({s for i in good for _, s in pairs[i : bisect_left(at, at[i] + n + k - q + 1)] if s > -n})
            if ids is None:
                ids = np.array([self.ids.get(x, -2) for x in w], np.int64)
            best = self._verify(item, own, k, ids, near)
            if best:
                found.append((item_id, best[1], best[2], best[0], 1 - best[0] / n))
        return sorted(found)

    def _verify(self, item: int, own: np.ndarray, k: int, ids: np.ndarray, starts: list[int]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the item's best stretch. Windows that a table proposes come first; the rest of what the bound lets pass is verified too, so that a walk that drifts apart loses nothing."""
        n = len(own)
        padded = np.concatenate([np.full(n, -3, np.int64), ids, np.full(n + k, -3, np.int64)])
        if item not in self.embedded:
            self.embedded[item] = self.embedding.embed(own[None, :], -1)
        parts = []  # (whether proposed, first, end) of stretches that hold all matches of their windows
        for a in range(0, len(starts), 256):
            part = starts[a : a + 256]
            windows = np.stack([padded[n + s : 2 * n + s] for s in part])
            proposed = self.embedding.candidates(self.embedded[item], windows)
            for s, good in zip(part, proposed.tolist()):
                low, high = max(0, s - k), min(len(ids), s + n + 2 * k)
                if parts and low <= parts[-1][2]:
                    parts[-1] = (parts[-1][0] or good, parts[-1][1], max(high, parts[-1][2]))
                else:
                    parts.append((good, low, high))
        best = None
        for _, low, high in sorted(parts, key=lambda p: not p[0]):
            d, b, e = substring_distance(own.tolist(), ids[low:high].tolist(), k)
            if d <= k and (best is None or (d, low + e) < (best[0], best[2])):
                best = (d, low + b, low + e)
        return best


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The items in order, a bounded block at a time; null ids and texts have nothing to find and are left out."""
    sizes = written(benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text", (F.regexp_count("text", F.lit(r"\s+")) + 1).cast("long").alias("n")).dropDuplicates(["item_id", "text"]), "items")
    parts = sizes.withColumn("p", F.pmod(F.xxhash64(F.lit(SEED), "item_id", "text"), F.lit(max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) * 2 // block_words)))))
    for p in [r["p"] for r in parts.select("p").distinct().orderBy("p").toLocalIterator()]:
        yield [(r["item_id"], r["text"]) for r in parts.where(F.col("p") == p).orderBy("item_id", "text").select("item_id", "text").toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each row of docs and item that it holds: doc_id, item_id, the first and end word, distance, similarity.

    Words are runs of letters, digits and underscores in lower case. Null and empty texts and items hold nothing; an item
    of one or two words must occur exactly; repeated documents give repeated rows; empty tables give no rows.
    """
    out = None
    for block in item_blocks(benchmark, block_words):
        index = Index(block, similarity)
        index.by = {q: dict(x) for q, x in index.by.items()}

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for x in index.search(t)]
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "start", "end", "distance", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that hold no item, all their columns."""
    for block in item_blocks(benchmark, block_words):
        index = Index(block, similarity)
        index.by = {q: dict(x) for q, x in index.by.items()}

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not t or not index.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
