"""Near-duplicates by containment: an LSH ensemble over MinHash signatures.

Two texts are linked if they share at least 80 % of the smaller one's distinct five-word shingles. Texts are partitioned
by shingle-set size (powers of two). For partitions i <= j the containment threshold t becomes the Jaccard threshold
t / (1 + u - t), u being the largest size ratio of their members (Zhu et al., 2016), and each pair of partitions gets the
number of bands that finds a pair at its own threshold with probability 1 - MISS. Candidates are checked exactly.

Copies of one text are one node throughout, so thousands of copies cost a row each. Nodes that share a band's value are
not paired with each other: within the bucket they are sorted by the next value of their signature (as in an LSH forest),
then at random, and each is a candidate with the NEAR nodes before it and with the bucket's smallest set so far, which is
what contains least and is contained most. So a bucket of m nodes gives O(m) candidates; the best of each node is checked.

The ensemble misses links: between sizes far apart, and in buckets that a passage crowds. So a last round finds every
link that is left between its classes. Only shingles that are held by more than one class can be part of such a link, and
a text of n shingles can be the smaller end only if ceil(0.8 n) of its shingles are; few texts are left then. Those ask
for the holders of their rarest shingles, one more than a link may lack, and the pairs are checked exactly too. Where many ask
for what many hold (copies that drifted just below the threshold, say), pairs are as many as the product: such a crowd is
counted in blocks, by matrix products over its texts' shingles, and no pair of it becomes a row unless it is a link.
Classes are connected components by contraction, each round a table in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.llm.common import fresh, written
from lattica.plans.lineage import forget

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, MISS, NEAR, SEED = 72, 0.001, 3, 60_013
#: Candidates whose signatures agree in so many standard deviations less than those of a link at the threshold aren't checked by the ensemble; the last round finds the links among them.
SIGMAS = 2.0
#: About how many entries are in one bucket of the last round, and how many texts are sampled for its hot shingles.
BUCKET, SAMPLED_NODES = 4_000_000, 8_192
#: Up to so many candidate ids (8 bytes each) are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Shingles that more texts than these ask for and hold make crowds, whose links are counted by blocks: so many texts and entries in one, about.
CROWD_ASKERS, CROWD_HOLDERS = 16, 64
BLOCK_TEXTS, BLOCK_ENTRIES = 2_048, 1 << 20


class Shingler:
    """Distinct 64-bit hashes of the five-word runs of a text, sorted. A text of 1 to 4 words has one: all of it.

    A word's hash is a polynomial over a random value for each byte, taken from running sums: no word becomes a Python
    object. Words are hashed PIECE bytes at a time (or one longer word), which bounds the tables.
    """

    PIECE = 1 << 20
    BASE = 0x9E3779B97F4A7C15 | 1
    MIX = np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, k: int = SHINGLE) -> None:
        self.k = k
        self.value = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)
        self.solid = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
        self.power = self.inverse = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if n > len(self.power):
            n = 1 << (n - 1).bit_length()
            self.power, self.inverse = np.full(n, self.BASE, np.uint64), np.full(n, pow(self.BASE, -1, 2**64), np.uint64)
            for t in (self.power, self.inverse):
                t[0] = 1
                np.multiply.accumulate(t, out=t)

    def words(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.diff(np.concatenate([[False], self.solid[raw], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = np.empty(len(starts), np.uint64)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(starts):
                j = max(i + 1, int(np.searchsorted(ends, starts[i] + self.PIECE, "right")))
                base, n = int(starts[i]), int(ends[j - 1] - starts[i])
                self._tables(n + 1)
                run = np.concatenate([[np.uint64(0)], np.cumsum(self.value[raw[base : base + n]] * self.power[:n])])
                out[i:j] = (run[ends[i:j] - base] - run[starts[i:j] - base]) * self.inverse[starts[i:j] - base]
                i = j
            out ^= out >> np.uint64(32)
            out *= self.MIX
        return out

    def __call__(self, text: str) -> np.ndarray:
        x = self.words(text)
        if not len(x):
            return x
        k = min(self.k, len(x))
        n = len(x) - k + 1
        with np.errstate(over="ignore"):
            h = np.full(n, k, np.uint64)
            for i in range(k):
                h ^= x[i : i + n]
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each of the hashes a x + b in 32 bits; pieces bound the memory for long texts."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        y = a[:, None] * x[None, i : i + 2048]
        y += b[:, None]
        np.minimum(best, y.min(axis=1), out=best)
    return best.view(np.int32)


def coefficients(bands: int = BANDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, bands, dtype=np.uint32)


def jaccard_threshold(steps: int, containment: float = CONTAINMENT) -> float:
    """For size partitions that lie `steps` apart."""
    return containment / (1 + 2.0 ** (steps + 1) - containment)


def bands_for(steps: int, containment: float = CONTAINMENT, bands: int = BANDS, miss: float = MISS) -> int:
    """How many bands of one row find a pair at the threshold but for a share of `miss`; all bands where even they don't suffice (three steps and more): the last round finds what they miss."""
    s = jaccard_threshold(steps, containment)
    return min(bands, math.ceil(math.log(miss) / math.log1p(-s)))


def text_hash() -> list[Column]:
    t = F.coalesce("text", F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2")]


def signed(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, h1, h2, size, sig, bytes (8 bits of each hash of sig) for every row."""
    a, b = coefficients(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            sizes, sigs = [], []
            for text in batch.column(3).to_pylist():
                s = shingle(text or "")
                sizes.append(len(s))
                sigs.append(signature(s, a, b) if len(s) else np.empty(0, np.int32))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array([(s & 255).astype(np.uint8).tobytes() for s in sigs], pa.binary())], names=["doc_id", "h1", "h2", "size", "sig", "bytes"])

    return docs.select("doc_id", *text_hash(), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, size int, sig array<int>, bytes binary")


def candidates(nodes: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS, near: int = NEAR) -> DataFrame:
    """a < b, seen: pairs of nodes (node, size, sig) that share a band that their partitions use, and in how many they met.

    Rows are sorted by range, so that a bucket that holds a third of all nodes is many tasks' work.
    """
    used = np.array([bands_for(k, containment, bands) for k in range(33)])
    n = F.size("sig")
    value = lambda k: F.get("sig", F.pmod(F.col("band") + k, n))
    rows = nodes.where("size > 0").select("node", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    rest = F.shiftleft(value(1).cast("long"), 32) + F.xxhash64("band", "node").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = rows.select(F.xxhash64("band", value(0)).alias("key"), rest.alias("rest"), "node", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("size")).alias("packed"))
    rows = rows.repartitionByRange("key", "rest").sortWithinPartitions("key", "rest", "node")

    def meet(key: np.ndarray, node: np.ndarray, packed: np.ndarray, known: int) -> np.ndarray:
        """The pairs of the rows from `known` on."""
        size, band, at = packed & 0xFFFFFFFF, packed >> 32, np.arange(len(key))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.minimum.reduceat((size << 20) | at, first) & 0xFFFFF
        x, y = [at], [np.repeat(least, np.diff(np.append(first, len(key))))]
        for k in range(1, near + 1):
            i = np.flatnonzero(key[k:] == key[:-k]) + k
            x.append(i), y.append(i - k)
        x, y = np.concatenate(x), np.concatenate(y)
        steps = np.abs(np.log2(size[x]).astype(np.int64) - np.log2(size[y]).astype(np.int64))
        good = (np.maximum(x, y) >= known) & (node[x] != node[y]) & (band[x] < used[steps])
        x, y = node[x[good]], node[y[good]]
        return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        before = [np.empty(0, np.int64)] * 3

        def out() -> pa.RecordBatch:
            pairs, seen = _distinct(np.concatenate(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(seen)], names=["a", "b", "seen"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in (0, 2, 3)]
            key, node, packed = (np.concatenate([p, q]) for p, q in zip(before, now))
            held.append(meet(key, node, packed, len(before[0])))
            # The bucket that may go on: its smallest node so far and its last ones.
            own = np.flatnonzero(key == key[-1])
            keep = np.unique(np.append(own[-near:], own[np.argmin(packed[own] & 0xFFFFFFFF)]))
            before = [key[keep], node[keep], packed[keep]]
            if sum(map(len, held)) > 1 << 20:
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, "a long, b long, seen long").groupBy("a", "b").agg(F.sum("seen").alias("seen"))


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and how often each occurs."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), (pairs[1:] != pairs[:-1]).any(1)]))
    return pairs[at], np.diff(np.append(at, len(pairs))).astype(np.int64)


def likely(pairs: DataFrame, nodes: DataFrame, containment: float = CONTAINMENT, sigmas: float = SIGMAS) -> DataFrame:
    """The pairs whose signatures agree in as many places as a linked pair of their sizes would, less `sigmas` standard deviations. 8 bits of each hash are compared: a signature is as many bytes as there are bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, p, q = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (3, 4, 5, 6))
            if not len(p):
                continue
            same = (np.frombuffer(b"".join(p), np.uint8) == np.frombuffer(b"".join(q), np.uint8)).reshape(len(p), -1)
            n = same.shape[1]
            small, large = np.minimum(x, y), np.maximum(x, y)
            shared = np.ceil(small * containment - 1e-9)
            j = shared / (small + large - shared)
            chance = j + (1 - j) / 256
            yield batch.slice(0).filter(pa.array(same.sum(1) >= n * chance - sigmas * np.sqrt(n * chance * (1 - chance)))).select(["a", "b", "seen"])

    own = nodes.where("size > 0").select("node", "size", "bytes")
    left, right = own.select(F.col("node").alias("a"), F.col("size").alias("x"), F.col("bytes").alias("p")), own.select(F.col("node").alias("b"), F.col("size").alias("y"), F.col("bytes").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "seen", "x", "y", "p", "q").mapInArrow(run, "a long, b long, seen long")


def bearing(docs: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    """node, more, text of nodes (node, h1, h2, rep, more), from the row of docs that represents it. Null ids have their text's hash in place of it."""
    own = nodes.select("node", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("rep", "h1").alias("_rep"), *more)
    if own.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        own = F.broadcast(own)
    h1, h2 = text_hash()
    full = docs.select(F.coalesce("doc_id", h1).alias("_id"), h1, h2, F.coalesce("text", F.lit("")).alias("text"))
    return full.join(own, (full["_id"] == own["_rep"]) & (full["h1"] == own["_h1"]) & (full["h2"] == own["_h2"])).select("node", *more, "text")


def hot_shingles(docs: DataFrame, nodes: DataFrame, rows: int, most: int, sampled: int = SAMPLED_NODES) -> np.ndarray:
    """Shingles, sorted, that about `most` nodes or more have, told by a sample of about `sampled` of the `rows` nodes. Which they are decides on the layout of the work only."""
    every = max(1, rows // sampled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingle(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["s"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            new = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
            s, i = np.unique(np.concatenate([s, new[0]]), return_inverse=True)
            n = np.bincount(i, weights=np.concatenate([n, new[1]]), minlength=len(s)).astype(np.int64)
        hot = s[n >= max(2, most / every)]
        yield pa.RecordBatch.from_arrays([pa.array([hot.tobytes()], pa.binary())], names=["s"])

    if rows < most:
        return np.empty(0, np.uint64)
    some = nodes.where(F.pmod("h2", F.lit(every)) == 0)
    found = bearing(docs, some).mapInArrow(run, "s binary").repartition(1).mapInArrow(count, "s binary").first()
    return np.frombuffer(found.s, np.uint64) if found else np.empty(0, np.uint64)


def shared_shingles(docs: DataFrame, nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Of the shingles of nodes (node, h1, h2, rep, size, label), those that nodes of more than one label have.

    A row for each bucket of shingles: id, times (of each such shingle), holders (times of them, indexes into node and
    label), node, label, many (how many such shingles each has here). Shingles are dealt by their low bits; those that
    are hot are dealt by shingle and node, so that a bucket has about `bucket` entries whatever any of them does.
    """
    nodes = nodes.where("size > 0")
    total, rows = nodes.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = 1 << max(3, math.ceil(total / bucket) - 1).bit_length()
    known = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, nodes, rows, max(2, bucket // 8)))
    low = buckets.bit_length() - 1
    parts = ["node", "label", "many", "key"]

    def ids(s: np.ndarray) -> np.ndarray:
        """32 upper bits and the bucket's: what tells shingles apart here."""
        return ((s >> np.uint64(32)) << np.uint64(low)) | (s & np.uint64(buckets - 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hot = Shingler(), known.value

        def cut(sets: list[np.ndarray], node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            s, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            is_hot = np.zeros(len(s), bool)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
            to, spread = (s & np.uint64(buckets - 1)).astype(np.int64), s[is_hot] ^ node[own[is_hot]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            to[is_hot] = ((spread * Shingler.MIX) >> np.uint64(32)).astype(np.int64) & (buckets - 1)
            out = []
            for flag in (False, True):
                at = np.flatnonzero(is_hot == flag)
                if not len(at):
                    continue
                at = at[np.argsort(to[at].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
                key = ids(s[at]) if flag else (s[at] >> np.uint64(32)).astype(np.uint32)
                ends = np.searchsorted(to[at], np.arange(buckets + 1))
                for k in np.flatnonzero(ends[1:] > ends[:-1]):
                    i, j = ends[k], ends[k + 1]
                    first = np.flatnonzero(np.concatenate([[True], own[at[i + 1 : j]] != own[at[i : j - 1]]]))
                    doc = own[at[i:j]][first]
                    other = np.flatnonzero(label[doc] != node[doc])  # most labels are their node
                    out.append((k, flag, node[doc].tobytes(), np.concatenate([other, label[doc][other]]).tobytes(), np.diff(np.append(first, j - i)).astype(np.uint32).tobytes(), key[i:j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()), *[pa.array([r[c] for r in out], pa.binary()) for c in range(2, 6)]], names=["bucket", "hot", *parts])

        with np.errstate(over="ignore"):
            sets, at, held = [], [], 0
            for batch in batches:
                node, label = (batch.column(i).to_numpy() for i in (0, 1))
                for i, text in enumerate(batch.column(2)):
                    sets.append(shingle(text.as_py()))
                    at.append((node[i], label[i]))
                    held += len(sets[-1])
                    if held >= 1 << 19:
                        yield cut(sets, *map(np.array, zip(*at)))
                        sets, at, held = [], [], 0
            if sets:
                yield cut(sets, *map(np.array, zip(*at)))

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        """The shingles of one bucket that are shared between labels."""
        flag = np.array(rows.column("hot").to_pylist())
        raw = {c: rows.column(c).to_pylist() for c in parts}
        node = np.frombuffer(b"".join(raw["node"]), np.int64)
        label, i = node.copy(), 0
        for own, other in zip(raw["node"], raw["label"]):
            at, to = np.frombuffer(other, np.int64).reshape(2, -1)
            label[i + at] = to
            i += len(own) // 8
        unique, doc = np.unique(node, return_inverse=True)
        of = np.empty(len(unique), np.int64)
        of[doc] = label
        entries, i = [], 0
        for f, m, k in zip(flag, raw["many"], raw["key"]):
            m = np.frombuffer(m, np.uint32)
            k = np.frombuffer(k, np.uint64) if f else (np.frombuffer(k, np.uint32).astype(np.uint64) << np.uint64(low)) | np.uint64(key[0].as_py())
            entries.append((k, np.repeat(doc[i : i + len(m)], m).astype(np.uint32), np.full(len(k), f)))
            i += len(m)
        s, own, hot = (np.concatenate([e[c] for e in entries]) for c in range(3))
        order = np.argsort(s)
        s, own, hot = s[order], own[order], hot[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.diff(np.append(first, len(s)))
        held = of[own]
        mixed = (np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first)) | np.logical_or.reduceat(hot, first)
        own = own[np.repeat(mixed, times)]
        # In a bucket of its own a hot shingle has a part of its holders: it counts as many times, to be the last choice.
        weight = np.where(np.logical_or.reduceat(hot, first), np.int64(1) << 40, times)
        many = np.bincount(own, minlength=len(unique))
        has = many > 0
        new = np.cumsum(has) - 1
        blob = lambda x, kind: pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary())
        return pa.table({"id": blob(s[first][mixed], np.int64), "weight": blob(weight[mixed], np.int64), "times": blob(times[mixed], np.uint32), "holders": blob(new[own], np.uint32), "node": blob(unique[has], np.int64), "label": blob(of[has], np.int64), "many": blob(many[has], np.int64)})

    dealt = bearing(docs, nodes, "label").select("node", "label", "text")
    dealt = dealt.mapInArrow(deal, "bucket int, hot boolean, " + ", ".join(f"{c} binary" for c in parts))
    return dealt.groupBy("bucket").applyInArrow(lambda k, t: meet(k, t), ", ".join(f"{c} binary" for c in ("id", "weight", "times", "holders", "node", "label", "many")))


def unpacked(shared: DataFrame, *columns: str) -> DataFrame:
    """The entries of shared_shingles: id, weight, node and label of each shingle and holder; or of the columns node and many, a row for each node of a bucket."""
    whole = "id" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda batch, i, c, kind=np.int64: np.frombuffer(batch.column(c)[i].as_py(), kind)
        for batch in batches:
            for i in range(batch.num_rows):
                if whole:
                    times, holders = read(batch, i, "times", np.uint32), read(batch, i, "holders", np.uint32)
                    found = {"id": np.repeat(read(batch, i, "id"), times), "weight": np.repeat(read(batch, i, "weight"), times), "node": read(batch, i, "node")[holders], "label": read(batch, i, "label")[holders]}
                else:
                    found = {c: read(batch, i, c) for c in columns}
                n = len(found[columns[0]])
                for a in range(0, n, 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[c][a : a + 100_000]) for c in columns], names=list(columns))

    need = ("id", "weight", "times", "holders", "node", "label") if whole else columns
    return shared.select(*need).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def meetings(docs: DataFrame, nodes: DataFrame, containment: float = CONTAINMENT, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """a < b, seen: pairs of nodes (node, h1, h2, rep, size, label) of different labels that may be linked; and a, b: links found in crowds. No linked pair of different labels is missing, but that crowds' links only join the same labels as all of them would.

    Of n shingles a link of x, the smaller set, needs n - f = ceil(containment n), all of them held by another label. So x
    asks only if it has m >= n - f such shingles, and then any m - (n - f) + 1 of them do: one is the other text's. It asks
    with the rarest.
    """
    shared = written(shared_shingles(docs, nodes, bucket), "shared")
    least = F.ceil(F.col("size") * F.lit(containment) - 1e-9)
    many = unpacked(shared, "node", "many").groupBy("node").agg(F.sum("many").alias("many"))
    askers = written(many.join(nodes.select("node", "size", F.col("label").alias("own")), "node").where(F.col("many") >= least).select("node", "own", (F.col("many") - least + 1).alias("asks")), "askers")
    few = lambda df: F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df
    entries = unpacked(shared, "id", "weight", "node", "label")
    own = entries.join(few(askers), "node")
    nth = F.row_number().over(W.partitionBy("node").orderBy("weight", "id"))
    asks = written(own.withColumn("nth", nth).where("nth <= asks").select("id", "weight", F.col("node").alias("x"), "own"), "asks")
    # What few ask for or few hold: rows are at most so many times the asks, or the entries.
    hot = asks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")).where((F.col("n") > CROWD_ASKERS) & (F.col("weight") > CROWD_HOLDERS))
    hot = written(hot.select("id"), "hot")
    met = entries.select("id", "node", "label").join(few(asks.join(hot, "id", "left_anti").select("id", "x", "own")), "id").where("node <> x AND label <> own")
    out = written(met.groupBy(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).agg(F.count(F.lit(1)).alias("seen")), "rest")
    # A crowd: the shingles that are tied by who asks for them, all who ask, all who hold.
    crowded = written(asks.join(hot, "id", "left_semi").select("x", "id"), "crowded")
    first = crowded.groupBy("x").agg(F.min("id").alias("first"))
    tied = components(crowded.join(first, "x").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    crowds = written(hot.join(tied.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("crowd")), "crowds")
    asking = first.join(crowds, first["first"] == crowds["id"]).select(F.col("x").alias("node"), "crowd", F.lit(True).alias("asks"))
    holding = entries.select("id", "node").join(few(crowds), "id").select("node", "crowd").distinct().withColumn("asks", F.lit(False))
    members = written(asking.union(holding), "members")
    links = crowd_links(members, docs, nodes, containment)
    forget(shared, askers, asks, hot, crowded, tied, crowds, members)
    return out, links


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of left shares with each of right. Values that many pairs share are counted by matrix products, the others pair by pair."""
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.int32)
    if not len(both):
        return out
    at, own, times, starts = [], [], [], []
    for values, of in sides:
        i = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[i] == values
        i, of = i[known], of[known]
        order = np.argsort(i, kind="stable")
        at.append(i[order]), own.append(of[order])
        times.append(np.bincount(i, minlength=len(both)))
        starts.append(np.cumsum(times[-1]) - times[-1])
    work = times[0] * times[1]
    dense = work > out.size // 64
    place = np.cumsum(dense) - 1
    for k in range(0, int(dense.sum()), 256):
        parts = []
        for side in (0, 1):
            use = dense[at[side]] & (place[at[side]] >= k) & (place[at[side]] < k + 256)
            m = np.zeros((len((left, right)[side]), 256), np.float32)
            m[own[side][use], place[at[side][use]] - k] = 1
            parts.append(m)
        np.add(out, parts[0] @ parts[1].T, out=out, casting="unsafe")
    # An entry of left meets all entries of right that have its value.
    mine = np.flatnonzero(~dense[at[0]])
    total = np.cumsum(times[1][at[0][mine]])
    i = 0
    while i < len(mine):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 21), "right")))
        n = times[1][at[0][mine[i:j]]]
        to = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[1][at[0][mine[i:j]]], n)
        cell, count = np.unique(np.repeat(own[0][mine[i:j]], n) * len(right) + own[1][to], return_counts=True)
        out.reshape(-1)[cell] += count.astype(np.int32)
        i = j
    return out


def crowd_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, containment: float = CONTAINMENT, texts: int = BLOCK_TEXTS, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """a, b: of the links between those of members (node, crowd, asks) that ask and the others of the same crowd, as many as join the same labels of nodes (node, h1, h2, rep, size, label). Each block of the one goes with each of the other to a task."""
    whole = bearing(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shingle(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())], names=["node", "label", "shingles"])

    def meet(rows: pa.Table) -> pa.Table:
        sides = []
        for flag in (True, False):
            own = rows.filter(pa.array([x == flag for x in rows.column("asks").to_pylist()], pa.bool_()))
            sides.append((own.column("node").to_numpy(), own.column("label").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in own.column("shingles")]))
        (a, la, left), (b, lb, right) = sides
        found: list[tuple[int, int]] = []
        if len(a) and len(b):
            shared, sizes, up = overlaps(left, right), np.array([len(x) for x in right]), {}

            def top(x: int) -> int:
                while up.setdefault(x, x) != x:
                    up[x] = x = up[up[x]]
                return x

            for i, x in enumerate(left):
                good = np.flatnonzero((shared[i] >= np.ceil(np.minimum(len(x), sizes) * containment - 1e-9)) & (lb != la[i]))
                for j in good[np.unique(lb[good], return_index=True)[1]]:
                    p, q = top(int(la[i])), top(int(lb[j]))
                    if p != q:
                        up[p] = q
                        found.append((int(min(a[i], b[j])), int(max(a[i], b[j]))))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    sets = written(whole.select("node", "label", "text").mapInArrow(cut, "node long, label long, shingles binary"), "sets")
    sized = members.join(nodes.select("node", "size"), "node")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / texts, F.sum(F.col("size").cast("long")) / entries))
    parts = sized.groupBy("crowd", "asks").agg(parts.alias("parts")).groupBy("crowd").agg(F.max(F.when(F.col("asks"), F.col("parts"))).alias("left"), F.max(F.when(~F.col("asks"), F.col("parts"))).alias("right"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    placed = members.join(parts, "crowd").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("asks"), F.col("left")).otherwise(F.col("right"))))
    left = placed.where("asks").select("node", "crowd", "asks", F.col("own").alias("i"), upto("right").alias("j"))
    right = placed.where("NOT asks").select("node", "crowd", "asks", upto("left").alias("i"), F.col("own").alias("j"))
    blocks = left.union(right).join(sets, "node").select("crowd", "i", "j", "asks", "node", "label", "shingles")
    links = written(blocks.groupBy("crowd", "i", "j").applyInArrow(meet, "a long, b long"), "links")
    forget(sets)
    return links


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, containment: float = CONTAINMENT, share: int = 256) -> DataFrame:
    """The pairs (a, b) of nodes (node, h1, h2, rep, size) that share at least that part of the smaller set, by their whole texts.

    The smaller texts follow the larger one in a stream, which goes once to each task that has some of its pairs: a text
    with many pairs is dealt to one task for every `share` of them.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    whole = written(bearing(docs, nodes.join(ends, "node", "left_semi")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, large = Shingler(), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if a is None:
                    last, large = b, shingle(text.as_py())
                    keep.append(False)
                    continue
                if b != last:
                    raise ValueError("a text is missing")
                x = shingle(text.as_py())
                at = np.minimum(np.searchsorted(large, x), max(0, len(large) - 1))
                shared = int((large[at] == x).sum()) if len(large) else 0
                keep.append(shared >= math.ceil(min(len(x), len(large)) * containment - 1e-9))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    size = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias("s" + c))
    swap = F.col("sa") <= F.col("sb")
    ordered = pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b").select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("b"))
    parts = ordered.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    small = ordered.join(parts, "b").withColumn("part", part).join(whole.select(F.col("node").alias("a"), "text"), "a").select("b", "part", "a", "text")
    large = parts.join(whole.select(F.col("node").alias("b"), "text"), "b").select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    stream = small.union(large).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    links = written(stream.mapInArrow(run, "a long, b long"), "links")
    forget(whole)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, label (a node of its component, one for all of it) of every node of edges (a, b).

    In each round every node goes over to the node around it, itself included, that comes first in a random order, and the
    edges between those that are left make the next round: their number falls by a constant factor, whatever the shape.
    A giant component's label is a hot key of the left sides only, which adaptive execution splits.
    """
    rest, maps, k = written(edges.select("a", "b"), "edges"), [], 0
    while k == 0 or rest.limit(1).count():
        order = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("node"))
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", order("a"))["node"].alias("label"))
        maps.append(written(to, "labels"))
        a, b = (maps[-1].select(F.col("node").alias(c), F.col("label").alias("l" + c)) for c in "ab")
        new = rest.join(a, "a").join(b, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        old, rest, k = rest, written(new, "edges"), k + 1
        forget(old)
    labels = maps[0]
    for m in maps[1:]:
        labels = labels.join(m.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = written(labels, "labels")
    forget(rest, *maps)
    return out


def best_of(pairs: DataFrame) -> DataFrame:
    """a, b: of each node's pairs (a, b, seen) the one that met most often."""
    order = lambda x: F.max_by(F.struct("a", "b"), F.struct("seen", F.col(x)))
    return written(pairs.groupBy(F.col("a").alias("node")).agg(order("b").alias("p")).select("p.*").union(pairs.groupBy(F.col("b").alias("node")).agg(order("a").alias("p")).select("p.*")).distinct(), "best")


def classes(docs: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS, near: int = NEAR, bucket: int = BUCKET) -> DataFrame:
    """A row for each row of docs: doc_id, h1, h2 (its text's hash), class_id (the least doc_id of its class).

    Equal texts share a class, null counts as empty, and texts without words are alike only to their equals. Rows with a
    null id take part; a class of such rows only has a null class_id. Repeated rows share their class. No rows: none.
    """
    rows = written(signed(docs, bands), "signed")
    found = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    signatures = written(found.withColumn("node", F.monotonically_increasing_id()), "signatures")
    ids, nodes = written(rows.select("doc_id", "h1", "h2"), "ids"), written(signatures.drop("sig", "bytes"), "nodes")
    forget(rows)
    if ids.groupBy("doc_id", "h1", "h2").count().where("count > 1").limit(1).count():  # repeated rows represent once
        docs = written(docs.select("doc_id", "text").distinct(), "once")
    # The ensemble: the best candidate of each node.
    met = written(candidates(signatures, containment, bands, near), "met")
    pairs = written(likely(met, signatures, containment), "pairs")
    best = best_of(pairs)
    links = linked(best, docs, nodes, containment)
    forget(signatures, met, pairs, best)
    # What is left between the classes so far: again the best of each node, then those that still would join two classes.
    labelled = lambda labels: nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labels = components(links)
    own = written(labelled(labels), "labelled")
    forget(labels)
    rest, crowded = meetings(docs, own, containment, bucket)
    best = best_of(rest)
    links = links.union(crowded).union(linked(best, docs, nodes, containment))
    labels = components(links)
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    open_ = written(rest.join(best, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).select("a", "b"), "open")
    links = links.union(linked(open_, docs, nodes, containment))
    forget(own, rest, best, labels, open_)
    classed = labelled(components(links))
    least = classed.groupBy("label").agg(F.min("rep").alias("class_id"))
    return ids.join(classed.join(least, "label").select("h1", "h2", "class_id"), ["h1", "h2"]).select("doc_id", "h1", "h2", "class_id")


def near_duplicates(docs: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS, near: int = NEAR) -> DataFrame:
    """doc_id, class_id of every row of docs."""
    return classes(docs, containment, bands, near).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS, near: int = NEAR) -> DataFrame:
    """The rows of docs with one row of each class: that with the least doc_id (of rows with null ids only, any one); all columns, whatever their names."""
    found = classes(docs, containment, bands, near)
    k1, k2, d, m1, m2, n = fresh(docs.columns, "k1", "k2", "d", "m1", "m2", "n")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", "doc_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select(F.col("doc_id").alias(d), F.col("h.h1").alias(k1), F.col("h.h2").alias(k2))
    h1, h2 = text_hash()
    marked = docs.withColumns({m1: h1, m2: h2})
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep[d]) & (marked[m1] == keep[k1]) & (marked[m2] == keep[k2]))
    # Rows that repeat in id and text: one of them.
    nth = F.row_number().over(W.partitionBy(d, k1, k2).orderBy(F.lit(0)))
    return kept.withColumn(n, nth).where(F.col(n) == 1).drop(d, k1, k2, m1, m2, n)
