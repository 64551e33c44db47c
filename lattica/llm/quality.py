"""Quality rules with an isolation forest on rule statistics.

Base rules reject short and repetitive texts outright. The rest is judged by two isolation forests, of repetition and of
form: the path lengths of a document's statistics over random splits, fitted on a bounded sample of labelled rows, give
scores; thresholds are calibrated on all labelled rows, so that at most GOOD_LOSS of the rows labelled good (and not
rejected by the base rules) are above one. Statistics cost one pass over the texts; fitting and scoring see only numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import SPACE, fresh, written

#: At most so many labelled rows are fitted on; they are those with the smallest hash of doc_id.
SAMPLE_ROWS = 8_192
TREES, TREE_ROWS, SEED = 200, 128, 50_011
BINS = 4_000
GOOD_LOSS = 0.001
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_marks"]
STATS = BASE + MORE
UPPER, MARKS = bytes(range(65, 91)), b"!?|{}[]=~^_\\"


def stats(text: str) -> tuple[int, ...]:
    """The numbers of STATS for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six characters
    lines = text.split("\n")
    full = lines if len(lines) == 1 else [x for x in lines if x.strip(SPACE)]
    repeats = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        twice = {x for x, n in Counter(windows).items() if n > 1}
        until = 0
        for i, x in enumerate(windows):
            if x in twice:
                repeats += i + 3 - max(i, until)
                until = i + 3
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeats,
        len(raw) - len(raw.translate(None, UPPER)), len(raw) - len(raw.translate(None, MARKS)),
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def features(s: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The statistics of the rules as ratios, in two groups: repetition (doubled lines, repeated words, length) and form (word length, symbols, capitals, marks). Each has a forest of its own, as among the ratios of one the other's would be hidden: short texts repeat by chance."""
    x = {k: np.asarray(v, dtype=np.float64) for k, v in s.items()}
    words, chars = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1)
    return [
        np.column_stack([x["n_dup_lines"] / words, x["n_repeat_words"] / words, np.log(words)]),
        np.column_stack([chars / words, x["n_symbols"] / chars, x["n_upper"] / chars, x["n_marks"] / chars]),
    ]


class Forest:
    """An isolation forest (Liu, Ting and Zhou, 2008) in arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, cut, left, length = [], [], [], []

        def grow(part: np.ndarray, depth: int, at: int) -> None:
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if depth == self.depth or len(part) < 2 or not len(wide):
                length[at] = depth + self._expected(len(part))
                return
            c = int(rng.choice(wide))
            v = rng.uniform(low[c], high[c])
            column[at], cut[at], left[at] = c, v, len(column)
            add()
            add()
            side = part[:, c] < v
            grow(part[side], depth + 1, left[at]) if side.any() else length.__setitem__(left[at], depth + 1)
            grow(part[~side], depth + 1, left[at] + 1) if (~side).any() else length.__setitem__(left[at] + 1, depth + 1)

        def add() -> None:
            column.append(0), cut.append(0.0), left.append(-1), length.append(0.0)

        add()
        grow(rows, 0, 0)
        return np.array(column), np.array(cut), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected): the nearer 1, the more isolated."""
        total = np.zeros(len(rows))
        for column, cut, left, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                inner = left[at] >= 0
                value = rows[np.arange(len(rows)), column[at]]
                at = np.where(inner, left[at] + (value >= cut[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self._expected(self.size), 1e-9))


class Judge:
    """Fitted forests and their thresholds; without labelled rows it rejects nothing beyond the base rules."""

    def __init__(self, forests: list[Forest] | None = None, thresholds: list[float] | None = None) -> None:
        self.forests, self.thresholds = forests or [], thresholds or [1.0] * len(forests or [])

    def each(self, s: dict[str, np.ndarray]) -> list[np.ndarray]:
        return [f.score(x) for f, x in zip(self.forests, features(s))] if len(s["n_words"]) else [np.zeros(0)] * len(self.forests)

    def scores(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """The largest of the forests' scores over their thresholds: 1 and more is anomalous."""
        return np.max([np.zeros(len(s["n_words"])), *(x / t for x, t in zip(self.each(s), self.thresholds))], axis=0)

    def kept(self, s: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
        return ~base_failed(s["n_words"], s["n_repeat_words"]) & (scores < 1)


def text_stats(texts: list) -> dict[str, np.ndarray]:
    rows = np.array([stats(t or "") for t in texts], dtype=np.int64).reshape(len(texts), len(STATS))
    return {k: rows[:, i] for i, k in enumerate(STATS)}


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = text_stats(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(s[k]) for k in STATS)], names=["doc_id", *STATS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def with_scores(numbers: DataFrame, judge: Judge) -> DataFrame:
    """numbers (STATS among its columns) with score, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in STATS}
            scores = judge.scores(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array(base_failed(s["n_words"], s["n_repeat_words"])), pa.array(judge.kept(s, scores))], names=[*batch.schema.names, "score", "base_failed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbers.schema)
    return numbers.mapInArrow(run, schema + ", score double, base_failed boolean, kept boolean")


def fit(numbers: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_loss: float = GOOD_LOSS) -> Judge:
    """numbers: doc_id and STATS. labels: doc_id, quality (1 good, 0 bad, null ignored; an id that is labelled twice has its lowest).

    The forests are fitted on the sample, good and bad alike: bad rows are rare there, hence short paths. Each one's
    threshold is the lowest of BINS steps with at most its part of good_loss of all rows labelled good at or above it; the
    second may use what the first leaves.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = written(numbers.join(marks, "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select(*STATS, "quality", F.xxhash64(F.lit(SEED), "doc_id").alias("_h")), "labelled")
    # The smallest hashes: first by their share, so that no partition sends more than its part, then exactly.
    share = 1.1 * sample_rows / max(1, rows.count())
    sample = rows.where(F.shiftrightunsigned("_h", 11) <= int(min(1.0, share) * 2**53)).orderBy("_h", *STATS).limit(sample_rows).toPandas()
    if len(sample) < 2:
        return Judge()
    judge = Judge([Forest(x) for x in features({k: sample[k].to_numpy() for k in STATS})])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(judge.each({k: batch.column(k).to_numpy(zero_copy_only=False) for k in STATS})):
                b, n = np.unique((x * BINS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), i)), pa.array(b), pa.array(n.astype(np.int64))], names=["forest", "bin", "n"])

    counts = {(r.forest, r.bin): r.n for r in rows.where("quality = 1").select(*STATS).mapInArrow(binned, "forest long, bin long, n long").groupBy("forest", "bin").agg(F.sum("n").alias("n")).collect()}
    left = good_loss * sum(n for (f, _), n in counts.items() if f == 0)
    for i in range(len(judge.forests)):
        own = {b: n for (f, b), n in counts.items() if f == i}
        above, b = 0, BINS + 1
        while b > 1 and above + own.get(b - 1, 0) <= left / (len(judge.forests) - i):
            b -= 1
            above += own.get(b, 0)
        judge.thresholds[i], left = b / BINS, left - above
    return judge


def judge_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_loss: float = GOOD_LOSS) -> DataFrame:
    """A row for each row of docs: doc_id, STATS, score, base_failed, kept. Repeated rows and null ids are judged each; other columns are ignored."""
    numbers = written(with_stats(docs), "stats")
    return with_scores(numbers, fit(numbers, labels, sample_rows, good_loss))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_loss: float = GOOD_LOSS) -> DataFrame:
    """The rows of docs that are kept, all their columns, whatever their names. What the base rules pass is written with its statistics, which are taken once; the forests see only those."""
    (name,) = fresh(docs.columns, "stats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = text_stats(batch.column("text").to_pylist())
            flat = pa.array(np.column_stack([s[k] for k in STATS]).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(STATS), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name]).filter(pa.array(~base_failed(s["n_words"], s["n_repeat_words"])))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    passed = written(docs.mapInArrow(run, schema), "passed")
    numbers = [F.get(name, F.lit(i)).alias(k) for i, k in enumerate(STATS)]
    judge = fit(passed.select("doc_id", *numbers), labels, sample_rows, good_loss)

    @F.pandas_udf("boolean")
    def good(stats: pd.Series) -> pd.Series:
        x = np.stack(stats.to_numpy()) if len(stats) else np.zeros((0, len(STATS)), np.int64)
        s = {k: x[:, i] for i, k in enumerate(STATS)}
        return pd.Series(judge.kept(s, judge.scores(s)))

    return passed.where(good(F.col(name))).drop(name)
