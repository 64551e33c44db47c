"""Line deduplication by levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n), sorted by the 128-bit hash: how many documents of some batches hold the line.
A batch first merge-anti-joins the runs of lines that are known to be frequent (they need no more counting), and adds
a run of its own at level 0. When a level has `fanout` runs they are compacted into one run of the next level; lines
that reach the threshold then move to the frequent runs. All of it is DataFrame code.

The texts move once, by document, to meet the positions of their dropped lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SPACE, written

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
#: Lines that make up more than 1 / HOT of all line rows: HOT at most, so that they may be broadcast.
HOT = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """Null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_ids(docs: DataFrame) -> DataFrame:
    """d and t tell documents apart, though ids may be null or repeated: rows that share both are copies of each other."""
    return docs.withColumns({"_d": F.col("doc_id"), "_t": F.xxhash64(F.coalesce("text", F.lit("")))})


def line_rows(docs: DataFrame, batches: int) -> DataFrame:
    """A row for each line with a key: _d, _t, pos, h1, h2, first (whether it is the document's first with this key), batch."""
    hashed = with_ids(docs).select("_d", "_t", F.transform(split_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("k"), i.cast("int").alias("pos"))).alias("_keys"))
    hashed = hashed.select("_d", "_t", F.sort_array(F.transform(F.filter("_keys", lambda x: x["k"] != ""), lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(7), x["k"]).alias("h2"), x["pos"].alias("pos")))).alias("_lines"))
    same = lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])
    marked = F.transform("_lines", lambda x, i: F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), ((i == 0) | ~same(x, F.get("_lines", i - 1))).alias("first")))
    rows = hashed.select("_d", "_t", F.inline(marked))
    return rows.withColumn("batch", F.pmod("_t", F.lit(batches)).cast("int"))


class LineRuns:
    """The runs, by level, and the frequent lines so far."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.frequent: list[DataFrame] = []

    def _run(self, df: DataFrame) -> DataFrame:
        return written(df.sortWithinPartitions(*HASH), "run")

    def add(self, lines: DataFrame) -> None:
        """lines: h1, h2, a row for each document that holds the line."""
        counts = lines.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
        for run in self.frequent:
            counts = counts.join(run.hint("merge"), HASH, "left_anti")
        self.levels[0].append(self._run(counts))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                self._compact(k)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, runs).groupBy(*HASH).agg(F.sum("n").alias("n"))

    def _compact(self, k: int) -> None:
        merged = written(self._merged(self.levels[k]).sortWithinPartitions(*HASH), "run")
        self.levels[k] = []
        self.frequent.append(merged.where(F.col("n") >= self.min_docs))
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(merged.where(F.col("n") < self.min_docs))

    def lines(self) -> DataFrame:
        """h1, h2, n of the lines that reach the threshold; n counts up to the batch in which it was reached, at least."""
        rest = [r for level in self.levels for r in level]
        known = reduce(DataFrame.union, self.frequent) if self.frequent else None
        if rest:
            late = (self._merged(rest) if len(rest) > 1 else rest[0]).where(F.col("n") >= self.min_docs)
            known = late if known is None else known.union(late)
        return known.groupBy(*HASH).agg(F.sum("n").alias("n"))


def dropped_positions(lines: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """_d, _t, _gone: the sorted positions of the frequent lines of each document that has some.

    A line that many documents hold would be one hot key: those counted above total / HOT are at most HOT and are
    broadcast; other keys hold about that share of the rows at most (some batches may not have counted them).
    """
    at = lines.select("_d", "_t", "pos", *HASH)
    bound = max(1, total // HOT)
    hot = frequent.where(F.col("n") > bound).select(*HASH)
    rest = frequent.where(F.col("n") <= bound).select(*HASH)
    parts = at.join(F.broadcast(hot), HASH, "left_semi").union(at.join(F.broadcast(hot), HASH, "left_anti").join(rest, HASH, "left_semi"))
    return parts.groupBy("_d", "_t").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without the lines whose key is found in at least min_docs documents).

    Every row is a document, repeated rows too. A null or empty text is one empty line, which has no key and stays.
    Input columns of these names are replaced; names _d, _t, _d2, _t2, _lines and _gone are taken.
    """
    spark = docs.sparkSession
    lines = written(line_rows(docs, batches), "lines", partitionBy="batch")
    total = lines.count()
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(lines.where((F.col("batch") == b) & F.col("first")).select(*HASH))
    frequent = written(runs.lines(), "frequent")
    gone = dropped_positions(lines, frequent, total).withColumnsRenamed({"_d": "_d2", "_t": "_t2"})
    full = with_ids(docs)
    joined = full.join(gone.hint("shuffle_hash"), full["_d"].eqNullSafe(gone["_d2"]) & (full["_t"] == gone["_t2"]), "left").drop("_d2", "_t2")
    joined = joined.withColumn("_lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("kept", kept).drop("_d", "_t", "_lines", "_gone")
