"""What the operators share: tables, lineage cuts, free names, prefix sums and checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.plans.lineage import cut

#: The six characters that count as white space in every contract here.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A side with at most so many rows is broadcast; a larger one is joined by salted shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **how: object) -> DataFrame:
    """df as a Parquet table in the shared folder: later plans start from files, so a lost executor costs only the reading."""
    return cut(df, name, **how)


def fresh(columns: list[str], *names: str) -> list[str]:
    """A name for each of `names` that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    end = "_"
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def offsets(counts: DataFrame, index: str, count: str, name: str, block: int = 4096) -> DataFrame:
    """counts (index, count) with the sum of all counts at smaller indexes. Two levels: no task sees more than block rows, or one row for each block."""
    blocks = counts.withColumn("_block", F.floor(F.col(index) / block))
    inner = W.partitionBy("_block").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    tops = blocks.groupBy("_block").agg(F.sum(count).alias("_n")).select("_block", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_before"))
    return blocks.withColumn("_within", F.coalesce(F.sum(count).over(inner), F.lit(0))).join(tops, "_block").select(index, count, (F.col("_before") + F.col("_within")).alias(name))


def join_checked(big: DataFrame, small: DataFrame, key: str, salts: int = 32, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner null-safe join on one key that may be hot in big and is unique in small. small is counted: up to limit rows it is broadcast, beyond that both sides are salted, which splits any key over `salts` tasks."""
    right = small.withColumnRenamed(key, "_key")
    on = big[key].eqNullSafe(F.col("_key"))
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(right), on).drop("_key")
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
    return big.join(right, big[key].eqNullSafe(right["_key"]) & (big["_salt"] == right["_salt2"])).drop("_key", "_salt", "_salt2")
