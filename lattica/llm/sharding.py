"""Sharding by a two-pass external shuffle.

Pass one scatters uniformly into buckets of a size that fits in memory, by a seeded hash. Pass two sorts each bucket (so
that a task that runs again sees the same order), shuffles it by Fisher-Yates (Spark's `shuffle`) and deals it out: the
global position is the bucket's offset plus the place within the bucket.

Digests are shuffled so, about 40 bytes a record whatever its text. Counts of the shards differ by one at most (the law
`rows`), and equal texts stay together where the law lets them: groups are dealt first, in a random order, each whole to
a shard in which it fits; all other records, among them those of a group larger than a shard, fill the shards up. Then
the slots of each shard are shuffled. The records themselves move once: they are scattered by their hash to meet their
places, and each task writes what it has of each shard, in the order of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fresh, offsets, written

SHARDS = 40
SEED = 20_011
BUCKET_ROWS = 32_768


def size(text: Column) -> Column:
    """UTF-8 bytes and 16; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def scatter_shuffle(rows: DataFrame, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with `position`, a uniform random permutation 0 .. n-1.

    Repeated rows are counted before they move and numbered afterwards (_copy), so that a row that makes up a third of
    the input is scattered like any other. An empty input gives no rows; nulls are values like others. rows are digests
    made here: none of their names begins with an underscore or is position.
    """
    names = rows.columns
    counted = written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")), "scatter")
    total = counted.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_rows))
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")
    each = each.withColumn("_hash", F.xxhash64(F.lit(seed), *names, "_copy")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    # The number of partitions is given, so the plan (and with it shuffle's generator, seeded by seed and partition) doesn't change from run to run.
    packed = (
        each.repartition(min(buckets, 20_000), "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "_hash").alias("_hash"), *names, "_copy"))).alias("_rows"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", F.shuffle("_rows", seed).alias("_rows"))
    )
    starts = offsets(each.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", "_n", "_start").drop("_n")
    placed = packed.select("_bucket", F.posexplode("_rows").alias("_place", "_row")).join(starts, "_bucket")
    return placed.select(*[F.col(f"_row.{c}").alias(c) for c in names], F.col("_row._copy").alias("_copy"), (F.col("_start") + F.col("_place")).alias("position"))


def dealt(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """row, shard, slot for every row of rows (row, text: hashes). Rows of equal text share a shard, but for texts that don't fit one beside the groups that came first."""
    each = written(rows.groupBy("row", "text").agg(F.count(F.lit(1)).alias("copies")), "rows")
    texts = each.groupBy("text").agg(F.sum("copies").alias("n"))
    total = each.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    least, more = divmod(total, shards)
    quota = F.lit(least) + (F.col("shard") < more).cast("long")
    groups = written(scatter_shuffle(texts.where((F.col("n") > 1) & (F.col("n") <= least)), seed, bucket_rows), "groups")
    grouped = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = offsets(groups.select("position", "n"), "position", "n", "before").drop("n")
    homes = written(groups.join(before, "position").select("text", "n", "before", F.floor(F.col("before") * F.lit(shards) / F.lit(max(1, grouped))).cast("int").alias("shard")), "homes")
    first = homes.groupBy("shard").agg(F.min("before").alias("first"))
    whole = written(homes.join(F.broadcast(first), "shard").where(F.col("before") - F.col("first") + F.col("n") <= quota).select("text", "shard", "n"), "whole")
    # What each shard still takes, and the positions among the other rows that fill it.
    held = whole.groupBy("shard").agg(F.sum("n").alias("n"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = written(every.join(held, "shard", "left").select("shard", (quota - F.coalesce("n", F.lit(0))).alias("room")), "room").collect()
    ends, free = [0], [r.room for r in sorted(room)]  # one number for each shard
    for n in free:
        ends.append(ends[-1] + n)
    other = each.join(whole, "text", "left_anti").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    filled = scatter_shuffle(other, seed + 2, bucket_rows)
    filled = filled.select("row", "nth", (F.size(F.filter(F.array(*[F.lit(int(e)) for e in ends[1:]]), lambda e: e <= F.col("position")))).cast("int").alias("shard"))
    placed = written(each.join(whole, "text").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"), "shard").unionByName(filled), "placed")
    return slots(placed, shards, total, seed + 4, bucket_rows)


def slots(placed: DataFrame, shards: int, total: int, seed: int, bucket_rows: int) -> DataFrame:
    """row, shard, slot of placed (row, nth, shard), which has `total` rows: the two passes within each shard."""
    parts = max(1, -(-total // (shards * bucket_rows)))
    each = placed.withColumn("_hash", F.xxhash64(F.lit(seed), "row", "nth")).withColumn("_bucket", F.col("shard") * F.lit(parts).cast("long") + F.pmod("_hash", F.lit(parts)))
    packed = (
        each.repartition(min(parts * shards, 20_000), "_bucket")
        .groupBy("_bucket")
        .agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), "_hash").alias("_hash"), "row", "nth"))).alias("_rows"))
        .sortWithinPartitions("_bucket")
        .select("_bucket", "shard", F.shuffle("_rows", seed).alias("_rows"))
    )
    starts = offsets(each.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "_bucket", "_n", "_start").drop("_n")
    least, more = divmod(total, shards)
    own = F.col("shard").cast("long") * least + F.least("shard", F.lit(more))
    return packed.join(starts, "_bucket").select("shard", "_start", F.posexplode("_rows").alias("_place", "_row")).select(F.col("_row.row").alias("row"), "shard", (F.col("_start") + F.col("_place") - own).alias("slot"))


def write_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, str, str]:
    """The records, all columns, as a table in the shared folder, one folder a shard; and the names of its columns shard and slot, which no column of docs has.

    Nulls are values like others, repeated rows get a place each, no rows give an empty table.
    """
    row, shard_, slot_ = fresh(docs.columns, "row", "shard", "slot")
    full = docs.withColumn(row, F.xxhash64(F.lit(seed), *[F.coalesce(F.xxhash64(F.col(f"`{c}`")), F.lit(0)) for c in docs.columns]))
    text = F.coalesce(F.xxhash64(F.lit(7), "text"), F.lit(0))
    digests = full.select(F.col(row).alias("row"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(text).alias("text"))
    places = written(dealt(digests, shards, seed, bucket_rows), "places").select(F.col("row").alias(row), F.col("shard").alias(shard_), F.col("slot").alias(slot_))
    repeated = places.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row)
    if repeated.limit(1).count():  # equal rows are one while they move
        repeated = written(repeated, "repeated")
        once = full.join(repeated, row, "left_semi").groupBy(*full.columns).agg(F.lit(1)).select(*full.columns)
        full = full.join(repeated, row, "left_anti").unionByName(once)
    out = places.join(full.hint("merge"), row).drop(row)
    return written(out.sortWithinPartitions(shard_, slot_), "shards", partitionBy=shard_), shard_, slot_


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each record in the written shards: doc_id, size, text_crc32 (0 for null), law, shard, slot, grown_shard (null: only the law `key` has it). Other columns are written too."""
    table, shard_, slot_ = write_shards(docs, shards, seed, bucket_rows)
    return table.select(
        "doc_id", size(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard_).cast("int").alias("shard"), F.col(slot_).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
