"""Mixing sources to target weights by pivotal dependent rounding.

Each source wants target / size copies of every document: a whole part, and a fraction that must be rounded. Units with
a fraction are paired; the pair's words are kept while mass moves between the two at random until one is 0 or 1 (so
expectations are kept as well), and the other goes on to the next pair. Chunks of about CHUNK units are folded in
parallel and leave one residual each; the residuals of CHUNK chunks form the chunks of the next level, until one is
left for each source, which a coin of its own probability settles. All coins are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.llm.common import WORD, join_checked, uniform, written

SEED = 30_011
CHUNK = 64
MAX_COPIES = 3
EPS = 1e-9
#: Up to so many sources are ranked by one task; more are ranked by range partitions.
RANKED_ROWS = 100_000

UNIT = ["doc_id", "crc", "copy"]


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `place`, 0-based, by code point, null last."""
    order = [F.col("source").asc_nulls_last()]
    if sources.limit(RANKED_ROWS + 1).count() <= RANKED_ROWS:
        return sources.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    parts = written(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return parts.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1).join(before, "_part").withColumn("place", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before", "count")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_COPIES) -> DataFrame:
    """sources (source, source_size, n) with target: the words of all sources shared by weight, none above `most` times its own; what is over goes to the others by weight, again and again."""
    own = written(ranked(sources).withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * float(most)), "sources")
    total = float(own.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = total / (own.agg(F.sum("w")).first()[0] or 1.0)
    while True:  # the level only rises, and each turn caps at least one more source or ends
        over = F.col("w") * level > F.col("cap")
        capped, open_w = own.agg(F.coalesce(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.lit(0.0)), F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.lit(0.0))).first()
        new = (total - capped) / open_w if open_w else level
        if not open_w or new <= level * (1 + 1e-12):
            break
        level = new
    return own.withColumn("target", F.least("cap", F.col("w") * level)).select("source", "source_size", "n", "target")


def let(values: Column, then) -> Column:
    """then(values), evaluated once."""
    return F.transform(F.array(values), then)[0]


def fold(units: Column, seed: int) -> Column:
    """units: array of struct(doc_id, crc, copy, size, x), 0 < x < 1. Struct(left: the residual unit or null, done: array of struct(doc_id, crc, copy, pick, size))."""
    unit = "struct<doc_id:bigint,crc:bigint,copy:bigint,size:double,x:double>"
    out = "struct<doc_id:bigint,crc:bigint,copy:bigint,pick:int,size:double>"
    picked = lambda u, x: F.struct(u["doc_id"].alias("doc_id"), u["crc"].alias("crc"), u["copy"].alias("copy"), (x > 0.5).cast("int").alias("pick"), u["size"].alias("size")).cast(out)
    with_x = lambda u, x: F.struct(u["doc_id"].alias("doc_id"), u["crc"].alias("crc"), u["copy"].alias("copy"), u["size"].alias("size"), x.alias("x")).cast(unit)
    whole = lambda x: (x < EPS) | (x > 1 - EPS)

    def settle(acc: Column, u: Column, v: Column, x: Column, y: Column) -> Column:
        first = whole(x)
        left = F.when(~first, with_x(u, x)).when(~whole(y), with_x(v, y))
        done = F.when(first & whole(y), F.concat(acc["done"], F.array(picked(u, x), picked(v, y)))).when(first, F.concat(acc["done"], F.array(picked(u, x)))).otherwise(F.concat(acc["done"], F.array(picked(v, y))))
        return F.struct(left.alias("left"), done.alias("done"))

    def step(acc: Column, v: Column) -> Column:
        u = acc["left"]
        ratio = v["size"] / u["size"]
        moves = F.struct(F.least(1 - u["x"], v["x"] * ratio).alias("up"), F.least(u["x"], (1 - v["x"]) * ratio).alias("down"), ratio.alias("r"))
        coin = uniform(F.lit(seed), u["doc_id"], u["crc"], u["copy"], v["doc_id"], v["crc"], v["copy"])
        shift = let(moves, lambda m: let(F.when(coin * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]), lambda d: F.struct((u["x"] + d).alias("x"), (v["x"] - d / m["r"]).alias("y"))))
        return F.when(u.isNull(), F.struct(v.cast(unit).alias("left"), acc["done"].alias("done"))).otherwise(let(shift, lambda s: settle(acc, u, v, s["x"], s["y"])))

    start = F.struct(F.lit(None).cast(unit).alias("left"), F.array().cast(f"array<{out}>").alias("done"))
    return F.aggregate(units, start, step)


def settled(folded: Column, seed: int) -> Column:
    """The last fold's decisions with its residual's, by a coin. What that is off by in words is taken back from decisions of this fold, the largest first that fit."""
    left, done = folded["left"], folded["done"]
    coin = (uniform(F.lit(seed), left["doc_id"], left["crc"], left["copy"]) < left["x"]).cast("int")

    def step(acc: Column, u: Column) -> Column:
        flip = ((u["pick"] == 1) & (acc["off"] >= u["size"])) | ((u["pick"] == 0) & (-acc["off"] >= u["size"]))
        turned = u.withField("pick", F.when(flip, 1 - u["pick"]).otherwise(u["pick"]))
        return F.struct((acc["off"] + F.when(flip, (1 - 2 * u["pick"]) * u["size"]).otherwise(0.0)).alias("off"), F.concat(acc["done"], F.array(turned)).alias("done"))

    large = F.array_sort(done, lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1)).otherwise(F.when(a["doc_id"] < b["doc_id"], -1).when(a["doc_id"] > b["doc_id"], 1).otherwise(0)))
    start = F.struct(((coin - left["x"]) * left["size"]).alias("off"), F.array(F.struct(left["doc_id"].alias("doc_id"), left["crc"].alias("crc"), left["copy"].alias("copy"), coin.alias("pick"), left["size"].alias("size"))).alias("done"))
    return F.when(left.isNull(), done).otherwise(F.aggregate(large, start, step)["done"])


def rounded(units: DataFrame, seed: int, chunk: int) -> DataFrame:
    """units (source, n, doc_id, crc, copy, size, x): doc_id, crc, copy, pick for each unit, in a reduction tree of as many levels as log(n) to base chunk."""
    row = ["doc_id", "crc", "copy", "size", "x"]
    level = units.withColumn("_slots", F.ceil(F.col("n") / chunk)).withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), *UNIT), F.col("_slots"))).withColumn("o", F.col("size"))
    most = units.agg(F.max("n")).first()[0] or 0
    # A chunk of each source waits for the last fold: its units, the large ones first, take up the tree's residual, so that what the coin settles is small.
    waits = (F.col("_chunk") == 0) & (F.col("_slots") > 1)
    reserve, level = level.where(waits).withColumn("_slots", F.lit(1).cast("long")), level.where(~waits)
    slots, depth, picks, left = -(-most // chunk), 0, [], None
    while left is None or slots > 1:
        if left is not None:
            slots, depth = -(-slots // chunk), depth + 1
            level = left.withColumn("_slots", F.ceil(F.col("_slots") / chunk)).withColumn("_chunk", F.floor(F.col("_chunk") / chunk)).withColumn("o", F.col("size") + 1e15)
        if slots <= 1:
            level = level.unionByName(reserve, allowMissingColumns=True)
        packed = level.groupBy("source", "_slots", "_chunk").agg(F.sort_array(F.collect_list(F.struct("o", F.xxhash64(*UNIT).alias("h"), *row)), asc=False).alias("_units"))
        done = written(packed.select("source", "_slots", "_chunk", fold(F.transform("_units", lambda u: F.struct(*[u[c].alias(c) for c in row])), seed + depth).alias("_f")), "fold")
        picks.append(done.select(F.inline("_f.done" if slots > 1 else settled(F.col("_f"), seed - 1))))
        left = done.where(F.col("_f.left").isNotNull()).select("source", "_slots", "_chunk", "_f.left.*")
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.drop("size")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row a row of docs: doc_id, crc (of the text), copy (1.. among rows equal in doc_id, source, size and crc), source, size, source_size, target, copies, taken.

    A null source is a source of its own, the last; a null or empty text has no words and gets no copy, like every
    document of a source without words. Repeated rows are units of their own. Other columns are ignored.
    """
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), F.coalesce(F.crc32("text"), F.lit(-1)).cast("long").alias("crc"))
    counted = written(each.groupBy("doc_id", "source", "size", "crc").agg(F.count(F.lit(1)).alias("_copies")), "mix")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.sum("_copies").alias("n"))
    goals = written(targets(sources, weights).withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    units = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
    units = join_checked(units, goals, "source").withColumn("base", F.floor(F.col("f") + EPS)).withColumn("x", F.greatest(F.col("f") - F.col("base"), F.lit(0.0)))
    open_ = units.where((F.col("size") > 0) & (F.col("x") > EPS)).select("source", "n", *UNIT, F.col("size").cast("double").alias("size"), "x")
    picks = rounded(open_, seed, chunk).withColumnsRenamed({c: f"_{c}" for c in UNIT})
    on = units["doc_id"].eqNullSafe(picks["_doc_id"]) & (units["crc"] == picks["_crc"]) & (units["copy"] == picks["_copy"])
    out = units.join(picks, on, "left").withColumn("copies", F.when(F.col("size") > 0, F.col("base") + F.coalesce("pick", F.lit(0))).otherwise(0).cast("long"))
    return out.select(*UNIT, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; rows without words aren't taken. Names beginning with _ are the operator's."""
    text = F.coalesce(F.crc32("text"), F.lit(-1)).cast("long")
    plan = mix(docs, weights, seed, chunk).where("copies > 0").groupBy("doc_id", "source", "size", "crc").agg(F.sort_array(F.collect_list(F.struct("copy", "copies"))).alias("_plan"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("crc").alias("_c"), "_plan")
    own = docs.withColumns({"_size": words(F.col("text")), "_crc": text})
    both = own.join(plan, own["doc_id"].eqNullSafe(plan["_d"]) & own["source"].eqNullSafe(plan["_s"]) & (own["_size"] == plan["_n"]) & (own["_crc"] == plan["_c"]))
    # Rows equal in all of these are told apart by a number, which needs no order: any of them may be any unit.
    nth = F.row_number().over(W.partitionBy("_d", "_s", "_n", "_c").orderBy(F.lit(0)))
    unit = F.filter("_plan", lambda u: u["copy"] == F.col("_nth"))
    return both.withColumn("_nth", nth.cast("long")).withColumn("_copies", F.get(unit, F.lit(0))["copies"]).where("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)
