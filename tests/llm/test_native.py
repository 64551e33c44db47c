"""Sharding, mixing and line dedup against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lattica.llm import line_dedup, mixing, sharding
from lattica.llm.common import offsets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """rows: (doc_id, text, source); lang and n_chars are filled."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


ODD = [(1, "one two\nthree", "a"), (1, "one two\nthree", "a"), (2, None, None), (None, "x", "b"), (None, None, None), (3, "", "a"), (4, "long " * 5000, "é"), (5, " \n \n", "b"), (6, "same", "c"), (7, "same", "c")]


def test_offsets_in_two_levels(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(25)], "k long, n long")
    got = dict((r.k, r.before) for r in offsets(df, "k", "n", "before", block=4).collect())
    assert got == {i: i * (i + 1) // 2 for i in range(25)}


def test_shards_hold_their_law(spark):
    rows = [(i, "w" * (i % 37), "s") for i in range(500)] + [(9, "hot", "s")] * 250
    got = sharding.shard(docs_of(spark, rows), bucket_rows=64).toPandas()
    assert len(got) == 750 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    counts = got.groupby("shard").size()
    assert len(counts) == 40 and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert Counter(zip(got.doc_id, got["size"], got.text_crc32)) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t, _ in rows)
    again = sharding.shard(docs_of(spark, rows).repartition(3), bucket_rows=64).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    # A group larger than a shard is spread over the shards.
    assert got[got.text_crc32 == zlib.crc32(b"hot")].shard.nunique() == 40


def test_equal_texts_share_a_shard(spark):
    texts = [f"t{i}" for i in range(400)] + [f"g{i}" for i in range(60) for _ in range(2 + i % 7)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(5000, "null", "s")] * 3 + [(6000 + i, None, "s") for i in range(4)]
    got = sharding.shard(docs_of(spark, rows), shards=8, bucket_rows=16).toPandas()
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    counts = got.groupby("shard").size()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    # Few other rows: groups fill the shards, and only what doesn't fit is split.
    rows = [(i, f"g{i // 9}", "s") for i in range(9 * 40)] + [(1000, "x", "s")]
    got = sharding.shard(docs_of(spark, rows), shards=8, bucket_rows=16).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and (got.groupby("text_crc32").shard.nunique() > 1).sum() <= 16


def test_shuffle_is_uniform(spark):
    got = sharding.scatter_shuffle(spark.range(4000).withColumnRenamed("id", "doc_id"), bucket_rows=500).toPandas().sort_values("position")
    assert sorted(got.position) == list(range(4000))
    x = got.doc_id.to_numpy()
    assert abs(((x - x.mean()) * (got.position - 1999.5)).mean()) < 0.05 * 4000**2 / 12
    assert (x[1:] == x[:-1] + 1).sum() < 15


def test_shards_of_odd_rows_and_of_none(spark):
    got = sharding.shard(docs_of(spark, ODD).withColumnRenamed("n_chars", "position")).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r.doc_id == 2} == {16}
    assert sharding.shard(docs_of(spark, ODD).limit(0)).count() == 0


def test_written_shards_are_the_records(spark):
    rows = [(i, f"text {i}", "s") for i in range(100)] + [(7, "text 7", "s")] * 3
    docs = docs_of(spark, rows).withColumnRenamed("lang", "shard").withColumnRenamed("n_chars", "Slot")
    back, shard, slot = sharding.write_shards(docs, shards=4)
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert sorted(r["count"] for r in back.groupBy(shard).count().collect()) == [25, 26, 26, 26] and slot not in docs.columns


def fill(sizes, weights=(1, 2, 3)):
    """Targets by the words of the contract."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, fixed = {}, set()
    left = total
    while True:
        free = [s for s in names if s not in fixed]
        for s in free:
            target[s] = left * w[s] / sum(w[x] for x in free)
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
            fixed.add(s)


def word_count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 50), "ab"[i % 2]) for i in range(1200)] + [(5000 + i, "v " * 10, None) for i in range(30)] + [(6000, "u u", "zz")]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += word_count(t)
    want = fill(sizes)
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s, n in sizes.items():
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert (mine.source_size == n).all() and abs(mine.target.iloc[0] - want[s]) < 1e-6 * want[s]
        assert abs(mine.taken.sum() - want[s]) <= max(0.005 * want[s], mine["size"].max())
    again = mixing.mix(docs_of(spark, rows).repartition(5)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_rounding_keeps_expectations(spark):
    rows = [(i, "w " * (1 + i % 9), "s") for i in range(400)] + [(1000 + i, "w " * 40, "t") for i in range(20)]
    taken = [mixing.mix(docs_of(spark, rows), seed=k, chunk=16).where("source = 's'").toPandas() for k in range(6)]
    f = taken[0].target.iloc[0] / taken[0].source_size.iloc[0]
    mean = sum(t.sort_values("doc_id").copies.to_numpy() for t in taken) / len(taken)
    assert abs(mean.mean() - f) < 0.05 and len({tuple(t.sort_values("doc_id").copies) for t in taken}) > 1


def test_mix_of_odd_rows_and_of_none(spark):
    assert mixing.mix(docs_of(spark, ODD)).count() == len(ODD)
    assert {r.taken for r in mixing.mix(docs_of(spark, ODD)).where("size = 0").collect()} == {0}
    assert mixing.mix(docs_of(spark, ODD).limit(0)).count() == 0
    wordless = docs_of(spark, [(1, "", "a"), (2, None, None)])
    assert [r.target for r in mixing.mix(wordless).collect()] == [0.0, 0.0]


def test_mixed_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(300)] + [(1, "w w", "b")] * 4
    plan = mixing.mix(docs_of(spark, rows)).groupBy("doc_id").sum("copies").collect()
    got = Counter(r.doc_id for r in mixing.mixed(docs_of(spark, rows)).collect())
    assert {k: v for k, v in plan if v} == dict(got)
    assert mixing.mixed(docs_of(spark, rows)).columns == docs_of(spark, rows).columns


def strip_lines(rows, least):
    """(doc_id, n_lines, n_dropped, kept) by the words of the contract; every row is a document."""
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(low)
    seen = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_is_brute_force(spark, batches, fanout):
    from pyspark.sql import functions as F

    rows = [(i, "\n".join(["Header", f"unique {i}", " HEADER\t", f"pair {i // 12}", "É", "", f"few {i // 5}"][: 2 + i % 6]), "s") for i in range(150)] + ODD + [(300 + i, "hot line", "s") for i in range(60)]
    got = line_dedup.dedup_lines(docs_of(spark, rows).withColumn("gone", F.lit(1)), batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == Counter(strip_lines(rows, 10))


def test_line_dedup_of_none(spark):
    assert line_dedup.dedup_lines(docs_of(spark, ODD).limit(0)).count() == 0


def test_no_python_in_native_plans(spark):
    for df in (sharding.shard(docs_of(spark, ODD)), mixing.mix(docs_of(spark, ODD)), line_dedup.dedup_lines(docs_of(spark, ODD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
