"""Plans that must stay even or small as tables grow, on small tables."""

import random
from array import array
from collections import Counter

import pytest

from lattica.operators import analytics as A
from lattica.operators import search as S
from lattica.operators import traverse as T
from lattica.plans import lineage as L
from lattica.schema import EDGE, NODE
from lattica.sources import files, star
from lattica.sources.files import conform
from pyspark.sql import functions as F


def edges_of(spark, rows):
    return conform(spark.createDataFrame([(*r, 0) if len(r) == 3 else r for r in rows], "source string, target string, type string, startLine long"), EDGE)


def test_hot_route_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr(A, "CELL", 16, raising=False)
    content = lambda i: 'get("/api/items/%d"); get("/api/items/%d"); get("/x/y")' % (i % 3, i % 2 + 5)
    paths = lambda i: "/api/items/:id" if i % 2 else "/api/items/1" if i % 4 else "/x/*"
    rows = [(f"c{i}", "Function", content(i), None, "P") for i in range(90)] + [(f"r{i}", "Route", None, paths(i), "P") for i in range(80)]
    n = conform(spark.createDataFrame(rows, "id string, label string, content string, path string, project string"), NODE)
    want = []
    for i in range(90):
        for lit in {f"/api/items/{i % 3}", f"/api/items/{i % 2 + 5}", "/x/y"}:
            want += [(f"c{i}", lit, f"r{j}") for j in range(80) if paths(j) == lit or (paths(j) == "/api/items/:id" and lit.startswith("/api")) or (paths(j) == "/x/*" and lit == "/x/y")]
    found = A.http_matches(n)
    assert Counter((r.id, r.literal, r.route) for r in found.collect()) == Counter(want)
    least = {}
    for c, lit, r in want:
        least[c, r] = min(lit, least.get((c, r), lit))
    old = [("c0", "r1", "CROSS_SERVICE_CALLS"), ("c0", "r3", "CROSS_SERVICE_CALLS"), ("c9", "r4", "CROSS_SERVICE_CALLS")]
    for s, t, _ in old:
        del least[s, t]
    linked = A.link_services(n, edges_of(spark, old))
    assert {(r.source, r.target): r.reason for r in linked.collect()} == least and linked.count() == len(least)
    # Nearly all rows are of one literal and one path, and yet no task makes many of them.
    for df in (found, linked):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.25 * sum(sizes)


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that traversals cut, as they ran; no table counts as small."""
    seen = []

    def cut(df, name="step", **how):
        out = L.cut(df, name, **how)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    for module in (T, A):
        monkeypatch.setattr(module, "cut", cut, raising=False)
    for where, name in ((L, "SMALL"), (T, "SMALL"), (T, "FRONTIER"), (T, "MANY")):
        monkeypatch.setattr(where, name, 0 if name == "MANY" else -1, raising=False)
    return seen


def random_pairs(n, m, seed):
    r = random.Random(seed)
    return [(str(r.randrange(n)), str(r.randrange(n))) for _ in range(m)]


def bfs(pairs, start):
    seen, depth, level = {start: 0}, 0, {start}
    while level:
        depth += 1
        level = {t for s, t in pairs if s in level and t not in seen}
        seen |= dict.fromkeys(level, depth)
    return seen


def test_index_tasks_stay_small(spark):
    conf = star.building(spark, 1 << 30)
    assert int(conf["spark.sql.shuffle.partitions"]) >= 512 and int(conf["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 16 << 20
    assert int(star.building(spark, 1000)["spark.sql.shuffle.partitions"]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    with L.set_for(spark, conf):
        out = spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string")
        path = L.new_path(spark, "test")
        out.write.partitionBy("p").parquet(path)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0" and sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]


def test_closure_of_large_frontiers(spark, plans):
    pairs = random_pairs(40, 60, 1)
    e = edges_of(spark, [(a, b, "CALLS") for a, b in pairs])
    for start in ("0", pairs[0][0]):
        assert dict(T.closure(e, spark.createDataFrame([(start,)], "id string")).collect()) == bfs(pairs, start)
    assert plans and not any("BroadcastHashJoin" in p for _, p in plans)


def test_small_frontiers_are_sent_and_edges_dropped(spark, monkeypatch):
    monkeypatch.setattr(T, "MANY", 0)
    pairs = [(str(i), str(i + 1)) for i in range(15)] + random_pairs(15, 20, 2)
    e = edges_of(spark, [(a, b, "CALLS") for a, b in pairs])
    assert dict(T.closure(e, spark.createDataFrame([("0",)], "id string")).collect()) == bfs(pairs, "0")


def test_cycles_and_parts_send_nothing_large(spark, plans):
    e = edges_of(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("d", "d", "CALLS"), ("x", "y", "CALLS")])
    assert sorted(r[0] for r in T.cycles(e).collect()) == [list("abca"), list("dd")]
    assert sorted(map(tuple, T.scc_members(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert plans and not any("BroadcastHashJoin" in p for _, p in plans)


def test_impact_does_not_move_all_edges(spark, plans):
    e = edges_of(spark, [("b", "a", "CALLS"), ("b", "a", "CALLS"), ("c", "b", "CALLS")])
    assert {r.id: r.depth for r in T.impact(e, "a").collect()} == {"b": 1, "c": 2}
    assert [p for name, p in plans if name == "back"] and not any("Exchange" in p for name, p in plans if name == "back")


def test_lists_are_merged_from_parents(spark, monkeypatch):
    r = random.Random(3)
    rows = [(str(i), str(r.randrange(i)), "EXTENDS", r.randrange(3)) for i in range(1, 40) for _ in range(r.choice((1, 1, 2)))]
    rows += [("x", "y", "EXTENDS", 0), ("y", "x", "EXTENDS", 0), ("z", "y", "EXTENDS", 0), ("z", "3", "EXTENDS", 1)]
    parents = {}
    for s, t, _, _ in sorted(set(rows), key=lambda x: (x[0], x[3], x[1])):
        parents.setdefault(s, []).append(t)
    ids = sorted({x for s, t, _, _ in rows for x in (s, t)} | {"alone"})
    each = []
    above = T.above_each
    monkeypatch.setattr(T, "above_each", lambda up, roots, *more: each.extend(x.root for x in roots.collect()) or above(up, roots, *more))
    for strategy, want in (("python", T.c3), ("java", T.first_wins), ("rust", lambda c, p: [c])):
        got = {x.root: x.mro for x in T.method_resolution(edges_of(spark, rows), spark.createDataFrame([(i,) for i in ids], "id string"), strategy).collect()}
        assert got == {i: want(i, parents) for i in ids}
    assert set(each) == {"x", "y", "z"}


def test_propagation_moves_votes_once(spark, plans):
    pairs = [(a, b) for a, b in random_pairs(30, 80, 4)]
    weight = Counter(tuple(sorted(p)) for p in pairs if p[0] != p[1])
    near = {}
    for (a, b), w in weight.items():
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    label = {i: i for i in near}
    for _ in range(3):
        votes = {i: Counter() for i in near}
        for i in near:
            for o, w in near[i].items():
                votes[i][label[o]] += w
        label = {i: max(v, key=lambda c: (v[c], c)) for i, v in votes.items()}
    assert dict(A.propagated(edges_of(spark, [(a, b, "CALLS") for a, b in pairs]), rounds=3).collect()) == label
    rounds = [p.split("== Initial Plan ==")[0] for name, p in plans if name == "labels"]
    assert "Join" not in rounds[0] and all("SortMergeJoin" not in p and p.count("Exchange hashpartitioning") <= 3 for p in rounds)


def test_texts_are_split_once(spark):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the dog the dog"), (3, None)], "doc_id long, text string")
    found = S.bm25(docs, "doc_id", "text", "the dog")
    assert [r.id for r in found.collect()] == [2, 1]
    assert "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()


def test_unique_edges_move_once(spark):
    e = edges_of(spark, [("a", "b", "CALLS", 1), ("a", "b", "CALLS", 1), ("a", "b", "CALLS", None), ("a", "b", "CALLS", 0), ("c", "b", "READS", 1)])
    out = files.unique_edges(e, tasks=3).groupBy("source", "target", "type", F.coalesce("startLine", F.lit(0)).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, out.collect())) == [("a", "b", "CALLS", 0, 1), ("a", "b", "CALLS", 1, 1), ("c", "b", "READS", 1, 1)]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_packed_louvain_is_louvain(spark):
    for seed in range(30):
        r = random.Random(seed)
        names = sorted({str(r.randrange(400)) for _ in range(25)})
        pairs = {tuple(sorted(r.sample(names, 2))): r.choice((1, 1, 1, 2, 3)) for _ in range(r.randrange(5, 90))}
        used = sorted({x for p in pairs for x in p})
        number = {x: i for i, x in enumerate(used)}
        both = sorted((number[x], number[y], w) for (a, b), w in pairs.items() for x, y in ((a, b), (b, a)))
        got = A.packed_louvain(*(array("i", c) for c in zip(*both))).tolist()
        want, first = A.louvain([(a, b, float(w)) for (a, b), w in pairs.items()]), {}
        for x in used:
            first.setdefault(want[x], x)
        assert [used[i] for i in got] == [first[want[x]] for x in used]
    found = A.communities(edges_of(spark, [(a, b, "CALLS") for (a, b), w in pairs.items() for _ in range(w)] + [("p", "q", "CALLS")]))
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert dict(found.collect()) == {x: first[want[x]] for x in used} | {"p": "p", "q": "p"}
