"""Search, traversal and analytics on hand-made graphs; closures against plain breadth-first search."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lattica.functions import text as X
from lattica.operators import analytics as A
from lattica.operators import search as S
from lattica.operators import traverse as T
from lattica.schema import EDGE, EDGE_TYPES, LABELS, NODE, parse_edge_types
from lattica.sources.files import conform
from pyspark.sql import functions as F


def nodes_of(spark, rows, columns="id string, label string, name string, qualifiedName string, filePath string, startLine long, endLine long, isExported boolean"):
    return conform(spark.createDataFrame(rows, columns), NODE)


def edges_of(spark, rows):
    return conform(spark.createDataFrame([(*r, 0) if len(r) == 3 else r for r in rows], "source string, target string, type string, startLine long"), EDGE)


def test_schema():
    assert len(LABELS) == 44 and len(EDGE_TYPES) == 31
    assert parse_edge_types("calls, CALLS,extends") == ["CALLS", "EXTENDS"]
    with pytest.raises(ValueError):
        parse_edge_types("NOPE")


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_tokens(spark):
    assert one(spark, X.tokens(F.lit("parseHTTPFile_v2x"))) == ["parse", "http", "file", "v", "2", "x"]
    assert one(spark, X.tokens(F.lit("日本 getURL"))) == ["日", "本", "get", "url"]
    assert one(spark, X.tokens(F.lit("__"))) == []


def test_text_functions(spark):
    assert one(spark, X.byte_levenshtein(F.lit("é"), F.lit("e"))) == 2
    assert [tuple(p) for p in one(spark, X.parameters(F.lit("fn f(a: Vec<T>, b)")))] == [("a", "Vec<T>"), ("b", "")]
    assert one(spark, X.parameters(F.lit("fn f()"))) == []
    assert one(spark, X.package_prefix(F.lit("abc"))) is None
    assert one(spark, X.string_literals(F.lit(r'f("a\"b", "c")'))) == ['a"b', "c"]
    assert one(spark, F.rlike(F.lit("/a/7/b"), X.route_regex(F.lit("/a/:id/b")))) and not one(spark, F.rlike(F.lit("/a/7/8/b"), X.route_regex(F.lit("/a/:id/b"))))
    assert one(spark, X.renamed_qn(F.lit("p.m.old#x"), "old", "new")) == "p.m.new#x"
    assert one(spark, X.word_occurrences(F.lit("foo foobar foo"), "foo")) == [0, 11]
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0


def test_paths_prefixes_parallel_and_sink(spark):
    e = edges_of(spark, [("a", "b", "CALLS", 1), ("a", "b", "CALLS", 2), ("b", "c", "CALLS", 1), ("c", "a", "CALLS", 1)])
    got = sorted(tuple(r.nodes) for r in T.trace_calls(e, "a", 5).collect())
    assert got == [("a", "b"), ("a", "b"), ("a", "b", "c"), ("a", "b", "c")]
    flow = edges_of(spark, [("s", "m", "DATAFLOWS"), ("m", "k", "DATAFLOWS"), ("k", "z", "DATAFLOWS")])
    assert [tuple(r.nodes) for r in T.taint(flow, "s", 5, "k").collect()] == [("s", "m", "k")]
    with pytest.raises(ValueError):
        T.trace_calls(e, "a", 0)


def test_path_filter(spark):
    n = nodes_of(spark, [(x, "Function", x, x, f"src/{x}.rs", 1, 2, False) for x in "abc"])
    e = edges_of(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS")])
    got = {tuple(r.nodes): list(r.edges) for r in T.filter_paths(T.trace_calls(e, "a", 2), n, exclude=["*b.rs"]).collect()}
    assert got == {("a",): [], ("a", "c"): []}


def test_cycles_and_scc(spark):
    e = edges_of(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("c", "d", "CALLS"), ("d", "d", "CALLS"), ("x", "y", "CALLS")])
    assert sorted(r[0] for r in T.cycles(e).collect()) == [list("abca"), list("dd")]
    assert sorted(map(tuple, T.scc_members(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]


def bfs(edges, start):
    seen, depth, level = {start: 0}, 0, [start]
    while level:
        depth += 1
        level = sorted({t for s, t in edges if s in level and t not in seen})
        seen |= dict.fromkeys(level, depth)
    return seen


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20))
def test_closure_is_bfs(spark, pairs):
    pairs = [(str(a), str(b)) for a, b in pairs]
    e = edges_of(spark, [(a, b, "CALLS") for a, b in pairs])
    got = dict(T.closure(e, spark.createDataFrame([(pairs[0][0],)], "id string")).collect())
    assert got == bfs(pairs, pairs[0][0])


def test_impact_and_risk(spark):
    e = edges_of(spark, [("b", "a", "CALLS"), ("c", "b", "IMPLEMENTS"), ("d", "a", "TESTS"), ("c", "a", "CALLS")])
    got = {r.id: (r.depth, r.type, list(r.path)) for r in T.impact(e, "a").collect()}
    assert got == {"b": (1, "CALLS", ["a", "b"]), "c": (1, "CALLS", ["a", "c"])}
    assert {r.id for r in T.impact(e, "a", tests=True).collect()} == {"b", "c", "d"}
    risk = T.assess_risk(T.impact(e, "a")).first()
    assert (risk.affected, risk.level) == (2, "Low") and abs(risk.score - (0.08 * 0.6 + 0.1 * 0.2 + 0.2)) < 1e-9


def test_mro():
    diamond = {"D": ["B", "C"], "B": ["A"], "C": ["A"]}
    assert T.c3("D", diamond) == ["D", "B", "C", "A"]
    assert T.c3("X", {"X": ["A", "B"], "A": ["B"], "B": ["A"]})[0] == "X"
    assert T.first_wins("D", diamond) == ["D", "B", "A", "C"]


def test_resolve_symbol(spark):
    n = nodes_of(spark, [("1", "Function", "f", "p.f", "", 1, 2, False), ("2", "Function", "g", "p.g", "", 1, 2, False), ("3", "Function", "g", "q.g", "", 1, 2, False)])
    assert T.resolve_symbol(n, "f") == ("found", "1") and T.resolve_symbol(n, "q.g") == ("found", "3")
    assert T.resolve_symbol(n, "g")[0] == "ambiguous" and T.resolve_symbol(n, "h")[0] == "missing"


def test_dead_code(spark):
    n = nodes_of(spark, [(x, "Function", x, q, p, 1, 2, ex) for x, q, p, ex in [("main", "m", "src/a.rs", False), ("used", "u", "src/a.rs", False), ("dead", "d", "src/a.rs", False), ("api", "a", "src/a.rs", True), ("loop1", "l1", "src/a.rs", False), ("helper", "h", "tests/x.rs", False), ("owned", "o", "src/a.rs", False)]])
    e = edges_of(spark, [("main", "used", "CALLS"), ("loop1", "loop1", "CALLS"), ("z", "owned", "DEFINES")])
    assert {r.name: r.confidence for r in A.dead_code(n, e).collect()} == {"dead": "High", "loop1": "Low", "owned": "Medium"}


def test_communities_split_and_modularity(spark):
    clique = lambda names: [(a, b, "CALLS") for a in names for b in names if a < b]
    e = edges_of(spark, clique("abcd") + clique("wxyz") + [("d", "w", "CALLS")])
    member = {r.id: r.community for r in A.communities(e).collect()}
    assert len({member[x] for x in "abcd"}) == 1 and len({member[x] for x in "wxyz"}) == 1 and member["a"] != member["w"]
    total = sum(r.modularity for r in A.modularity(e, A.communities(e)).collect())
    assert 0.3 < total < 0.5
    assert len({v for v in A.louvain([("a", "b", 1.0), ("c", "d", 1.0)]).values()}) == 2


def test_quality_and_routes(spark):
    n = nodes_of(spark, [("r", "Route", "r", "r", "", 1, 1, None), ("h1", "Handler", "h1", "h", "", 1, 1, None), ("h2", "Handler", "h2", "h", "", 1, 1, None)])
    e = edges_of(spark, [("h2", "r", "HANDLES"), ("h1", "r", "HANDLES_ROUTE"), ("gone", "r", "CALLS")])
    assert A.routes(n, e).first().handlerName == "h2" and A.route_map(n, e).first().handler == "h1"
    assert [tuple(r)[2] for r in A.duplicate_names(n).collect()] == [2]
    assert [r.missing for r in A.orphan_edges(n, e).collect()] == ["source"]


def test_diff_and_changed(spark):
    lines = ["+++ b/x.rs", "@@ -1 +3,4 @@", "@@ -9,0 +20 @@", "+++ b/y.rs", "@@ -1,2 +0,0 @@"]
    hunks = A.parse_diff(spark.createDataFrame(list(enumerate(lines)), "seq long, value string"))
    assert sorted(map(tuple, hunks.collect())) == [("x.rs", 3, 4), ("x.rs", 20, 1)]
    n = nodes_of(spark, [("a", "Function", "a", "a", "x.rs", 1, 3, None), ("b", "Function", "b", "b", "x.rs", 7, 9, None)])
    assert [(r.id, r.risk) for r in A.changed_symbols(n, edges_of(spark, [("q", "a", "CALLS")]), hunks).collect()] == [("a", "medium")]


def test_rename(spark):
    assert A.apply_rename("old(old_x); old", [0, 12], "old", "new") == "new(old_x); new"
    with pytest.raises(ValueError):
        A.rename_plan(nodes_of(spark, [("a", "Function", "old", "p.old", "f", 1, 1, None)]), edges_of(spark, [("a", "b", "CALLS")]), spark.createDataFrame([("f", "old()")], "filePath string, text string"), "a", "1x")


def test_search_guards(spark):
    n = nodes_of(spark, [("a", "Function", "Alpha", "p.Alpha", "f", 1, 1, None), ("b", "Function", "alphabet", "p.b", "f", 1, 1, None), ("c", "Route", "alpha", "r", "f", 1, 1, None)])
    e = edges_of(spark, [("x", "b", "CALLS"), ("y", "b", "CALLS")])
    assert [(r.name, r.score) for r in S.by_name(n, "alpha").collect()] == [("Alpha", 1.0), ("alphabet", 0.8)]
    assert [r.degree for r in S.search("graph", n, e, "alpha", least=1).collect()] == [2]
    assert [r.name for r in S.fuzzy(n, "alpho").collect()] == ["Alpha"]
    with pytest.raises(ValueError):
        S.by_name(n, " ")
    with pytest.raises(ValueError):
        S.by_regex(n, "a" * 5000)
    with pytest.raises(ValueError):
        S.search("psychic", n, e, "a")
    assert S.clamp(None) == 50 and S.clamp(10**6) == 500


def test_rrf_prefers_both_lists(spark):
    hit = lambda rows: spark.createDataFrame([(n, "Function", "f", 1, n, s, "x", 0) for n, s in rows], "name string, label string, filePath string, startLine long, qualifiedName string, score double, matchReason string, degree long")
    got = S.rrf([hit([("a", 9.0), ("b", 8.0)]), hit([("b", 1.0), ("c", 0.5)])]).collect()
    assert [r.name for r in got] == ["b", "a", "c"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-12


def test_methods_of_every_class_are_resolved(spark):
    from lattica.plans.queries import QUERIES
    from lattica.sources.star import Graph

    sf = "/root/testdata/sf0.001"
    g = Graph(spark, sf)
    up = {r.source: r.target for r in g.edges.where("type = 'EXTENDS'").collect()}  # one parent each
    want = {}
    for r in g.nodes.where("label = 'Class'").select("id").collect():
        line = [r.id]
        while line[-1] in up and up[line[-1]] not in line:
            line.append(up[line[-1]])
        want[r.id] = ">".join(line)
    assert {r.root: r.mro for r in QUERIES["g19_method_resolution"](spark, sf).collect()} == want
