import pytest

from lattica.cypher.compiler import cypher
from lattica.cypher.parser import QueryError, parse

ACCEPTED = [
    "MATCH (n) RETURN n", "match (n:Function) return n.name", "MATCH (n:A:B) RETURN n;", "MATCH (n:F {name: 'x', line: 3}) RETURN n", "MATCH (a)-[r]->(b) RETURN a, b", "MATCH (a)<-[r:CALLS]-(b) RETURN r",
    "MATCH (a)-[:X|:Y]-(b) RETURN a", "MATCH (a)<-[r]->(b) RETURN a", "MATCH (a)-[*]->(b) RETURN b", "MATCH (a)-[*2]->(b) RETURN b", "MATCH (a)-[*1..3]->(b) RETURN b", "MATCH (a)-[*..3]->(b) RETURN b", "MATCH (a)-[*2..]->(b) RETURN b",
    "MATCH (n) WHERE n.a = 1 AND NOT n.b <> 2 OR n.c IS NULL RETURN n", "MATCH (n) WHERE n.a != 1 RETURN n", "MATCH (n) WHERE n.name =~ 'a.*' RETURN n", "MATCH (n) WHERE n.name STARTS WITH 'a' RETURN n", "MATCH (n) WHERE n.name ENDS WITH \"a\" RETURN n",
    "MATCH (n) WHERE n.name CONTAINS 'a' RETURN n", "MATCH (n) WHERE n.id IN ['a', 'b'] RETURN n", "MATCH (n) WHERE n.x IS NOT NULL RETURN n", "MATCH (n) RETURN DISTINCT n.a AS a ORDER BY a DESC, n.b ASC SKIP 1 LIMIT 2", "MATCH (n) RETURN count(*)",
    "MATCH (n) RETURN count(DISTINCT n.a) AS k, collect(n.b) AS l", "MATCH (n) WITH n.a AS a, count(n) AS k WHERE k > 1 RETURN a", "UNWIND [1, 2.5] AS x RETURN x", "MATCH (a) OPTIONAL MATCH (a)-[r:X]->(b) RETURN a, b", "MATCH (a) RETURN a.x AS x UNION MATCH (b) RETURN b.x AS x",
    "MATCH (a) RETURN a.x AS x UNION ALL MATCH (b) RETURN b.x AS x", "MATCH (n) WHERE EXISTS((n)-[:X]->()) RETURN n", "MATCH (n) WHERE EXISTS(n.x) RETURN n", "MATCH (n) RETURN -n.a + 2 * (n.b - 1) / 3 % 4 AS v", "MATCH (n) // comment\nRETURN n", "MATCH (n) RETURN *",
    "MATCH (n) RETURN true, false, null", "MATCH (matching) RETURN matching.returned", "MATCH () RETURN 1", "MATCH (n) RETURN n.a.b", "RETURN 1 AS one",
]
REFUSED = ["", "   ", "CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.a = 1 RETURN n", "MERGE (n) RETURN n", "MATCH (n) REMOVE n.a RETURN n", "CALL db.x() RETURN 1", "FOREACH (x IN [1] | RETURN x)", "LOAD CSV FROM 'x' AS r RETURN r",
           "MATCH (a), (b) RETURN a", "MATCH (a)-->(b) RETURN a", "MATCH (n) RETURN CASE WHEN 1 THEN 2 END", "MATCH (n) RETURN $p", "MATCH (n) RETURN {a: 1}", "MATCH (n) RETURN n.l[0]", "MATCH (n) WHERE n.a XOR n.b RETURN n", "MATCH (n)", "MATCH (n RETURN n", "WHERE 1 = 1 RETURN 1", "MATCH (n) RETURN n LIMIT 1.5"]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepts(text):
    assert parse(text)


@pytest.mark.parametrize("text", REFUSED)
def test_refuses(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.fixture(scope="module")
def graph(spark):
    from lattica.schema import EDGE, NODE
    from lattica.sources.files import conform

    n = spark.createDataFrame([("a", "Function", "alpha", 1), ("b", "Function", "beta", 5), ("c", "Method", "gamma", None), ("d", "Class", "delta", 9)], "id string, label string, name string, startLine long")
    e = spark.createDataFrame([("a", "b", "CALLS", 1), ("b", "a", "CALLS", 2), ("b", "c", "CALLS", 3), ("a", "c", "READS", 4)], "source string, target string, type string, startLine long")
    return conform(n, NODE), conform(e, EDGE)


def rows(graph, text):
    return sorted(map(tuple, cypher(text, *graph).collect()), key=repr)


def test_chain_and_direction(graph):
    assert rows(graph, "MATCH (x)-[:CALLS]->(y)-[:CALLS]->(z:Method) RETURN x.id, z.id") == [("a", "c")]
    assert rows(graph, "MATCH (x:Method)<-[r]-(y) RETURN y.id, r.type") == [("a", "READS"), ("b", "CALLS")]
    assert len(rows(graph, "MATCH (x {id: 'b'})-[:CALLS]-(y) RETURN y.id")) == 3


def test_variable_length_uses_an_edge_once(graph):
    assert rows(graph, "MATCH (x {id: 'a'})-[r:CALLS*1..5]->(y) RETURN y.id, size(r)") == [("a", 2), ("b", 1), ("c", 2)]
    assert ("a", "a") in rows(graph, "MATCH (x {id: 'a'})-[:CALLS*0..1]->(y) RETURN x.id, y.id")


def test_optional_keeps_rows_and_where_is_part_of_it(graph):
    assert rows(graph, "MATCH (x:Function) OPTIONAL MATCH (x)-[r:READS]->(y) WHERE y.name = 'gamma' RETURN x.id, y.id") == [("a", "c"), ("b", None)]


def test_null_logic_and_order(graph):
    assert rows(graph, "MATCH (x) WHERE NOT x.startLine > 4 RETURN x.id") == [("a",)]
    assert [r[0] for r in cypher("MATCH (x) RETURN x.id AS i, x.startLine AS l ORDER BY l", *graph).collect()] == ["a", "b", "d", "c"]
    assert [r[0] for r in cypher("MATCH (x) RETURN x.id AS i ORDER BY x.startLine DESC LIMIT 2", *graph).collect()] == ["c", "d"]


def test_exists_within_or(graph):
    assert rows(graph, "MATCH (x) WHERE x.label = 'Class' OR EXISTS((x)-[:READS]->()) RETURN x.id") == [("a",), ("d",)]


def test_integer_division_and_unknown_names(graph):
    assert rows(graph, "UNWIND [7, 0 - 7] AS v RETURN v / 2 AS h") == [(-3,), (3,)]
    for bad in ("MATCH (x) RETURN y.id", "MATCH (x) RETURN x.nope", "MATCH (x) RETURN nope(x.id)", "MATCH (x) RETURN x.id AS a UNION MATCH (x) RETURN x.id AS b"):
        with pytest.raises(QueryError):
            cypher(bad, *graph)


def test_empty_unwind(graph):
    assert rows(graph, "MATCH (x:Nothing) RETURN count(*) AS n") == [(0,)]
