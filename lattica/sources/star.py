"""The property graph of a star schema (region, nation, customer, supplier, part, orders, lineitem).

The mapping is plain SQL that other engines run as well. Nations are modules, customers functions, suppliers methods,
parts classes, orders variables; routes, endpoints, handlers, middleware, tools and files are made from keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lattica.plans.lineage import set_for, shared_dir, stored_bytes
from lattica.schema import EDGE, NODE

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_COLUMNS = "id label name qualifiedName filePath startLine endLine language signature returnType docstring content isExported isGlobal parentQn project httpMethod path expectedSchema hash lineCount parameterCount".split()
NODE_TYPES = T.StructType([NODE[c] for c in _COLUMNS])
_KIND = {"startLine": "BIGINT", "endLine": "BIGINT", "lineCount": "BIGINT", "parameterCount": "BIGINT", "isExported": "BOOLEAN", "isGlobal": "BOOLEAN"}


def _node(source: str, **values: str) -> str:
    """One SELECT of the union; texts that aren't given are '', numbers and flags NULL."""
    cells = [f"{values[c] if c in values else ('CAST(NULL AS ' + _KIND[c] + ')' if c in _KIND else chr(39) * 2)} AS {c}" for c in _COLUMNS]
    return f"SELECT {', '.join(cells)} FROM {source}"


_PLACE = "JOIN {nation} ON n_nationkey = %s JOIN {region} ON r_regionkey = n_regionkey"
_S = "CAST(%s AS STRING)"

NODES_SQL = "\nUNION ALL ".join(
    [
        _node("{nation} JOIN {region} ON r_regionkey = n_regionkey", id=f"'n:' || {_S % 'n_nationkey'}", label="'Module'", name="n_name", qualifiedName="r_name || '.' || n_name", filePath="r_name || '/' || n_name", startLine="1", language="'rust'", isExported="true", project="r_name"),
        _node("{nation} JOIN {region} ON r_regionkey = n_regionkey", id=f"'f:' || {_S % 'n_nationkey'}", label="'File'", name="n_name || '.rs'", qualifiedName="r_name || '.' || n_name || '.rs'", filePath="r_name || '/' || n_name || '.rs'", language="CASE WHEN n_nationkey % 3 = 0 THEN 'rust' WHEN n_nationkey % 3 = 1 THEN 'python' ELSE 'go' END", project="r_name", hash=f"CASE WHEN n_nationkey % 10 = 9 THEN '' ELSE 'h' || {_S % 'n_nationkey'} END", lineCount="CAST(n_nationkey * 100 + 50 AS BIGINT)"),
        _node("{customer} " + _PLACE % "c_nationkey", id=f"'c:' || {_S % 'c_custkey'}", label="'Function'", name=f"CASE WHEN c_custkey % 29 = 0 THEN 'test_' || {_S % 'c_custkey'} WHEN c_custkey % 31 = 0 THEN 'main' ELSE c_name END", qualifiedName=f"r_name || '.' || n_name || '.' || CASE WHEN c_custkey % 97 = 0 THEN 'dup' ELSE c_name END", filePath="r_name || '/' || n_name || '.rs'", startLine="CAST(c_custkey % 1000 + 1 AS BIGINT)", endLine="CAST(c_custkey % 1000 + 1 + c_custkey % 40 AS BIGINT)", language="CASE WHEN n_nationkey % 3 = 0 THEN 'rust' WHEN n_nationkey % 3 = 1 THEN 'python' ELSE 'go' END", signature=f"'fn f' || {_S % 'c_custkey'} || '(a: i' || {_S % '(c_custkey % 4)'} || ', b: str)'", returnType="'void'", docstring="c_mktsegment", content=f"CASE WHEN c_custkey % 20 = 1 THEN 'client.get(\"/api/items/' || {_S % '(c_custkey % 60)'} || '\")' WHEN c_custkey % 20 = 2 THEN 'stub = client.Get' || c_mktsegment || '(req)' WHEN c_custkey % 20 = 3 THEN 'channel.publish(\"topic' || {_S % '(c_custkey % 7)'} || '\")' WHEN c_custkey % 20 = 4 THEN 'io.emit(\"event' || {_S % '(c_custkey % 5)'} || '\")' WHEN c_custkey % 20 = 5 THEN 'post(\"/graphql\", \"query Q {{{{ x }}}}\")' ELSE '' END", isExported="c_custkey % 11 = 0", isGlobal="false", parentQn="r_name || '.' || n_name", project="r_name", parameterCount="CAST(2 AS BIGINT)"),
        _node("{supplier} " + _PLACE % "s_nationkey", id=f"'s:' || {_S % 's_suppkey'}", label="'Method'", name="s_name", qualifiedName="r_name || '.' || n_name || '.' || s_name", filePath="r_name || '/' || n_name || '.rs'", startLine="CAST(s_suppkey * 7 % 900 + 1 AS BIGINT)", endLine="CAST(s_suppkey * 7 % 900 + 20 AS BIGINT)", language="'rust'", signature=f"'fn m' || {_S % 's_suppkey'} || '(self)'", returnType="'i64'", docstring="'supplies parts'", isExported="s_suppkey % 2 = 0", isGlobal="false", parentQn=f"'p:' || {_S % 's_suppkey'}", project="r_name", parameterCount="CAST(s_suppkey % 5 AS BIGINT)"),
        _node("{part} JOIN {region} ON r_regionkey = p_partkey % 5", id=f"'p:' || {_S % 'p_partkey'}", label="'Class'", name="p_name", qualifiedName=f"r_name || '.lib.' || replace(p_name, ' ', '_') || '#' || {_S % 'p_partkey'}", filePath=f"r_name || '/lib' || {_S % '(p_partkey % 20)'} || '.rs'", startLine="CAST(p_partkey % 500 + 1 AS BIGINT)", endLine="CAST(p_partkey % 500 + 30 AS BIGINT)", language="'rust'", docstring="p_brand", content="p_type", isExported="p_size % 2 = 0", parentQn="r_name || '.lib'", project="r_name"),
        _node("{orders} JOIN {customer} ON c_custkey = o_custkey " + _PLACE % "c_nationkey", id=f"'o:' || {_S % 'o_orderkey'}", label="'Variable'", name=f"'order_' || {_S % 'o_orderkey'}", qualifiedName=f"r_name || '.' || n_name || '.order_' || {_S % 'o_orderkey'}", filePath="r_name || '/' || n_name || '.rs'", startLine="CAST(o_orderkey % 2000 + 1 AS BIGINT)", endLine="CAST(o_orderkey % 2000 + 1 AS BIGINT)", language="'rust'", docstring="o_orderpriority", isExported="false", isGlobal="o_orderstatus = 'P'", parentQn=f"'c:' || {_S % 'o_custkey'}", project="r_name"),
        _node("{part} JOIN {region} ON r_regionkey = p_partkey % 5 WHERE p_partkey % 10 = 0", id=f"'r:' || {_S % 'p_partkey'}", label="'Route'", name=f"'route_' || {_S % 'p_partkey'}", qualifiedName=f"r_name || '.route_' || {_S % 'p_partkey'}", filePath="r_name || '/routes.rs'", startLine="CAST(p_partkey % 300 + 1 AS BIGINT)", httpMethod="CASE WHEN p_partkey % 20 = 0 THEN 'GET' ELSE 'POST' END", path=f"CASE WHEN p_partkey % 30 = 0 THEN '/api/items/:id' WHEN p_partkey % 40 = 0 THEN '/files/*' ELSE '/api/items/' || {_S % '(p_partkey % 60)'} END", project="r_name"),
        _node("{part} JOIN {region} ON r_regionkey = p_partkey % 5 WHERE p_partkey % 25 = 1", id=f"'e:' || {_S % 'p_partkey'}", label="'Endpoint'", name=f"'endpoint_' || {_S % 'p_partkey'}", qualifiedName=f"r_name || '.endpoint_' || {_S % 'p_partkey'}", filePath="r_name || '/routes.rs'", startLine="CAST(p_partkey % 300 + 2 AS BIGINT)", httpMethod="'GET'", path=f"'/api/e/' || {_S % '(p_partkey % 40)'}", expectedSchema=f"'schema' || {_S % '(p_partkey % 3)'}", project="r_name"),
        _node("{supplier} " + _PLACE % "s_nationkey" + " WHERE s_suppkey % 4 = 0", id=f"'h:' || {_S % 's_suppkey'}", label="'Handler'", name=f"'handle_' || {_S % 's_suppkey'}", qualifiedName=f"r_name || '.handle_' || {_S % 's_suppkey'}", filePath="r_name || '/handlers.rs'", startLine="CAST(s_suppkey % 300 + 3 AS BIGINT)", project="r_name"),
        _node("{supplier} " + _PLACE % "s_nationkey" + " WHERE s_suppkey % 8 = 0", id=f"'w:' || {_S % 's_suppkey'}", label="'Middleware'", name=f"'guard_' || {_S % 's_suppkey'}", qualifiedName=f"r_name || '.guard_' || {_S % 's_suppkey'}", filePath="r_name || '/middleware.rs'", startLine="CAST(1 AS BIGINT)", project="r_name"),
        _node("{supplier} " + _PLACE % "s_nationkey" + " WHERE s_suppkey % 9 = 0", id=f"'t:' || {_S % 's_suppkey'}", label="'Tool'", name=f"'tool_' || {_S % 's_suppkey'}", qualifiedName=f"r_name || '.tool_' || {_S % 's_suppkey'}", filePath="r_name || '/tools.rs'", startLine="CAST(1 AS BIGINT)", docstring="'does things'", project="r_name"),
    ]
)


def _edge(type_: str, source: str, target: str, rows: str, confidence: str = "0.9", tier: str = "'IMPORT_SCOPED'", reason: str = "''", line: str = "CAST(0 AS BIGINT)", project: str = "r_name") -> str:
    return f"SELECT {source} AS source, {target} AS target, '{type_}' AS type, CAST({confidence} AS DOUBLE) AS confidence, {tier} AS confidenceTier, {reason} AS reason, {line} AS startLine, {project} AS project FROM {rows}"


_C = "{customer} " + _PLACE % "c_nationkey"
_SUP = "{supplier} " + _PLACE % "s_nationkey"
_N = "(SELECT count(*) AS n FROM {customer}) z"
_PART = "{part} JOIN {region} ON r_regionkey = p_partkey % 5"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}:' || CAST({key} AS STRING)"


EDGES_SQL = "\nUNION ALL ".join(
    [
        _edge("DEFINES", _id("n", "c_nationkey"), _id("c", "c_custkey"), _C, "1.0", "'SAME_FILE'"),
        _edge("DEFINES", _id("n", "s_nationkey"), _id("s", "s_suppkey"), _SUP, "1.0", "'SAME_FILE'"),
        _edge("CALLS", _id("c", "c"), _id("s", "s"), "(SELECT o_custkey AS c, l_suppkey AS s, min(l_linenumber) AS line, r_name FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {customer} ON c_custkey = o_custkey " + _PLACE % "c_nationkey" + " GROUP BY o_custkey, l_suppkey, r_name) d", "0.85", "'GLOBAL'", "'dense'", "CAST(line AS BIGINT)"),
        _edge("CALLS", _id("c", "c_custkey"), _id("c", "((c_custkey * 7 + 3) % n)"), _C + " CROSS JOIN " + _N + " WHERE c_custkey % 13 <> 5", "0.95", "'SAME_FILE'", "'sparse'", "CAST(c_custkey % 50 AS BIGINT)"),
        _edge("CALLS", _id("c", "c_custkey"), _id("c", "((c_custkey * 3 + 1) % n)"), _C + " CROSS JOIN " + _N + " WHERE c_custkey % 5 = 0", "0.80", "'GLOBAL'", "'sparse'", "CAST(c_custkey % 50 + 1 AS BIGINT)"),
        _edge("FFI_CALLS", _id("c", "c_custkey"), _id("s", "c_custkey % 10"), _C + " WHERE c_custkey % 37 = 0", "0.7", "'GLOBAL'", "'ffi'"),
        _edge("HAS_METHOD", _id("p", "s_suppkey"), _id("s", "s_suppkey"), _SUP, "1.0", "'SAME_FILE'"),
        _edge("USES_TYPE", _id("o", "l_orderkey"), _id("p", "l_partkey"), "{lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey " + _PLACE % "c_nationkey" + " WHERE l_linenumber = 1"),
        _edge("USES_TYPE", _id("c", "c_custkey"), _id("p", "c_custkey"), _C + " WHERE c_custkey % 6 = 0"),
        _edge("READS", _id("c", "o_custkey"), _id("o", "o_orderkey"), "{orders} JOIN {customer} ON c_custkey = o_custkey " + _PLACE % "c_nationkey" + " WHERE o_orderstatus = 'O'", "0.75"),
        _edge("WRITES", _id("c", "o_custkey"), _id("o", "o_orderkey"), "{orders} JOIN {customer} ON c_custkey = o_custkey " + _PLACE % "c_nationkey" + " WHERE o_orderstatus = 'F'", "0.75"),
        _edge("DATAFLOWS", _id("c", "c_custkey"), _id("c", "((c_custkey * 5 + 2) % n)"), _C + " CROSS JOIN " + _N + " WHERE c_custkey % 3 = 0", "0.8", line="CAST(c_custkey % 9 AS BIGINT)"),
        _edge("DATAFLOWS", _id("c", "c_custkey"), _id("s", "c_custkey % 25"), _C + " WHERE c_custkey % 4 = 0", "0.85"),
        _edge("EXTENDS", _id("p", "p_partkey"), _id("p", "CAST(floor(p_partkey / 2) AS BIGINT)"), _PART + " WHERE p_partkey > 0", "0.95"),
        _edge("IMPLEMENTS", _id("p", "p_partkey"), _id("p", "p_partkey + 1"), _PART + " WHERE p_partkey % 17 = 0", "0.9"),
        _edge("HANDLES_ROUTE", _id("h", "s_suppkey"), _id("r", "(s_suppkey * 10) % 200"), _SUP + " WHERE s_suppkey % 4 = 0"),
        _edge("HANDLES", _id("h", "s_suppkey"), _id("e", "((s_suppkey * 25) % 200 + 1)"), _SUP + " WHERE s_suppkey % 4 = 0"),
        _edge("USES", _id("w", "s_suppkey"), _id("h", "s_suppkey"), _SUP + " WHERE s_suppkey % 8 = 0"),
        _edge("HANDLES_TOOL", _id("h", "CAST(floor(s_suppkey / 4) AS BIGINT) * 4"), _id("t", "s_suppkey"), _SUP + " WHERE s_suppkey % 9 = 0"),
        _edge("CALLS", _id("h", "s_suppkey"), _id("c", "s_suppkey"), _SUP + " WHERE s_suppkey % 4 = 0", reason="'sparse'"),
        _edge("CALLS", _id("c", "c_custkey"), _id("e", "((c_custkey * 25) % 200 + 1)"), _C + " WHERE c_custkey % 9 = 0", reason="'schema' || CAST(c_custkey % 3 AS STRING)"),
        _edge("CALLS", _id("c", "c_custkey"), _id("h", "(c_custkey % 8) * 4"), _C + " WHERE c_custkey % 50 = 7", reason="'sparse'"),
        _edge("HTTP_CALLS", _id("c", "c_custkey"), _id("r", "(c_custkey % 20) * 10"), _C + " WHERE c_custkey % 14 = 0", "0.8"),
        _edge("FETCHES", _id("c", "c_custkey"), _id("p", "c_custkey + 1"), _C + " WHERE c_custkey % 12 = 0", "0.8"),
        _edge("HAS_PROPERTY", _id("p", "p_partkey"), _id("o", "p_partkey"), _PART + " WHERE p_partkey % 5 = 0"),
        _edge("TESTS", _id("c", "c_custkey"), _id("c", "((c_custkey + 1) % n)"), _C + " CROSS JOIN " + _N + " WHERE c_custkey % 29 = 0", "1.0"),
        _edge("IMPORTS", _id("n", "n_nationkey"), _id("n", "((n_nationkey * 3 + 1) % 25)"), "{nation} JOIN {region} ON r_regionkey = n_regionkey", "0.95"),
        _edge("INCLUDES", _id("f", "n_nationkey"), _id("f", "((n_nationkey * 2) % 25)"), "{nation} JOIN {region} ON r_regionkey = n_regionkey", "0.95"),
        _edge("REEXPORTS", _id("n", "n_nationkey"), _id("c", "n_nationkey * 4"), "{nation} JOIN {region} ON r_regionkey = n_regionkey", "0.95"),
        _edge("ENTRY_POINT_OF", _id("c", "c_custkey"), _id("n", "c_nationkey"), _C + " WHERE c_custkey % 31 = 0"),
        _edge("STEP_IN_PROCESS", _id("c", "c_custkey"), "'proc:' || CAST(c_custkey % 7 AS STRING)", _C + " WHERE c_custkey % 21 = 0"),
    ]
)


def plain(sql: str) -> str:
    """The SQL over tables of these names, for engines where they are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{{", "{").replace("}}", "}")


#: For statements that other engines run: nodes and edges as common table expressions.
GRAPH_CTE = f"nodes AS ({plain(NODES_SQL)}),\nedges AS ({plain(EDGES_SQL)})"


#: Shuffled bytes of one task of the index, and stored bytes of the tables for each partition that they are shuffled into at first: tasks stay small as tables grow.
TASK_BYTES, PART_BYTES = 8 << 20, 2 << 20


def building(spark: SparkSession, stored: int) -> dict[str, str]:
    """Settings for the index of tables of so many bytes. Concurrent writers: rows needn't be sorted by partition, a task has those of one or a few."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // PART_BYTES))
    return {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES), "spark.sql.maxConcurrentOutputFileWriters": "50"}


#: (application, directory, table) -> where it is stored
_STORED: dict[tuple[str, str, str], str] = {}


class Graph:
    """nodes and edges of one star schema directory.

    Like any source, it is indexed once: the first query of an application writes nodes by label and edges by type into
    the shared folder, and all queries read the partitions that they need from there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, sql: str) -> DataFrame:
        return self.spark.sql(sql, **{t: self.table(t) for t in TABLES})

    def _stored(self, name: str, sql: str, part: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = f"{shared_dir(self.spark)}/graph/{key[0]}/{name}-{uuid.uuid4().hex}"
            with set_for(self.spark, building(self.spark, stored_bytes(self.spark, *[f"{self.sf_dir}/{t}.parquet" for t in TABLES]))):
                self.derived(sql).write.partitionBy(part).parquet(path)
            _STORED[key] = path
        return self.spark.read.schema(NODE_TYPES if name == "nodes" else EDGE).parquet(_STORED[key])

    @property
    def nodes(self) -> DataFrame:
        return self._stored("nodes", NODES_SQL, "label")

    @property
    def edges(self) -> DataFrame:
        return self._stored("edges", EDGES_SQL, "type")
