"""Analytics: dead code, communities, architecture, cross-service links, interface reviews, data quality, changes, renames."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.functions import text as X
from lattica.operators.search import indegree
from lattica.operators.traverse import closure
from lattica.plans.lineage import cut

# Dead code

ENTRY_PATTERNS = tuple("main Main __main__ wmain WinMain DLLMain".split())
TEST_PATTERNS = tuple("test_* *_test *_spec it_* sec_* snap_* perf_* bench_*".split())
ENTRY_ATTRIBUTES = tuple("#[" + x for x in ("tool", "forge", *(f"{r}::main" for r in ("tokio", "rocket", "actix", "axum"))))
LIVE_TYPES = ("CALLS", "FFI_CALLS", "IMPLEMENTS", "HANDLES_ROUTE", "USAGE", "TESTS", "USES_TYPE", "HTTP_CALLS", "ASYNC_CALLS")
DEAD_REASON = "zero incoming CALLS edges"


def seed_rule(entries: tuple[str, ...] = ENTRY_PATTERNS, tests: tuple[str, ...] = TEST_PATTERNS, exported: bool = True, dispatch: bool = True) -> Column:
    """Whether a function is alive by itself, as far as its own row tells."""
    tail = F.regexp_extract("qualifiedName", r"#([^#]*)$", 1)
    test_module = (tail == "tests") | F.startswith(tail, F.lit("tests_"))
    rules = [X.glob_match(F.col("name"), p) for p in (*entries, *tests)]
    rules += [test_module, F.rlike(F.translate("filePath", "\\", "/"), F.lit(r"(^|/)tests?/")), F.rlike("signature", F.lit(r"#\[(\w+::)*test\b"))]
    rules += [F.contains("signature", F.lit(a)) for a in ENTRY_ATTRIBUTES] + [F.contains("signature", F.lit('extern "C"'))]
    if dispatch:
        rules.append((tail != "") & ~test_module)
    if exported:
        rules.append(F.coalesce("isExported", F.lit(False)))
    return reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])


def dead_code(nodes: DataFrame, edges: DataFrame, project: str | None = None, labels: tuple[str, ...] = ("Function", "Method"), seeds: DataFrame | None = None, **options: object) -> DataFrame:
    """Functions that no seed reaches: name, qualifiedName, filePath, startLine, language, confidence, reason; by qualified name.

    seeds (id) replaces the rules' own. confidence: Low if some CALLS edge points at it, Medium if any other edge does (DEFINES counts), High if none.
    """
    functions = nodes.where(F.col("label").isin(*labels))
    if project:
        functions = functions.where(F.col("project") == project)
    if seeds is None:
        seeds = functions.where(seed_rule(**options)).select("id").union(edges.where("type = 'REEXPORTS'").select("target")).union(nodes.where(~F.col("label").isin(*labels)).select("id")).distinct()
    live = closure(edges.where(F.col("type").isin(*LIVE_TYPES)), seeds)
    called = edges.where("type = 'CALLS'").select(F.col("target").alias("id")).distinct().withColumn("_called", F.lit(True))
    other = edges.where("type <> 'CALLS'").select(F.col("target").alias("id")).distinct().withColumn("_other", F.lit(True))
    dead = functions.join(live.select("id").hint("merge"), "id", "left_anti").join(called.hint("merge"), "id", "left").join(other.hint("merge"), "id", "left")
    confidence = F.when(F.col("_called"), "Low").when(F.col("_other"), "Medium").otherwise("High")
    return dead.select(*"name qualifiedName filePath startLine language".split(), confidence.alias("confidence"), F.lit(DEAD_REASON).alias("reason")).orderBy("qualifiedName")


# Communities


def call_weights(edges: DataFrame) -> DataFrame:
    """a < b, weight: undirected CALLS graph without loops."""
    e = edges.where("type = 'CALLS' AND source <> target")
    return e.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def louvain(links: list[tuple[str, str, float]], resolution: float = 1.0, rounds: int = 20) -> dict[str, int]:
    """Community by node: local moves in id order, then split into connected parts; numbered by first appearance."""
    near: dict[str, dict[str, float]] = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    order = sorted(near)
    degree = {n: sum(near[n].values()) for n in order}
    twice = sum(degree.values()) or 1.0
    of = {n: i for i, n in enumerate(order)}
    total = {i: degree[n] for i, n in enumerate(order)}
    for _ in range(rounds):
        moved = False
        for n in order:
            total[of[n]] -= degree[n]
            weight: dict[int, float] = {}
            for m, w in near[n].items():
                weight[of[m]] = weight.get(of[m], 0) + w
            gain = lambda c: weight.get(c, 0) - resolution * degree[n] * total.get(c, 0) / twice  # noqa: B023, E731
            best = min(weight, key=lambda c: (-gain(c), c), default=of[n])
            if gain(best) > gain(of[n]) + 1e-12:
                of[n], moved = best, True
            total[of[n]] = total.get(of[n], 0) + degree[n]
        if not moved:
            break
    part: dict[str, int] = {}
    for n in order:
        if n not in part:
            part[n], stack = len(set(part.values())), [n]
            while stack:
                x = stack.pop()
                for m in near[x]:
                    if m not in part and of[m] == of[n]:
                        part[m] = part[n]
                        stack.append(m)
    return part


def packed_louvain(source: array, target: array, weight: array, resolution: float = 1.0, rounds: int = 20) -> np.ndarray:
    """`louvain` of nodes 0 to n - 1, numbered in id order: for each node the least node of its community. Both directions of every link are given, by source; weights are whole. It holds 12 bytes a direction."""
    near, w, start = np.frombuffer(target, np.int32), np.frombuffer(weight, np.int32), np.frombuffer(source, np.int32)
    n = int(start[-1]) + 1
    begin = np.searchsorted(start, np.arange(n + 1, dtype=np.int32))
    degrees = np.add.reduceat(w, begin[:-1], dtype=np.int64).astype(float)
    even = (np.maximum.reduceat(w, begin[:-1]) == 1).tolist()
    at, degree, total, of = begin.tolist(), degrees.tolist(), degrees.tolist(), np.arange(n, dtype=np.int32)
    twice = float(degrees.sum()) or 1.0
    for _ in range(rounds):
        moved = False
        for i in range(n):
            around = of[near[at[i] : at[i + 1]]].tolist()
            own = int(of[i])
            total[own] -= degree[i]
            if even[i]:
                links: dict[int, int] = Counter(around)
            else:
                links = {}
                for c, x in zip(around, w[at[i] : at[i + 1]].tolist()):
                    links[c] = links.get(c, 0) + x
            share, best, most = resolution * degree[i], own, -math.inf
            for c, x in links.items():
                gain = x - share * total[c] / twice
                if gain > most or gain == most and c < best:
                    best, most = c, gain
            if best != own and most > links.get(own, 0) - share * total[own] / twice + 1e-12:
                of[i], own, moved = best, best, True
            total[own] += degree[i]
        if not moved:
            break
    part = np.full(n, -1, np.int32)
    for i in range(n):
        if part[i] < 0:
            part[i], stack = i, [i]
            while stack:
                x = stack.pop()
                more = near[at[x] : at[x + 1]]
                more = more[(of[more] == of[i]) & (part[more] < 0)]
                part[more] = i
                stack += more.tolist()
    return part


def communities(edges: DataFrame, resolution: float = 1.0, seeds: int = 1) -> DataFrame:
    """id, community, by label propagation on the distributed graph down to its weak components, Louvain within each.

    Louvain is sequential: a component is one task. Its nodes are numbered and its links come sorted, so that the task holds 24 bytes of
    each link. `propagated` is the form for components that don't fit.
    """
    from lattica.operators.traverse import weak_components

    weights = cut(call_weights(edges), "weights")
    member = cut(weak_components(weights.select(F.col("a").alias("source"), F.col("b").alias("target"))), "member")
    keys = cut(member.select("component").distinct().withColumn("k", F.monotonically_increasing_id()), "keys")
    number = F.row_number().over(W.partitionBy("k").orderBy("id")) - 1
    member = cut(member.join(keys, "component").select("id", "k", number.alias("n")), "member")
    a, b = member.select(F.col("id").alias("a"), "k", "n"), member.select(F.col("id").alias("b"), F.col("n").alias("m"))
    links = weights.join(a.hint("shuffle_hash"), "a").join(b.hint("shuffle_hash"), "b").select("k", "n", "m", F.col("weight").cast("int").alias("w"))
    both = cut(links.union(links.select("k", "m", "n", "w")), "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, (array("i"), array("i"), array("i"))

        def found() -> Iterator[pa.RecordBatch]:
            of = packed_louvain(*held, resolution=resolution)
            for i in range(0, len(of), 100_000):
                part = of[i : i + 100_000]
                yield pa.record_batch({"k": pa.array([key] * len(part), pa.int64()), "n": pa.array(np.arange(i, i + len(part), dtype=np.int32)), "m": pa.array(part)})

        for batch in batches:
            ks = batch.column(0).to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), len(ks)]
            for i, j in zip(ends, ends[1:]):
                if i < j:
                    if key is not None and ks[i] != key:
                        yield from found()
                        held = (array("i"), array("i"), array("i"))
                    key = int(ks[i])
                    for to, column in zip(held, batch.columns[1:]):
                        to.frombytes(column.to_numpy()[i:j].astype(np.int32).tobytes())
        if key is not None:
            yield from found()

    of = cut(both.repartition("k").sortWithinPartitions("k", "n", "m").mapInArrow(run, "k long, n int, m int"), "of")
    first = member.select("k", F.col("n").alias("m"), F.col("id").alias("community"))
    return of.join(member.hint("merge"), ["k", "n"]).join(first.hint("merge"), ["k", "m"]).select("id", "community")


def propagated(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community: weighted label propagation; each round every node takes the label with most weight around it, the least on ties."""
    w = call_weights(edges)
    both = cut(w.select(F.col("a").alias("id"), F.col("b").alias("o"), "weight").union(w.select("b", "a", "weight")), "weights")
    best = lambda label: F.max_by(label, F.struct("v", F.col(label))).alias("community")
    # At first each node is its own label: the first round needs no join.
    labels = cut(both.withColumnRenamed("weight", "v").groupBy("id").agg(best("o")), "labels") if rounds else both.select("id").distinct().withColumn("community", F.col("id"))
    for _ in range(rounds - 1):
        # The labels are the side that is kept in memory, so that links aren't sorted; votes move once, to their node.
        near = both.join(labels.select(F.col("id").alias("o"), "community").hint("shuffle_hash"), "o").select("id", "community", "weight").repartition("id")
        new = cut(near.groupBy("id", "community").agg(F.sum("weight").alias("v")).groupBy("id").agg(best("community")), "labels")
        same = new.join(labels.withColumnRenamed("community", "old").hint("merge"), "id").where("community <> old").limit(1).count() == 0
        labels = new
        if same:
            break
    return labels


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """community, size, inside, total, modularity: inside / 2m - (total / 2m) ** 2, both directions counted."""
    w = call_weights(edges)
    a, b = member.select(F.col("id").alias("a"), F.col("community").alias("ca")), member.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    both = w.join(a, "a").join(b, "b")
    inside = both.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum(F.col("weight") * 2).alias("inside"))
    total = both.select(F.explode(F.array("ca", "cb")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("total"))
    m2 = w.agg((F.sum("weight") * 2).alias("_m2"))
    out = member.groupBy("community").agg(F.count(F.lit(1)).alias("size")).join(inside, "community", "left").join(total, "community", "left").crossJoin(F.broadcast(m2))
    out = out.withColumn("inside", F.coalesce("inside", F.lit(0.0))).withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.select("community", "size", "inside", "total", (F.col("inside") / F.col("_m2") - F.pow(F.col("total") / F.col("_m2"), 2)).alias("modularity"))


# Architecture

PACKAGE_LABELS = tuple("Function Method Class Struct Enum Trait Interface Module".split())


def languages(nodes: DataFrame) -> DataFrame:
    """language, files, symbols, most files first."""
    files = nodes.where("label = 'File' AND language <> ''").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    symbols = nodes.where(F.col("label").isin("Function", "Method", "Class") & (F.col("language") != "")).groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))
    return files.join(symbols, "language", "left").select("language", "files", F.coalesce("symbols", F.lit(0)).alias("symbols")).orderBy(F.col("files").desc(), "language")


def packages(nodes: DataFrame) -> DataFrame:
    p = nodes.where(F.col("label").isin(*PACKAGE_LABELS)).select(X.package_prefix(F.col("qualifiedName")).alias("package")).where("package IS NOT NULL")
    return p.groupBy("package").agg(F.count(F.lit(1)).alias("symbols")).orderBy(F.col("symbols").desc(), "package")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions named like entries or source of ENTRY_POINT_OF."""
    marked = edges.where("type = 'ENTRY_POINT_OF'").select(F.col("source").alias("id")).distinct().withColumn("_m", F.lit(True))
    named = reduce(lambda a, b: a | b, [F.col("name") == p for p in ENTRY_PATTERNS])
    return nodes.where("label = 'Function'").join(marked, "id", "left").where(named | F.col("_m")).select("id", "name", "qualifiedName", "filePath").orderBy("qualifiedName", "id")


def one_handler(edges: DataFrame, last: bool = False) -> DataFrame:
    """id (route or endpoint), handler: the first by source id, or the last."""
    order = F.max("source") if last else F.min("source")
    return edges.where("type IN ('HANDLES', 'HANDLES_ROUTE')").groupBy(F.col("target").alias("id")).agg(order.alias("handler"))


def routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes with the last handler that was set."""
    h = one_handler(edges, last=True).join(nodes.select(F.col("id").alias("handler"), F.col("name").alias("handlerName")), "handler", "left")
    return nodes.where("label = 'Route'").join(h, "id", "left").select("id", "httpMethod", "path", F.coalesce("handlerName", F.lit("")).alias("handlerName")).orderBy("path", "httpMethod", "id")


def hotspots(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    callers = indegree(edges).withColumnRenamed("degree", "callers")
    return nodes.where(F.col("label").isin("Function", "Method")).join(callers, "id").select("id", "name", "qualifiedName", "callers").orderBy(F.col("callers").desc(), "qualifiedName", "id").limit(limit)


def modules_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin("Function", "Method", "Class")).select("id", X.parent_directory(F.col("filePath")).alias("module"))


def module_edges(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    m = modules_of(nodes)
    e = edges.where(F.col("type").isin(*types)).select("source", "target")
    return e.join(m.select(F.col("id").alias("source"), F.col("module").alias("ms")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("mt")), "target").groupBy("ms", "mt").agg(F.count(F.lit(1)).alias("n"))


def boundaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """module, internal, incoming, outgoing, cohesion: internal / all, 1.0 without edges."""
    pairs = module_edges(nodes, edges)
    rows = pairs.select(F.explode(F.array_distinct(F.array("ms", "mt"))).alias("module"), "ms", "mt", "n").groupBy("module").agg(
        F.sum(F.when(F.col("ms") == F.col("mt"), F.col("n")).otherwise(0)).alias("internal"),
        F.sum(F.when((F.col("mt") == F.col("module")) & (F.col("ms") != F.col("mt")), F.col("n")).otherwise(0)).alias("incoming"),
        F.sum(F.when((F.col("ms") == F.col("module")) & (F.col("ms") != F.col("mt")), F.col("n")).otherwise(0)).alias("outgoing"),
    )
    out = modules_of(nodes).select("module").distinct().join(rows, "module", "left").fillna(0, ["internal", "incoming", "outgoing"])
    all_ = F.col("internal") + F.col("incoming") + F.col("outgoing")
    return out.withColumn("cohesion", F.when(all_ == 0, 1.0).otherwise(F.col("internal") / all_)).orderBy("module")


def dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ms -> mt between different modules, with circular: whether mt reaches ms. The module graph is small: pairs grow to the closure's."""
    direct = cut(module_edges(nodes, edges).where("ms <> mt").select("ms", "mt", "n"), "modules")
    reach = direct.select("ms", "mt").distinct()
    while True:  # path doubling
        more = cut(reach.union(reach.select("ms", F.col("mt").alias("_m")).join(reach.select(F.col("ms").alias("_m"), "mt"), "_m").select("ms", "mt")).distinct(), "reach")
        if more.count() == reach.count():
            break
        reach = more
    back = reach.select(F.col("mt").alias("ms"), F.col("ms").alias("mt")).withColumn("_c", F.lit(True))
    return direct.join(back, ["ms", "mt"], "left").select(F.col("ms").alias("source"), F.col("mt").alias("target"), F.col("n").alias("edges"), F.coalesce("_c", F.lit(False)).alias("circular")).orderBy("source", "target")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """layer, members (sorted names), n; the first rule that fits decides."""
    of = lambda t: edges.where(F.col("type") == t)
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    controllers = flag(of("HANDLES_ROUTE").select(F.col("source").alias("id")), "c")
    services = flag(of("CALLS").join(controllers.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")), "s")
    repositories = flag(of("FETCHES").select(F.col("source").alias("id")), "r")
    holders, callers = flag(of("HAS_PROPERTY").select(F.col("source").alias("id")), "h"), flag(of("CALLS").select(F.col("source").alias("id")), "k")
    df = nodes
    for part in (controllers, services, repositories, holders, callers):
        df = df.join(part, "id", "left")
    layer = F.when(F.col("c"), "Controller").when(F.col("s"), "Service").when(F.col("r"), "Repository").when(F.col("label").isin("Class", "Struct", "Record", "Interface") & F.col("h") & F.col("k").isNull(), "Model")
    return df.withColumn("layer", layer).where("layer IS NOT NULL").groupBy("layer").agg(F.array_sort(F.collect_set("name")).alias("members"), F.count(F.lit(1)).alias("n")).orderBy("layer")


# Cross-service

CONFIDENCE = "CASE WHEN matchType = 'Exact' AND protocol IN ('HTTP', 'gRPC') THEN 'High' WHEN matchType IN ('Exact', 'Parameterized') THEN 'Medium' ELSE 'Low' END"


#: Rows of one side that a cell of `crossed` takes.
CELL = 1024


def matching_paths(literals: DataFrame, paths: DataFrame) -> DataFrame:
    """literal, path: each distinct literal with the distinct route paths that it matches. Literal paths join by equality, patterns by regex."""
    text = literals.select("literal").distinct()
    r = paths.select("path").distinct().withColumn("_open", X.route_kind(F.col("path")) != "Exact")
    exact = text.join(r.where("NOT _open"), F.col("literal") == F.col("path")).select("literal", "path")
    # Patterns and literals share their first segment, or the pattern begins with a wildcard: an equi-join before the regex.
    first = lambda c: F.regexp_extract(c, r"^/([^/:*]*)", 1)
    open_ = text.withColumn("_k", F.explode(F.array_distinct(F.array(first("literal"), F.lit(""))))).join(r.where("_open").withColumn("_k", first("path")), "_k").where(F.rlike("literal", X.route_regex(F.col("path"))))
    return exact.union(open_.select("literal", "path"))


def crossed(left: DataFrame, right: DataFrame, pairs: DataFrame, lkey: str, rkey: str, lid: str, rid: str) -> DataFrame:
    """Each row of left with each row of right whose keys (lkey, rkey) are in pairs, a table that was cut, with pairs' other columns.

    A few keys may hold most rows of both sides, and the result is their product. So a key's rows are dealt into blocks by their ids, and
    each two blocks meet in a cell: tasks are even, and all that is shuffled are copies of the two sides, a row for each CELL rows that it meets.
    """
    blocks = lambda df, key, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))
    sized = cut(pairs.join(blocks(left, lkey, "_a"), lkey).join(blocks(right, rkey, "_b"), rkey), "cells")
    cells = sized.agg(F.sum(F.col("_a").cast("long") * F.col("_b"))).first()[0] or 1
    dealt = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = [lkey, rkey, "_i", "_j"]
    l = left.join(sized, lkey).withColumn("_i", dealt(lid, "_a")).withColumn("_j", each("_b")).drop("_a", "_b")  # noqa: E741
    r = right.join(sized.select(lkey, rkey, "_a", "_b"), rkey).withColumn("_j", dealt(rid, "_b")).withColumn("_i", each("_a")).drop("_a", "_b")
    n = min(cells, 2000)  # a fixed number: the copies are few bytes, which would be merged into one task though their product is large
    return l.repartition(n, *keys).join(r.repartition(n, *keys).hint("merge"), keys).drop("_i", "_j")


def literals_of(nodes: DataFrame) -> DataFrame:
    """id, project, literal: the string literals of functions that may be paths."""
    text = nodes.where(F.col("label").isin("Function", "Method") & (F.coalesce("content", F.lit("")) != ""))
    return text.select("id", "project", F.explode(F.array_distinct(X.string_literals(F.col("content")))).alias("literal")).where(F.startswith("literal", F.lit("/")))


def route_paths(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'Route'").select(F.col("id").alias("route"), "path")


def http_matches(nodes: DataFrame) -> DataFrame:
    """id, literal, route, matchType: callers' string literals against route paths. Distinct literals are matched with distinct paths, once; callers and routes meet after that."""
    text, r = cut(literals_of(nodes).select("id", "literal"), "literals"), cut(route_paths(nodes), "routes")
    pairs = matching_paths(text, r).withColumn("matchType", X.route_kind(F.col("path")))
    return crossed(text, r, pairs, "literal", "path", "id", "route").select("id", "literal", "route", "matchType")


def detect_services(nodes: DataFrame) -> DataFrame:
    """protocol, source, target, direction, matchType, confidence of all five kinds."""
    f = nodes.where(F.col("label").isin("Function", "Method") & (F.coalesce("content", F.lit("")) != "")).select("id", "content")
    row = lambda df, protocol, target, direction="CALLS", match="Exact": df.select(F.lit(protocol).alias("protocol"), F.col("id").alias("source"), target.alias("target"), F.lit(direction).alias("direction"), (match if isinstance(match, Column) else F.lit(match)).alias("matchType"))
    parts = [row(http_matches(nodes), "HTTP", F.col("route"), match=F.col("matchType"))]
    for values in (X.grpc_urls(F.col("content")), X.grpc_calls(F.col("content"))):
        parts.append(row(f.select("id", F.explode(F.array_distinct(values)).alias("t")), "gRPC", F.col("t")))
    parts.append(row(f.select("id", F.explode(F.array_distinct(X.graphql(F.col("content")))).alias("t")), "GraphQL", F.col("t")))
    for protocol, calls in (("MessageQueue", X.QUEUE_CALLS), ("EventBus", X.BUS_CALLS)):
        for call, direction in calls.items():
            parts.append(row(f.select("id", F.explode(F.array_distinct(X.call_arguments(F.col("content"), call))).alias("t")), protocol, F.col("t"), direction, "Pattern"))
    return reduce(DataFrame.union, parts).withColumn("confidence", F.expr(CONFIDENCE))


def link_services(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New CROSS_SERVICE_CALLS edges, those that exist left out. The reason is the least literal that matches."""
    texts = literals_of(nodes).groupBy(F.col("id").alias("source")).agg(F.array_sort(F.collect_set("literal")).alias("_l"), F.min("project").alias("project"))
    old = edges.where("type = 'CROSS_SERVICE_CALLS'").select("source", "target").distinct()
    texts = cut(texts.join(old.select("source").distinct().withColumn("_old", F.lit(True)), "source", "left"), "literals")
    routes_ = cut(route_paths(nodes).groupBy(F.col("route").alias("target")).agg(F.array_sort(F.collect_set("path")).alias("_r")), "routes")
    # The literals of a caller and the paths of a route are one key each, so that a caller and a route meet once.
    l, r = texts.select("_l").distinct().withColumn("literal", F.explode("_l")), routes_.select("_r").distinct().withColumn("path", F.explode("_r"))  # noqa: E741
    pairs = matching_paths(l, r).join(l, "literal").join(r, "path").groupBy("_l", "_r").agg(F.min("literal").alias("reason"))
    new = crossed(texts, routes_, pairs, "_l", "_r", "source", "target")
    # Only callers that have such edges are compared with them: the others' rows needn't move again.
    new = new.where("_old IS NULL").select("source", "target", "project", "reason").union(new.where("_old").join(old, ["source", "target"], "left_anti").select("source", "target", "project", "reason"))
    return new.select("source", "target", F.lit("CROSS_SERVICE_CALLS").alias("type"), F.lit(0.9).alias("confidence"), F.lit("GLOBAL").alias("confidenceTier"), "reason", F.lit(0).cast("long").alias("startLine"), "project")


# Interfaces


def route_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every route with its first handler and that handler's first middleware, '' where there is none."""
    name = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(c + "Name"))
    middleware = edges.where("type = 'USES'").groupBy(F.col("target").alias("handler")).agg(F.min("source").alias("middleware"))
    df = nodes.where("label = 'Route'").select("id", "httpMethod", "path", "filePath").join(one_handler(edges), "id", "left").join(middleware, "handler", "left").join(name("handler"), "handler", "left").join(name("middleware"), "middleware", "left")
    return df.select("id", "httpMethod", "path", F.coalesce("handlerName", F.lit("")).alias("handler"), F.coalesce("middlewareName", F.lit("")).alias("middleware"), "filePath").orderBy("path", "httpMethod", "id")


def shape_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CALLS of endpoints whose reason isn't the endpoint's schema."""
    e = edges.where("type = 'CALLS'").select("source", F.col("target").alias("id"), F.col("reason").alias("actual"))
    return nodes.where("label = 'Endpoint' AND expectedSchema <> ''").select("id", F.col("name").alias("endpoint"), F.col("expectedSchema").alias("expected")).join(e, "id").where("actual <> expected").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").select("endpoint", "caller", "source", "expected", "actual").orderBy("endpoint", "source")


def api_impact(nodes: DataFrame, edges: DataFrame, endpoint: str | None = None) -> DataFrame:
    """Endpoint, handler, and the handler's callers."""
    e = nodes.where("label = 'Endpoint'")
    if endpoint:
        e = e.where((F.col("name") == endpoint) | (F.col("path") == endpoint))
    named = e.select("id", F.col("name").alias("endpoint"), "path").join(one_handler(edges), "id").join(nodes.select(F.col("id").alias("handler"), F.col("name").alias("handlerName")), "handler")
    calls = edges.where("type = 'CALLS'").select("source", F.col("target").alias("handler"))
    return named.join(calls, "handler", "left").join(nodes.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source", "left").select("endpoint", "path", F.col("handlerName").alias("handler"), F.coalesce("caller", F.lit("")).alias("caller")).distinct().orderBy("endpoint", "caller")


def tool_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    h = edges.where("type = 'HANDLES_TOOL'").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("handler"))
    df = nodes.where("label = 'Tool'").join(h, "id", "left").join(nodes.select(F.col("id").alias("handler"), F.col("name").alias("handlerName")), "handler", "left")
    return df.select("id", "name", "docstring", F.coalesce("handlerName", F.lit("")).alias("handler"), "filePath").orderBy("name", "id")


# Data quality


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Groups of one label and qualified name with several ids. The ids are sorted and joined by commas."""
    return nodes.where("qualifiedName <> ''").groupBy("label", "qualifiedName").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def orphan_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    s = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "type", F.lit("source").alias("missing"))
    t = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target", "type", F.lit("target").alias("missing"))
    return s.union(t)


def project_isolation(nodes: DataFrame, projects: list[str]) -> DataFrame:
    """One row: total, known (in the projects), stray."""
    known = F.count_if(F.col("project").isin(*projects))
    return nodes.agg(F.count(F.lit(1)).alias("total"), known.alias("known"), (F.count(F.lit(1)) - known).alias("stray"))


def empty_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.where("label = 'File' AND coalesce(hash, '') = ''").select("id", "filePath").orderBy("filePath")


def quality_report(nodes: DataFrame, edges: DataFrame, projects: list[str]) -> DataFrame:
    """check, violations of all four."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
    return one("DQ-002", duplicate_names(nodes)).union(one("DQ-004", orphan_edges(nodes, edges))).union(project_isolation(nodes, projects).select(F.lit("DQ-005").alias("check"), F.col("stray").alias("violations"))).union(one("DQ-006", empty_hashes(nodes)))


# Changes and renames


def parse_diff(lines: DataFrame) -> DataFrame:
    """filePath, start, length of every hunk's new side. lines: value, seq; a file's name fills down to its hunks."""
    name = F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.*)$", 1)
    fill = W.partitionBy(*([F.col("diff")] if "diff" in lines.columns else [F.lit(0)])).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    df = lines.withColumn("filePath", F.last(F.when(F.startswith("value", F.lit("+++ ")), name), ignorenulls=True).over(fill))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    length = F.regexp_extract("value", hunk, 2)
    return df.where(F.rlike("value", F.lit(hunk))).select("filePath", F.regexp_extract("value", hunk, 1).cast("long").alias("start"), F.when(length == "", 1).otherwise(length.try_cast("long")).cast("long").alias("length")).where("length > 0 AND filePath <> '/dev/null'")


def changed_symbols(nodes: DataFrame, edges: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a hunk (filePath, start, length), with incoming edges and risk."""
    n = nodes.where(F.col("label").isin("Function", "Method", "Class") & F.col("startLine").isNotNull())
    h = hunks.select("filePath", F.col("start").alias("_a"), (F.col("start") + F.col("length") - 1).alias("_b"))
    met = n.join(h, (n["filePath"] == h["filePath"]) & (n["startLine"] <= h["_b"]) & (F.coalesce(n["endLine"], n["startLine"]) >= h["_a"])).select(n["id"], n["name"], n["qualifiedName"], n["filePath"], n["startLine"], n["endLine"]).distinct()
    incoming = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    out = met.join(incoming, "id", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0)))
    return out.withColumn("risk", X.risk_of(F.col("incoming"))).orderBy("filePath", "startLine", "id")


def rename_plan(nodes: DataFrame, edges: DataFrame, files: DataFrame, id_: str, new: str) -> DataFrame:
    """filePath, position, old, new: text edits in the files of the symbol and its neighbours. files: filePath, text."""
    row = nodes.where(F.col("id") == id_).select("name").first()
    if row is None:
        raise LookupError(id_)
    if not re.fullmatch(r"(?a)(?!\d)\w+", new):
        raise ValueError(f"not an identifier: {new}")
    around = edges.where(F.col("source") == id_).select(F.col("target").alias("id")).union(edges.where(F.col("target") == id_).select("source")).union(nodes.where(F.col("id") == id_).select("id")).distinct()
    paths = nodes.join(around, "id", "left_semi").select("filePath").distinct()
    return files.join(paths, "filePath", "left_semi").select("filePath", F.explode(X.word_occurrences(F.col("text"), row.name)).alias("position")).select("filePath", "position", F.lit(row.name).alias("old"), F.lit(new).alias("new"))


def apply_rename(text: str, positions: list[int], old: str, new: str) -> str:
    """Right to left, so that positions stay true."""
    for p in sorted(positions, reverse=True):
        text = text[:p] + new + text[p + len(old) :]
    return text


def renamed_nodes(nodes: DataFrame, id_: str, old: str, new: str) -> DataFrame:
    mine = F.col("id") == id_
    return nodes.withColumn("qualifiedName", F.when(mine, X.renamed_qn(F.col("qualifiedName"), old, new)).otherwise(F.col("qualifiedName"))).withColumn("name", F.when(mine, F.lit(new)).otherwise(F.col("name")))
