"""Traversal: simple paths, taint, cross-service traces, cycles, closures, impact, context.

Paths are arrays of ids, joined level by level (one shuffle a level); names are joined at the end only. Closures loop on
the driver over distributed frontiers, each level cut to a table, visited nodes removed by anti-join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as X
from lattica.plans.lineage import SMALL, beside, cut
from lattica.schema import parse_edge_types

CALL_TYPES = ("CALLS", "FFI_CALLS")
FLOW_TYPES = ("DATAFLOWS", "READS", "WRITES")
TAINT_TYPES = FLOW_TYPES + ("FFI_CALLS",)
MAX_NODES, MAX_DEPTH, IMPACT_DEPTH = 5000, 10, 5
EDGE_WEIGHTS = {"CALLS": 1.0, "IMPLEMENTS": 0.8, "USES_TYPE": 0.6, "HTTP_CALLS": 0.4}


def numbered(edges: DataFrame, types: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """The edges of the types, with an id that puts parallel edges in a fixed order."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return e.withColumn("eid", F.concat_ws("_", "source", "target", "type", F.coalesce("startLine", F.lit(0)).cast("string")))


def simple_paths(edges: DataFrame, start: str, depth: int, sink: str | None = None) -> DataFrame:
    """nodes, edges (ids), types, depth of every path of 1 to depth edges from start that repeats no node, prefixes too. With a sink: only paths that end there; they go no further."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    hop = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("eid").alias("_e"), F.col("type").alias("_k"))
    none = F.array().cast("array<string>")
    now = edges.sparkSession.range(1).select(F.array(F.lit(start)).alias("nodes"), none.alias("edges"), none.alias("types"))
    found = []
    for _ in range(depth):
        now = now.join(hop, F.element_at("nodes", -1) == F.col("_s")).where(~F.array_contains("nodes", F.col("_t")))
        now = now.select(F.array_append("nodes", F.col("_t")).alias("nodes"), F.array_append("edges", F.col("_e")).alias("edges"), F.array_append("types", F.col("_k")).alias("types"))
        if sink is not None:
            found.append(now.where(F.element_at("nodes", -1) == sink))
            now = now.where(F.element_at("nodes", -1) != sink)
        else:
            found.append(now)
    return reduce(DataFrame.union, found).withColumn("depth", F.size("edges"))


def trace_calls(edges: DataFrame, start: str, depth: int) -> DataFrame:
    return simple_paths(numbered(edges, CALL_TYPES), start, depth)


def trace_flow(edges: DataFrame, start: str, depth: int) -> DataFrame:
    return simple_paths(numbered(edges, FLOW_TYPES), start, depth)


def trace_all(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Both, without removing anything twice."""
    return trace_calls(edges, start, depth).union(trace_flow(edges, start, depth))


def taint(edges: DataFrame, source: str, depth: int, sink: str | None = None) -> DataFrame:
    return simple_paths(numbered(edges, TAINT_TYPES), source, depth, sink)


def cross_service_view(edges: DataFrame) -> DataFrame:
    """Calls forward, and HANDLES_ROUTE backwards: from a route to its handler."""
    forward = numbered(edges, CALL_TYPES + ("HTTP_CALLS",))
    back = numbered(edges, ("HANDLES_ROUTE",)).withColumns({"source": F.col("target"), "target": F.col("source")})
    return forward.unionByName(back)


def cross_service_paths(edges: DataFrame, start: str, depth: int) -> DataFrame:
    return simple_paths(cross_service_view(edges), start, depth)


def http_hops(edges: DataFrame, start: str) -> DataFrame:
    """The one-hop shortcut: the HTTP_CALLS edges of a node."""
    return simple_paths(numbered(edges, ("HTTP_CALLS",)), start, 1)


def filter_paths(paths: DataFrame, nodes: DataFrame, include: list[str] = (), exclude: list[str] = (), module: str | None = None, symbol: str | None = None) -> DataFrame:
    """Drops nodes from paths by file globs, module substring and name regex; edges stay between survivors that were neighbours; paths without nodes go."""
    ok = F.lit(True)
    if include:
        ok = ok & reduce(lambda a, b: a | b, [X.glob_search(F.col("filePath"), g) for g in include])
    for g in exclude:
        ok = ok & ~X.glob_search(F.col("filePath"), g)
    if module:
        ok = ok & F.contains("filePath", F.lit(module))
    if symbol:
        ok = ok & F.rlike("name", F.lit(symbol))
    keyed = paths.withColumn("_p", F.concat_ws("|", "nodes", "edges"))
    good = keyed.select("_p", F.posexplode("nodes").alias("_i", "id")).join(nodes.select("id", ok.alias("_ok")), "id", "left").where(F.coalesce("_ok", F.lit(False)))
    kept = good.groupBy("_p").agg(F.sort_array(F.collect_list("_i")).alias("_kept"))
    both = keyed.join(kept, "_p")
    edges_left = F.filter(F.transform("edges", lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: F.array_contains("_kept", x["i"]) & F.array_contains("_kept", x["i"] + 1))
    out = both.select(F.transform("_kept", lambda i: F.get("nodes", i)).alias("nodes"), F.transform(edges_left, lambda x: x["e"]).alias("edges"), F.transform(edges_left, lambda x: F.get("types", x["i"])).alias("types"))
    return out.withColumn("depth", F.size("edges"))


def resolve_symbol(nodes: DataFrame, symbol: str, project: str | None = None) -> tuple[str, str | None]:
    """('found', id), ('ambiguous', None) or ('missing', None): a unique name, else a unique qualified name."""
    n = nodes.where(F.col("project") == project) if project else nodes
    row = n.agg(
        F.count_if(F.col("name") == symbol).alias("a"), F.min(F.when(F.col("name") == symbol, F.col("id"))).alias("x"),
        F.count_if(F.col("qualifiedName") == symbol).alias("b"), F.min(F.when(F.col("qualifiedName") == symbol, F.col("id"))).alias("y"),
    ).first()
    if row.a == 1:
        return "found", row.x
    if row.b == 1:
        return "found", row.y
    return ("ambiguous" if row.a or row.b else "missing"), None


#: Edges from which `closure` takes care to read no edge too often, and rows of a frontier that is sent to them.
MANY, FRONTIER = 1_000_000, 200_000


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """id, depth of all nodes reached from seeds (id) along edges (source, target), seeds at depth 0. max_nodes stops growing once so many are found.

    Every level reads the edges; they move only to meet a large frontier. Where they are many, those to nodes that were reached are
    dropped once the levels since cost as much as that does, and if it didn't halve them, after twice as much the next time.
    """
    hop = cut(edges.select("source", "target"), "hops")
    left, spent, wait = hop.count(), 0, 6
    seen = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "seen")
    parts, depth = [seen], 0
    n = total = frontier.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        at = frontier.select(F.col("id").alias("source"))
        spent += 1 if n <= FRONTIER else 4
        near = cut(hop.join(F.broadcast(at) if n <= FRONTIER else at.hint("shuffle_hash"), "source").select(F.col("target").alias("id")).distinct(), "near")
        k = near.count()
        old = seen.select("id") if k > SMALL else seen.select("id").join(F.broadcast(near), "id", "left_semi")  # of these at most k
        frontier = cut(near.join(beside(old, k), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        n = frontier.count()
        if not n:
            break
        parts.append(frontier)
        total += n
        seen = reduce(DataFrame.union, parts)
        if depth % 8 == 0:
            seen = cut(seen, "seen")
            parts = [seen]
        if max_nodes and total >= max_nodes:
            break
        if left > MANY and spent >= wait:
            hop = cut(hop.join(seen.select(F.col("id").alias("target")).hint("shuffle_hash"), "target", "left_anti").select("source", "target"), "hops")
            before, left, spent = left, hop.count(), 0
            wait = 6 if left <= before / 2 else 2 * wait
    return reduce(DataFrame.union, parts)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def reverse_reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    return closure(reversed_edges(edges), start).where("depth > 0").select("id", "depth")


def subgraph(edges: DataFrame, start: DataFrame, depth: int, cap: int = MAX_NODES) -> tuple[DataFrame, DataFrame, bool]:
    """Undirected neighbourhood: nodes (id, depth), at most cap by depth and id, the edges between them, and whether it was cut."""
    near = cut(closure(edges.unionByName(reversed_edges(edges)), start, depth, cap), "near")
    cutoff = near.count() > cap
    kept = near.orderBy("depth", "id").limit(cap) if cutoff else near
    ends = kept.select("id")
    inner = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inner.select(*edges.columns), cutoff


def impact(edges: DataFrame, start: str, types: str | None = None, depth: int = IMPACT_DEPTH, tests: bool = False) -> DataFrame:
    """id, depth, type, path: who is affected by a change of start, one path each, the first by (path). Reverse breadth-first search; TESTS only if asked."""
    wanted = parse_edge_types(types) + (["TESTS"] if tests else [])
    back = cut(numbered(edges, wanted).select(F.col("target").alias("_at"), F.col("source").alias("id"), "type"), "back")
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"), F.lit("").alias("type"), F.array(F.lit(start)).alias("path"))
    seen = [frontier.select("id")]
    found = []
    for k in range(1, min(depth, MAX_DEPTH) + 1):
        step = frontier.select(F.col("id").alias("_at"), "path").join(back, "_at").join(reduce(DataFrame.union, seen).distinct(), "id", "left_anti")
        step = step.groupBy("id").agg(F.min(F.struct("path", "type")).alias("m")).select("id", F.lit(k).alias("depth"), "m.type", F.array_append("m.path", F.col("id")).alias("path"))
        frontier = cut(step, "impact")
        if not frontier.limit(1).count():
            break
        found.append(frontier)
        seen.append(frontier.select("id"))
    return reduce(DataFrame.union, found) if found else frontier.where(F.lit(False))


def edge_weight(type_: Column) -> Column:
    return reduce(lambda c, kv: c.when(type_ == kv[0], kv[1]), EDGE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(0.3)


def assess_risk(affected: DataFrame) -> DataFrame:
    """One row: affected, maxDepth, edgeFactor, score, level."""
    a = affected.agg(F.count(F.lit(1)).alias("affected"), F.coalesce(F.max("depth"), F.lit(0)).alias("maxDepth"), F.coalesce(F.max(edge_weight(F.col("type"))), F.lit(0.0)).alias("edgeFactor"))
    n, d = F.col("affected"), F.col("maxDepth")
    count = F.when(n > 50, 1.0).when(n > 20, 0.8).when(n > 5, 0.5).otherwise(0.08)
    deep = F.when(d > 5, F.least(F.lit(1.0), 0.5 + (d - 5) * 0.1)).when(d >= 3, 0.5).otherwise(d / 3.0 * 0.3)
    a = a.withColumn("score", F.least(F.lit(1.0), count * 0.6 + deep * 0.2 + F.col("edgeFactor") * 0.2))
    level = F.greatest(F.when(n > 50, 3).when(n > 20, 2).when(n > 5, 1).otherwise(0), F.when(F.col("score") >= 0.8, 3).when(F.col("score") >= 0.6, 2).when(F.col("score") >= 0.3, 1).otherwise(0))
    return a.withColumn("level", F.get(F.array(*[F.lit(x) for x in ("Low", "Medium", "High", "Critical")]), level))


def neighbours(nodes: DataFrame, edges: DataFrame, id_: str, incoming: bool) -> DataFrame:
    """type, id, name, label of one node's neighbours, by type and name."""
    here, there = ("target", "source") if incoming else ("source", "target")
    e = edges.where(F.col(here) == id_).select("type", F.col(there).alias("id"))
    return e.join(nodes.select("id", "name", "label"), "id").select("type", "id", "name", "label").orderBy("type", "name", "id")


def processes(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    return neighbours(nodes, edges.where("type IN ('STEP_IN_PROCESS', 'ENTRY_POINT_OF')"), id_, incoming=False)


def context(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """For each of ids (id): definition and sorted lists of callers, callees, types, imports, exports and tests."""
    def lists(here: str, there: str, types: tuple[str, ...], name: str) -> DataFrame:
        e = edges.where(F.col("type").isin(*types)).select(F.col(here).alias("id"), F.col(there).alias("_o")).join(ids, "id", "left_semi")
        return e.join(nodes.select(F.col("id").alias("_o"), "name"), "_o").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias(name))

    out = nodes.join(ids, "id", "left_semi").select("id", "name", "qualifiedName", "label", "filePath", "startLine", X.parameters(F.col("signature")).alias("parameters"), "returnType")
    for name, part in (
        ("callers", ("target", "source", CALL_TYPES)), ("callees", ("source", "target", CALL_TYPES)), ("types", ("source", "target", ("USES_TYPE",))),
        ("imports", ("source", "target", ("IMPORTS", "INCLUDES"))), ("exports", ("source", "target", ("REEXPORTS",))), ("tests", ("target", "source", ("TESTS",))),
    ):
        out = out.join(lists(*part, name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def include_closure(edges: DataFrame, file_id: DataFrame) -> DataFrame:
    return closure(edges.where("type IN ('INCLUDES', 'IMPORTS')"), file_id).where("depth > 0")


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that may lie on a cycle: nodes without incoming or outgoing edges are peeled off, level by level."""
    now = cut(edges.select("source", "target").distinct(), "core")
    n = now.count()
    while True:
        out, in_ = now.select(F.col("source").alias("target")).distinct(), now.select(F.col("target").alias("source")).distinct()
        new = cut(now.join(beside(out, n), "target", "left_semi").join(beside(in_, n), "source", "left_semi").select("source", "target"), "core")
        before, n = n, new.count()
        if n == before:
            return new
        now = new


def weak_components(edges: DataFrame) -> DataFrame:
    """id, component (its least id), by min-label propagation with pointer jumping."""
    both = cut(edges.select("source", "target").union(edges.select("target", "source")).distinct(), "both")
    labels = cut(both.groupBy(F.col("source").alias("id")).agg(F.least(F.min("target"), F.first("source")).alias("component")), "labels")
    n = labels.count()
    while True:
        around = both.join(beside(labels.select(F.col("id").alias("target"), "component"), n), "target").groupBy(F.col("source").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(beside(around, n), "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(beside(far, n), "component", "left").select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        if not new.where("component <> old").limit(1).count():
            return new.select("id", "component")
        labels = new.select("id", "component")


def dfs_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """One cycle for each back edge of a depth-first search with sorted roots and targets; the closing node is repeated."""
    after: dict[str, list[str]] = {}
    for s, t in sorted(set(edges)):
        after.setdefault(s, []).append(t)
    colour: dict[str, int] = {}
    found = []
    for root in sorted(after):
        if colour.get(root):
            continue
        path, stack = [root], [iter(after[root])]
        colour[root] = 1
        while stack:
            t = next(stack[-1], None)
            if t is None:
                colour[path.pop()] = 2
                stack.pop()
            elif colour.get(t) == 1:
                found.append(path[path.index(t) :] + [t])
            elif not colour.get(t):
                colour[t] = 1
                path.append(t)
                stack.append(iter(after.get(t, ())))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """cycle (array of ids): the search runs within each weak component of the peeled graph. It is sequential, so a component must fit in a task; scc_members scales."""
    core = trimmed(edges)
    grouped = core.join(weak_components(core).withColumnRenamed("id", "source"), "source")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cycle": dfs_cycles(list(zip(frame["source"], frame["target"])))})

    return grouped.groupBy("component").applyInPandas(run, "cycle array<string>")


def scc_members(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, scc (its least id) of the nodes on cycles: forward-backward colouring over distributed tables, a component a colour each round."""
    core, done = trimmed(edges), []
    loops = edges.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("scc"))
    for _ in range(max_rounds):
        if not core.limit(1).count():
            break
        ids = core.select(F.col("source").alias("id")).union(core.select(F.col("target").alias("id"))).distinct()
        colour = cut(ids.withColumn("c", F.col("id")), "colour")
        n = colour.count()
        while True:  # the least id that reaches each node
            near = core.join(beside(colour.select(F.col("id").alias("source"), "c"), n), "source").groupBy(F.col("target").alias("id")).agg(F.min("c").alias("n"))
            new = cut(colour.join(beside(near, n), "id", "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c")), "colour")
            if not new.where("c <> old").limit(1).count():
                break
            colour = new.select("id", "c")
        # Backwards from each colour's own node, within its colour.
        own = core.join(beside(colour.select(F.col("id").alias("source"), F.col("c").alias("cs")), n), "source").join(beside(colour.select(F.col("id").alias("target"), F.col("c").alias("ct")), n), "target").where("cs = ct")
        got = cut(closure(reversed_edges(own), colour.where("id = c").select("id")).select("id").join(beside(colour, n), "id").select("id", F.col("c").alias("scc")), "scc")
        done.append(got)
        core = trimmed(core.join(beside(got.select(F.col("id").alias("source")), n), "source", "left_anti").join(beside(got.select(F.col("id").alias("target")), n), "target", "left_anti"))
    all_ = reduce(DataFrame.union, [*done, loops]) if done else loops
    sizes = all_.groupBy("scc").agg(F.count_distinct("id").alias("n"))
    return all_.join(sizes, "scc").where("n > 1").select("id", "scc").union(loops).distinct()


def c3_merge(cls: str, lists: list[list[str]]) -> list[str]:
    """cls and the merge of its parents' lists and the list of its parents; on conflict what could be merged."""
    out = [cls]
    while lists := [x for x in lists if x]:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            break
        out.append(head)
        lists = [x[1:] if x[0] == head else x for x in lists]
    return out


def c3(cls: str, parents: dict[str, list[str]], path: tuple[str, ...] = ()) -> list[str]:
    """C3 linearisation; on conflict what could be merged, a cycle ends the list."""
    if cls in path:
        return []
    return c3_merge(cls, [c3(p, parents, (*path, cls)) for p in parents.get(cls, [])] + [list(parents.get(cls, []))])


def first_merge(cls: str, lists: list[list[str]]) -> list[str]:
    return list(dict.fromkeys([cls, *(x for part in lists for x in part)]))


def first_wins(cls: str, parents: dict[str, list[str]]) -> list[str]:
    out: list[str] = []
    stack = [cls]
    while stack:
        x = stack.pop()
        if x not in out:
            out.append(x)
            stack += reversed(parents.get(x, []))
    return out


MRO: dict[str, Callable] = {"python": c3, "ruby": c3, "rust": lambda c, p: [c]}
MERGES: dict[str, Callable] = {"python": c3_merge, "ruby": c3_merge, "rust": lambda c, lists: [c]}


def method_resolution(edges: DataFrame, roots: DataFrame, strategy: str = "python", max_depth: int = 64) -> DataFrame:
    """root, mro: for each of roots (id), over the EXTENDS edges above it; parents in order of line, then id.

    A class's list is merged from its parents' lists, so each class is met once, after its parents. Classes at or below a cycle, where a list
    depends on where it began, and those deeper than max_depth collect the edges above them, each for itself.
    """
    up = cut(edges.where("type = 'EXTENDS'").select("source", "target", F.coalesce("startLine", F.lit(0)).alias("line")).distinct(), "up")
    roots = cut(roots.select(F.col("id").alias("root")).distinct(), "roots")
    need = up.groupBy("source").agg(F.count(F.lit(1)).alias("need"))
    up_ = cut(up.join(need.hint("merge"), "source"), "up")
    merge = MERGES.get(strategy, first_merge)

    @F.pandas_udf("array<string>")
    def merged(source: pd.Series, above: pd.Series) -> pd.Series:
        return pd.Series([merge(s, [list(x["mro"]) for x in rows] + [[x["target"] for x in rows]]) for s, rows in zip(source, above)])

    tops = roots.select(F.col("root").alias("id")).union(up.select("target")).distinct().join(up.select(F.col("source").alias("id")).hint("merge"), "id", "left_anti")
    done = [cut(tops.select("id", F.array("id").alias("mro")), "mro")]
    waiting, n = None, done[0].count()
    for _ in range(max_depth):
        if not n:
            break
        met = up_.join(beside(done[-1].select(F.col("id").alias("target"), "mro"), n), "target").select("source", "need", F.struct("line", "target", "mro").alias("p"))
        one = met.where("need = 1").select(F.col("source").alias("id"), F.concat(F.array("source"), F.col("p.mro")).alias("mro")) if strategy != "rust" else met.where("need = 1").select(F.col("source").alias("id"), F.array("source").alias("mro"))
        some = met.where("need > 1")
        some = cut((some if waiting is None else some.union(waiting)).groupBy("source", "need").agg(F.collect_list("p").alias("p")), "some")
        ready = some.where("size(p) = need").select(F.col("source").alias("id"), merged("source", F.array_sort("p")).alias("mro"))
        waiting = some.where("size(p) < need").select("source", "need", F.explode("p").alias("p"))
        done.append(cut(one.union(ready), "mro"))
        n = done[-1].count()
    lists = reduce(DataFrame.union, done).withColumnRenamed("id", "root")
    rest = cut(roots.join(lists.select("root").hint("merge"), "root", "left_anti"), "rest")
    whole = roots.join(lists.hint("merge"), "root")
    return whole.union(above_each(up, rest, strategy, max_depth)) if rest.limit(1).count() else whole


def above_each(up: DataFrame, roots: DataFrame, strategy: str, max_depth: int) -> DataFrame:
    """root, mro: the edges above each root (root) are collected and ordered in one place."""
    now = roots.select("root", F.col("root").alias("source"))
    found = []
    seen = cut(now, "mro")
    for _ in range(max_depth):
        step = cut(now.join(up.hint("merge"), "source").select("root", "source", "target", "line"), "mro")
        if not step.limit(1).count():
            break
        found.append(step)
        now = cut(step.select("root", F.col("target").alias("source")).distinct().join(seen.hint("merge"), ["root", "source"], "left_anti"), "mro")
        seen = seen.union(now)
    run_mro = MRO.get(strategy, first_wins)
    links = reduce(DataFrame.union, found).distinct() if found else seen.select("root", "source", F.lit(None).cast("string").alias("target"), F.lit(0).cast("long").alias("line")).where("false")
    grouped = roots.join(links.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("source", "line", "target"))).alias("l")), "root", "left")

    @F.pandas_udf("array<string>")
    def order(root: pd.Series, links_: pd.Series) -> pd.Series:
        out = []
        for r, rows in zip(root, links_):
            parents: dict[str, list[str]] = {}
            for x in rows if rows is not None else ():
                parents.setdefault(x["source"], []).append(x["target"])
            out.append(run_mro(r, parents))
        return pd.Series(out)

    return grouped.select("root", order("root", "l").alias("mro"))
