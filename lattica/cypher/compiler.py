"""Syntax tree to DataFrame plan. Catalyst does the optimising: joins, pushdown and pruning are left to it.

A variable bound to a node or an edge is a set of columns var__property, so that only the properties that a query names
are read. MATCH is a chain of inner joins; a pattern that shares no variable is joined by its WHERE.

Patterns match by homomorphism; a variable-length relationship doesn't use an edge twice. A label list means any of
them, no label all. `*` without an upper bound ends at MAX_HOPS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.cypher.parser import Clause, Expr, NodePattern, Pattern, Projection, QueryError, RelPattern, parse

MAX_HOPS = 10
EDGE_LABEL = "CodeRelation"

AGGREGATES = frozenset("count sum avg min max collect".split())
SCALARS = {
    "tolower": F.lower, "lower": F.lower, "toupper": F.upper, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "sign": F.signum, "exp": F.exp, "log": F.log, "coalesce": F.coalesce,
    "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
    "replace": F.replace, "split": lambda x, d: F.split(x, F.concat(F.lit("\\Q"), d, F.lit("\\E")), -1), "left": F.left, "right": F.right,
    "substring": lambda x, a, n=None: F.substr(x, a + 1, n) if n is not None else F.substr(x, a + 1), "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "range": lambda a, b, k=None: F.sequence(a, b, k) if k is not None else F.sequence(a, b), "round": F.round,
}


class Compiler:
    def __init__(self, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> None:
        self.nodes = nodes
        self.edges = edges.withColumn("id", F.concat_ws("_", "source", "target", "type", F.coalesce("startLine", F.lit(0)).cast("string")))
        self.max_hops = max_hops

    def run(self, text: str) -> DataFrame:
        out: DataFrame | None = None
        for clauses, all_ in parse(text):
            part = Part(self).run(clauses)
            if out is not None:
                if part.columns != out.columns:
                    raise QueryError("the parts of a UNION return the same columns")
                out = out.union(part)
                part = out if all_ else out.distinct()
            out = part
        return out


class Part:
    """The clauses between two UNIONs."""

    def __init__(self, owner: Compiler) -> None:
        self.owner, self.df, self.scope, self.fresh = owner, None, {}, 0

    def run(self, clauses: list[Clause]) -> DataFrame:
        for c in clauses:
            getattr(self, "do_" + c.kind)(c)
        return self.df

    def name(self, what: str) -> str:
        self.fresh += 1
        return f"_{what}{self.fresh}"

    # Patterns

    def entity(self, df: DataFrame, var: str) -> DataFrame:
        return df.select([F.col(c).alias(f"{var}__{c}") for c in df.columns])

    def rows_of(self, n: NodePattern) -> tuple[DataFrame, str]:
        if EDGE_LABEL in n.labels:
            if len(n.labels) > 1:
                raise QueryError(f"{EDGE_LABEL} has no other labels")
            return self.owner.edges, "edge"
        df = self.owner.nodes
        return (df.where(F.col("label").isin(n.labels)) if n.labels else df), "node"

    def bind_node(self, n: NodePattern, key: str | None) -> str:
        """Joins the node pattern by the id column `key` (None: no key); its variable."""
        var = n.var or self.name("n")
        if var in self.scope:
            if self.scope[var] == "scalar":
                raise QueryError(f"{var} isn't a node")
            if key:
                self.df = self.df.where(F.col(key) == F.col(f"{var}__id"))
            if n.labels and EDGE_LABEL not in n.labels:
                self.df = self.df.where(F.col(f"{var}__label").isin(n.labels))
        else:
            rows, kind = self.rows_of(n)
            own = self.entity(rows, var)
            self.df = own if self.df is None else self.df.join(own, F.col(key) == F.col(f"{var}__id")) if key else self.df.crossJoin(own)
            self.scope[var] = kind
        for prop, e in n.props:
            self.df = self.df.where(self.prop(var, [prop]) == self.expr(e))
        return var

    def oriented(self, r: RelPattern) -> DataFrame:
        """Edges of the wanted types with _from and _to in the direction of reading."""
        e = self.owner.edges
        if r.types:
            e = e.where(F.col("type").isin(r.types))
        out, back = e.withColumns({"_from": F.col("source"), "_to": F.col("target")}), e.withColumns({"_from": F.col("target"), "_to": F.col("source")})
        return out if r.direction == "out" else back if r.direction == "in" else out.union(back.where("source <> target"))

    def bind_rel(self, start: str, r: RelPattern) -> str:
        """Joins the edges; the column that holds the next node's id."""
        edges, to = self.oriented(r), self.name("to")
        if r.low is None:
            var = r.var or self.name("r")
            if var in self.scope:
                raise QueryError(f"{var} is bound already")
            own = edges.select(F.col("_from").alias("_f"), F.col("_to").alias(to), *[F.col(c).alias(f"{var}__{c}") for c in self.owner.edges.columns])
            self.df = self.df.join(own, F.col(f"{start}__id") == F.col("_f")).drop("_f")
            self.scope[var] = "edge"
            return to
        hop = edges.select(F.col("_from").alias("_f"), F.col("_to").alias("_t"), F.col("id").alias("_e"))
        path = f"{r.var or self.name('r')}__path"
        now = self.df.withColumns({to: F.col(f"{start}__id"), path: F.array().cast("array<string>")})
        found = [now] if r.low == 0 else []
        for k in range(1, (r.high if r.high is not None else max(self.owner.max_hops, r.low)) + 1):
            now = now.join(hop, F.col(to) == F.col("_f")).where(~F.array_contains(path, F.col("_e"))).withColumns({to: F.col("_t"), path: F.array_append(path, F.col("_e"))}).drop("_f", "_t", "_e")
            if k >= r.low:
                found.append(now)
        self.df = reduce(DataFrame.union, found)
        if r.var:
            self.scope[r.var] = "path"
        return to

    def bind(self, p: Pattern) -> None:
        var = self.bind_node(p.nodes[0], None)
        for r, n in zip(p.rels, p.nodes[1:]):
            to = self.bind_rel(var, r)
            var = self.bind_node(n, to)
            self.df = self.df.drop(to)

    def apart(self, p: Pattern, prefix: str) -> tuple[DataFrame, dict[str, str], Column]:
        """The pattern matched on its own; its new variables, and the condition that joins its bound ones."""
        part = Part(self.owner)
        part.fresh = self.fresh + 1000
        bound = {n.var for n in p.nodes if n.var in self.scope} | {r.var for r in p.rels if r.var in self.scope}
        names = {v: prefix + v for v in bound}
        nodes = [NodePattern(names.get(n.var, n.var), n.labels, [(k, e) for k, e in n.props]) for n in p.nodes]
        rels = [RelPattern(names.get(r.var, r.var), r.types, r.low, r.high, r.direction) for r in p.rels]
        part.bind(Pattern(nodes, rels))
        on = reduce(lambda a, b: a & b, [F.col(f"{v}__id") == F.col(f"{names[v]}__id") for v in sorted(bound)], F.lit(True))
        return part.df, {v: k for v, k in part.scope.items() if v not in names.values()}, on

    # Clauses

    def do_match(self, c: Clause) -> None:
        self.bind(c.body)
        if c.where is not None:
            self.filter(c.where)

    def do_optional(self, c: Clause) -> None:
        if self.df is None:
            raise QueryError("OPTIONAL MATCH needs something before it")
        right, new, on = self.apart(c.body, self.name("b") + "_")
        hidden = [x for x in right.columns if not any(x.startswith(v + "__") for v in new if not v.startswith("_"))]
        self.scope |= new
        if c.where is not None:
            on = on & self.expr(c.where)
        self.df = self.df.join(right, on, "left").drop(*hidden)
        for v in [v for v in new if v.startswith("_")]:
            self.scope.pop(v)

    def filter(self, e: Expr) -> None:
        """Conjuncts one by one; an EXISTS among them becomes a semi or anti join."""
        if e[0] == "and":
            self.filter(e[1])
            self.filter(e[2])
            return
        no = e[0] == "not"
        inner = e[1] if no else e
        if inner[0] == "exists":
            right, _, on = self.apart(inner[1], self.name("b") + "_")
            self.df = self.df.join(right, on, "left_anti" if no else "left_semi")
        else:
            condition = self.expr(e)  # may join a flag first
            self.df = self.df.where(condition)

    def do_unwind(self, c: Clause) -> None:
        e, var = c.body
        if var in self.scope:
            raise QueryError(f"{var} is bound already")
        if self.df is None:
            self.df = self.owner.nodes.sparkSession.range(1).select()
        self.df = self.df.withColumn(var, F.explode(self.expr(e)))
        self.scope[var] = "scalar"

    def do_with(self, c: Clause) -> None:
        self.project(c.body, final=False)
        if c.where is not None:
            self.filter(c.where)

    def do_return(self, c: Clause) -> None:
        self.project(c.body, final=True)

    def project(self, p: Projection, final: bool) -> None:
        if self.df is None:
            self.df = self.owner.nodes.sparkSession.range(1).select()
        items = p.items or [(("var", v), v, v) for v in sorted(self.scope) if not v.startswith("_")]
        plain: dict[str, Column] = {}
        totals: dict[str, Column] = {}
        scope: dict[str, str] = {}
        alias: dict[str, Expr] = {}
        shown: list[tuple[str, str]] = []
        for e, name, text in items:
            if not final and name is None and e[0] != "var":
                raise QueryError(f"WITH {text} needs AS")
            out = name or text
            if out in alias:
                raise QueryError(f"{out} is returned twice")
            alias[out] = e
            if e[0] == "var" and self.kind(e[1]) != "scalar" and not (final and self.kind(e[1]) == "path"):
                kind = self.kind(e[1])
                scope[out] = kind
                for c in [c for c in self.df.columns if c.startswith(e[1] + "__")]:
                    plain[f"{out}__{c[len(e[1]) + 2:]}"] = F.col(f"`{c}`")
                shown.append((out, kind))
            else:
                (totals if self.has_total(e) else plain)[out] = self.expr(e)
                scope[out] = "scalar"
                shown.append((out, "scalar"))
        order = []
        if totals:
            df = self.df.groupBy(*[c.alias(k) for k, c in plain.items()]).agg(*[c.alias(k) for k, c in totals.items()])
            self.df, before, self.scope = df, self.scope, scope
        else:
            before = None
        hidden: dict[str, Column] = {}
        for e, up in p.order:
            match = next((k for k, x in alias.items() if x == e or e == ("var", k)), None)
            if match is not None and scope[match] == "scalar":
                key = match
            elif totals or p.distinct:
                raise QueryError("after aggregation or DISTINCT, ORDER BY takes returned columns")
            else:
                key = self.name("o")
                hidden[key] = self.expr(self.replace(e, alias))
            order.append(F.col(f"`{key}`").asc_nulls_last() if up else F.col(f"`{key}`").desc_nulls_first())
        if not totals:
            df = self.df.select(*[c.alias(k) for k, c in {**plain, **hidden}.items()])
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*order)
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
        df = df.drop(*hidden)
        if final:
            out = []
            for v, kind in shown:
                if kind == "scalar":
                    out.append(F.col(f"`{v}`"))
                else:
                    own = [c for c in df.columns if c.startswith(v + "__")]
                    out.append(F.struct(*[F.col(f"`{c}`").alias(c[len(v) + 2 :]) for c in own]).alias(v))
            df = df.select(*out)
        self.df, self.scope = df, scope

    def replace(self, e, alias: dict[str, Expr]):
        """Aliases of plain items within a larger ORDER BY expression stand for their expressions."""
        if isinstance(e, tuple):
            if e and e[0] == "var" and e[1] in alias and e[1] not in self.scope:
                return alias[e[1]]
            return tuple(self.replace(x, alias) for x in e)
        return [self.replace(x, alias) for x in e] if isinstance(e, list) else e

    # Expressions

    def kind(self, var: str) -> str:
        if var not in self.scope:
            raise QueryError(f"unknown variable: {var}")
        return self.scope[var]

    def has_total(self, e) -> bool:
        if isinstance(e, tuple):
            return (len(e) > 1 and e[0] == "call" and e[1] in AGGREGATES) or any(self.has_total(x) for x in e)
        return isinstance(e, list) and any(self.has_total(x) for x in e)

    def prop(self, var: str, path: list[str]) -> Column:
        kind = self.kind(var)
        if kind == "scalar":
            return reduce(lambda c, k: c[k], path, F.col(f"`{var}`"))
        known = self.owner.edges.columns if kind == "edge" else self.owner.nodes.columns
        if path[0] not in known:
            raise QueryError(f"{var} has no property {path[0]}")
        return reduce(lambda c, k: c[k], path[1:], F.col(f"`{var}__{path[0]}`"))

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def expr(self, e: Expr) -> Column:
        return getattr(self, "x_" + e[0])(*e[1:])

    def x_lit(self, v: object) -> Column:
        return F.lit(v)

    def x_list(self, items: list[Expr]) -> Column:
        return F.array(*[self.expr(x) for x in items])

    def x_var(self, v: str) -> Column:
        kind = self.kind(v)
        return F.col(f"`{v}`") if kind == "scalar" else F.col(f"`{v}__path`") if kind == "path" else F.col(f"`{v}__id`")

    def x_prop(self, v: str, path: list[str]) -> Column:
        return self.prop(v, path)

    def x_or(self, a: Expr, b: Expr) -> Column:
        return self.expr(a) | self.expr(b)

    def x_and(self, a: Expr, b: Expr) -> Column:
        return self.expr(a) & self.expr(b)

    def x_not(self, a: Expr) -> Column:
        return ~self.expr(a)

    def x_neg(self, a: Expr) -> Column:
        return -self.expr(a)

    def x_cmp(self, op: str, a: Expr, b: Expr) -> Column:
        x, y = self.expr(a), self.expr(b)
        if op == "=~":
            return F.rlike(x, F.concat(F.lit("^(?:"), y, F.lit(")$")))
        return {"=": x.__eq__, "<>": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)

    def x_starts(self, a: Expr, b: Expr) -> Column:
        return F.startswith(self.expr(a), self.expr(b))

    def x_ends(self, a: Expr, b: Expr) -> Column:
        return F.endswith(self.expr(a), self.expr(b))

    def x_contains(self, a: Expr, b: Expr) -> Column:
        return F.contains(self.expr(a), self.expr(b))

    def x_in(self, a: Expr, b: Expr) -> Column:
        x = self.expr(a)
        if b[0] == "list":
            return reduce(lambda p, q: p | q, [x == self.expr(y) for y in b[1]], F.lit(False))
        return F.array_contains(self.expr(b), x)

    def x_isnull(self, a: Expr, yes: bool) -> Column:
        x = self.expr(a)
        return x.isNull() if yes else x.isNotNull()

    def x_bin(self, op: str, a: Expr, b: Expr) -> Column:
        x, y = self.expr(a), self.expr(b)
        if op == "+":
            kinds = (self.type_of(x), self.type_of(y)) if not (self.has_total(a) or self.has_total(b)) else ()
            if any(isinstance(k, T.StringType) for k in kinds) or any(isinstance(k, T.ArrayType) for k in kinds):
                return F.concat(x, y)
            return x + y
        if op == "/" and not (self.has_total(a) or self.has_total(b)) and all(isinstance(self.type_of(c), T.IntegralType) for c in (x, y)):
            return ((x - x % y) / y).cast("bigint")
        return {"-": x.__sub__, "*": x.__mul__, "/": x.__truediv__, "%": x.__mod__}[op](y)

    def x_exists(self, p: Pattern) -> Column:
        """Within a larger expression: a flag joined from the pattern's distinct keys."""
        right, _, on = self.apart(p, prefix := self.name("b") + "_")
        flag = self.name("e")
        keys = [c for c in right.columns if c.startswith(prefix) and c.endswith("__id")]
        self.df = self.df.join(right.select(*keys).distinct().withColumn(flag, F.lit(True)), on, "left").drop(*keys)
        return F.coalesce(F.col(flag), F.lit(False))

    def x_star(self) -> Column:
        return F.lit(1)

    def x_call(self, name: str, distinct: bool, args: list[Expr]) -> Column:
        if name in AGGREGATES:
            if len(args) != 1 or (args[0] == ("star",) and name != "count"):
                raise QueryError(f"{name} takes one argument")
            x = self.expr(args[0])
            if name == "collect":
                return F.collect_set(x) if distinct else F.collect_list(x)
            if distinct:
                return {"count": F.count_distinct, "sum": F.sum_distinct, "avg": lambda c: F.sum_distinct(c) / F.count_distinct(c), "min": F.min, "max": F.max}[name](x)
            return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](x)
        if name in ("id", "label", "labels", "type") and len(args) == 1 and args[0][0] == "var":
            want = "type" if name == "type" else "id" if name == "id" else "label"
            c = self.prop(args[0][1], [want])
            return F.array(c) if name == "labels" else c
        if name in ("size", "length") and len(args) == 1:
            x = self.expr(args[0])
            return F.size(x) if isinstance(self.type_of(x), T.ArrayType) else F.length(x)
        if name not in SCALARS or distinct:
            raise QueryError(f"unknown function: {name}")
        return SCALARS[name](*[self.expr(a) for a in args])


def cypher(text: str, nodes: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """The query's result; nothing runs before an action."""
    return Compiler(nodes, edges, max_hops).run(text)
