"""The commands over one graph store. Each returns a DataFrame, or a small dict where the answer is one fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.cypher.compiler import cypher
from lattica.functions.text import is_stale
from lattica.operators import analytics, metrics, search, traverse
from lattica.plans.index import index
from lattica.sources.files import GraphStore, export_graph, import_graph


class NotFound(LookupError):
    """The symbol is unknown, or several have its name."""


class Service:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, GraphStore(spark, path)

    @property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self.store.nodes, self.store.edges

    def _id(self, symbol: str, project: str | None = None) -> str:
        state, id_ = traverse.resolve_symbol(self.store.nodes, symbol, project)
        if state != "found":
            raise NotFound(f"{symbol}: {state}")
        return id_

    def index(self, root: str, project: str, force: bool = False) -> dict:
        return index(self.spark, root, self.store, project, force)

    def query(self, text: str) -> DataFrame:
        return cypher(text, *self.graph)

    def search(self, query: str, mode: str = "exact", **options: object) -> DataFrame:
        return search.search(mode, *self.graph, query, **options)

    def trace(self, symbol: str, kind: str = "calls", depth: int = 5, project: str | None = None) -> DataFrame:
        kinds = {"calls": traverse.trace_calls, "data_flow": traverse.trace_flow, "all": traverse.trace_all, "cross_service": traverse.cross_service_paths}
        if kind not in kinds:
            raise ValueError(f"unknown trace: {kind}")
        return kinds[kind](self.store.edges, self._id(symbol, project), depth)

    def cycles(self, types: tuple[str, ...] = traverse.CALL_TYPES) -> DataFrame:
        return traverse.cycles(self.store.edges.where(F.col("type").isin(*types)))

    def impact(self, symbol: str, types: str | None = None, depth: int = traverse.IMPACT_DEPTH, tests: bool = False) -> tuple[DataFrame, DataFrame]:
        affected = traverse.impact(self.store.edges, self._id(symbol), types, depth, tests)
        return affected, traverse.assess_risk(affected)

    def context(self, symbol: str) -> DataFrame:
        return traverse.context(*self.graph, self.spark.createDataFrame([(self._id(symbol),)], "id string"))

    def detect_changes(self, diff: list[str]) -> DataFrame:
        lines = self.spark.createDataFrame(list(enumerate(diff)), "seq long, value string")
        return analytics.changed_symbols(*self.graph, analytics.parse_diff(lines))

    def rename(self, symbol: str, new: str, files: DataFrame) -> DataFrame:
        return analytics.rename_plan(*self.graph, files, self._id(symbol), new)

    def dead_code(self, **options: object) -> DataFrame:
        return analytics.dead_code(*self.graph, **options)

    def architecture(self) -> dict[str, DataFrame]:
        n, e = self.graph
        return {"languages": analytics.languages(n), "packages": analytics.packages(n), "entry_points": analytics.entry_points(n, e), "routes": analytics.routes(n, e), "hotspots": analytics.hotspots(n, e), "boundaries": analytics.boundaries(n, e), "dependencies": analytics.dependencies(n, e), "layers": analytics.layers(n, e), "services": analytics.detect_services(n)}

    def complexity(self, red_only: bool = False) -> DataFrame:
        return metrics.ranked(metrics.complexity(self.store.nodes), red_only)

    def communities(self, resolution: float = 1.0) -> DataFrame:
        return analytics.communities(self.store.edges, resolution)

    def cross_service(self) -> DataFrame:
        return analytics.detect_services(self.store.nodes)

    def link_services(self) -> int:
        new = analytics.link_services(*self.graph)
        n = new.count()
        self.store.load(self.spark.createDataFrame([], self.store.nodes.schema), new)
        return n

    def route_map(self) -> DataFrame:
        return analytics.route_map(*self.graph)

    def shape_check(self) -> DataFrame:
        return analytics.shape_check(*self.graph)

    def api_impact(self, endpoint: str | None = None) -> DataFrame:
        return analytics.api_impact(*self.graph, endpoint)

    def tool_map(self) -> DataFrame:
        return analytics.tool_map(*self.graph)

    def quality(self, projects: list[str]) -> DataFrame:
        return analytics.quality_report(*self.graph, projects)

    def status(self, indexed: str = "", current: str = "") -> DataFrame:
        return self.store.projects().withColumn("stale", is_stale(F.lit(indexed), F.lit(current)))

    def list(self) -> DataFrame:
        return self.store.projects()

    def clean(self, project: str) -> None:
        self.store.delete_project(project)

    def export(self, path: str) -> dict:
        return export_graph(*self.graph, path)

    def import_(self, path: str) -> dict:
        nodes, edges, manifest = import_graph(self.spark, path)
        self.store.load(nodes, edges)
        return manifest
