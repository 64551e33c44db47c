"""The write path: files -> extraction -> resolution -> graph store, whole or only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import resolve as R
from lattica.plans.lineage import cut, forget
from lattica.schema import EDGE, NODE
from lattica.sources.extract import extract, tables
from lattica.sources.files import GraphStore, conform, diff_files, discover, unique_edges, without_files


def resolved(nodes: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """All edges of a project: extracted ones, calls, flows, reads and writes, imports, includes, types; dangling type edges pruned."""
    files = nodes.where("label = 'File'")
    specs = facts.where("kind = 'import'").select("filePath", "spec", "language", "name").distinct()
    targets = cut(R.resolve_imports(specs.select("filePath", "spec", "language").distinct(), files), "imports")
    names = specs.join(targets, ["filePath", "spec"]).select("filePath", "name", "targetFile").distinct()
    symbols = R.symbol_table(nodes)
    fact = lambda kind: facts.where(F.col("kind") == kind).select("source", "name", "filePath", "startLine", "project")
    calls = R.resolve_calls(fact("call"), symbols, names)
    flows, parameters = R.resolve_flows(fact("assign").select(F.lit("AssignFrom").alias("kind"), "*", F.lit(None).cast("int").alias("paramIndex")), symbols, names)
    variables = R.symbol_table(nodes, ("Variable", "GlobalVar", "Const", "Static"))
    access = R.resolve_accesses(fact("read").withColumn("write", F.lit(False)).union(fact("write").withColumn("write", F.lit(True))), variables, names)
    typed = R.prune_types(R.retarget_types(conform(edges, EDGE), nodes, names), nodes)
    cpp = F.col("filePath").rlike(r"\.(c|h|cc|cpp|cxx|hpp|hh)$")
    parts = [calls, flows, access, R.import_edges(targets.where(~cpp), files), R.import_edges(targets.where(cpp), files, "INCLUDES")]
    out = typed.select(*EDGE.fieldNames())
    for p in parts:
        out = out.unionByName(conform(p, EDGE))
    return unique_edges(out)


#: What resolution makes anew each time, beside the types that files themselves tell.
RESOLVED = ("CALLS", "DATAFLOWS", "READS", "WRITES", "IMPORTS", "INCLUDES")


def index_files(store: GraphStore, files: DataFrame, project: str, gone: DataFrame | None = None) -> dict:
    """Replaces the files' rows (filePath, content, language, hash) in the store, and takes out those in gone (filePath).

    Only these files are parsed. Facts and links of all others are kept in the store, and resolution runs over the whole
    project: what unchanged files call in changed ones is found again, or no longer, as by a fresh index. Edges of other
    making stay while both their ends do. Only the project's partitions are written.
    """
    got = cut(extract(files, project), "extracted")
    nodes, links, facts = tables(got)
    nodes = nodes.join(files.select("filePath", "hash"), "filePath", "left").withColumn("hash", F.when(F.col("label") == "File", F.coalesce("hash", F.lit(""))).otherwise(F.lit("")))
    touched = files.select("filePath")
    touched = cut((touched.union(gone.select("filePath")) if gone is not None else touched).distinct(), "touched")
    mine = F.col("project") == project
    old_nodes, old_edges = without_files(store.nodes.where(mine), store.edges.where(mine), touched)
    all_nodes = cut(conform(nodes, NODE).unionByName(old_nodes).dropDuplicates(["id"]), "nodes")
    there = cut(store.nodes.where(mine).join(touched, "filePath", "left_semi").select(F.col("id").alias("source")), "gone")
    all_facts = cut(facts.unionByName(store.read("facts").where(mine).join(touched, "filePath", "left_anti").select(*facts.columns)), "facts")
    all_links = cut(links.unionByName(store.read("links").where(mine).join(there, "source", "left_anti").select(*links.columns)), "links")
    made = all_links.select("type").distinct()
    others = old_edges.where(~F.col("type").isin(*RESOLVED)).join(made, "type", "left_anti").select(*EDGE.fieldNames())
    all_edges = cut(unique_edges(resolved(all_nodes, all_links, all_facts).unionByName(others)), "edges")
    store.replace(project, nodes=all_nodes, edges=all_edges, facts=all_facts, links=all_links)
    counts = {"nodes": all_nodes.count(), "edges": all_edges.count()}
    forget(got, touched, there, all_nodes, all_facts, all_links, all_edges)
    return counts


def index(spark: SparkSession, root: str, store: GraphStore, project: str, force: bool = False) -> dict:
    """Brings the store up to date with a source tree: only added and changed files are parsed, deleted ones go. A store without links (an imported one) is parsed whole."""
    disk = cut(discover(spark, root), "disk")
    state = cut(diff_files(disk.select("filePath", "hash"), store.file_hashes(project), force or not store.exists("links")), "diff")
    counts = dict(state.groupBy("state").count().collect())
    if any(counts.get(k) for k in ("added", "changed", "deleted")):
        todo = cut(disk.join(state.where("state IN ('added', 'changed')").select("filePath"), "filePath", "left_semi"), "todo")
        index_files(store, todo, project, state.where("state = 'deleted'"))
    return {k: counts.get(k, 0) for k in ("added", "changed", "unchanged", "deleted")}
