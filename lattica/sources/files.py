"""Files as sources and graph tables as sinks: discovery, hashes, chunking, loads, deletes, artifacts."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lattica.plans.lineage import cut
from lattica.schema import EDGE, FACT_FIELDS, LINK_FIELDS, NODE

SKIPPED = (".git", "target", "node_modules", "build", "dist", "vendor", "__pycache__", ".venv", ".idea", ".cache")
MAX_FILE = 10 * 1024 * 1024
EXTENSIONS = {
    "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "go": "go", "java": "java", "cs": "csharp", "f90": "fortran", "f": "fortran", "f95": "fortran", "rb": "ruby", "php": "php", "scala": "scala", "hs": "haskell",
    "ml": "ocaml", "sh": "bash", "bash": "bash", "v": "verilog", "sv": "verilog", "html": "html", "css": "css", "json": "json",
}
IGNORE_FILES = (".gitignore", ".ignore", ".latticaignore")


# Discovery


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column, content: Column | None = None) -> Column:
    """By extension; a .h whose text has C++ keywords is C++."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    lang = F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))
    if content is None:
        return lang
    return F.when((extension(path) == "h") & F.rlike(content, F.lit(r"(?m)^\s*(class|namespace|template)\b|\bpublic:|\bprivate:|::")), "cpp").otherwise(lang)


def ignored(root: str) -> list[str]:
    """Globs of the root's ignore files, relative to it. Negations and nested files aren't read."""
    found = []
    for name in IGNORE_FILES:
        p = Path(root, name)
        if p.is_file():
            found += [x.strip().strip("/") for x in p.read_text(encoding="utf-8", errors="replace").splitlines() if x.strip() and not x.startswith(("#", "!"))]
    return found


def discover(spark: SparkSession, root: str) -> DataFrame:
    """filePath (relative), length, content, language of the code files under root: known extensions, no skipped or ignored folders, no links, at most MAX_FILE bytes."""
    base = "file:" + os.path.abspath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + base.replace(".", r"\."), "")
    df = files.where(F.col("length") <= MAX_FILE).withColumn("filePath", rel)
    df = df.where(F.try_element_at(F.create_map(*[F.lit(x) for k in EXTENSIONS for x in (k, True)]), extension(F.col("filePath"))).isNotNull())
    for d in SKIPPED:
        df = df.where(~F.rlike("filePath", F.lit(rf"(^|/){d.replace('.', chr(92) + '.')}/")))
    for g in ignored(root):
        pattern = fnmatch.translate(g).replace("(?s:", "").replace(r")\Z", "").replace(r")\z", "")
        df = df.where(~F.rlike("filePath", F.lit(rf"(^|/){pattern}(/|$)")))
    text = F.decode("content", "UTF-8")
    return df.select("filePath", "length", text.alias("content"), language_of(F.col("filePath"), text).alias("language"), F.sha2("content", 256).alias("hash"))


# Hashes and chunks


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def gear_table() -> list[int]:
    return [int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "little") for i in range(256)]


def chunk_offsets(data: bytes, least: int = 2048, mean: int = 4096, most: int = 8192) -> list[tuple[int, int]]:
    """Content-defined chunks (start, length) by a gear hash, with a stricter mask before the mean size than after it."""
    gear, bits = gear_table(), mean.bit_length() - 1
    strict, loose = (1 << (bits + 1)) - 1, (1 << (bits - 1)) - 1
    found, start = [], 0
    while start < len(data):
        end, h = min(len(data), start + most), 0
        at = end
        if end - start > least:
            for i in range(start + least, end):
                h = ((h << 1) + gear[data[i]]) & 0xFFFFFFFFFFFFFFFF
                if not (h >> 20) & (strict if i - start < mean else loose):
                    at = i + 1
                    break
        found.append((start, at - start))
        start = at
    return found


def chunks(files: DataFrame, id_: str = "filePath", content: str = "content") -> DataFrame:
    """id, chunkIndex, start, length, hash of every chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for key, data in zip(frame[id_], frame[content]):
                data = data.encode() if isinstance(data, str) else bytes(data or b"")
                rows += [(key, i, a, n, hashlib.sha256(data[a : a + n]).hexdigest()) for i, (a, n) in enumerate(chunk_offsets(data))]
            yield pd.DataFrame(rows, columns=["id", "chunkIndex", "start", "length", "hash"])

    kind = files.schema[id_].dataType.simpleString()
    return files.select(id_, content).mapInPandas(run, f"id {kind}, chunkIndex int, start long, length long, hash string")


def aggregate_hash(chunk_rows: DataFrame) -> DataFrame:
    """id, hash of the sorted chunk hashes: the order of chunks doesn't matter."""
    return chunk_rows.groupBy("id").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("hash"))), 256).alias("hash"))


# Loading


def conform(df: DataFrame, schema) -> DataFrame:
    """All columns of the schema, missing texts as '', the rest as null."""
    out = []
    for f in schema:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            out.append((F.coalesce(c, F.lit("")) if f.dataType.simpleString() == "string" else c).alias(f.name))
        else:
            out.append((F.lit("") if f.dataType.simpleString() == "string" else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def unique_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """The first row of each id by order."""
    return nodes.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(order))).where("_n = 1").drop("_n")


#: Edges of one task of `unique_edges`, where their number is known.
TASK_EDGES = 500_000


def unique_edges(edges: DataFrame, order: str | None = None, tasks: int | None = None) -> DataFrame:
    """One row for each source, target, type and line (null as 0). tasks: how many share the edges; what is grouped by ends and type afterwards moves no more."""
    key = ["source", "target", "type", "_line"]
    df = edges.withColumn("_line", F.coalesce("startLine", F.lit(0)))
    if tasks:
        df = df.repartition(tasks, "source", "target", "type")
    if order is None:
        return df.dropDuplicates(key).drop("_line")
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n", "_line")


def fields(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split(" ") for f in text.split(", "))])


class GraphStore:
    """nodes/ partitioned by project and label, edges/ by project and type, and what files say of themselves before resolution, facts/ and links/, by project, under one folder. Files are immutable: a change writes the partitions of its project anew."""

    PARTS = {"nodes": ["project", "label"], "edges": ["project", "type"], "facts": ["project"], "links": ["project"]}
    SCHEMAS = {"nodes": NODE, "edges": EDGE, "facts": fields(FACT_FIELDS), "links": fields(LINK_FIELDS)}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/{name}").schema
            return True
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return False
            raise

    def read(self, name: str) -> DataFrame:
        schema = self.SCHEMAS[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return conform(self.spark.read.parquet(f"{self.path}/{name}"), schema)

    @property
    def nodes(self) -> DataFrame:
        return self.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.read("edges")

    def save(self, name: str, df: DataFrame, mode: str = "append") -> None:
        parts = self.PARTS[name]
        df.repartition(*parts).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def load(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Appends what isn't there yet."""
        self.save("nodes", conform(nodes, NODE).dropDuplicates(["id"]).join(cut(self.nodes.select("id")), "id", "left_anti").select(*NODE.fieldNames()))
        self.save("edges", unique_edges(conform(edges, EDGE)).join(cut(self.edges.select("source", "target", "type", "startLine")), ["source", "target", "type", "startLine"], "left_anti").select(*EDGE.fieldNames()))

    def projects(self) -> DataFrame:
        return self.nodes.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("label") == "File").alias("files")).orderBy("project")

    def file_hashes(self, project: str) -> DataFrame:
        return self.nodes.where((F.col("label") == "File") & (F.col("project") == project)).select("filePath", "hash")

    def replace(self, project: str, **tables: DataFrame) -> None:
        """The project's partitions of each table, anew; other projects' aren't touched. tables are cut: they don't read the store."""
        for name, df in tables.items():
            self.save(name, df, "overwrite")
            second = [*self.PARTS[name], None][1]
            left = {r[0] for r in df.select(second).distinct().collect()} if second else set() if df.limit(1).count() else {None}
            self._drop(name, project, second, left)

    def _drop(self, table: str, project: str, part: str | None, left: set) -> None:
        """The project's partitions by `part` that aren't left go; without `part`, all of the project if left holds None."""
        jvm = self.spark.sparkContext._jvm
        names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/project={names.escapePathName(project)}")
        fs = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(folder):
            return
        if part is None:
            if None in left:
                fs.delete(folder, True)
            return
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if name.startswith(f"{part}=") and names.unescapePathName(name.split("=", 1)[1]) not in left:
                fs.delete(s.getPath(), True)

    def delete_files(self, paths: DataFrame) -> None:
        """Rows of these files (filePath) go, of whatever project, with the edges at their nodes."""
        for project in [r.project for r in self.nodes.join(paths.select("filePath"), "filePath", "left_semi").select("project").distinct().collect()]:
            mine = F.col("project") == project
            nodes, edges = without_files(self.nodes.where(mine), self.edges.where(mine), paths)
            self.replace(project, nodes=cut(nodes), edges=cut(edges))

    def delete_project(self, project: str) -> None:
        for name in self.PARTS:
            self._drop(name, project, None, {None})


def without_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside the paths (filePath), and the edges with neither end within them."""
    gone = nodes.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("id")
    left = nodes.join(paths.select("filePath").distinct(), "filePath", "left_anti").select(*nodes.columns)
    e = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return left, e.select(*edges.columns)


# Incremental


def diff_files(disk: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """filePath, state (added, changed, unchanged, deleted). disk: filePath, hash (null: not readable by policy, neither changed nor deleted); stored: filePath, hash."""
    d = disk.select("filePath", F.col("hash").alias("_d"), F.lit(True).alias("_on"))
    s = stored.select("filePath", F.col("hash").alias("_s"), F.lit(True).alias("_in"))
    state = F.when(F.col("_on").isNull(), "deleted").when(F.col("_d").isNull(), F.when(F.col("_in"), "unchanged")).when(F.col("_in").isNull(), "added").when((F.col("_d") != F.coalesce("_s", F.lit(""))) | F.lit(force), "changed").otherwise("unchanged")
    return d.join(s, "filePath", "full_outer").select("filePath", state.alias("state")).where("state IS NOT NULL")


# Artifacts


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, info: dict | None = None) -> dict:
    """zstd Parquet and a manifest in path; the manifest."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    spark = nodes.sparkSession
    manifest = {"magic": "lattica-graph", "version": 1, "nodes": spark.read.parquet(f"{path}/nodes").count(), "edges": spark.read.parquet(f"{path}/edges").count(), **(info or {})}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Checks the magic, the version and the counts."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("magic") != "lattica-graph":
        raise ValueError("not a graph artifact")
    if manifest.get("version") != 1:
        raise ValueError(f"unknown artifact version: {manifest.get('version')}")
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if nodes.count() != manifest["nodes"] or edges.count() != manifest["edges"]:
        raise ValueError("the artifact is incomplete")
    return nodes, edges, manifest
