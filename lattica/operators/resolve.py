"""Resolution: from extracted facts (calls, imports, assignments, reads, writes, externs) to edges, by ranked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.schema import EDGE_COLUMNS

SAME_FILE, IMPORTED, EXPORTED = 0.95, 0.90, 0.80
BUILDERS = tuple("new default clone into from unwrap to_string len iter map collect".split())
CALLABLE = ("Function", "Method", "Constructor", "Macro")
PROBES = tuple("rs py ts tsx js jsx go java c h cpp hpp".split())


def symbol_table(nodes: DataFrame, labels: tuple[str, ...] = CALLABLE) -> DataFrame:
    """id, name, filePath, exported."""
    return nodes.where(F.col("label").isin(*labels)).select("id", "name", "filePath", F.coalesce("isExported", F.lit(False)).alias("exported"))


def ranked_targets(facts: DataFrame, symbols: DataFrame, imports: DataFrame, key: list[str]) -> DataFrame:
    """For each fact (key, filePath, name) its best symbol: target, confidence, tier. Ranks: same file, imported name, exported anywhere; the least id among equals.

    imports: filePath, name, targetFile. One equi-join on the name for each rank, and a row_number over the fact.
    """
    s = symbols.select(F.col("id").alias("target"), F.col("name").alias("_n"), F.col("filePath").alias("_f"), "exported")
    i = imports.select(F.col("filePath").alias("_if"), F.col("name").alias("_in"), F.col("targetFile").alias("_it"))
    same = facts.join(s, (facts["name"] == s["_n"]) & (facts["filePath"] == s["_f"])).select(*key, "target", F.lit(1).alias("rank"))
    named = facts.join(i, (facts["name"] == i["_in"]) & (facts["filePath"] == i["_if"])).select(*key, "name", "_it")
    imported = named.join(s, (named["name"] == s["_n"]) & (named["_it"] == s["_f"])).select(*key, "target", F.lit(2).alias("rank"))
    anywhere = s.where("exported").groupBy("_n").agg(F.min("target").alias("target"))
    exported = facts.join(anywhere, facts["name"] == anywhere["_n"]).select(*key, "target", F.lit(3).alias("rank"))
    best = same.union(imported).union(exported).groupBy(*key).agg(F.min(F.struct("rank", "target")).alias("_b"))
    confidence = F.when(F.col("_b.rank") == 1, SAME_FILE).when(F.col("_b.rank") == 2, IMPORTED).otherwise(EXPORTED)
    tier = F.when(F.col("_b.rank") == 1, "SAME_FILE").when(F.col("_b.rank") == 2, "IMPORT_SCOPED").otherwise("GLOBAL")
    return best.select(*key, F.col("_b.target").alias("target"), confidence.alias("confidence"), tier.alias("confidenceTier"))


def edge(df: DataFrame, type_: str, reason: str) -> DataFrame:
    return df.select("source", "target", F.lit(type_).alias("type"), "confidence", "confidenceTier", F.lit(reason).alias("reason"), F.col("startLine").cast("long").alias("startLine"), "project")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS, one for each caller and callee, the first line. calls: source, name, filePath, startLine, project."""
    facts = calls.where(~F.col("name").isin(*BUILDERS)).groupBy("source", "name", "filePath", "project").agg(F.min("startLine").alias("startLine"))
    found = ranked_targets(facts, symbols, imports, ["source", "name", "filePath", "startLine", "project"])
    best = found.where("source <> target").groupBy("source", "target", "project").agg(F.max_by(F.struct("confidence", "confidenceTier"), "confidence").alias("c"), F.min("startLine").alias("startLine"))
    return edge(best.select("source", "target", "project", "startLine", "c.*"), "CALLS", "")


def resolve_flows(assignments: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DATAFLOWS and the Parameter nodes that they need. assignments: kind (ReturnAssign, AssignFrom, ArgPass), source, name, filePath, startLine, paramIndex, project.

    A returned value flows from the callee to the source at .90, an assigned one at .85; an argument flows to callee.paramN at .80.
    """
    found = ranked_targets(assignments, symbols, imports, ["kind", "source", "name", "filePath", "startLine", "paramIndex", "project"])
    arg = F.col("kind") == "ArgPass"
    confidence = F.when(arg, 0.80).when(F.col("kind") == "ReturnAssign", 0.90).otherwise(0.85)
    parameter = F.concat("target", F.lit(".param"), F.coalesce("paramIndex", F.lit(0)).cast("string"))
    flows = found.select(F.when(arg, F.col("source")).otherwise(F.col("target")).alias("source"), F.when(arg, parameter).otherwise(F.col("source")).alias("target"), confidence.alias("confidence"), "confidenceTier", "startLine", "project", F.col("kind").alias("reason"))
    edges = flows.select("source", "target", F.lit("DATAFLOWS").alias("type"), "confidence", "confidenceTier", "reason", F.col("startLine").cast("long").alias("startLine"), "project").dropDuplicates(["source", "target", "startLine"])
    nodes = found.where(arg).select(parameter.alias("id"), F.lit("Parameter").alias("label"), F.concat(F.lit("param"), F.coalesce("paramIndex", F.lit(0)).cast("string")).alias("name"), parameter.alias("qualifiedName"), F.col("target").alias("parentQn"), "project").distinct()
    return edges, nodes


def resolve_accesses(accesses: DataFrame, variables: DataFrame, imports: DataFrame) -> DataFrame:
    """READS and WRITES at .75. accesses: source, name, filePath, startLine, write, project."""
    found = ranked_targets(accesses, variables, imports, ["source", "name", "filePath", "startLine", "write", "project"]).withColumn("confidence", F.lit(0.75))
    return edge(found.where("NOT write"), "READS", "").union(edge(found.where("write"), "WRITES", ""))


def signature_mismatch(a: Column, b: Column) -> Column:
    """Share of parameter positions whose types differ, by the longer list."""
    longest = F.greatest(F.size(a), F.size(b))
    norm = lambda c: F.transform(c, lambda p: F.lower(F.regexp_replace(p["type"], r"[\s&*]|const|mut", "")))
    same = F.aggregate(F.zip_with(norm(a), norm(b), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)
    return F.when(longest == 0, 0.0).otherwise(1 - same / longest)


def resolve_ffi(externs: DataFrame, functions: DataFrame) -> DataFrame:
    """FFI_CALLS: .85 less .15 of the mismatch where both have signatures, .70 by name only. externs: source, name, signature, language, startLine, project; functions: nodes."""
    from lattica.functions.text import parameters

    f = functions.where(F.col("label") == "Function").select(F.col("id").alias("target"), F.col("name").alias("_n"), F.col("signature").alias("_s"), F.col("language").alias("_l"))
    both = externs.join(f, (externs["name"] == f["_n"]) & (externs["language"] != f["_l"]))
    known = (F.coalesce("signature", F.lit("")) != "") & (F.coalesce("_s", F.lit("")) != "")
    confidence = F.when(known, F.greatest(F.lit(0.70), 0.85 - 0.15 * signature_mismatch(parameters(F.col("signature")), parameters(F.col("_s"))))).otherwise(0.70)
    best = both.withColumn("confidence", confidence).groupBy("source", "name", "startLine", "project").agg(F.max_by(F.struct("target", "confidence"), F.struct("confidence", "target")).alias("b"))
    return edge(best.select("source", "b.*", F.lit("GLOBAL").alias("confidenceTier"), "startLine", "project"), "FFI_CALLS", "ffi")


def normalized(path: Column) -> Column:
    """Path with . and .. resolved."""
    def step(acc: Column, p: Column) -> Column:
        return F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """filePath, spec, rank, candidate: where an import may lead, in order. imports: filePath, spec, language."""
    here = F.regexp_extract("filePath", r"^(.*/)?[^/]*$", 1)
    spec, lang = F.col("spec"), F.col("language")
    dotted = F.translate(spec, ".", "/")
    rust = F.regexp_replace(F.regexp_replace(spec, r"^(crate|self|super)::", ""), "::", "/")
    relative = normalized(F.concat(here, F.regexp_replace(spec, r"\.(js|jsx|mjs|cjs)$", "")))
    python = F.when(lang == "python", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>"))
    is_rel = F.startswith(spec, F.lit("."))
    none = F.array().cast("array<string>")
    ordered = F.concat(
        F.array(spec),
        F.when(lang == "rust", F.array(F.concat(F.lit("src/"), rust, F.lit(".rs")), F.concat(F.lit("src/"), rust, F.lit("/mod.rs")), F.concat(rust, F.lit(".rs")), F.concat(F.lit("src/"), F.regexp_replace(rust, r"/[^/]*$", ""), F.lit(".rs")))).otherwise(none),
        python,
        F.when(lang == "java", F.array(F.concat(dotted, F.lit(".java")), F.concat(F.regexp_replace(dotted, r"/[^/]*$", ""), F.lit(".java")))).otherwise(none),
        F.when(is_rel, F.concat(F.array(relative), *[F.array(F.concat(relative, F.lit("." + p))) for p in PROBES], *[F.array(F.concat(relative, F.lit("/index." + p))) for p in ("ts", "tsx", "js", "jsx")])).otherwise(none),
    )
    return imports.select("filePath", "spec", F.posexplode(ordered).alias("rank", "candidate"))


def suffixes(files: DataFrame) -> DataFrame:
    """filePath, suffix: the path and each of its tails that begins after a slash."""
    parts = F.split("filePath", "/")
    return files.select("filePath", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """filePath, spec, targetFile: the first candidate that is a file; a spec with a dot also by path suffix, same folder first, then the shortest path."""
    f = files.select(F.col("filePath").alias("targetFile")).distinct()
    exact = import_candidates(imports).join(f, F.col("candidate") == F.col("targetFile")).select("filePath", "spec", F.col("rank").cast("long").alias("rank"), "targetFile")
    tails = suffixes(files.select("filePath").distinct()).select(F.col("filePath").alias("targetFile"), "suffix")
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    by_tail = imports.where(F.contains("spec", F.lit(".")) & ~F.startswith("spec", F.lit("."))).join(tails, F.col("spec") == F.col("suffix"))
    by_tail = by_tail.select("filePath", "spec", (F.lit(1000) + F.when(folder("filePath") == folder("targetFile"), 0).otherwise(1000) + F.length("targetFile")).cast("long").alias("rank"), "targetFile")
    best = exact.union(by_tail).where("filePath <> targetFile").groupBy("filePath", "spec").agg(F.min(F.struct("rank", "targetFile")).alias("b"))
    return best.select("filePath", "spec", F.col("b.targetFile").alias("targetFile"))


def import_edges(resolved: DataFrame, file_nodes: DataFrame, type_: str = "IMPORTS") -> DataFrame:
    ids = file_nodes.where("label = 'File'").select("id", "filePath", "project")
    out = resolved.join(ids.select(F.col("id").alias("source"), "filePath", "project"), "filePath").join(ids.select(F.col("id").alias("target"), F.col("filePath").alias("targetFile")), "targetFile")
    return edge(out.select("source", "target", F.lit(0.95).alias("confidence"), F.lit("IMPORT_SCOPED").alias("confidenceTier"), F.lit(0).alias("startLine"), "project").distinct(), type_, "")


def include_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """INCLUDES of C and C++ files."""
    own = imports.where(F.col("language").isin("c", "cpp"))
    return import_edges(resolve_imports(own, files), files, "INCLUDES")


def retarget_types(edges: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """EXTENDS, IMPLEMENTS and USES_TYPE whose target is a bare name get the type's id by the ranks of calls; the rest of the edges stay."""
    types = ("EXTENDS", "IMPLEMENTS", "USES_TYPE")
    ids = nodes.select("id")
    loose = edges.where(F.col("type").isin(*types)).join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    facts = loose.join(nodes.select(F.col("id").alias("source"), "filePath"), "source").withColumn("name", F.col("target")).select("source", "name", "filePath", "type", "startLine", "project", "reason")
    symbols = symbol_table(nodes, tuple("Class Struct Enum Trait Interface TypeAlias Record".split()))
    fixed = ranked_targets(facts, symbols, imports, ["source", "name", "type", "startLine", "project", "reason"])
    fixed = fixed.select(*EDGE_COLUMNS)
    kept = edges.join(loose.select("source", "target", "type", "startLine"), ["source", "target", "type", "startLine"], "left_anti").select(*fixed.columns)
    return kept.union(fixed)


def prune_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without type edges that still point nowhere."""
    typed = F.col("type").isin("EXTENDS", "IMPLEMENTS", "USES_TYPE")
    good = edges.where(typed).join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(*edges.columns)
    return edges.where(~typed).union(good)
