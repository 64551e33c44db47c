"""Search over nodes: by name, type and file, regex, fuzzy, graph-enhanced, multi-signal, full text, semantic, hybrid.

Every search is one scan of nodes with label IN (...), so the label and project filters reach the reader, and ends in
a top-k (score desc, name, id), which Spark runs without a global sort. Hits have the columns of schema.HIT.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.functions import text as X
from lattica.plans.lineage import cut

SYMBOLS = "Function Method Class Struct Enum Trait Interface Module Namespace Macro TypeAlias Typedef Variable Const Static GlobalVar".split()
REGEX_LABELS = ("Function", "Method", "Class")
LIMIT, MOST, MAX_DISTANCE, MAX_PATTERN = 50, 500, 3, 4096
RRF_K = 60
FIELDS = (("name", 3.5), ("qualifiedName", 2.0), ("docstring", 0.5), ("content", 0.3))


def clamp(limit: int | None) -> int:
    return min(LIMIT if limit is None else limit, MOST)


def scope(nodes: DataFrame, labels: list[str] | tuple[str, ...] | None, project: str | None) -> DataFrame:
    if labels:
        nodes = nodes.where(F.col("label").isin(*labels))
    return nodes.where(F.col("project") == project) if project else nodes


def hits(df: DataFrame, reason: str | Column, limit: int | None) -> DataFrame:
    """df has a score, and degree where it means anything."""
    degree = F.col("degree") if "degree" in df.columns else F.lit(0)
    reason = F.lit(reason) if isinstance(reason, str) else reason
    out = df.orderBy(F.col("score").desc(), "name", "id").limit(clamp(limit))
    return out.select("name", "label", "filePath", "startLine", "qualifiedName", "score", reason.alias("matchReason"), degree.cast("long").alias("degree"))


def by_name(nodes: DataFrame, query: str, project: str | None = None, limit: int | None = None, labels: list[str] | None = None) -> DataFrame:
    """Case-insensitive substring of the name. A blank query raises."""
    if not query.strip():
        raise ValueError("empty query")
    df = scope(nodes, labels or SYMBOLS, project).where(F.contains(F.lower("name"), F.lower(F.lit(query))))
    return hits(df.withColumn("score", X.name_relevance(F.col("name"), F.lit(query))), "exact", limit)


def by_type(nodes: DataFrame, label: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    return hits(scope(nodes, [label], project).withColumn("score", F.lit(1.0)), "type", limit)


def by_file(nodes: DataFrame, path: str, project: str | None = None) -> DataFrame:
    """All symbols of a file by line (null as 0) and name; no limit."""
    df = scope(nodes, SYMBOLS, project).where(F.col("filePath") == path).withColumn("score", F.lit(1.0))
    return df.select("name", "label", "filePath", "startLine", "qualifiedName", "score", F.lit("file").alias("matchReason"), F.lit(0).cast("long").alias("degree")).orderBy(F.coalesce("startLine", F.lit(0)), "name")


def by_regex(nodes: DataFrame, pattern: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Unanchored; names first, then qualified names. Java's dialect, hence the length guard."""
    if len(pattern.encode()) > MAX_PATTERN:
        raise ValueError(f"pattern longer than {MAX_PATTERN} bytes")
    name, qn = F.rlike("name", F.lit(pattern)), F.rlike("qualifiedName", F.lit(pattern))
    df = scope(nodes, REGEX_LABELS, project).where(name | qn).withColumn("score", F.lit(1.0)).withColumn("_r", F.when(name, "regex: name").otherwise("regex: qualified name"))
    return hits(df, F.col("_r"), limit)


def fuzzy(nodes: DataFrame, query: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    """At most 3 byte edits between names in ASCII lower case; score 1 - d / longer length."""
    q = X.ascii_lower(F.lit(query))
    df = scope(nodes, REGEX_LABELS, project).withColumn("_d", X.byte_levenshtein(X.ascii_lower(F.col("name")), q, MAX_DISTANCE)).where("_d >= 0")
    longest = F.greatest(F.octet_length("name"), F.lit(len(query.encode())), F.lit(1))
    return hits(df.withColumn("score", 1 - F.col("_d") / longest), F.concat(F.lit("fuzzy: distance "), F.col("_d").cast("string")), limit)


def indegree(edges: DataFrame, types: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    return edges.where(F.col("type").isin(*types)).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def graph_enhanced(nodes: DataFrame, edges: DataFrame, query: str, project: str | None = None, limit: int | None = None, labels: list[str] | None = None, least: int | None = None, most: int | None = None) -> DataFrame:
    df = scope(nodes, labels or SYMBOLS, project).where(F.contains(F.lower("name"), F.lower(F.lit(query))))
    df = df.withColumn("score", X.name_relevance(F.col("name"), F.lit(query))).join(indegree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if least is not None:
        df = df.where(F.col("degree") >= least)
    if most is not None:
        df = df.where(F.col("degree") <= most)
    return hits(df, F.concat(F.lit("graph: degree "), F.col("degree").cast("string")), limit)


def multi_signal(nodes: DataFrame, edges: DataFrame, query: str, module: str = "", project: str | None = None, limit: int | None = None) -> DataFrame:
    """.4 name + .3 min(degree / 100, 1) + .2 proximity + .1 tested, over names that contain the query."""
    tested = edges.where("type = 'TESTS'").select(F.col("target").alias("id")).distinct().withColumn("_t", F.lit(1.0))
    df = scope(nodes, SYMBOLS, project).where(F.contains(F.lower("name"), F.lower(F.lit(query)))).join(indegree(edges), "id", "left").join(tested, "id", "left")
    df = df.withColumn("degree", F.coalesce("degree", F.lit(0)))
    score = 0.4 * X.signal_relevance(F.col("name"), F.lit(query)) + 0.3 * F.least(F.col("degree") / 100, F.lit(1.0)) + 0.2 * X.module_proximity(F.col("filePath"), F.lit(module)) + 0.1 * F.coalesce("_t", F.lit(0.0))
    return hits(df.withColumn("score", score), "multi-signal", limit)


def field_score(query: Column) -> Column:
    """Weighted token relevance of the fields; what is no better than 0.3 counts nothing. No idf, no length norm."""
    one = lambda f: X.token_relevance(F.coalesce(F.col(f), F.lit("")), query)
    return reduce(lambda a, b: a + b, [F.when(one(f) > 0.3, one(f)).otherwise(0.0) * w for f, w in FIELDS])


def full_text(nodes: DataFrame, query: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    """Any query token in name, qualified name, docstring or content; weighted field score above 0."""
    q = X.tokens(F.lit(query))
    any_field = F.lower(F.concat_ws(" ", *[f for f, _ in FIELDS]))
    df = scope(nodes, SYMBOLS, project).where(F.exists(q, lambda t: F.contains(any_field, t))).withColumn("score", field_score(F.lit(query))).where("score > 0")
    return hits(df, "full text", limit)


def inverted_index(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """token, id, tf of every token of every row."""
    return docs.select(F.col(id_).alias("id"), F.explode(X.tokens(F.col(text))).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id_: str, text: str, query: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Real BM25 as an extra: id, score. Only the query's tokens are counted; document lengths come in the same pass. Texts are split once: what is needed of them is written."""
    want = X.tokens(F.lit(query))
    rows = docs.select(F.col(id_).alias("id"), X.tokens(F.col(text)).alias("t")).select("id", F.size("t").alias("n"), F.filter("t", lambda x: F.array_contains(want, x)).alias("t"))
    rows = cut(rows, "tokens")
    stats = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("n").alias("_avg"))
    tf = rows.select("id", "n", F.explode("t").alias("token")).groupBy("id", "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    joined = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))  # df has a row for each query token, stats one
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("_avg")))
    return joined.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), "id").limit(clamp(limit))


def semantic(embeddings: DataFrame, query: list[float], limit: int | None = None, id_: str = "nodeId", vector: str = "embedding") -> DataFrame:
    """id, score: the nearest by cosine; every row is compared."""
    score = X.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return embeddings.select(F.col(id_).alias("id"), score.alias("score")).orderBy(F.col("score").desc(), "id").limit(clamp(limit))


def hydrate(found: DataFrame, nodes: DataFrame, reason: str = "semantic", limit: int | None = None) -> DataFrame:
    return hits(found.join(nodes, "id"), reason, limit)


def rrf(lists: list[DataFrame], limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hit lists, by qualified name (or name): the first occurrence's metadata stay. A list has at most 1000 rows."""
    rank = W.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "name", "qualifiedName")
    ranked = [df.withColumn("_rank", F.row_number().over(rank)).withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, ranked).withColumn("_key", F.when(F.coalesce("qualifiedName", F.lit("")) != "", F.col("qualifiedName")).otherwise(F.col("name")))
    meta = F.struct("name", "label", "filePath", "startLine", "qualifiedName", "degree")
    fused = rows.groupBy("_key").agg(F.sum(1 / (k + F.col("_rank"))).alias("score"), F.min_by(meta, F.struct("_list", "_rank")).alias("_m"))
    out = fused.select("_m.*", "score", F.lit("hybrid").alias("matchReason")).orderBy(F.col("score").desc(), "name", "qualifiedName").limit(clamp(limit))
    return out.select("name", "label", "filePath", "startLine", "qualifiedName", "score", "matchReason", "degree")


def hybrid(nodes: DataFrame, embeddings: DataFrame, query: str, vector: list[float], limit: int | None = None) -> DataFrame:
    n = 2 * clamp(limit)
    return rrf([full_text(nodes, query, limit=n), hydrate(semantic(embeddings, vector, n), nodes, limit=n)], limit)


def max_normalized(df: DataFrame, count: str, name: str) -> DataFrame:
    """id, `name`: the count as a share of the greatest."""
    top = df.agg(F.max(count).alias("_max"))
    return df.crossJoin(F.broadcast(top)).select("id", (F.col(count) / F.col("_max")).alias(name))  # top is one row


def file_heat(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, heat: imports of the node's file or module, max-normalised."""
    count = edges.where(F.col("type").isin("IMPORTS", "INCLUDES")).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return max_normalized(count, "n", "heat")


def post_score(found: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """.5 score + .3 centrality + .2 heat for hits with a qualified name."""
    key = nodes.select("id", F.col("qualifiedName"), "label", "startLine")
    scored = found.join(key, ["qualifiedName", "label", "startLine"], "left").join(max_normalized(indegree(edges), "degree", "_c"), "id", "left").join(file_heat(nodes, edges), "id", "left")
    score = 0.5 * F.col("score") + 0.3 * F.coalesce("_c", F.lit(0.0)) + 0.2 * F.coalesce("heat", F.lit(0.0))
    return scored.withColumn("score", score).orderBy(F.col("score").desc(), "name", "qualifiedName").limit(clamp(limit)).select(*found.columns)


MODES: dict[str, Callable] = {"exact": by_name, "regex": by_regex, "fuzzy": fuzzy, "graph": graph_enhanced, "multi": multi_signal, "fulltext": full_text}


def search(mode: str, nodes: DataFrame, edges: DataFrame, query: str, **options: object) -> DataFrame:
    """Dispatch by mode name; unknown modes raise."""
    if mode not in MODES:
        raise ValueError(f"unknown search mode: {mode}")
    return MODES[mode](nodes, edges, query, **options) if mode in ("graph", "multi") else MODES[mode](nodes, query, **options)
