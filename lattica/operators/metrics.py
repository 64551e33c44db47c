"""Code metrics of functions: the counts by a vectorised UDF over the functions' text, the rest as Column math."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import bucket, halstead, maintainability
from lattica.sources.extract import blanked

#: metric -> the greatest green, yellow and red value
THRESHOLDS = {"cyclomatic": (10, 20, 25), "cognitive": (10, 15, 20), "nesting": (3, 5, 6), "lines": (30, 100, 200), "volume": (100, 1000, 8000)}
MAINTAINABILITY = (85, 65, 25)
TIMES = tuple(f"O({x})" for x in "1/log n/n/n log n/n^2/n^3/2^n".split("/"))
SPACES, SEVERITY = tuple(f"O({x})" for x in "1 n n^2".split()), tuple("green yellow red critical".split())

BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|when|foreach|until|unless)\b|\?(?![.?:])")
SHORT = re.compile(r"&&|\|\||\band\b|\bor\b")
ARMS, EXITS = re.compile(r"=>"), re.compile(r"\b(?:return|break|continue|throw|raise)\b")
LOOP = re.compile(r"\b(?:for|while|loop|foreach|until)\b")
ALLOCATE = re.compile(r"\b(?:vec!|Vec::new|new\b|malloc|list\(|dict\(|append|push|HashMap|\[\]|make\()|\[[^\]]*\bfor\b")
OPERAND = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?")
OPERATOR = re.compile(r"[-+*/%=<>!&|^~?:]+|[.,;()\[\]{}]")
KEYWORDS = frozenset("if else elif for while return break continue match case switch try catch except finally raise throw fn def func function let var const class struct impl pub in and or not new with as import from use".split())

COUNTS = "cyclomatic int, cognitive int, nesting int, operators int, operands int, allOperators int, allOperands int, timeClass string, spaceClass string"


def python_counts(f: ast.AST) -> tuple[int, int, int, int]:
    """cyclomatic, cognitive, nesting, loop depth."""
    branches = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.IfExp, ast.match_case)
    nest = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.With, ast.Try, ast.Match)
    loops = (ast.For, ast.While, ast.AsyncFor)
    total, cognitive, deepest, loop_depth = 1, 0, 0, 0

    def walk(x: ast.AST, depth: int, loop: int) -> None:
        nonlocal total, cognitive, deepest, loop_depth
        for y in ast.iter_child_nodes(x):
            d, k = depth, loop
            if isinstance(y, branches):
                total += 1
            if isinstance(y, (ast.If, *loops, ast.ExceptHandler, ast.IfExp)):
                cognitive += 1 + depth
            if isinstance(y, ast.BoolOp):
                total += len(y.values) - 1
                cognitive += 1
            if isinstance(y, ast.Match):
                total -= 1
            if isinstance(y, nest):
                d += 1
                deepest = max(deepest, d)
            if isinstance(y, (*loops, ast.comprehension)):
                k += 1
                loop_depth = max(loop_depth, k)
            walk(y, d, k)

    walk(f, 0, 0)
    return total, cognitive, deepest, loop_depth


def brace_counts(text: str) -> tuple[int, int, int, int]:
    total, cognitive, deepest, loop_depth, depth = 1, 0, 0, 0, 0
    loops: list[int] = []
    for line in text.split("\n"):
        b = len(BRANCH.findall(line))
        total += b + len(SHORT.findall(line))
        cognitive += b * max(1, depth) + len(SHORT.findall(line))
        if LOOP.search(line):
            loops.append(depth)
            loop_depth = max(loop_depth, len(loops))
        depth += line.count("{") - line.count("}")
        deepest = max(deepest, depth - 1)
        while loops and depth <= loops[-1]:
            loops.pop()
    return total + max(0, len(ARMS.findall(text)) - 1), cognitive, max(0, deepest), loop_depth


def counts(text: str, language: str, name: str) -> tuple:
    """The values of COUNTS for one function's text."""
    plain = text if language == "python" else blanked(text, language)
    found = None
    if language == "python":
        try:
            f = ast.parse(re.sub(r"(?m)^" + re.match(r"\s*", text)[0], "", text)).body[0]
            found = python_counts(f)
        except (SyntaxError, ValueError, IndexError, RecursionError):
            pass
    cyclomatic, cognitive, nesting, loops = found or brace_counts(plain)
    words = OPERAND.findall(plain)
    operands = [w for w in words if w not in KEYWORDS]
    operators = OPERATOR.findall(plain) + [w for w in words if w in KEYWORDS]
    own = max(0, len(re.findall(rf"\b{re.escape(name)}\s*\(", plain)) - 1) if name else 0
    if own >= 2:
        time = "O(2^n)"
    elif own == 1:
        time = "O(n)"
    elif re.search(r"binary_search|bisect|/\s*2\b.*\bmid\b|\bmid\b.*/\s*2\b|>>\s*1", plain) and loops == 1:
        time = "O(log n)"
    elif re.search(r"\.sort(?:_by\w*|_unstable\w*)?\(|\bsorted\(", plain):
        time = "O(n log n)"
    else:
        time = TIMES[(0, 2, 4, 5)[min(loops, 3)]]
    allocates = bool(ALLOCATE.search(plain))
    space = "O(n^2)" if allocates and loops >= 2 else "O(n)" if allocates or own else "O(1)"
    return cyclomatic, cognitive, nesting, len(set(operators)), len(set(operands)), len(operators), len(operands), time, space


def rank(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int")


def complexity(nodes: DataFrame) -> DataFrame:
    """id, the metrics, a severity for each and the worst of them. nodes: functions and methods with content."""
    fields = [f.split(" ")[0] for f in COUNTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [counts(t or "", la or "", n or "") for t, la, n in zip(frame["content"], frame["language"], frame["name"])]
            out = pd.DataFrame(rows, columns=fields)
            out.insert(0, "id", frame["id"].to_numpy())
            out.insert(1, "lines", (frame["endLine"] - frame["startLine"] + 1).to_numpy())
            yield out

    f = nodes.where(F.col("label").isin("Function", "Method") & (F.coalesce("content", F.lit("")) != "")).select("id", "name", "language", "content", F.coalesce("startLine", F.lit(0)).alias("startLine"), F.coalesce("endLine", "startLine", F.lit(0)).alias("endLine"))
    return severities(f.mapInPandas(run, "id string, lines long, " + COUNTS))


def severities(m: DataFrame) -> DataFrame:
    """Adds Halstead, maintainability and severities to id, lines and COUNTS."""
    m = m.withColumn("h", halstead(F.col("operators"), F.col("operands"), F.col("allOperators"), F.col("allOperands"))).select("*", "h.volume", "h.difficulty", "h.effort", "h.bugs").drop("h")
    m = m.withColumn("maintainability", maintainability(F.col("volume"), F.col("cyclomatic"), F.col("lines")))
    marks = {k: bucket(F.col(k), t) for k, t in THRESHOLDS.items()}
    mi = F.col("maintainability")
    marks["maintainability"] = F.when(mi >= MAINTAINABILITY[0], "green").when(mi >= MAINTAINABILITY[1], "yellow").when(mi >= MAINTAINABILITY[2], "red").otherwise("critical")
    t, s = rank(F.col("timeClass"), TIMES), rank(F.col("spaceClass"), SPACES)
    marks["timeClass"] = F.when(t <= 2, "green").when(t <= 3, "yellow").when(t <= 5, "red").otherwise("critical")
    marks["spaceClass"] = F.when(s <= 1, "green").when(s <= 2, "yellow").otherwise("red")
    m = m.withColumns({k + "Severity": c for k, c in marks.items()})
    worst = F.greatest(*[rank(F.col(k + "Severity"), SEVERITY) for k in marks])
    return m.withColumn("severity", F.element_at(F.array(*[F.lit(x) for x in SEVERITY]), worst))


def ranked(m: DataFrame, red_only: bool = False) -> DataFrame:
    level = rank(F.col("severity"), SEVERITY)
    return (m.where(level >= 3) if red_only else m).orderBy(level.desc(), "id")


def summary(m: DataFrame) -> DataFrame:
    """One row: functions, and how many of each severity."""
    return m.agg(F.count(F.lit(1)).alias("functions"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY])
