"""Scalar functions on names, paths, signatures and literals, as Column builders."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CJK = r"぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Identifier tokens in lower case: split at separators, case changes, acronym ends, digits, and around each CJK character."""
    x = F.regexp_replace(c, rf"([{CJK}])", " $1 ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")
    for pattern in (r"(?<=[\p{Ll}])(?=\p{Lu})", r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", r"(?<=\p{L})(?=\p{N})", r"(?<=\p{N})(?=\p{L})"):
        x = F.regexp_replace(x, pattern, " ")
    return F.filter(F.split(F.lower(x), " "), lambda t: t != "")


def joined_tokens(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def fold_case(c: Column) -> Column:
    return F.lower(c)


@F.pandas_udf(T.StringType())
def normalize_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def byte_levenshtein(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance over UTF-8 bytes; -1 above `most`."""
    x, y = (F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b))
    return F.levenshtein(x, y) if most is None else F.levenshtein(x, y, most)


def name_relevance(name: Column, query: Column) -> Column:
    """1.0 equal or empty query, 0.8 prefix, 0.5 otherwise; ASCII case is ignored."""
    n, q = ascii_lower(name), ascii_lower(query)
    return F.when((q == "") | (n == q), 1.0).when(F.startswith(n, q), 0.8).otherwise(0.5)


def signal_relevance(name: Column, query: Column) -> Column:
    """1.0 equal, 0.8 prefix or part, 0.0 otherwise."""
    n, q = ascii_lower(name), ascii_lower(query)
    return F.when(n == q, 1.0).when(F.contains(n, q), 0.8).otherwise(0.0)


def token_relevance(value: Column, query: Column) -> Column:
    """1.0 equal, 0.8 prefix, 0.7 all query tokens among the value's, 0.5 part, 0.3 otherwise."""
    v, q = ascii_lower(value), ascii_lower(query)
    have, want = tokens(value), tokens(query)
    return F.when(v == q, 1.0).when(F.startswith(v, q), 0.8).when((F.size(want) > 0) & F.forall(want, lambda t: F.array_contains(have, t)), 0.7).when(F.contains(v, q), 0.5).otherwise(0.3)


def module_proximity(path: Column, pattern: Column) -> Column:
    return F.when(F.contains(path, pattern), 1.0).otherwise(0.5)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for empty vectors, unequal lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of equally long vectors; an empty array gives an empty one."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda p, q: p + q.cast("double")))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors))).otherwise(F.array().cast("array<double>"))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def package_prefix(qn: Column) -> Column:
    """The first two dotted components; null without a dot."""
    return F.when(F.contains(qn, F.lit(".")), F.substring_index(qn, ".", 2))


def parent_directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def module_path(path: Column) -> Column:
    """Directory and stem with dots."""
    return F.translate(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"\.[^./]*$", ""), "/", ".")


def parent_name(qn: Column) -> Column:
    return F.regexp_extract(qn, r"^(.*)\.[^.]*$", 1)


def parameters(signature: Column) -> Column:
    """array<struct<name, type>> of what is between the first ( and the last )."""
    inner = F.trim(F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1))
    one = lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("name"), F.when(F.contains(p, F.lit(":")), F.trim(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1))).otherwise("").alias("type"))
    return F.when(inner == "", F.array().cast("array<struct<name:string,type:string>>")).otherwise(F.transform(F.split(inner, ","), one))


def quote_regex(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def glob_match(value: Column, pattern: str) -> Column:
    """Whole string; only * is special."""
    return F.rlike(value, F.lit("(?s)^" + ".*".join(map(quote_regex, pattern.split("*"))) + "$"))


def glob_search(value: Column, pattern: str) -> Column:
    """Anywhere in the string; * and ? are special."""
    return F.rlike(value, F.lit("".join(".*" if c == "*" else "." if c == "?" else quote_regex(c) for c in pattern)))


def string_literals(text: Column) -> Column:
    """The double-quoted literals, escapes resolved."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: F.regexp_replace(s, r"\\(.)", "$1"))


def grpc_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(grpcs?://[^\s\"']+)"), F.lit(1))


def grpc_calls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b(?:client|stub)\.([A-Z]\w*)\("), F.lit(1))


def graphql(text: Column) -> Column:
    """The operation names and 'endpoint' where a /graphql address is named."""
    names = F.regexp_extract_all(text, F.lit(r"\b(?:query|mutation|subscription)\s+(\w+)\s*[({]"), F.lit(1))
    return F.array_compact(F.concat(names, F.array(F.when(F.contains(text, F.lit("/graphql")), F.lit("endpoint")))))


#: call -> direction
QUEUE_CALLS = {"producer.send": "EMITS", "consumer.subscribe": "LISTENS_ON", "channel.publish": "EMITS", "channel.consume": "LISTENS_ON"}
BUS_CALLS = {"io.emit": "EMITS", "socket.on": "LISTENS_ON", "emitter.emit": "EMITS", "emitter.on": "LISTENS_ON"}


def call_arguments(text: Column, call: str) -> Column:
    """The first arguments of call(...), quotes trimmed, empty ones dropped."""
    found = F.regexp_extract_all(text, F.lit(quote_regex(call) + r"\s*\(([^,)]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda a: F.btrim(F.trim(a), F.lit("\"'"))), lambda a: a != "")


def route_regex(path: Column) -> Column:
    """:param segments take one segment, * takes anything; all else is literal."""
    quoted = F.regexp_replace(path, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r":[^/]+", "[^/]+"), r"\*", ".*"), F.lit("$"))


def route_kind(path: Column) -> Column:
    return F.when(F.contains(path, F.lit(":")), "Parameterized").when(F.contains(path, F.lit("*")), "Wildcard").otherwise("Exact")


def bucket(value: Column, limits: tuple[float, float, float]) -> Column:
    """green, yellow, red, critical: the limits are the greatest values of the first three."""
    return F.when(value <= limits[0], "green").when(value <= limits[1], "yellow").when(value <= limits[2], "red").otherwise("critical")


def maintainability(volume: Column, cyclomatic: Column, lines: Column) -> Column:
    v, n = F.greatest(volume, F.lit(1.0)), F.greatest(lines.cast("double"), F.lit(1.0))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (171 - 5.2 * F.log(v) - 0.23 * cyclomatic - 16.2 * F.log(n)) * 100 / 171))


def halstead(n1: Column, n2: Column, big1: Column, big2: Column) -> Column:
    """struct(volume, difficulty, effort, bugs) of distinct and total operators and operands."""
    n, total = (n1 + n2).cast("double"), (big1 + big2).cast("double")
    volume = F.when(n > 0, total * F.log2(F.greatest(n, F.lit(1.0)))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2.0 * big2 / n2).otherwise(0.0)
    return F.struct(volume.alias("volume"), difficulty.alias("difficulty"), (volume * difficulty).alias("effort"), (F.pow(volume * difficulty, F.lit(2.0 / 3)) / 3000).alias("bugs"))


IDENT = r"[A-Za-z0-9_]"


def is_identifier(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^(?!\d)\w+$"))


def word_occurrences(text: Column, word: str) -> Column:
    """0-based positions of word at ASCII identifier boundaries."""

    @F.pandas_udf("array<long>")
    def find(s: pd.Series) -> pd.Series:
        pattern = re.compile(rf"(?<!{IDENT}){re.escape(word)}(?!{IDENT})")
        return s.map(lambda t: [m.start() for m in pattern.finditer(t or "")])

    return find(text)


def renamed_qn(qn: Column, old: str, new: str) -> Column:
    """The last component that is `old`, bounded by dots or #, becomes `new`; else the name stays."""
    return F.regexp_replace(qn, rf"^(.*?)(^|\.){quote_regex(old)}(#[^.]*)?$", rf"$1$2{new}$3")


def risk_of(incoming: Column) -> Column:
    return F.when(incoming == 0, "low").when(incoming <= 3, "medium").otherwise("high")


def is_stale(indexed: Column, current: Column) -> Column:
    return (F.coalesce(indexed, F.lit("")) != "") & (F.coalesce(current, F.lit("")) != "") & (indexed != current)
