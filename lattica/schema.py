"""Labels, edge types, confidence ranges and column lists of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = (
    "Project Folder File Module Class Struct Enum Trait Impl Function Method Variable GlobalVar Parameter Const Static "
    "Macro TypeAlias Typedef Namespace Interface Constructor Property Record Delegate Annotation Template Union Variant Field "
    "Event Handler Middleware Service Endpoint Route Process Database Config Test Section Community Tool Embedding"
).split()

#: type -> (least, greatest confidence)
EDGE_TYPES: dict[str, tuple[float, float]] = {}
for _names, _low, _high in (
    ("CONTAINS DEFINES MEMBER_OF IMPORTS INCLUDES HAS_METHOD HAS_PROPERTY STEP_IN_PROCESS ENTRY_POINT_OF TESTS REEXPORTS", 0.95, 1.0),
    ("IMPLEMENTS EXTENDS METHOD_OVERRIDES METHOD_IMPLEMENTS HANDLES_ROUTE HANDLES_TOOL", 0.90, 1.0),
    ("CALLS", 0.80, 0.95),
    ("USES_TYPE DATAFLOWS HTTP_CALLS ASYNC_CALLS", 0.80, 0.90),
    ("REFERENCES FETCHES USAGE EMITS LISTENS_ON", 0.75, 0.85),
    ("FFI_CALLS", 0.70, 0.85),
    ("READS WRITES ACCESSES", 0.70, 0.80),
):
    EDGE_TYPES |= dict.fromkeys(_names.split(), (_low, _high))

TIERS = {"SAME_FILE": 0.95, "IMPORT_SCOPED": 0.90, "GLOBAL": 0.50}
FLOW_KINDS = ("ArgPass", "ReturnAssign", "AssignFrom", "AssignTo")

_text = "label name qualifiedName filePath language signature returnType docstring content parentQn project httpMethod path expectedSchema hash".split()
NODE = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in _text]
    + [T.StructField(c, T.LongType()) for c in ("startLine", "endLine", "lineCount", "parameterCount")]
    + [T.StructField(c, T.BooleanType()) for c in ("isExported", "isGlobal")]
)
NODE_COLUMNS = NODE.fieldNames()

EDGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("source", "target", "type")]
    + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("confidenceTier", "reason")]
    + [T.StructField("startLine", T.LongType()), T.StructField("project", T.StringType())]
)
EDGE_COLUMNS = EDGE.fieldNames()

HIT = ["name", "label", "filePath", "startLine", "qualifiedName", "score", "matchReason", "degree"]


def parse_edge_types(text: str | None, default: tuple[str, ...] = ("CALLS", "IMPLEMENTS", "USES_TYPE")) -> list[str]:
    """A comma list of edge types, in order, each once; empty: the default. Unknown names raise."""
    names = list(dict.fromkeys(x.strip().upper() for x in (text or "").split(",") if x.strip()))
    for x in names:
        if x not in EDGE_TYPES:
            raise ValueError(f"unknown edge type: {x}")
    return names or list(default)

#: What extraction tells of a file beside its nodes: facts to resolve, and edges by the names in the text.
FACT_FIELDS = "kind string, source string, name string, filePath string, startLine long, spec string, language string, project string"
LINK_FIELDS = "source string, target string, type string, startLine long, project string"
