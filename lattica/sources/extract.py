"""Source text to nodes, edges and facts, in one mapInPandas pass: Python by its own parser, other languages by patterns.

Patterns see one line at a time with comments and strings blanked; blocks end at the matching brace, by indentation or
by an end word. They don't see what a full grammar would (macros, templates over several lines).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.schema import FACT_FIELDS, LINK_FIELDS

NODE_FIELDS = "id string, label string, name string, qualifiedName string, filePath string, startLine long, endLine long, language string, signature string, docstring string, content string, isExported boolean, parentQn string, project string"
SCHEMA = f"nodes array<struct<{', '.join(f.replace(' ', ':', 1) for f in NODE_FIELDS.split(', '))}>>, edges array<struct<{', '.join(f.replace(' ', ':', 1) for f in LINK_FIELDS.split(', '))}>>, facts array<struct<{', '.join(f.replace(' ', ':', 1) for f in FACT_FIELDS.split(', '))}>>".replace(":long", ":bigint")

W = r"[A-Za-z_]\w*"
#: language -> (label, pattern with the name in group 1)
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [("Function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+({W})"), ("Struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+({W})"), ("Enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+({W})"), ("Trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+({W})"), ("Impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({W})"), ("Module", rf"^\s*(?:pub\s+)?mod\s+({W})"), ("Const", rf"^\s*(?:pub\s+)?const\s+({W})\s*:"), ("Static", rf"^\s*(?:pub\s+)?static\s+(?:mut\s+)?({W})\s*:"), ("TypeAlias", rf"^\s*(?:pub\s+)?type\s+({W})"), ("Macro", rf"^\s*macro_rules!\s*({W})")],
    "c": [("Function", rf"^[A-Za-z_][\w\s\*]*?[\s\*]({W})\s*\([^;]*$"), ("Struct", rf"^\s*(?:typedef\s+)?struct\s+({W})\s*\{{?"), ("Enum", rf"^\s*(?:typedef\s+)?enum\s+({W})"), ("Macro", rf"^\s*#\s*define\s+({W})"), ("Typedef", rf"^\s*typedef\s+.*?({W})\s*;"), ("GlobalVar", rf"^(?:static\s+|extern\s+)?(?:int|char|long|double|float|size_t)\s+\*?({W})\s*(?:=|;)")],
    "cpp": [("Class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+({W})"), ("Struct", rf"^\s*struct\s+({W})"), ("Enum", rf"^\s*enum\s+(?:class\s+)?({W})"), ("Namespace", rf"^\s*namespace\s+({W})"), ("Function", rf"^\s*[A-Za-z_][\w\s\*&:<>,]*?[\s\*&](?:\w+::)?(~?{W})\s*\([^;]*$")],
    "typescript": [("Class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({W})"), ("Interface", rf"^\s*(?:export\s+)?interface\s+({W})"), ("Enum", rf"^\s*(?:export\s+)?enum\s+({W})"), ("TypeAlias", rf"^\s*(?:export\s+)?type\s+({W})\s*="), ("Function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({W})"), ("Const", rf"^\s*(?:export\s+)?const\s+({W})\b"), ("Method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*({W})\s*\([^;]*\)\s*(?::[^={{]+)?\{{")],
    "javascript": [("Class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({W})"), ("Function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({W})"), ("Variable", rf"^(?:export\s+)?(?:const|let|var)\s+({W})\b"), ("Method", rf"^\s+(?:static\s+|async\s+)*({W})\s*\([^;]*\)\s*\{{")],
    "go": [("Method", rf"^func\s+\([^)]*\)\s*({W})"), ("Function", rf"^func\s+({W})"), ("Struct", rf"^type\s+({W})\s+struct"), ("Interface", rf"^type\s+({W})\s+interface"), ("TypeAlias", rf"^type\s+({W})\s+(?!struct|interface)")],
    "java": [("Class", rf"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+({W})"), ("Interface", rf"^\s*(?:public\s+|private\s+)*interface\s+({W})"), ("Enum", rf"^\s*(?:public\s+|private\s+)*enum\s+({W})"), ("Method", rf"^\s+(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+[\w<>\[\], ]+\s+({W})\s*\(")],
    "csharp": [("Namespace", r"^\s*namespace\s+([\w.]+)"), ("Class", rf"^\s*(?:public\s+|internal\s+|private\s+|abstract\s+|sealed\s+|static\s+|partial\s+)*class\s+({W})"), ("Struct", rf"^\s*(?:public\s+|internal\s+)*struct\s+({W})"), ("Interface", rf"^\s*(?:public\s+|internal\s+)*interface\s+({W})"), ("Enum", rf"^\s*(?:public\s+|internal\s+)*enum\s+({W})"), ("Method", rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+[\w<>\[\], ]+\s+({W})\s*\(")],
    "fortran": [("Module", rf"(?i)^\s*module\s+(?!procedure)({W})"), ("Function", rf"(?i)^\s*(?:[\w\s\(\)=*]*\s)?(?:function|subroutine)\s+({W})"), ("Function", rf"(?i)^\s*program\s+({W})")],
    "ruby": [("Class", r"^\s*class\s+([\w:]+)"), ("Namespace", r"^\s*module\s+([\w:]+)"), ("Method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "php": [("Namespace", r"^\s*namespace\s+([\w\\]+)"), ("Class", rf"^\s*(?:abstract\s+|final\s+)?class\s+({W})"), ("Trait", rf"^\s*trait\s+({W})"), ("Function", rf"^function\s+({W})"), ("Method", rf"^\s+(?:public\s+|private\s+|protected\s+|static\s+)*function\s+({W})")],
    "scala": [("Namespace", r"^\s*package\s+([\w.]+)"), ("Class", rf"^\s*(?:case\s+|abstract\s+|sealed\s+)*(?:class|object)\s+({W})"), ("Trait", rf"^\s*(?:sealed\s+)?trait\s+({W})"), ("Method", rf"^\s*(?:override\s+|private\s+)*def\s+({W})")],
    "haskell": [("Module", r"^module\s+([\w.]+)"), ("TypeAlias", rf"^type\s+({W})"), ("Struct", rf"^(?:data|newtype)\s+({W})"), ("Function", r"^([a-z]\w*'*)\s*::")],
    "ocaml": [("Module", rf"^\s*module\s+({W})"), ("TypeAlias", rf"^\s*type\s+({W})"), ("Function", rf"^\s*let\s+(?:rec\s+)?({W})\s+[\w(~?]"), ("Variable", rf"^let\s+({W})\s*=")],
    "bash": [("Function", rf"^\s*(?:function\s+)?({W})\s*\(\)"), ("GlobalVar", rf"^(?:export\s+|readonly\s+)?({W})=")],
    "verilog": [("Module", rf"^\s*module\s+({W})"), ("Function", rf"^\s*function\s+(?:\[[^\]]*\]\s*)?({W})"), ("Method", rf"^\s*task\s+({W})")],
    "css": [("Class", r"^\s*\.([\w-]+)[^{};]*\{"), ("Namespace", r"^\s*@([\w-]+)[^{};]*\{")],
    "html": [("Property", r"\bid\s*=\s*[\"']([^\"']+)[\"']")],
    "json": [("Property", r"^\s*\"([^\"]+)\"\s*:")],
    "regex": [("Const", r"\(\?P?<([A-Za-z_]\w*)>")],
}
COMPILED = {k: [(a, re.compile(p)) for a, p in v] for k, v in PATTERNS.items()}
IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "c": r"^\s*#\s*include\s*[\"<]([^\">]+)", "cpp": r"^\s*#\s*include\s*[\"<]([^\">]+)", "typescript": r"(?:from|import|require\()\s*[\"']([^\"']+)[\"']", "javascript": r"(?:from|import|require\()\s*[\"']([^\"']+)[\"']",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"$", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "csharp": r"^\s*using\s+([\w.]+)\s*;", "fortran": r"(?i)^\s*use\s+(\w+)", "ruby": r"^\s*require(?:_relative)?\s+[\"']([^\"']+)", "php": r"^\s*use\s+([\w\\]+)", "scala": r"^\s*import\s+([\w.]+)", "haskell": r"^import\s+(?:qualified\s+)?([\w.]+)", "ocaml": r"^\s*open\s+([\w.]+)", "bash": r"^\s*(?:source|\.)\s+(\S+)",
}
EXTENDS = {"java": r"class\s+\w+\s+extends\s+(\w+)", "cpp": r"(?:class|struct)\s+\w+\s*:\s*(?:public|private|protected)?\s*(\w+)", "typescript": r"class\s+\w+\s+extends\s+(\w+)", "javascript": r"class\s+\w+\s+extends\s+(\w+)", "ruby": r"class\s+\w+\s*<\s*(\w+)", "scala": r"(?:class|object)\s+\w+.*?\bextends\s+(\w+)", "php": r"class\s+\w+\s+extends\s+(\w+)"}
IMPLEMENTS = {"rust": r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+", "java": r"\bimplements\s+([\w, ]+)"}
CALL = re.compile(rf"\b({W})\s*\(")
WORDS = frozenset("if for while switch return catch sizeof match fn func function def new in and or not elif else with assert class struct".split())
TYPES = frozenset("Class Struct Enum Trait Interface Impl Namespace Module".split())
BODIES = frozenset("Function Method".split()) | TYPES


def package_of(project: str, path: str) -> str:
    """project.dir.dir.stem; dots in folders become _, Python's __init__ is dropped."""
    parts = path.strip("/").split("/")
    stem = re.sub(r"\.[^.]*$", "", parts[-1])
    folders = [p.replace(".", "_") for p in parts[:-1]]
    return ".".join([project, *folders, *([] if parts[-1] == "__init__.py" else [stem])])


def qualified(base: str, name: str, disambiguator: str = "") -> str:
    return f"{base}.{name}" + (f"#{re.sub(r'[^A-Za-z0-9_]', '_', disambiguator)}" if disambiguator else "")


class File:
    """What one file gives."""

    def __init__(self, project: str, path: str, language: str) -> None:
        self.project, self.path, self.language, self.base = project, path, language, package_of(project, path)
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.facts: list[dict] = []
        self.seen: dict[str, int] = {}
        self.node("File", path.rsplit("/", 1)[-1], 1, 1, id_="file:" + self.base)

    def node(self, label: str, name: str, start: int, end: int, parent: str | None = None, signature: str = "", doc: str = "", exported: bool = False, content: str = "", id_: str | None = None) -> str:
        qn = id_ or qualified(parent or self.base, name)
        self.seen[qn] = self.seen.get(qn, 0) + 1
        if self.seen[qn] > 1:
            qn = f"{qn}#{start}"
        self.nodes.append({"id": qn, "label": label, "name": name, "qualifiedName": qn, "filePath": self.path, "startLine": start, "endLine": end, "language": self.language, "signature": signature, "docstring": doc, "content": content, "isExported": exported, "parentQn": parent or "", "project": self.project})
        if id_ is None:
            self.edge(parent or "file:" + self.base, qn, "DEFINES" if not parent else "HAS_METHOD" if label in ("Method", "Function") else "CONTAINS", start)
        return qn

    def edge(self, source: str, target: str, type_: str, line: int) -> None:
        self.edges.append({"source": source, "target": target, "type": type_, "startLine": line, "project": self.project})

    def fact(self, kind: str, source: str, name: str, line: int, spec: str = "") -> None:
        self.facts.append({"kind": kind, "source": source, "name": name, "filePath": self.path, "startLine": line, "spec": spec, "language": self.language, "project": self.project})


def python_file(out: File, text: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.split("\n")

    def visit(body: list, parent: str | None, owner: str) -> None:
        for x in body:
            if isinstance(x, ast.ClassDef):
                qn = out.node("Class", x.name, x.lineno, x.end_lineno, parent, doc=ast.get_docstring(x) or "", exported=not x.name.startswith("_"))
                for b in x.bases:
                    out.edge(qn, ast.unparse(b).split(".")[-1], "EXTENDS", x.lineno)
                visit(x.body, qn, qn)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                label = "Method" if parent and parent == owner and any(n["id"] == parent and n["label"] == "Class" for n in out.nodes) else "Function"
                qn = out.node(label, x.name, x.lineno, x.end_lineno, parent, f"def {x.name}({ast.unparse(x.args)})", ast.get_docstring(x) or "", not x.name.startswith("_"), "\n".join(lines[x.lineno - 1 : x.end_lineno]))
                facts(x, qn)
                visit([y for y in x.body if isinstance(y, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))], qn, "")
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                for a in x.names:
                    spec = a.name if isinstance(x, ast.Import) else "." * x.level + (x.module or "")
                    out.fact("import", "file:" + out.base, a.asname or a.name, x.lineno, spec)

    def facts(f: ast.AST, qn: str) -> None:
        for x in ast.walk(f):
            if isinstance(x, ast.Call):
                name = x.func.id if isinstance(x.func, ast.Name) else x.func.attr if isinstance(x.func, ast.Attribute) else None
                if name:
                    out.fact("call", qn, name, x.lineno)
            elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name):
                out.fact("assign", qn, x.value.func.id, x.lineno)
            elif isinstance(x, ast.Name):
                out.fact("write" if isinstance(x.ctx, ast.Store) else "read", qn, x.id, x.lineno)

    visit(tree.body, None, "")


BLANK = {"hash": re.compile(r"#.*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"), "c": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'", re.S)}


def blanked(text: str, language: str) -> str:
    """Comments and strings become blanks; lines keep their numbers."""
    style = BLANK["hash"] if language in ("ruby", "bash") else BLANK["c"]
    return style.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def block_end(lines: list[str], start: int, language: str) -> int:
    """The last line (1-based) of the block that begins in line start."""
    if language in ("ruby", "fortran", "verilog", "haskell", "ocaml"):
        indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
        for i in range(start, len(lines)):
            x = lines[i]
            if x.strip() and len(x) - len(x.lstrip()) <= indent:
                return i + 1 if x.strip().lower().startswith("end") else i
        return len(lines)
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened:
                return i + 1
        if opened and depth <= 0:
            return i + 1
    return start


def pattern_file(out: File, text: str) -> None:
    language = out.language
    raw = text.split("\n")
    plain = raw if language in ("html", "json", "regex") else blanked(text, language).split("\n")
    imports = re.compile(IMPORTS[language]) if language in IMPORTS else None
    extends, implements = EXTENDS.get(language), IMPLEMENTS.get(language)
    open_: list[tuple[int, str, str]] = []  # end line, qualified name, label
    for i, line in enumerate(plain, 1):
        while open_ and open_[-1][0] < i:
            open_.pop()
        if imports and (m := imports.search(raw[i - 1])):
            out.fact("import", "file:" + out.base, re.split(r"[/.:\\]", m[1].rstrip("/"))[-1], i, m[1])
            continue
        for label, pattern in COMPILED[language]:
            m = pattern.search(line if label != "Macro" or language == "rust" else raw[i - 1])
            if not m or m[1] in WORDS:
                continue
            end = block_end(plain, i, language) if label in BODIES else i
            holder = next((x for x in reversed(open_) if x[2] in TYPES), None)
            if label == "Function" and holder and holder[2] in ("Impl", "Class", "Struct", "Trait", "Interface"):
                label = "Method"
            exported = bool(re.match(r"\s*(pub|public|export)\b", line)) or (language == "go" and m[1][:1].isupper())
            qn = out.node(label, m[1], i, end, holder[1] if holder else None, raw[i - 1].strip() if label in ("Function", "Method") else "", "", exported, "\n".join(raw[i - 1 : end]) if label in ("Function", "Method") else "")
            if extends and (e := re.search(extends, line)):
                out.edge(qn, e[1], "EXTENDS", i)
            if implements and (e := re.search(implements, line)):
                for t in e[1].split(","):
                    out.edge(qn, t.strip().split("::")[-1], "IMPLEMENTS", i)
            if label in BODIES and end > i:
                open_.append((end, qn, label))
            break
        owner = next((x for x in reversed(open_) if x[2] in ("Function", "Method")), None)
        if owner:
            for m in CALL.finditer(line):
                if m[1] not in WORDS and not (plain[i - 1].lstrip().startswith(("fn ", "def ", "func "))):
                    out.fact("call", owner[1], m[1], i)


def extract_file(project: str, path: str, language: str, text: str) -> File:
    out = File(project, path, language)
    if language == "python":
        python_file(out, text)
    elif language in COMPILED:
        pattern_file(out, text)
    return out


def extract(files: DataFrame, project: str) -> DataFrame:
    """nodes, edges and facts (arrays) of each file. files: filePath, language, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [extract_file(project, p, la, t or "") for p, la, t in zip(frame["filePath"], frame["language"], frame["content"])]
            yield pd.DataFrame({"nodes": [f.nodes for f in found], "edges": [f.edges for f in found], "facts": [f.facts for f in found]})

    return files.select("filePath", "language", "content").mapInPandas(run, SCHEMA)


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, facts as tables of their own."""
    return tuple(extracted.select(F.inline(c)) for c in ("nodes", "edges", "facts"))
