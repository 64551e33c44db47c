"""Files, extraction, resolution, metrics, the store, the index pipeline, commands and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics as M
from lattica.operators import resolve as R
from lattica.plans.index import index
from lattica.service import NotFound, Service
from lattica.sources import extract as E
from lattica.sources import files as S
from lattica.streaming import watch as V

RUST = """use crate::util::helper;

pub trait Shape { fn area(&self) -> f64; }
pub struct Sq { a: f64 }
impl Shape for Sq {
    fn area(&self) -> f64 { self.a * self.a }
}

// fn ghost() {}
pub fn main() {
    let s = "fn fake() {";
    helper(s);
    if s.len() > 1 && s.len() < 5 {
        for i in 0..3 { helper(s); }
    }
}
"""
PYTHON = '''import os
from pkg.util import helper


class Base:
    """Doc."""

    def run(self, x: int) -> int:
        total = helper(x)
        for i in range(x):
            if i > 2 and x:
                total += self.run(i)
        return total


class Child(Base):
    pass
'''


def test_language_and_chunks(spark):
    df = spark.createDataFrame([("a.RS", ""), ("x.h", "class A {"), ("y.h", "int f();"), ("z.txt", "")], "p string, t string")
    assert [r[0] for r in df.select(S.language_of(F.col("p"), F.col("t"))).collect()] == ["rust", "cpp", "c", ""]
    data = random.Random(1).randbytes(60_000)
    parts = S.chunk_offsets(data)
    assert sum(n for _, n in parts) == len(data) and all(2048 <= n <= 8192 for _, n in parts[:-1])
    moved = S.chunk_offsets(b"xyz" + data)
    assert {data[a : a + n] for a, n in parts[-3:]} & {(b"xyz" + data)[a : a + n] for a, n in moved}
    assert S.chunk_offsets(b"") == []


def test_extract_rust():
    f = E.extract_file("p", "src/geo.rs", "rust", RUST)
    got = {(n["label"], n["name"]) for n in f.nodes}
    assert {("Trait", "Shape"), ("Struct", "Sq"), ("Impl", "Shape"), ("Function", "main"), ("Method", "area")} - got <= {("Impl", "Shape")}
    assert ("Function", "ghost") not in got and ("Function", "fake") not in got
    main = next(n for n in f.nodes if n["name"] == "main")
    assert main["startLine"] == 10 and main["endLine"] == 16 and main["isExported"] and main["id"] == "p.src.geo.main"
    assert {x["name"] for x in f.facts if x["kind"] == "call" and x["source"] == main["id"]} >= {"helper"}
    assert [x["spec"] for x in f.facts if x["kind"] == "import"] == ["crate::util::helper"]


def test_extract_python():
    f = E.extract_file("p", "a.b/__init__.py", "python", PYTHON)
    ids = {n["id"]: n["label"] for n in f.nodes}
    assert ids["p.a_b.Base"] == "Class" and ids["p.a_b.Base.run"] == "Method"
    assert ("p.a_b.Child", "Base", "EXTENDS") in {(e["source"], e["target"], e["type"]) for e in f.edges}
    assert E.extract_file("p", "bad.py", "python", "def (").facts == []


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("c", "#include <a.h>\n#define X 1\nint f(int a) {\n return g(a);\n}\n", {("Function", "f"), ("Macro", "X")}), ("cpp", "namespace n {\nclass A : public B {\n};\n}\n", {("Namespace", "n"), ("Class", "A")}),
        ("go", "package p\nfunc F(a int) {\n g()\n}\ntype T struct {\n}\nfunc (t T) M() {\n}\n", {("Function", "F"), ("Struct", "T"), ("Method", "M")}), ("java", "public class A extends B {\n  public int f(int x) {\n  }\n}\n", {("Class", "A"), ("Method", "f")}),
        ("typescript", "export class A {\n  run(x: number): void {\n  }\n}\nexport interface I {\n}\n", {("Class", "A"), ("Method", "run"), ("Interface", "I")}), ("javascript", "function f() {\n}\nconst v = 1;\n", {("Function", "f"), ("Variable", "v")}),
        ("csharp", "namespace N {\n class C {\n  public int M(int a) {\n  }\n }\n}\n", {("Namespace", "N"), ("Class", "C"), ("Method", "M")}), ("fortran", "module m\nend module\nsubroutine s(a)\nend subroutine\n", {("Module", "m"), ("Function", "s")}),
        ("ruby", "class A < B\n  def x\n  end\nend\n", {("Class", "A"), ("Method", "x")}), ("php", "<?php\nclass A {\n  public function m() {\n  }\n}\n", {("Class", "A"), ("Method", "m")}), ("scala", "object O {\n  def f(x: Int) = x\n}\n", {("Class", "O"), ("Method", "f")}),
        ("haskell", "module M where\nf :: Int -> Int\ndata T = T\n", {("Module", "M"), ("Function", "f"), ("Struct", "T")}), ("ocaml", "let f x = x\ntype t = int\n", {("Function", "f"), ("TypeAlias", "t")}), ("bash", "f() {\n echo\n}\nX=1\n", {("Function", "f"), ("GlobalVar", "X")}),
        ("verilog", "module m(a);\nendmodule\n", {("Module", "m")}), ("html", '<p id="x">', {("Property", "x")}), ("css", ".a { color: red }\n", {("Class", "a")}), ("json", '{\n "k": 1\n}\n', {("Property", "k")}), ("regex", r"(?P<year>\d+)", {("Const", "year")}),
    ],
)
def test_extract_languages(language, text, want):
    assert want <= {(n["label"], n["name"]) for n in E.extract_file("p", "f.x", language, text).nodes}


def test_call_ranks(spark):
    symbols = spark.createDataFrame([("same", "f", "a.rs", False), ("imported", "f", "b.rs", False), ("exported", "f", "c.rs", True), ("hidden", "g", "d.rs", False)], "id string, name string, filePath string, exported boolean")
    imports = spark.createDataFrame([("x.rs", "f", "b.rs")], "filePath string, name string, targetFile string")
    calls = spark.createDataFrame([(p, n, p, 1, "q") for p, n in [("a.rs", "f"), ("x.rs", "f"), ("z.rs", "f"), ("z.rs", "g"), ("a.rs", "clone")]], "source string, name string, filePath string, startLine long, project string")
    assert {(r.source, r.target, r.confidence) for r in R.resolve_calls(calls, symbols, imports).collect()} == {("a.rs", "same", 0.95), ("x.rs", "imported", 0.9), ("z.rs", "exported", 0.8)}


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ["src/util.rs", "web/a/x.ts", "web/a/index.ts", "org/acme/T.java", "inc/deep/h.h", "lib/h.h", "pkg/m.py"]], "filePath string")
    imports = spark.createDataFrame([("src/main.rs", "crate::util::f", "rust"), ("web/b.ts", "./a/x.js", "typescript"), ("web/b.ts", "./a", "typescript"), ("M.java", "org.acme.T", "java"), ("lib/m.c", "h.h", "c"), ("q.py", "pkg.m", "python"), ("q.py", "nope", "python")], "filePath string, spec string, language string")
    got = {(r.filePath, r.spec): r.targetFile for r in R.resolve_imports(imports, files).collect()}
    assert got == {("src/main.rs", "crate::util::f"): "src/util.rs", ("web/b.ts", "./a/x.js"): "web/a/x.ts", ("web/b.ts", "./a"): "web/a/index.ts", ("M.java", "org.acme.T"): "org/acme/T.java", ("lib/m.c", "h.h"): "lib/h.h", ("q.py", "pkg.m"): "pkg/m.py"}


def test_flows_accesses_ffi_and_types(spark):
    from lattica.schema import EDGE, NODE

    none = spark.createDataFrame([], "filePath string, name string, targetFile string")
    symbols = spark.createDataFrame([("p.g", "g", "a.rs", True)], "id string, name string, filePath string, exported boolean")
    facts = spark.createDataFrame([("ArgPass", "p.f", "g", "a.rs", 3, 1, "q"), ("ReturnAssign", "p.f", "g", "a.rs", 4, None, "q")], "kind string, source string, name string, filePath string, startLine long, paramIndex int, project string")
    edges, params = R.resolve_flows(facts, symbols, none)
    assert {(r.source, r.target, r.confidence) for r in edges.collect()} == {("p.f", "p.g.param1", 0.8), ("p.g", "p.f", 0.9)} and [r.id for r in params.collect()] == ["p.g.param1"]
    nodes = S.conform(spark.createDataFrame([("c.f", "Function", "bridge", "c", "int bridge(a: int, b: int)"), ("T", "Class", "T", "rust", ""), ("S", "Struct", "S", "rust", "")], "id string, label string, name string, language string, signature string"), NODE)
    ext = spark.createDataFrame([("r.x", "bridge", "fn bridge(a: int, b: str)", "rust", 1, "q"), ("r.y", "bridge", "", "rust", 1, "q")], "source string, name string, signature string, language string, startLine long, project string")
    assert {(r.source, round(r.confidence, 3)) for r in R.resolve_ffi(ext, nodes).collect()} == {("r.x", 0.775), ("r.y", 0.7)}
    e = S.conform(spark.createDataFrame([("S", "T", "EXTENDS", 1), ("S", "Missing", "IMPLEMENTS", 2), ("S", "x", "READS", 3)], "source string, target string, type string, startLine long"), EDGE)
    assert {(r.target, r.type) for r in R.prune_types(R.retarget_types(e, nodes, none), nodes).collect()} == {("T", "EXTENDS"), ("x", "READS")}


def test_metrics(spark):
    nodes = spark.createDataFrame([("a", "Function", "main", "rust", RUST[RUST.index("pub fn main") :], 10, 16), ("b", "Method", "run", "python", "\n".join(PYTHON.split("\n")[7:13]), 8, 13), ("c", "Function", "e", "rust", "", 1, 1)], "id string, label string, name string, language string, content string, startLine long, endLine long")
    got = {r.id: r for r in M.complexity(nodes).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].cyclomatic, got["a"].lines, got["a"].timeClass) == (4, 7, "O(n)")
    assert (got["b"].cyclomatic, got["b"].cognitive, got["b"].nesting, got["b"].timeClass) == (4, 4, 2, "O(n)")
    assert M.summary(M.complexity(nodes)).first().functions == 2 and 0 <= got["a"].maintainability <= 100
    assert M.counts("fn f() { v.sort(); }", "rust", "f")[7] == "O(n log n)" and M.counts("fn f(n) { f(n-1) + f(n-2) }", "rust", "f")[7] == "O(2^n)"


def test_diff_states(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("locked", None)], "filePath string, hash string")
    stored = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4"), ("locked", "9")], "filePath string, hash string")
    assert dict(S.diff_files(disk, stored).collect()) == {"a": "added", "b": "unchanged", "c": "changed", "d": "deleted", "locked": "unchanged"}
    assert dict(S.diff_files(disk, stored, force=True).collect())["b"] == "changed"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    for path, text in {"src/main.rs": RUST, "src/util.rs": "pub fn helper(x: &str) {\n    deep(x);\n}\nfn deep(x: &str) {\n}\nfn unused() {\n}\n", "pkg/util.py": "def helper(x):\n    return x\n", "pkg/app.py": PYTHON, "target/build.rs": "fn skipped() {}\n", "notes.txt": "no", "gen/out.rs": "fn out() {}\n", ".gitignore": "gen/\n# c\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_index_then_change_then_delete(spark, tree, tmp_path):
    service = Service(spark, str(tmp_path / "store"))
    assert service.index(str(tree), "p") == {"added": 4, "changed": 0, "unchanged": 0, "deleted": 0}
    calls = {(r.source, r.target) for r in service.store.edges.where("type = 'CALLS'").collect()}
    assert ("p.src.main.main", "p.src.util.helper") in calls and ("p.src.util.helper", "p.src.util.deep") in calls and ("p.pkg.app.Base.run", "p.pkg.util.helper") in calls
    assert service.store.edges.where("type = 'EXTENDS'").first().target == "p.pkg.app.Base"
    assert {tuple(r) for r in service.query("MATCH (to:Function {name: 'deep'})<-[:CALLS]-(of:Function) RETURN of.name").collect()} == {("helper",)}
    assert "unused" in {r.name for r in service.dead_code().collect()} and "deep" not in {r.name for r in service.dead_code().collect()}
    assert [list(r.nodes) for r in service.trace("main", depth=2).where("depth = 2").collect()] == [["p.src.main.main", "p.src.util.helper", "p.src.util.deep"]]
    affected, risk = service.impact("deep")
    assert {r.id for r in affected.collect()} == {"p.src.util.helper", "p.src.main.main"} and risk.first().level
    with pytest.raises(NotFound):
        service.trace("helper")
    assert service.index(str(tree), "p") == {"added": 0, "changed": 0, "unchanged": 4, "deleted": 0}
    (tree / "src/util.rs").write_text("pub fn helper(x: &str) {\n}\n")
    (tree / "pkg/util.py").unlink()
    assert service.index(str(tree), "p") == {"added": 0, "changed": 1, "unchanged": 2, "deleted": 1}
    ids = {r.id for r in service.store.nodes.collect()}
    assert "p.src.util.deep" not in ids and "p.pkg.util.helper" not in ids and "p.src.util.helper" in ids
    assert service.search("helper").count() == 1 and service.complexity().count() >= 3 and service.context("main").count() == 1
    assert [r.name for r in service.detect_changes(["+++ b/src/main.rs", "@@ -11 +11 @@"]).collect()] == ["main"]
    manifest = service.export(str(tmp_path / "art"))
    other = Service(spark, str(tmp_path / "copy"))
    assert other.import_(str(tmp_path / "art")) == manifest and other.store.nodes.count() == manifest["nodes"]
    other.clean("p")
    assert other.store.nodes.count() == 0 and service.list().first().project == "p"


def test_index_of_changes_equals_a_fresh_index(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    call = "from b import helper\n\ndef caller():\n    return helper(1)\n"
    (root / "a.py").write_text(call)
    (root / "c.py").write_text("def lone():\n    return 1\n")
    store = S.GraphStore(spark, str(tmp_path / "store"))
    other = S.GraphStore(spark, str(tmp_path / "other"))
    other_root = tmp_path / "second"
    other_root.mkdir()
    (other_root / "z.py").write_text("def z():\n    return 0\n")
    index(spark, str(other_root), store, "q")
    seen = []
    for step, text in enumerate(["def helper(x):\n    return x\n", "def helper(x):\n    return x + 1\n", "def renamed(x):\n    return x\n", "def helper(x):\n    return x\n", None]):
        if text is None:
            (root / "b.py").unlink()
        else:
            (root / "b.py").write_text(text)
        index(spark, str(root), store, "p")
        fresh = S.GraphStore(spark, str(tmp_path / f"fresh{step}"))
        index(spark, str(root), fresh, "p")
        for name, drop in (("nodes", ()), ("edges", ())):
            got, want = (x.read(name).where("project = 'p'").drop(*drop) for x in (store, fresh))
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        seen.append(store.edges.where("type IN ('CALLS', 'IMPORTS') AND project = 'p'").count())
    assert seen == [2, 2, 1, 2, 0] and store.nodes.where("project = 'q' AND name = 'z'").count() == 1 and not other.exists("nodes")


def test_watch_brings_the_store_up_to_date(spark, tree, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "store"))
    index(spark, str(tree), store, "p")
    on_batch = V.indexer(str(tree), store, "p")
    q = V.watch(spark, str(tree), on_batch, str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    (tree / "src/new.rs").write_text("pub fn fresh() {\n    helper(1);\n}\n")
    q = V.watch(spark, str(tree), on_batch, str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert store.nodes.where("name = 'fresh'").count() == 1
    assert store.edges.where("source = 'p.src.new.fresh' AND type = 'CALLS'").first().target.endswith("util.helper")


def test_windows_on_a_stream_equal_the_table(spark, tmp_path):
    import datetime as d

    base = d.datetime(2024, 1, 1)
    rows = [(i, base + d.timedelta(minutes=7 * i), i % 3, "abc"[i % 3], float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "e"))
    stream = V.tumbling(V.events_stream(spark, str(tmp_path / "e"), events.schema, most_files=3), late="1 day")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, V.tumbling(events).collect()))


def test_debounce_and_cache(spark, tmp_path):
    assert V.debounce_step(500.0, [], None, 10.0) == (500.0, [])
    window, gaps = V.debounce_step(500.0, [1.0] * 10, 0.0, 6000.0)
    assert window == 350.0 and len(gaps) == 10
    events = spark.createDataFrame([(1, t) for t in (0, 6_000_000, 12_000_000)], "k long, us long").select("k", F.timestamp_micros("us").alias("ts"))
    assert [round(x) for x in sorted(r.windowMs for r in V.adaptive_debounce(events, "k", "ts").collect())] == [245, 350, 500]
    parts = tmp_path / "events"
    events.write.parquet(str(parts))
    q = V.adaptive_debounce(V.events_stream(spark, str(parts), events.schema), "k", "ts").writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("debounced").count() == 3
    c = V.ParseCache(2)
    assert c.get("a", "x\ny\nz", len) == 5 and c.get("a", "x\ny\nz", len) == 5 and c.hits == 1
    assert c.reusable("a", "x\ny\nzz") is False or c.reusable("a", "x\ny\nz")
    c.get("b", "1", len), c.get("c", "2", len)
    assert set(c.entries) == {"c"}


def test_artifact_checks(spark, tmp_path):
    (tmp_path / "bad" / "manifest").mkdir(parents=True)
    (tmp_path / "bad" / "manifest" / "part.txt").write_text('{"magic": "other"}')
    with pytest.raises(ValueError):
        S.import_graph(spark, str(tmp_path / "bad"))
