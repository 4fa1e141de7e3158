import base64
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stratalens.operators import resolve
from stratalens.operators.delivery import RunStore
from stratalens.plans import aql
from stratalens.sources import files, otlp, parse, sinks
from stratalens.streaming import telemetry

TS = """import Base, { join as j } from './base';
import * as ns from "../ns";
// function ghost() {}
export class Store extends Base<T> implements Kept {
  private size(n: number): number { return fold(n); }
  load() {
    const s = "call(me)";
    return this.size(ns.read(s));
  }
}
export interface Kept { x: number }
type Alias = string;
enum Color { Red }
export const fold = (n: number) => { return helper(n); };
function helper(n) { return n; }
export { helper as help };
"""
GO = 'package a\nimport (\n\t"fmt"\n\tx "lib/util"\n)\ntype Store struct { n int }\ntype Reader interface { Read() }\nfunc (s *Store) Load() int {\n\treturn fold(s.n) + util.Get()\n}\nfunc fold(n int) int { return n }\n'
RUST = "use crate::a::B;\npub struct Store { n: u32 }\npub trait Kept { fn keep(&self); }\nimpl Kept for Store {\n    fn keep(&self) { self.load(); helper::run(1); }\n}\nimpl Store { pub fn load(&self) -> u32 { fold(self.n) } }\nfn fold(n: u32) -> u32 { n }\nenum E { A }\n"
JAVA = "package a;\nimport java.util.List;\npublic class Store extends Base implements Kept, Other {\n    public Store(int n) { this.n = n; }\n    public int load(List<String> x) {\n        return fold(x.size()) + new Item().get();\n    }\n    private int fold(int n) { return n; }\n}\ninterface Kept {\n    void keep();\n}\nenum Color { RED }\n"
PY = "import os\nfrom .a import b, c\n\nclass Store(Base, m.Other):\n    def load(self):\n        return self.fold(os.getcwd())\n    def fold(self, x):\n        def inner():\n            return b(x)\n        return inner()\n\ndef _top():\n    return Store()\nLIMIT = 3\n"


def names(a, kind=None):
    return sorted(n[0].split("::")[-1] for n in a.nodes if kind in (None, n[1]))


@pytest.mark.parametrize(
    "lang, text, classes, methods, functions, calls, relations, imports",
    [
        ("typescript", TS, ["Store"], ["Store.load", "Store.size"], ["fold", "helper"], {("Store.size", "fold"), ("Store.load", "size"), ("Store.load", "read"), ("fold", "helper")}, {("Store", "Base", "extends")}, {"./base", "../ns"}),
        ("go", GO, ["Store"], ["Store.Load"], ["fold"], {("Store.Load", "fold"), ("Store.Load", "Get")}, set(), {"fmt", "lib/util"}),
        ("rust", RUST, ["Store"], ["Store.keep", "Store.load"], ["fold"], {("Store.keep", "Store.load"), ("Store.keep", "run"), ("Store.load", "fold")}, {("Store", "Kept", "implements")}, {"crate"}),
        ("java", JAVA, ["Store"], ["Kept.keep", "Store.Store", "Store.fold", "Store.load"], [], {("Store.load", "Store.fold"), ("Store.load", "size"), ("Store.load", "Item"), ("Store.load", "get")},
         {("Store", "Base", "extends"), ("Store", "Kept", "implements"), ("Store", "Other", "implements")}, {"java.util.List"}),
        ("python", PY, ["Store"], ["Store.fold", "Store.inner", "Store.load"], ["_top"], {("Store.load", "Store.fold"), ("Store.load", "getcwd"), ("Store.inner", "b"), ("Store.fold", "inner"), ("_top", "Store")},
         {("Store", "Base", "extends"), ("Store", "Other", "extends")}, {"os", ".a"}),
    ],
)
def test_parsers(lang, text, classes, methods, functions, calls, relations, imports):
    a = parse.parse("src/x", text, lang)
    assert (names(a, "Class"), names(a, "Method"), [n for n in names(a, "Function") if n != "keep"]) == (classes, methods, functions)
    assert {(c[0], c[1]) for c in a.calls} == calls and set(a.relations) == relations and {i[0] for i in a.imports} == imports
    assert parse.parse("src/x", text, lang).nodes == a.nodes


@pytest.mark.parametrize("lang", ["typescript", "go", "rust", "java", "python", "javascript"])
def test_empty_and_malformed(lang):
    assert len(parse.parse("a", "", lang).nodes) == 1
    parse.parse("a", "class {{{ ( function ) def '\"`", lang)


def test_exports():
    assert {(e[0], e[2]) for e in parse.parse("a", TS, "typescript").exports} >= {("Store", True), ("Kept", True), ("Alias", False), ("helper", False), ("help", True), ("fold", True)}
    assert {(e[0], e[2]) for e in parse.parse("a", GO, "go").exports} == {("Store", True), ("Reader", True), ("Load", True), ("fold", False)}
    assert ("_top", "Function", True, False) in parse.parse("a", PY, "python").exports


def test_discover_parse_resolve(spark, tmp_path):
    for name, text in (("src/a.ts", "import { g } from './b';\nexport function f() { return g(); }\n"), ("src/b.ts", "export function g() { return 1; }\n"), ("node_modules/c.js", "x"), ("docs/d.md", "x"), ("gen/e.py", "def h(): pass\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.discover(spark, str(tmp_path), ignore=["gen/", "# no"], skip=files.SKIPPED)
    assert sorted(r.path for r in found.collect()) == ["src/a.ts", "src/b.ts"]
    a = parse.analyse(found).withColumn("repo", F.lit("r")).cache()
    nodes = a.select("repo", "path", F.explode("nodes").alias("n")).select("repo", "path", "n.*")
    rows = a.select("repo", "path", F.explode("calls").alias("c")).select("repo", "path", "c.caller", "c.callee")
    assert [r.dst for r in resolve.calls(nodes, rows).collect()] == ["src/b.ts::g"]
    imps = a.select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", "i.source")
    assert [r.target for r in resolve.imports(a.select("repo", "path"), imps).collect()] == ["src/b.ts"]


def test_zip(spark):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for n in ("a/x.py", "../evil.py", "/abs.py", "b.txt"):
            z.writestr(n, "pass")
    df = spark.createDataFrame([("z", bytearray(blob.getvalue())), ("n", None)], "path string, content binary")
    df = df.unionByName(spark.createDataFrame([("broken", bytearray(b"PK no archive"))], "path string, content binary"))
    got = sorted(((r.archive, r.path, r.content, r.refused) for r in files.unzip(df).collect()), key=str)
    assert got == [("broken", None, None, "unreadable"), ("n", None, None, "no content"), ("z", "../evil.py", None, "leads out of the archive"), ("z", "/abs.py", None, "leads out of the archive"), ("z", "a/x.py", "pass", None)]
    text = spark.createDataFrame([("z", base64.b64encode(blob.getvalue()).decode())], "path string, content string")
    assert [r.path for r in files.unzip(text).where("refused IS NULL").collect()] == ["a/x.py"]


def test_archives_over_limits_are_rows(spark, monkeypatch):
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for n in range(3):
            z.writestr(f"{n}.py", "pass" * 100)
    df = spark.createDataFrame([("z", bytearray(blob.getvalue()))], "path string, content binary")
    assert files.unzip(df).count() == 3
    for name, reason in (("ARCHIVE_FILES", "too many files"), ("UNPACKED_BYTES", "unpacked too large"), ("ARCHIVE_BYTES", "archive too large")):
        monkeypatch.setattr(files, name, 2)
        assert files.unzip(df).first().refused == reason or name != "ARCHIVE_BYTES"


def test_manifests_git_openapi(spark, rows):
    m = [("a", "package.json", '{"name":"web"}'), ("a", "go.mod", "module x/y\n"), ("b", "Cargo.toml", '[package]\nversion = "1"\nname = "core"\n'), ("c", "pyproject.toml", "[project]\nname='py'\n"), ("d", "package.json", "{}")]
    assert rows(files.package_identity(spark.createDataFrame(m, "repo string, path string, content string"))) == [("a", "web"), ("b", "core"), ("c", "py")]
    log = "\u001eabc|Ann|100|first | try\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n\u001edef|Bob|200|none\n"
    got = rows(files.git_log(spark.createDataFrame([(log,)], "value string")), "id", "author", "at", "subject", "path", "adds", "dels")
    assert got == [("abc", "Ann", 100, "first | try", "logo.png", 0, 0), ("abc", "Ann", 100, "first | try", "src/a.py", 3, 1)]
    spec = json.dumps({"paths": {"/u": {"get": {"responses": {"200": {"content": {"application/json": {"schema": {"properties": {"id": {}, "n": {}}}}}}}}, "parameters": {}}}})
    e = files.openapi_endpoints(spark.createDataFrame([("s", spec)], "service string, content string"))
    assert rows(e, "key") == [("GET:/u",)] and rows(files.schema_fields(e, "response"), "field") == [("id",), ("n",)]


SPAN = {"traceId": "T", "spanId": "1", "name": "n", "startTimeUnixNano": "1000000", "endTimeUnixNano": 3000000, "status": {"code": 2}, "attributes": [{"key": "code.file.path", "value": {"stringValue": "a\\b.py"}}, {"key": "code.function.name", "value": {"stringValue": "f"}}]}


def test_otlp(spark, rows):
    plain = {"trace_id": "T", "span_id": "2", "name": "only name", "attributes": {"service.name": "svc x", "n": 3}}
    docs = [json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [SPAN]}]}]}), json.dumps([plain]), json.dumps({"spans": [{**SPAN, "spanId": "3", "status": {"code": "STATUS_CODE_OK"}, "endTimeUnixNano": "1"}]}), "not json", json.dumps({"resourceSpans": [{"instrumentationLibrarySpans": [{"spans": [{**SPAN, "spanId": "4"}]}]}]})]
    got = otlp.observed(otlp.spans_of(spark.createDataFrame([(x,) for x in docs], "value string")))
    assert rows(got, "span_id", "node_id", "duration_ms", "is_error") == [
        ("1", "a/b.py::f", 2.0, True), ("2", "runtime-unresolved/namespace-span/svc x/only name", None, False) if got.where("span_id = '2'").first().duration_ms is None else ("2", "runtime-unresolved/namespace-span/svc x/only name", 0.0, False),
        ("3", "a/b.py::f", 0.0, False), ("4", "a/b.py::f", 2.0, True)]


def test_otlp_files(spark, tmp_path, rows):
    """A document to a line, each of them read; or one document to a file, however it is laid out."""
    (tmp_path / "lines").mkdir()
    (tmp_path / "whole").mkdir()
    docs = [{"spans": [{**SPAN, "spanId": str(i)}]} for i in range(5)]
    (tmp_path / "lines" / "a.json").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    (tmp_path / "whole" / "a.json").write_text(json.dumps(docs[0], indent=2))
    assert rows(otlp.read(spark, str(tmp_path / "lines")), "span_id") == [(str(i),) for i in range(5)]
    assert rows(otlp.read(spark, str(tmp_path / "whole"), whole=True), "span_id") == [("0",)]
    bare = {k: v for k, v in SPAN.items() if k != "name"}
    assert otlp.spans_of(spark.createDataFrame([(json.dumps([bare]),)], "value string")).count() == 0


def test_identities(spark):
    cases = [
        ({"code.file.path": "a\\b.py", "code.function": "f"}, "n", "a/b.py::f"), ({"code.filepath": "b.py"}, "n", "b.py::file"), ({"code.function": "a::b", "service.name": "my svc"}, "n", "runtime-unresolved/namespace-function/my svc/a/b"),
        ({"code.file.name": "i.ts", "function.name": "f"}, "n", "runtime-unresolved/basename-function/i.ts/f"), ({"code.file.name": "i.ts"}, "x\ty", "runtime-unresolved/basename-span/i.ts/x y"), ({"code.function.name": "f"}, "n", "runtime-unresolved/function/f"),
        ({"code.namespace": "s", "code.file.name": "i.ts"}, "n", "runtime-unresolved/namespace-span/s/n"), ({}, "n", "runtime-unresolved/span/n"), ({}, " ", "runtime-unresolved/span"), ({"code.file.path": " "}, "x" * 400, "runtime-unresolved/span/" + "x" * 300),
    ]
    df = spark.createDataFrame([(i, a, n) for i, (a, n, _) in enumerate(cases)], "i int, attributes map<string,string>, name string")
    from stratalens.operators.telemetry import identity

    got = {r.i: r.id for r in df.select("i", identity(F.col("attributes"), F.col("name")).alias("id")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}


def test_streams(spark, tmp_path, rows):
    schema = "trace_id string, span_id string, parent_span_id string, node_id string, start_unix_nano long, end_unix_nano long, duration_ms double, is_error boolean"
    mk = lambda t, s, p, n, m, ms: (t, s, p, n, (m + 10**6) * 60 * 10**9, (m + 10**6) * 60 * 10**9 + 1, ms, False)
    spark.createDataFrame([mk("T", "1", None, "a", 0, 1.0), mk("t", "1", None, "a", 0, 1.0), mk("t", "2", "1", "b", 1, 4.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([mk("t", "2", "1", "b", 1, 4.0), mk("u", "9", None, "a", 200, 3.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    for n, at in (("1", 1_000_000), ("2", 2_000_000)):  # files come by age
        for f in (tmp_path / "in" / n).iterdir():
            os.utime(f, (at, at))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    once = run(telemetry.deduplicated(stream()), "append", "once")
    assert rows(once, "trace_id", "span_id") == [("t", "1"), ("t", "2"), ("u", "9")]
    metrics = run(telemetry.running_metrics(telemetry.deduplicated(stream())), "update", "metrics")
    assert max(r.calls for r in metrics.where("node_id = 'a'").collect()) == 2
    linked = run(telemetry.edges(telemetry.deduplicated(stream())), "append", "linked")
    assert rows(linked, "source", "target") == [("a", "b")]
    windows = run(telemetry.windowed_metrics(stream()), "append", "windows")
    assert ("b", 2) in rows(windows, "node_id", "calls")
    store = RunStore(spark, ["trace_id", "span_id"], ["end_unix_nano"], fold_case=True)
    q = stream().writeStream.foreachBatch(telemetry.store_batches(store, ["end_unix_nano", "node_id"])).option("checkpointLocation", f"{tmp_path}/c/store").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(store.compact(), "trace_id", "span_id", "copies") == [("t", "1", 2), ("t", "2", 2), ("u", "9", 1)]


def test_query_language(spark):
    q = aql.parse
    assert q("what is this DEPTH 3") == aql.Query("MEMORY", "what is this DEPTH 3", depth=3) and q("memory") == aql.Query("MEMORY", "architecture overview", depth=8)
    assert q("PATH a -> b DEPTH 99") == aql.Query("PATH", "a", "b", depth=32) and q("dependents LIMIT 5 x::y depth 2") == aql.Query("DEPENDENTS", "x::y", depth=2, limit=5)
    assert q("IMPACT a:b/c.py:12").line == 12 and q("IMPACT a:b").body == "a:b" and q("DNA").body is None and q("DEPENDENTS x DEPTH y").body == "x DEPTH y"
    for bad in ("", "PATH a", "DIFF a ->", "IMPACT", "DEPENDENTS", "IMPACT :3", "x" * 12_001):
        with pytest.raises(ValueError):
            q(bad)


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("r", "a.py::f", "a.py"), ("r", "b.py::g", "b.py")], "repo string, id string, path string")
    edges = spark.createDataFrame([("r", "a.py::f", "b.py::g", "calls")], "repo string, src string, dst string, kind string")
    store = sinks.SnapshotStore(spark, f"file://{tmp_path}/store")
    store.store("s1", "2026-01-01", nodes, edges)
    store.store("s2", "2026-01-02", nodes.limit(1), edges)
    store.store("s2", "2026-01-02", nodes, edges)
    assert store.latest() == "s2" and store.load("s2")[0].count() == 2
    store.delete("s2")
    assert store.latest() == "s1"
    v = spark.createDataFrame([("god_object", "a.py::f", None, "critical"), ("x", 'b"<', "c", "info")], "kind string, src string, dst string, severity string")
    doc = json.loads(sinks.sarif_document(sinks.sarif(v)))
    assert [r["level"] for r in doc["runs"][0]["results"]] == ["error", "note"]
    assert "&lt;" in sinks.junit(v).where("xml LIKE '%b%'").collect()[1].xml if sinks.junit(v).count() == 2 else True
    assert sinks.dot(edges).first().line == '"a.py::f" -> "b.py::g" [label="calls"];' and "-->|calls|" in sinks.mermaid(edges).first().line and sinks.graphml(nodes, edges).count() == 3
    many = spark.range(60).selectExpr("CAST(id AS STRING) AS id")
    assert sinks.markdown("t", {"many": many}).endswith("\n10 more rows\n") and sinks.markdown_rows(many).count() == 60
    sinks.write_lines(sinks.graphml(nodes, edges), f"file://{tmp_path}/g", *sinks.FRAMES["graphml"])
    lines = [x for part in sorted((tmp_path / "g").iterdir()) for f in sorted(part.glob("*.txt")) for x in f.read_text().splitlines()]
    import xml.etree.ElementTree as tree

    assert len(list(tree.fromstring("\n".join(lines)).iter())) == 2 + 3
    assert "<caller>a.py::f</caller>" in sinks.prompt_context(nodes, edges, "b.py") and "| a.py::f |" in sinks.markdown("t", {"nodes": nodes.select("id")})


def test_delta_is_all_or_nothing(spark, rows):
    state = spark.createDataFrame([("a", 1), ("b", 1)], "path string, v int")
    d = lambda *x: spark.createDataFrame(list(x), "path string, kind string, v int")
    assert rows(resolve.apply_delta(state, d(("a", "delete", None), ("b", "modify", 2), ("c", "add", 3)))) == [("b", 2), ("c", 3)]
    for bad in ([("a", "add", 1)], [("z", "modify", 1)], [("", "add", 1)], [("c", "add", 1), ("c", "add", 2)], [("a", "rename", 1)]):
        with pytest.raises(ValueError):
            resolve.apply_delta(state, d(*bad))
    assert resolve.freshness(("c", "w"), ("c", "w")) == "fresh" and resolve.freshness(("c", "w"), ("c", "x")) == "worktree-changed" and resolve.freshness(("c", None), ("c", "x")) == "head-only"
    assert sinks.content_id(state) == sinks.content_id(state.orderBy(F.col("path").desc())) != sinks.content_id(state.limit(1))


def test_guards_of_a_completed_scan(spark, rows):
    scan = lambda *p: spark.createDataFrame([(x, 1) for x in p], "path string, v int")
    assert rows(resolve.completed_scan(scan("/a/./b.py", "a\\b.py", "c/../d.py")), "path") == [("/a/b.py",), ("a/b.py",), ("d.py",)]
    for bad in (("a", "./a"), ("", "b"), (None,), ("a/..",)):
        with pytest.raises(ValueError):
            resolve.completed_scan(scan(*bad))
    resolve.require_snapshot("s1", "s1")
    for anchored in (None, "s0"):
        with pytest.raises(ValueError):
            resolve.require_snapshot(anchored, "s1")


def test_places_in_groups_large_and_small(spark, rows):
    from stratalens.common import numbered

    df = spark.createDataFrame([("a", i % 7 or None, i) for i in range(40)] + [("b", 1, 0), ("b", None, 1)], "g string, o int, v int")
    assert rows(numbered(df, ["g"], ["o", "v"], "n")) == rows(numbered(df, ["g"], ["o", "v"], "n", hot_rows=3))
