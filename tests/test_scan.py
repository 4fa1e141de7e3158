"""A whole scan: texts to symbols to the graph."""

from pyspark.sql import functions as F

from stratalens.plans import ingest
from stratalens.sources import parse

FILES = [
    ("r", "src/a.ts", "typescript", "import { g } from './b';\nexport class A extends Base {\n  run() {\n    return g();\n  }\n}\nclass Base {}\nfunction one() { return one2(); }\n"),
    ("r", "src/b.ts", "typescript", "export function g() { return h(); }\nfunction h() { return 1; }\n"),
    ("r", "app/main.py", "python", "from lib.util import load\n\ndef main():\n    return load()\n"),
    ("r", "src/lib/util.py", "python", "def load():\n    return 2\n"),
    ("q", "src/b.ts", "typescript", "export function g() { return 3; }\n"), ("q", "bad.py", "python", "def ("), ("q", "empty.go", "go", ""),
]


def test_scan_of_a_small_tree(spark, rows):
    df = spark.createDataFrame(FILES, "repo string, path string, language string, content string")
    parts = [parse.analyse(df.where(F.col("repo") == r).select("path", "language", "content")).withColumn("repo", F.lit(r)) for r in ("r", "q")]
    analyses = parts[0].unionByName(parts[1])
    nodes, edges = ingest.scan(analyses)
    got = set(rows(edges, "repo", "src", "dst", "kind", "weight"))
    assert {
        ("r", "src/a.ts::file", "src/b.ts::file", "import", 1.0), ("r", "app/main.py::file", "src/lib/util.py::file", "import", 1.0), ("r", "src/a.ts::A.run", "src/b.ts::g", "calls", 1.5),
        ("r", "src/b.ts::g", "src/b.ts::h", "calls", 1.5), ("r", "app/main.py::main", "src/lib/util.py::load", "calls", 1.5), ("r", "src/a.ts::A", "src/a.ts::Base", "extends", 2.0),
    } == got
    files = {(r.repo, r.path) for r in nodes.where("kind = 'File'").collect()}
    assert files == {(r, p) for r, p, *_ in FILES}


def test_scan_of_the_tables_counts_each_file_once(spark):
    d = "/root/testdata/sf0.001"
    got = {(r.repo, r.record, r.kind): r.n for r in ingest.scan_graph(spark, d).collect()}
    files = {r.repo: r.n for r in ingest.texts(spark, d).groupBy("repo").agg(F.countDistinct("path").alias("n")).collect()}
    assert {repo: n for (repo, record, kind), n in got.items() if (record, kind) == ("node", "file")} == files
    assert any(kind == "calls" for _, _, kind in got)
