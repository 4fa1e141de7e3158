import random

from pyspark.sql import functions as F

from stratalens.functions import paths
from stratalens.operators import causality, extract, history, lane, scoring, structure, telemetry, traverse


def test_components_both_ways(spark, rows):
    rng = random.Random(9)
    links = [(k, f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for k in "ab" for _ in range(22)] + [("c", "x", "x"), ("d", "p", "q"), ("d", "q", "p")]
    df = spark.createDataFrame(links, "key string, src string, dst string")
    small, loop = rows(traverse.components(df)), rows(traverse.components(df, group_edges=0))
    reach = {}
    for k, a, b in links:
        reach.setdefault((k, a), set()).add(b)
    changed = True
    while changed:
        changed = False
        for (k, a), to in reach.items():
            more = set().union(*(reach.get((k, b), set()) for b in to)) - to
            if more:
                to |= more
                changed = True
    want = sorted((k, a, min(x for x in to | {a} if x == a or a in reach.get((k, x), ()) and x in to)) for (k, a), to in reach.items() if any(a in reach.get((k, b), ()) for b in to if b != a))
    assert small == loop == want
    assert traverse.components(df.limit(0)).count() == 0


def test_reach_both_ways(spark, rows):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.randrange(20), rng.randrange(20)) for k in "ab" for _ in range(25)], "key string, src int, dst int")
    seeds = spark.createDataFrame([("a", 1), ("a", 2), ("b", 99), ("z", 1)], "key string, node int")
    for reverse in (False, True):
        assert rows(traverse.reach(df, seeds, 4, reverse)) == rows(traverse.reach(df, seeds, 4, reverse, group_edges=0))


def test_simple_cycles_once_each(spark, rows):
    df = spark.createDataFrame([("k", a, b) for a, b in ("ab", "bc", "ca", "ba", "cd", "dd")], "key string, src string, dst string")
    assert rows(traverse.simple_cycles(df)) == [("k", "a -> b", 2), ("k", "a -> b -> c", 3)]


def test_asof_against_brute_force(spark):
    rng = random.Random(5)
    right = [(rng.choice("ab"), rng.randrange(50), i) for i in range(60)] + [(None, 3, 1), ("a", None, 2)]
    left = [(i, rng.choice("abc"), rng.choice([None, *range(-3, 55)])) for i in range(120)]
    r, x = spark.createDataFrame(right, "k string, t long, v int"), spark.createDataFrame(left, "i int, k string, at long")
    for forward in (False, True):
        want = {}
        for i, k, at in left:
            ok = [(t, v) for kk, t, v in right if kk == k and t is not None and at is not None and (t >= at if forward else t <= at)]
            edge = (min if forward else max)((t for t, _ in ok), default=None)
            want[i] = max((v for t, v in ok if t == edge), default=None)
        for pack in (3, 64):
            assert {q.i: q.v for q in history.asof(x, r, "k", "at", "t", ["v"], forward, pack).collect()} == want


def test_paths(spark):
    df = spark.createDataFrame([("src/a/b.ts", "./c"), ("src/a/b.ts", "../d/./e"), ("b.ts", "../../x"), ("s\\a\\b.py", ".c"), ("m.rs", "crate::x::y"), ("m.py", "x.y"), ("m.ts", "@s/p/q")], "path string, source string")
    got = [r.c[0] for r in df.select(paths.candidates(F.col("path"), F.col("source")).alias("c")).collect()]
    assert got == ["src/a/c", "src/d/e", "x", "s/a/.c", "src/x/y", "x/y", "@s/p/q"]
    assert [r.p for r in df.select(paths.external_root(F.col("source")).alias("p")).collect()] == [None, None, None, None, None, "x", "@s/p"]


def test_hash_and_clones(spark, rows):
    df = spark.createDataFrame([("",), ("aé€",), ("x" * 400,)], "t string")

    def h(s):
        n = 0
        for b in s.encode():
            n = (n * 31 + b) % 1_000_000_007
        return n

    assert [r.h for r in df.select(structure.polynomial_hash(F.col("t")).alias("h")).collect()] == [h(""), h("aé€"), h("x" * 400)]
    body = "\n".join(f'call( "{{}}"  {i}' for i in range(9))
    files = spark.createDataFrame([(1, body.replace("{}", "p")), (2, body.replace("{}", "q").replace("\n", "\r\n") + "\r\n"), (3, None), (4, ""), (5, "short")], "k int, text string")
    got = rows(structure.clone_clusters(structure.clone_windows(files, "k", "text")), "places", "files", "duplicate_lines")
    assert sum(p for p, _, _ in got) == 4 and all(f == 2 for _, f, _ in got)


def test_test_paths(spark):
    cases = {"src/tests/a.py": True, "src\\test\\a.py": True, "a/test_x.py": True, "a/x_test.go": True, "a/XTest.java": True, "a/x.spec.ts": True, "src/contest.py": False, "src/latest/a.py": False, "src/attest_x.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.t for r in df.select("p", structure.is_test(F.col("p")).alias("t")).collect()} == cases


def test_annotations_and_gate(spark, rows):
    n = spark.createDataFrame([("r", "a", "@Injectable()"), ("r", "b", None), ("r", "c", "@RestController")], "repo string, id string, annotations string")
    assert rows(structure.annotation_boundaries(n)) == [("r", "application", "a"), ("r", "presentation", "c")]
    v = spark.createDataFrame([("god_object", 1), ("circular_dependency", 3)], "kind string, rank int")
    assert structure.gate(v).first().passed is False and structure.gate(v.limit(0)).first().passed is True


def test_constraints(spark, rows):
    texts = ["a >= 3", "a < 3", "b == x", "b != x", "c = 1", "c = 2", "d > 1", "d < 2", "e >= 4", "e == 3", "f >= 1", "f <= 1", "what", None, "g > 1", "g == 1"]
    got = dict(rows(causality.constraint_conflicts(spark.createDataFrame([(t,) for t in texts], "cond string"))))
    assert got == {"a": "empty range", "b": "value excluded", "c": "several values", "e": "value out of range", "g": "value out of range"}


def test_taint_stops_at_sanitisers(spark, rows):
    f = spark.createDataFrame([(1, "s", "a", "calls", 1.0), (2, "a", "k", "writes", 1.0), (3, "s", "b", "sanitizes", 1.0), (4, "b", "m", "writes", 1.0), (5, "s", "t", "trust_boundary", 1.0), (6, "t", "k", "calls", 1.0), (7, "k", "z", "writes", 1.0)], "fact_id int, src string, dst string, rel string, conf double")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(causality.taint(f, one("s"), one("k", "m", "z"), 8), "sink", "depth", "boundary") == [("k", 2, True)]


def test_hotspots_merge_and_history_facts(spark, rows):
    h = spark.createDataFrame([("a", {"runtime.cpu_ms": "100", "runtime.error_rate": "0.1"}), ("b", {"runtime.cpu_ms": "0"}), ("c", {"runtime.latency_ms": "x"}), ("d", None)], "id string, attributes map<string,string>")
    assert rows(causality.runtime_hotspots(h)) == [("a", 3.0)]
    b = spark.createDataFrame([(2, "x", "k2", None, "r", None, {"p": "2", "q": "2"}), (1, "x", None, "n1", None, None, {"p": "1"}), (3, "y", "k", None, None, None, None)], "ord int, id string, kind string, name string, repo string, path string, attributes map<string,string>")
    got = {r.id: r for r in causality.merge_entities(b).collect()}
    assert (got["x"].kind, got["x"].name, got["x"].attributes) == ("k2", "n1", {"p": "1", "q": "2"}) and got["y"].attributes == {}
    g = causality.git_facts(spark.createDataFrame([("ann", "c1", 1, "f"), ("ann", "c2", 2, "f"), ("bob", "c2", 2, "g")], "author string, id string, at int, path string"))
    assert ("commit:c2", "commit:c1", "supersedes", 1.0) in rows(g) and ("author:ann", "file:f", "owns", 0.4) in rows(g)


def test_lane(spark, rows):
    e = spark.createDataFrame(
        [("p", "1", "static", 0.5, None, 1, ["b", "a", "a"]), ("p", "1", "static", 0.5, None, 2, []), ("q", "2", "static", 0.5, None, 1, []), ("p", "3", "predicted", 0.5, 0.9, 1, []), ("p", "4", "static", 1.5, None, 1, []), ("p", None, "static", 0.5, None, 1, [])],
        "project_id string, id string, evidence string, confidence double, observed_score double, created_at_ms long, entities array<string>")
    got = lane.remember(e, "p").collect()
    assert [(r.id, r.entities) for r in got] == [("1", ["a", "b"])]
    o = spark.createDataFrame([("s", 5.0, True, True, None, False, None), ("s", -5.0, True, False, False, True, False), ("s", 0.0, None, None, None, None, None)], "strategy string, reward double, accepted boolean, validated boolean, improved boolean, rollback boolean, approved boolean")
    assert rows(lane.strategies(o), "attempts", "successes", "mean_reward") == [(3, 1, 0.0)]


def test_scores_and_budget(spark, rows):
    e = spark.createDataFrame([("a", True, None, False, None), ("b", None, None, None, None), ("c", False, True, True, True)], "id string, v boolean, i boolean, r boolean, x boolean")
    assert rows(e.select("id", scoring.observed_score(["v", "i"], ["r", "x"]).alias("s"))) == [("a", 1.0), ("b", None), ("c", 0.25)]
    assert rows(e.select("id", F.array_join(scoring.blockers(["v", "i"], "x"), ",").alias("s"))) == [("a", "i,x"), ("b", "v,i,x"), ("c", "v")]
    b = spark.createDataFrame([("k", 1, 40), ("k", 2, 70), ("k", 3, 5)], "k string, o int, n int")
    assert rows(scoring.within_budget(b, ["k"], ["o"], "n", 100), "o") == [(1,)]
    assert scoring.terms("What is src/a.ts::f? is") == ["what", "is", "src/a.ts::f"]


def test_lines_and_infrastructure(spark, rows):
    x = spark.createDataFrame([("f", 1, 2, False, 1, 5), ("f", 0, 2, False, 1, 5), ("f", 2, -1, False, 1, 5), ("f", 3, 1, True, 1, 5), ("f", 4, 1, False, 5, 1), (" ", 1, 1, False, 1, 5), ("f", 1, 3, None, None, None)], "file string, line int, hits int, synthetic boolean, observed_start int, observed_end int")
    assert rows(telemetry.line_report(x)) == [("f", 2, 1, 5)]
    i = spark.createDataFrame([("eBPF", "pid"), ("ebpf", " "), ("log", "x")], "source string, subject string")
    assert rows(telemetry.valid_infrastructure(i)) == [("eBPF", "pid", False)]


def test_extractors(spark, rows):
    code = "const x = req.body.name;\nlog(x);\nconst y = escape(x);\ndb.query(y);\nbus.publish('orders.new', y);\nbus.on(\"done\", f); bus.send(`q1`)\nconst t = process.env.API_TOKEN || os.getenv('FEATURE_A');\n"
    arts = [
        ("r", "src/a.ts", code), ("r", "CODEOWNERS", "# c\n/src @org/core @ann\n\nbad\n"), ("r", "db/s.sql", "CREATE TABLE users (\n  id int,\n  PRIMARY KEY (id)\n);\nALTER TABLE `logs` ADD x int;\n"), ("r", "p.prisma", "model Post {\n  id Int\n  title String?\n  tags Tag[]\n}\n"),
        ("r", "a.graphql", "type User {\n  id: ID!\n  name: String\n}\n"), ("r", "m.tf", 'resource "aws_x" "a" {\n  name = "plain.text"\n  role = aws_role.b.arn\n  n = var.size\n  depends_on = [module.net]\n}\n'),
        ("r", "package.json", '{"name":"web","dependencies":{"core":"1"},"devDependencies":{"jest":"2"}}'), ("q", "Cargo.toml", '[package]\nname = "core"\n[dependencies]\nserde = "1"\n'), ("r", None, "x"), ("r", "n.ts", None),
    ]
    df = spark.createDataFrame(arts, "repo string, path string, content string")
    got = {(r.src.split("::")[-1], r.rel, r.dst.split("::")[-1]) for r in extract.extract(df).collect()}
    f = "file:src/a.ts"
    assert {("input:1", "trust_boundary", f), ("input:1", "sanitizes", "sanitizer:3"), ("sanitizer:3", "writes", "sink:4"), (f, "writes", "sink:4"), (f, "publishes", "topic:orders.new"), ("event:done", "consumes", f), (f, "publishes", "queue:q1"),
            (f, "reads", "config:API_TOKEN"), (f, "reads", "config:FEATURE_A"), ("owner:org/core", "owns", "ownership:/src"), ("owner:ann", "owns", "ownership:/src"), ("file:db/s.sql", "defines", "table:users"), ("table:users", "defines", "table:users.id"),
            ("file:db/s.sql", "migrates", "table:logs"), ("table:Post", "defines", "table:Post.title"), ("infra:aws_x.a", "depends_on", "infra:aws_role.b"), ("infra:aws_x.a", "depends_on", "infra:module.net")} <= got
    assert ("input:1", "assigns", "value:x") in got and ("sanitizer:3", "assigns", "value:t") in got and ("input:1", "assigns", "value:y") in got
    more = spark.createDataFrame([("r", "tests/a.py", "assert f(x) == 1\npytest.raises(E)\nif a == b: pass\nc += req.query\nd => e\n"), ("r", "b.ts", "const k = import.meta.env.API_KEY;\n")], "repo string, path string, content string")
    facts = {(r.src.split("::")[-1], r.rel, r.dst.split("::")[-1]) for r in extract.extract(more).collect()}
    assert facts == {("test:1", "asserts", "file:tests/a.py"), ("test:2", "exercises", "file:tests/a.py"), ("input:4", "trust_boundary", "file:tests/a.py"), ("input:4", "assigns", "value:c"), ("file:b.ts", "reads", "config:API_KEY")}
    assert not any("PRIMARY" in d or "var." in d or "plain" in d for _, _, d in got)
    assert rows(extract.contract_fields(extract.lines(df)), "owner", "field", "type", "required") == [("Post", "id", "Int", True), ("Post", "tags", "Tag[]", False), ("Post", "title", "String", False), ("User", "id", "ID", True), ("User", "name", "String", False)]
    needs = extract.manifests(df)
    assert rows(needs, "repo", "declared", "requires") == [("q", "core", "serde"), ("r", "web", "core"), ("r", "web", "jest")]
    ids = spark.createDataFrame([("q", "core"), ("r", "web")], "repo string, name string")
    assert rows(extract.resolve_manifests(needs, ids)) == [("r", "core", "q")]
