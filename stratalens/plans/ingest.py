"""Queries over sources, parsers, extractors and reports. Where the test tables hold results instead of raw texts, the raw texts are made from them first, so that what comes out can be held against them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import stage, table
from stratalens.operators import causality, extract, lane, resolve, structure, telemetry
from stratalens.plans import graphs, runtime
from stratalens.plans.facts import _FILES, import_rows
from stratalens.plans.scores import _DNA
from stratalens.plans.registry import registry
from stratalens.plans.views import FACTS_SQL, GRAPH_SQL, facts, graph
from stratalens.sources import files as sources
from stratalens.sources import otlp, parse, sinks

QUERIES, SQL, query = registry()


# parsers

_TEXTS = "WITH RECURSIVE t AS (SELECT file_id, repository AS repo, replace(path, chr(92), '/') AS path, lang, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS text FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL AND content IS NOT NULL AND content <> '')"
_LINES = _TEXTS + ", l AS (SELECT file_id, repo, path, lang, generate_subscripts(x, 1) AS line, unnest(x) AS text FROM (SELECT *, string_split(text, chr(10)) AS x FROM t))"


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, repo, path, lang, content) of files with content; paths with slashes."""
    return table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL AND content IS NOT NULL AND content <> ''").select(
        "file_id", F.col("repository").alias("repo"), F.translate("path", "\\", "/").alias("path"), "lang", "content")


def parsed(spark: SparkSession, d: str, langs: list[str] | None = None) -> DataFrame:
    """Parsed files, each under its id."""
    t = texts(spark, d)
    t = t.where(F.col("lang").isin(langs)) if langs else t
    return parse.analyse(t.select(F.concat_ws("\u0001", F.col("file_id").cast("string"), "repo", "path").alias("path"), F.coalesce("lang", sources.language(F.col("path"))).alias("language"), "content"))


def _of(analyses: DataFrame, column: str) -> DataFrame:
    key = F.split("path", "\u0001")
    return analyses.select(key[0].cast("long").alias("file_id"), key[1].alias("repo"), key[2].alias("path"), F.explode(column).alias("x"))


@query(_LINES + """, d AS (SELECT file_id, regexp_extract(text, '^(?:async )?(def|class) (\\w+)', 1) AS what, regexp_extract(text, '^(?:async )?(def|class) (\\w+)', 2) AS name, line FROM l WHERE lang = 'python')
SELECT file_id, name, CASE what WHEN 'def' THEN 'Function' ELSE 'Class' END AS kind, CAST(min(line) AS INT) AS line FROM d WHERE what <> '' GROUP BY ALL""")
def parse_python(spark: SparkSession, d: str) -> DataFrame:
    """Top-level functions and classes of Python files, and where they begin."""
    got = _of(parsed(spark, d, ["python"]), "nodes").select("file_id", F.col("x.name").alias("name"), F.col("x.kind").alias("kind"), F.col("x.line").alias("line"))
    return got.where("kind IN ('Function', 'Class')").select("file_id", "name", "kind", "line")


@query(_LINES + """, d AS (SELECT file_id, unnest(regexp_extract_all(text, '(?:^|[^\\w.$])function\\s+(\\w+)', 1)) AS name, line FROM l WHERE lang IN ('typescript', 'javascript'))
SELECT file_id, name, CAST(min(line) AS INT) AS line FROM d WHERE name <> '' GROUP BY ALL""")
def parse_ts(spark: SparkSession, d: str) -> DataFrame:
    """Functions declared in TypeScript and JavaScript files, and where they begin."""
    got = _of(parsed(spark, d, ["typescript", "javascript"]), "nodes").where("x.kind = 'Function'").select("file_id", F.col("x.name").alias("name"), F.col("x.line").alias("line"))
    return got.groupBy("file_id", "name").agg(F.min("line").alias("line"))


@query(_LINES + """, d AS (SELECT file_id, regexp_extract(text, '^import .*? from [''"]([^''"]+)[''"]', 1) AS source FROM l WHERE lang IN ('typescript', 'javascript')
 UNION ALL SELECT file_id, regexp_extract(text, '^from (\\S+) import ', 1) FROM l WHERE lang = 'python') SELECT DISTINCT file_id, source FROM d WHERE source <> ''""")
def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    """What TypeScript, JavaScript and Python files import names from."""
    return _of(parsed(spark, d, ["typescript", "javascript", "python"]), "imports").select("file_id", F.col("x.source").alias("source")).distinct()


@query()
def parse_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls in all five languages: from which function, to what, on which line."""
    return _of(parsed(spark, d), "calls").select("file_id", F.col("x.caller").alias("caller"), F.col("x.callee").alias("callee"), F.col("x.line").alias("line"))


def scan(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From parsed files (repo, path, nodes, imports, calls, relations) to the graph: nodes (repo, id, kind, name, path, line) and edges (repo, src, dst, kind, weight).

    The first node of an id counts and the first edge of a kind between two nodes. Imports link files, calls their functions, relations types of one file.
    """
    nodes = analyses.select("repo", "path", F.explode("nodes").alias("n")).select("repo", "n.id", "n.kind", "n.name", "path", "n.line")
    nodes = nodes.groupBy("repo", "id").agg(F.min(F.struct("line", "kind", "name", "path")).alias("r")).select("repo", "id", "r.kind", "r.name", "r.path", "r.line")
    node_file = lambda p: F.concat(p, F.lit("::file"))
    imports = resolve.imports(analyses.select("repo", "path"), analyses.select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", "i.source")).where("target IS NOT NULL")
    calls = resolve.calls(nodes, analyses.select("repo", "path", F.explode("calls").alias("c")).select("repo", "path", "c.caller", "c.callee"))
    types = resolve.type_relations(nodes, analyses.select("repo", "path", F.explode("relations").alias("r")).select("repo", "path", F.col("r.source").alias("source_type"), F.col("r.target").alias("target_type"), F.col("r.kind").alias("kind")))
    edges = imports.select("repo", node_file(F.col("path")).alias("src"), node_file(F.col("target")).alias("dst"), F.lit("import").alias("kind"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(calls.select("repo", "src", "dst", F.lit("calls").alias("kind"), F.lit(1.5).alias("weight"))).unionByName(types.select("repo", "src", "dst", "kind", F.lit(2.0).alias("weight")))
    return nodes, edges.distinct()


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Parsed files under their own paths; of files delivered twice the one of least id."""
    last = texts(spark, d).groupBy("repo", "path").agg(F.min(F.struct("file_id", "lang", "content")).alias("f")).select("repo", "path", "f.*")
    got = parse.analyse(last.select(F.col("file_id").cast("string").alias("path"), F.coalesce("lang", sources.language(F.col("path"))).alias("language"), "content"))
    own = last.select(F.col("file_id").cast("string").alias("id"), "repo", F.col("path").alias("p"))
    fix = lambda c: F.concat(F.col("p"), F.substring(c, F.length("id") + 1, F.length(c)))
    rows = stage(got.join(own, F.col("path") == F.col("id")), "analyses")
    nodes = F.transform("nodes", lambda n: F.struct(fix(n["id"]).alias("id"), n["kind"].alias("kind"), F.when(n["kind"] == "File", F.element_at(F.split("p", "/"), -1)).otherwise(n["name"]).alias("name"), n["line"].alias("line")))
    return rows.select("repo", F.col("p").alias("path"), nodes.alias("nodes"), "imports", "calls", "relations")


@query()
def scan_graph(spark: SparkSession, d: str) -> DataFrame:
    """A whole scan of the source texts: files parsed, nodes and edges made, counted by kind."""
    nodes, edges = scan(_scanned(spark, d))
    count = lambda df, what: df.groupBy("repo", F.lit(what).alias("record"), F.lower("kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node").unionByName(count(edges, "edge"))


# changes to a state of files

_CUT = "TIMESTAMP '2026-03-05 00:00:00'"
_STATE = "WITH s AS (SELECT repository || '/' || path AS path, min(file_id) AS v FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL AND scanned_at < " + _CUT + """ GROUP BY 1),
n AS (SELECT repository || '/' || path AS path, max(file_id) AS v, bool_and(coalesce(content, '') = '') AS gone FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL AND scanned_at >= """ + _CUT + " GROUP BY 1)"


@query(_STATE + " SELECT path, v FROM s WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, v FROM n WHERE NOT gone")
def incremental_delta(spark: SparkSession, d: str) -> DataFrame:
    """Files as first scanned, after a later batch of additions, changes and deletions (files that came back empty), applied as a whole or not at all."""
    f = table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL").withColumn("path", F.concat_ws("/", "repository", "path"))
    state = stage(f.where(f"scanned_at < {_CUT}").groupBy("path").agg(F.min("file_id").alias("v")), "state")
    later = f.where(f"scanned_at >= {_CUT}").groupBy("path").agg(F.max("file_id").alias("v"), F.min((F.coalesce("content", F.lit("")) == "")).alias("gone"))
    known = later.join(state.select("path", F.lit(True).alias("known")), "path", "left")
    kind = F.when(F.col("gone"), F.when(F.col("known"), "delete")).when(F.col("known"), "modify").otherwise("add")
    return resolve.apply_delta(state, stage(known.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "kind", "v"), "delta"))


_PAIRS = """WITH s AS (SELECT snapshot_id, min(repository) AS repo, min(taken_at) AS t, max(node_count) AS n, max(edge_count) AS e FROM snapshots GROUP BY 1),
p AS (SELECT repo, snapshot_id, lag(n) OVER w AS n0, lag(e) OVER w AS e0, n, e, lag(snapshot_id) OVER w AS was FROM s WINDOW w AS (PARTITION BY repo ORDER BY t, snapshot_id))"""


@query(_PAIRS + " SELECT repo, snapshot_id, CASE WHEN n0 IS NULL OR n IS NULL THEN 'unknown' WHEN n0 <> n THEN 'commit-changed' WHEN e0 IS NULL OR e IS NULL THEN 'head-only' WHEN e0 = e THEN 'fresh' ELSE 'worktree-changed' END AS freshness FROM p WHERE was IS NOT NULL")
def snapshot_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot against the one before, its number of nodes standing for the commit and of edges for the work tree."""
    from pyspark.sql import Window as W

    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("repository").alias("repo"), F.min("taken_at").alias("t"), F.max("node_count").alias("n"), F.max("edge_count").alias("e"))
    w = W.partitionBy("repo").orderBy("t", "snapshot_id")
    p = s.select("repo", "snapshot_id", "n", "e", F.lag("n").over(w).alias("n0"), F.lag("e").over(w).alias("e0"), F.lag("snapshot_id").over(w).alias("was")).where("was IS NOT NULL")
    return p.select("repo", "snapshot_id", resolve.freshness_of(F.col("n0"), F.col("e0"), F.col("n"), F.col("e")).alias("freshness"))


# OTLP documents

@query("WITH o AS (SELECT trace_id, span_id, parent_span_id, name, start_time_unix_nano AS s, end_time_unix_nano AS e, status.code AS code, " + runtime._ATTR + """ FROM otlp_spans WHERE name IS NOT NULL)
SELECT DISTINCT trace_id, span_id, parent_span_id, name, s AS start_unix_nano, e AS end_unix_nano, greatest(e - s, 0) / 1e6 AS duration_ms, coalesce(code = 2, false) AS is_error, """ + runtime.IDENTITY_SQL + " AS node_id FROM o")
def otlp_decode(spark: SparkSession, d: str) -> DataFrame:
    """Raw spans written as OTLP documents, one for each span, and read again."""
    raw = table(spark, d, "otlp_spans")
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.col("start_time_unix_nano").cast("string").alias("startTimeUnixNano"),
        F.col("end_time_unix_nano").cast("string").alias("endTimeUnixNano"), "status", pairs.alias("attributes"),
    )
    docs = raw.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))
    got = otlp.observed(otlp.spans_of(docs))
    return got.select("trace_id", "span_id", "parent_span_id", "name", "start_unix_nano", "end_unix_nano", "duration_ms", "is_error", "node_id").distinct()


# artifacts

#: Lines of code made of a file's calls, by the length of the callee's name.
_SHAPES = ["const {a} = req.body.{b};", "{a} = escape({a});", "db.query({b});", "bus.publish('{b}', {a});", "retry({b});", "mutex.enter({b});", "const k = process.env.KEY_{b};"]


def _shape_sql() -> str:
    part = lambda t: "'" + t.replace("'", "''").replace("{a}", "' || c.caller_name || '").replace("{b}", "' || c.callee_name || '") + "'"
    return "CASE length(c.callee_name) % 7 " + " ".join(f"WHEN {i} THEN {part(t)}" for i, t in enumerate(_SHAPES)) + " END"


def _artifact_sql() -> str:
    f = "'repo:' || repo || '::file:' || path"
    hit = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
    words = {name: w for name, *_, w in extract.SIGNALS}
    arms = [f"SELECT {f'{f} || chr(58) || chr(58) || {chr(39)}{n}:{chr(39)} || line' if source else f} AS src, '{rel}' AS rel, {f if source else f'{f} || chr(58) || chr(58) || {chr(39)}{n}:{chr(39)} || line'} AS dst FROM gen WHERE {hit(w)}"
            for n, _, rel, source, w in extract.SIGNALS if n not in ("sanitizer", "test")]
    value = "regexp_extract(text, '^(?:const )?(\\S+) = ', 1)"
    return _FILES + f""", one AS (SELECT repository AS repo, replace(path, chr(92), '/') AS path, arg_min(calls, file_id) AS calls FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL GROUP BY 1, 2),
calls AS (SELECT repo, path, unnest(calls) AS c FROM one), gen AS (SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY c.line, c.col, c.caller_name, c.callee_name) AS line, c.callee_name AS callee, {_shape_sql()} AS text FROM calls WHERE c.caller_name IS NOT NULL AND c.callee_name IS NOT NULL),
ev AS (SELECT repo, path, line, 1 AS o, {f} || '::input:' || line AS id, NULL AS rel, true AS opens FROM gen WHERE {hit(words['input'])} UNION ALL SELECT repo, path, line, 2, {f} || '::value:' || {value}, 'assigns', false FROM gen WHERE {value} <> ''
  UNION ALL SELECT repo, path, line, 3, {f} || '::sanitizer:' || line, 'sanitizes', true FROM gen WHERE {hit(words['sanitizer'])} UNION ALL SELECT repo, path, line, 4, {f} || '::sink:' || line, 'writes', false FROM gen WHERE {hit(words['sink'])}),
fl AS (SELECT *, last_value(CASE WHEN opens THEN id END IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ev)
SELECT DISTINCT src, rel, dst FROM ({' UNION ALL '.join(arms)} UNION ALL SELECT prev, rel, id FROM fl WHERE rel IS NOT NULL AND prev IS NOT NULL
 UNION ALL SELECT {f}, 'publishes', 'topic:' || callee FROM gen WHERE length(callee) % 7 = 3 UNION ALL SELECT {f}, 'reads', 'repo:' || repo || '::config:KEY_' || callee FROM gen WHERE length(callee) % 7 = 6)"""


@query(_artifact_sql())
def extract_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """All facts of source texts, which are made of each file's calls: inputs and what they reach, sinks, events, locks, retries, environment."""
    one = table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL").groupBy(F.col("repository").alias("repo"), F.translate("path", "\\", "/").alias("path")).agg(F.min_by("calls", "file_id").alias("calls"))
    call = F.filter("calls", lambda c: c["caller_name"].isNotNull() & c["callee_name"].isNotNull())
    keyed = F.array_sort(F.transform(call, lambda c: F.struct(c["line"].alias("line"), c["col"].alias("col"), c["caller_name"].alias("a"), c["callee_name"].alias("b"))))

    def line(c):
        out = None
        for i, t in enumerate(_SHAPES):
            pieces = [c[x[1]] if x in ("{a}", "{b}") else F.lit(x) for x in re.split(r"(\{[ab]\})", t) if x]
            out = (F.when if out is None else out.when)(F.length(c["b"]) % 7 == i, F.concat(*pieces))
        return out

    arts = one.select("repo", "path", F.array_join(F.transform(keyed, line), "\n").alias("content")).where("content <> ''")
    return extract.extract(arts).select("src", "rel", "dst").distinct()


_OWNED = GRAPH_SQL + ", o AS (SELECT DISTINCT repo, path, owner FROM nodes WHERE owner <> '' AND path <> '' AND lower(kind) = 'file')"


@query(_OWNED + " SELECT 'owner:' || owner AS src, 'owns' AS rel, 'repo:' || repo || '::ownership:/' || path AS dst FROM o")
def extract_codeowners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of files, written as a CODEOWNERS file for each repository and read again."""
    own = graph(spark, d)[0].where("owner <> '' AND path <> '' AND lower(kind) = 'file'").select("repo", F.concat(F.lit("/"), "path", F.lit(" @"), "owner").alias("line"))
    arts = own.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("content")).withColumn("path", F.lit("CODEOWNERS"))
    return extract.codeowners(extract.lines(arts)).where("rel = 'owns'").select("src", "rel", "dst").distinct()


_COLUMNS = "WITH e AS (SELECT DISTINCT repository AS repo, name FROM causal_entities WHERE kind = 'table' AND name <> '' AND repository IS NOT NULL)"


@query(_COLUMNS + " SELECT repo, name AS tab, c AS col FROM e, (SELECT unnest(['id', 'created_at', 'amount']) AS c)")
def extract_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Tables of each repository, written as SQL and read again."""
    name = F.when(F.col("name") != "", F.concat(F.lit("CREATE TABLE "), "name", F.lit(" (\n  id bigint,\n  created_at timestamp,\n  amount int,\n  PRIMARY KEY (id)\n);")))
    ddl = table(spark, d, "causal_entities").where("kind = 'table' AND repository IS NOT NULL").select(F.col("repository").alias("repo"), name.alias("ddl")).where("ddl IS NOT NULL").distinct()
    arts = ddl.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("ddl")), "\n").alias("content")).withColumn("path", F.lit("schema.sql"))
    got = extract.schemas(extract.lines(arts)).where("kind = 'column'").select(F.regexp_extract("src", "^repo:(.*)::table:", 1).alias("repo"), F.regexp_extract("src", "::table:(.*)$", 1).alias("tab"), F.col("dst"))
    return got.select("repo", "tab", F.element_at(F.split("dst", "\\."), -1).alias("col")).distinct()


_NEEDS = _FILES + ", r AS (SELECT DISTINCT repo, nullif(CASE WHEN s LIKE '@%' THEN regexp_extract(s, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(s, '^([^/.:]+)', 1) END, '') AS requires FROM (SELECT repo, i.source_name AS s FROM (SELECT repo, unnest(imports) AS i FROM f)) WHERE NOT regexp_matches(s, '^(\\.|/|crate::|self::|super::)'))"


@query(_NEEDS + " SELECT repo, 'package.json' AS path, repo AS declared, requires FROM r WHERE requires IS NOT NULL")
def extract_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Packages that each repository imports, written as its manifest and read again."""
    needs = resolve.external_dependencies(import_rows(spark, d)).groupBy("repo").agg(F.collect_set("package").alias("p"))
    text = F.to_json(F.struct(F.col("repo").alias("name"), F.map_from_arrays("p", F.transform("p", lambda x: F.lit("1.0.0"))).alias("dependencies")))
    arts = needs.select("repo", F.lit("package.json").alias("path"), text.alias("content"))
    return extract.manifests(arts).select("repo", "path", "declared", "requires")


@query(_FILES + ", x AS (SELECT repo, path, unnest(exports) AS e FROM f) SELECT DISTINCT repo, string_split(path, '/')[-1] AS owner, e.name AS field, e.kind AS type, coalesce(e.is_public, false) AS required FROM x WHERE regexp_matches(e.name, '^\\w+$') AND regexp_matches(e.kind, '^\\w+$') AND regexp_matches(string_split(path, '/')[-1], '^[A-Za-z]\\w*\\.\\w+$')")
def extract_contract_fields(spark: SparkSession, d: str) -> DataFrame:
    """Exports of each file, written as a GraphQL type and read again; public ones are required."""
    from stratalens.plans.facts import files

    name = F.element_at(F.split("path", "/"), -1)
    x = files(spark, d).select("repo", name.alias("owner"), F.explode("exports").alias("e")).where(r"e.name RLIKE '^[A-Za-z0-9_]+$' AND e.kind RLIKE '^[A-Za-z0-9_]+$' AND owner RLIKE '^[A-Za-z][A-Za-z0-9_]*[.][A-Za-z0-9_]+$'")
    line = F.concat(F.lit("  "), "e.name", F.lit(": "), "e.kind", F.when(F.coalesce("e.is_public", F.lit(False)), "!").otherwise(""))
    kind = F.concat(F.lit("type "), F.replace("owner", F.lit("."), F.lit("__dot__")), F.lit(" {\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n}"))
    arts = x.groupBy("repo", "owner").agg(kind.alias("content")).select("repo", F.concat("owner", F.lit(".graphql")).alias("path"), "content")
    got = extract.contract_fields(extract.lines(arts))
    return got.select("repo", F.replace("owner", F.lit("__dot__"), F.lit(".")).alias("owner"), "field", "type", "required").distinct()


@query(FACTS_SQL + ", k AS (SELECT DISTINCT id, regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') AS n FROM entities) SELECT DISTINCT 'infra:kube_app.' || a.n AS src, 'infra:kube_app.' || b.n AS dst FROM facts f JOIN k a ON a.id = f.src JOIN k b ON b.id = f.dst WHERE f.rel = 'depends_on' AND a.n <> b.n")
def extract_terraform(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between entities, written as Terraform resources and read again."""
    fac = facts(spark, d)[1].where("rel = 'depends_on'")
    n = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    pairs = fac.select(n("src").alias("a"), n("dst").alias("b")).where("a <> b").distinct()
    block = F.concat(F.lit('resource "kube_app" "'), "a", F.lit('" {\n  name = "plain.text"\n  n = var.size\n'), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("  needs = kube_app."), "b"))), "\n"), F.lit("\n}"))
    arts = pairs.groupBy("a").agg(block.alias("content")).select(F.lit("all").alias("repo"), F.concat("a", F.lit(".tf")).alias("path"), "content")
    return extract.terraform_refs(extract.lines(arts)).select("src", "dst").distinct()


@query(_FILES + ", x AS (SELECT DISTINCT repo, path, unnest(list_transform(exports, lambda e: e.name)) AS name FROM f) SELECT DISTINCT repo AS service, CASE WHEN length(name) % 2 = 0 THEN 'GET' ELSE 'POST' END || ':/' || name AS key FROM x WHERE regexp_matches(name, '^\\w+$')")
def openapi_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Exports of each repository, written as an OpenAPI specification and read again."""
    from stratalens.plans.facts import files

    x = files(spark, d).select("repo", F.explode("exports").alias("e")).select("repo", F.col("e.name").alias("name")).where("name RLIKE '^[A-Za-z0-9_]+$'").distinct()
    entry = F.concat(F.lit('"/'), "name", F.lit('":{"'), F.when(F.length("name") % 2 == 0, "get").otherwise("post"), F.lit('":{"responses":{}},"parameters":{}}'))
    spec = x.groupBy(F.col("repo").alias("service")).agg(F.concat(F.lit('{"paths":{'), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}}")).alias("content"))
    return sources.openapi_endpoints(spec).select("service", "key")


_LOG = "WITH s AS (SELECT snapshot_id, min(repository) AS repo, epoch_ms(min(taken_at)) // 1000 AS at FROM snapshots GROUP BY 1), n AS (SELECT snapshot_id, path, count(*) AS adds FROM snapshot_nodes WHERE path <> '' GROUP BY 1, 2)"


@query(_LOG + " SELECT s.snapshot_id AS id, s.repo AS author, s.at, n.path, n.adds, 0 AS dels FROM n JOIN s USING (snapshot_id)")
def git_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots written as a log, each a commit that adds the lines of its nodes to their files, and read again."""
    at = F.unix_seconds(F.min("taken_at").cast("timestamp"))
    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("repository").alias("repo"), at.alias("at"))
    n = table(spark, d, "snapshot_nodes").where("path <> ''").groupBy("snapshot_id", "path").agg(F.count(F.lit(1)).alias("adds"))
    body = n.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("adds").cast("string"), F.lit("0"), "path"))), "\n").alias("body"))
    log = s.join(body, "snapshot_id").select(F.concat(F.lit("\u001e"), F.concat_ws("|", "snapshot_id", "repo", F.col("at").cast("string"), F.lit("scan")), F.lit("\n"), "body", F.lit("\n")).alias("value"))
    return sources.git_log(log).select("id", "author", "at", "path", "adds", F.col("dels").cast("int").alias("dels"))


# facts and entities

@query("WITH e AS (SELECT DISTINCT entity_id AS id FROM causal_entities WHERE entity_id IS NOT NULL), ok AS (SELECT DISTINCT from_id AS src, to_id AS dst, relation AS rel, evidence AS ev, confidence AS conf, cond FROM causal_facts WHERE confidence >= 0 AND confidence <= 1 AND from_id IN (SELECT id FROM e) AND to_id IN (SELECT id FROM e)) SELECT * FROM ok")
def accepted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Delivered facts whose ends exist and whose confidence lies in 0..1, exact repetitions once."""
    e = table(spark, d, "causal_entities").select(F.col("entity_id").alias("id")).where("id IS NOT NULL")
    f = table(spark, d, "causal_facts").select("fact_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("relation").alias("rel"), F.col("evidence").alias("ev"), F.col("confidence").alias("conf"), "cond")
    return causality.accept_facts(f, e).select("src", "dst", "rel", "ev", "conf", "cond")


_BUNDLES = "WITH b AS (SELECT entity_id AS id, kind, name, repository AS repo, path, attributes, row_number() OVER (PARTITION BY entity_id ORDER BY recorded_at, deleted_at, kind, name, repository, path, CAST(map_entries(attributes) AS VARCHAR)) AS ord FROM (SELECT DISTINCT * REPLACE (map_from_entries(list_sort(map_entries(attributes))) AS attributes) FROM causal_entities WHERE entity_id IS NOT NULL))"


@query(_BUNDLES + """, a AS (SELECT id, ord, unnest(map_entries(attributes)) AS e FROM b), k AS (SELECT id, e.key AS key, arg_min(e.value, ord) AS value FROM a GROUP BY 1, 2)
SELECT b.id, arg_min(kind, ord) FILTER (kind IS NOT NULL) AS kind, arg_min(name, ord) FILTER (name IS NOT NULL) AS name, arg_min(repo, ord) FILTER (repo IS NOT NULL) AS repo, arg_min(path, ord) FILTER (path IS NOT NULL) AS path,
 coalesce((SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM k WHERE k.id = b.id), '') AS attributes FROM b GROUP BY b.id""")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Lifetimes of an entity as bundles of its data, by time: of each field the first that is known, attributes of earlier ones winning."""
    from pyspark.sql import Window as W

    e = table(spark, d, "causal_entities").where("entity_id IS NOT NULL").select(
        F.col("entity_id").alias("id"), "kind", "name", F.col("repository").alias("repo"), "path", F.array_sort(F.map_entries("attributes")).alias("a"), "recorded_at", "deleted_at").distinct()
    last = lambda c: F.col(c).asc_nulls_last()
    order = F.row_number().over(W.partitionBy("id").orderBy(*[last(c) for c in ("recorded_at", "deleted_at", "kind", "name", "repo", "path")], F.col("a").cast("string")))
    got = causality.merge_entities(e.select("id", "kind", "name", "repo", "path", F.map_from_entries("a").alias("attributes"), order.alias("ord")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return got.select("id", "kind", "name", "repo", "path", text.alias("attributes"))


_HOT = """WITH m AS (SELECT target_node AS id, sum(total_latency_ms) / sum(invocation_count) AS lat, sum(error_count) / sum(invocation_count) AS err, sum(invocation_count) AS mem FROM (SELECT DISTINCT * FROM runtime_edges)
 WHERE target_node IS NOT NULL AND invocation_count > 0 AND total_latency_ms >= 0 AND error_count >= 0 GROUP BY 1)"""


@query(_HOT + " SELECT id, round(CASE WHEN lat > 1 THEN log10(lat) ELSE 0 END + 0.2 * log10(mem + 1) + 10 * err, 6) AS score FROM m WHERE lat <> 0 OR mem <> 0 OR err <> 0")
def runtime_hotspots(spark: SparkSession, d: str) -> DataFrame:
    """How much latency, calls (in place of memory) and errors of each target tell."""
    r = table(spark, d, "runtime_edges").distinct().where("target_node IS NOT NULL AND invocation_count > 0 AND total_latency_ms >= 0 AND error_count >= 0")
    n = F.sum("invocation_count")
    got = r.groupBy(F.col("target_node").alias("id")).agg((F.sum("total_latency_ms") / n).alias("lat"), (F.sum("error_count") / n).alias("err"), n.alias("mem"))
    kv = F.create_map(F.lit("runtime.latency_ms"), F.col("lat").cast("string"), F.lit("runtime.error_rate"), F.col("err").cast("string"), F.lit("runtime.memory_bytes"), F.col("mem").cast("string"))
    return causality.runtime_hotspots(got.select("id", kv.alias("attributes")))


@query("""SELECT coalesce(nullif(trim(trace_id), ''), 'runtime:observation:' || target_node || ':' || coalesce(last_seen_unix_nano // 1000000, 0)) AS src, target_node AS dst, 'observes' AS rel, 'runtime' AS ev, 1.0::DOUBLE AS conf, min(last_seen_unix_nano // 1000000) AS ms FROM runtime_edges WHERE target_node IS NOT NULL GROUP BY 1, 2""")
def runtime_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observed calls as facts: which trace observed which node."""
    return causality.observations(table(spark, d, "runtime_edges").withColumn("ms", F.expr("last_seen_unix_nano div 1000000")), "trace_id", "target_node", "ms")


@query(FACTS_SQL + """, ep AS (SELECT fact_id AS id, split_part(src, ':', 1) AS project, ev, conf, coalesce(ms, 0) AS created FROM facts), kept AS (SELECT * FROM ep WHERE project = 'symbol' AND ev <> 'predicted') SELECT CAST(id AS VARCHAR) AS id, conf, created FROM kept ORDER BY created DESC, CAST(id AS VARCHAR) LIMIT 2000""")
def lane_remember(spark: SparkSession, d: str) -> DataFrame:
    """Facts as episodes of a project: the newest 2,000 of those that carry no prediction."""
    f = facts(spark, d)[1]
    ep = f.select(F.split("src", ":")[0].alias("project_id"), F.col("fact_id").cast("string").alias("id"), F.col("ev").alias("evidence"), F.col("conf").alias("confidence"), F.lit(1.0).alias("observed_score"), F.coalesce("ms", F.lit(0)).alias("created_at_ms"), F.array("src", "dst").alias("entities"))
    return lane.remember(ep, "symbol").select("id", F.col("confidence").alias("conf"), F.col("created_at_ms").alias("created"))


@query("SELECT CAST(user_id AS VARCHAR) AS subject, count(*) AS n, false AS proves_source FROM events WHERE lower(event_type) = 'click' AND user_id IS NOT NULL GROUP BY 1")
def infrastructure_observations(spark: SparkSession, d: str) -> DataFrame:
    """Events as observations of infrastructure, one type of them standing for those by eBPF; they never prove that source code ran."""
    rows = table(spark, d, "events").select(F.when(F.lower("event_type") == "click", "eBPF").otherwise("log").alias("source"), F.col("user_id").cast("string").alias("subject"))
    return telemetry.valid_infrastructure(rows).groupBy("subject", "proves_source").agg(F.count(F.lit(1)).alias("n"))


# boundaries by annotation, relations of types

_SUFFIXED = [s for s, _ in structure.NAME_SUFFIXES] + ["", "Thing"]
_SUFFIXED_SQL = "name || (['" + "', '".join(_SUFFIXED) + f"'])[length(id) % {len(_SUFFIXED)} + 1]"


@query(GRAPH_SQL + f", n AS (SELECT repo, id, {_SUFFIXED_SQL} AS name FROM nodes), b AS (SELECT repo, CASE " + " ".join(f"WHEN ends_with(name, '{s}') THEN '{b}'" for s, b in structure.NAME_SUFFIXES) + " END AS boundary, id FROM n) SELECT * FROM b WHERE boundary IS NOT NULL")
def naming_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers by the usual endings of names, which nodes get by the length of their id."""
    name = F.concat("name", F.element_at(F.lit(_SUFFIXED), (F.length("id") % len(_SUFFIXED) + 1).cast("int")))
    return structure.naming_boundaries(graph(spark, d)[0].withColumn("name", name))


_TEST_PATHS = ["{p}", "tests/{p}", "a/__tests__/{p}", "{d}/test_{n}", "{d}/spec_{n}", "{d}/{s}_test.go", "{d}/{s}Test.java", "{d}/{s}_spec.rb", "{d}/{s}.test.ts", "{d}/{s}.spec.tsx", "attest/{p}", "{d}/latest_{n}", "contest\\{p}", "test\\{p}"]


def _test_path_sql() -> str:
    part = {"p": "path", "n": "n", "s": "s", "d": "d"}
    texts_ = ["'" + re.sub(r"\{(\w)\}", lambda m: f"' || {part[m[1]]} || '", t) + "'" for t in _TEST_PATHS]
    return GRAPH_SQL + f""", f AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS n, string_split(string_split(path, '/')[-1], '.')[1] AS s, regexp_replace(path, '/[^/]*$', '') AS d FROM nodes WHERE path LIKE '%/%'),
x AS (SELECT DISTINCT unnest([{', '.join(texts_)}]) AS path FROM f), y AS (SELECT path, string_split(replace(path, chr(92), '/'), '/') AS parts FROM x), z AS (SELECT *, parts[-1] AS n, string_split(parts[-1], '.')[1] AS s FROM y)
SELECT path, list_has_any(parts, ['test', 'tests', 'spec', 'specs', '__tests__', '__test__']) OR starts_with(s, 'test_') OR starts_with(s, 'spec_') OR ends_with(s, '_test') OR ends_with(s, 'Test') OR ends_with(s, '_spec') OR contains(n, '.test.') OR contains(n, '.spec.') AS test FROM z"""


@query(_test_path_sql())
def test_paths(spark: SparkSession, d: str) -> DataFrame:
    """Which paths are those of tests: files' own paths, and variants of them that look like tests or nearly so."""
    path = graph(spark, d)[0].where("path LIKE '%/%'").select("path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    parts = {"{p}": F.col("path"), "{n}": name, "{s}": F.split(name, r"\.")[0], "{d}": F.regexp_replace("path", "/[^/]*$", "")}
    variants = [F.concat(*[parts[x] if x in parts else F.lit(x) for x in re.split(r"(\{\w\})", t) if x]) for t in _TEST_PATHS]
    return path.select(F.explode(F.array(*variants)).alias("path")).distinct().select("path", structure.is_test(F.col("path")).alias("test"))


_NOTES = {"service": "@Service", "api": "@RestController", "data": "@Repository", "domain": "@Entity", "ui": "@Controller", "core": "@Injectable", "infra": "@Component"}
_NOTE_SQL = "CASE element_at(metadata, 'layer')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NOTES.items()) + " END"
_LAYER_SQL = "CASE " + " ".join(f"WHEN contains(note, '{s}') THEN '{b}'" for s, b in structure.ANNOTATIONS) + " END"


@query(f"WITH n AS (SELECT DISTINCT snapshot_id, node_id AS id, {_NOTE_SQL} AS note FROM snapshot_nodes WHERE node_id IS NOT NULL), b AS (SELECT snapshot_id AS repo, id, {_LAYER_SQL} AS boundary FROM n) SELECT DISTINCT repo, boundary, id FROM b WHERE boundary IS NOT NULL")
def annotation_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Layers by annotation, which the layer in a node's metadata stands for."""
    note = F.lit(None).cast("string")
    for k, v in _NOTES.items():
        note = F.when(F.col("metadata")["layer"] == k, v).otherwise(note)
    n = table(spark, d, "snapshot_nodes").where("node_id IS NOT NULL").select(F.col("snapshot_id").alias("repo"), F.col("node_id").alias("id"), note.alias("annotations")).distinct()
    return structure.annotation_boundaries(n).distinct()


@query(GRAPH_SQL + ", r AS (SELECT DISTINCT repo, split_part(src, '::', 1) AS path, split_part(src, '::', 2) AS a, split_part(dst, '::', 2) AS b, kind FROM edges WHERE kind IN ('extends', 'implements')) SELECT DISTINCT r.repo, r.path || '::' || r.a AS src, r.path || '::' || r.b AS dst, r.kind FROM r JOIN nodes x ON x.repo = r.repo AND x.id = r.path || '::' || r.a JOIN nodes y ON y.repo = r.repo AND y.id = r.path || '::' || r.b")
def type_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of types by name: those whose both types are in the file that names them."""
    nodes, edges = graph(spark, d)
    part = lambda c, i: F.split(c, "::")[i]
    rows = edges.where("kind IN ('extends', 'implements')").select("repo", part("src", 0).alias("path"), part("src", 1).alias("source_type"), part("dst", 1).alias("target_type"), "kind")
    return resolve.type_relations(nodes, rows)


# reports

@query(GRAPH_SQL + graphs._ALL + """ SELECT '{"ruleId":"' || kind || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || concat_ws(' -> ', src, dst) ||
 '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || split_part(src, '::', 1) || '"}}}]}' AS json FROM violations""")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sarif(graphs.violations(spark, d))


@query(GRAPH_SQL + graphs._ALL + """ SELECT '<testcase name="' || replace(kind || ': ' || src, '>', '&gt;') || '"><failure message="' || replace(concat_ws(' -> ', src, dst), '>', '&gt;') || '"/></testcase>' AS xml FROM violations""")
def junit_cases(spark: SparkSession, d: str) -> DataFrame:
    return sinks.junit(graphs.violations(spark, d))


@query(GRAPH_SQL + """ SELECT '"' || src || '" -> "' || dst || '" [label="' || kind || '"];' AS line FROM edges""")
def dot_edges(spark: SparkSession, d: str) -> DataFrame:
    return sinks.dot(graph(spark, d)[1])


@query(GRAPH_SQL + """ SELECT 'n' || substr(md5(src), 1, 10) || '["' || src || '"] -->|' || kind || '| n' || substr(md5(dst), 1, 10) || '["' || dst || '"]' AS line FROM edges""")
def mermaid_edges(spark: SparkSession, d: str) -> DataFrame:
    return sinks.mermaid(graph(spark, d)[1])


@query(GRAPH_SQL + """ SELECT '<node id="' || id || '"/>' AS line FROM nodes UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '" label="' || kind || '"/>' FROM edges""")
def graphml_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.graphml(*graph(spark, d))


@query(GRAPH_SQL + " SELECT '| ' || concat_ws(' | ', repo, id, kind, name, path, CAST(line AS VARCHAR)) || ' |' AS line FROM (SELECT repo, id, coalesce(kind, '') AS kind, coalesce(name, '') AS name, coalesce(path, '') AS path, coalesce(CAST(line AS VARCHAR), '') AS line FROM nodes)")
def markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_rows(graph(spark, d)[0].select("repo", "id", "kind", "name", "path", "line"))


@query(GRAPH_SQL + graphs._PATHB + graphs._RULES + """, b AS (SELECT repo, boundary, count(*) AS members FROM pb GROUP BY 1, 2), f AS (SELECT boundary, string_agg(token, ', ' ORDER BY ord) AS tokens FROM rules GROUP BY 1)
SELECT repo, boundary, 1 AS place, '### Boundary: ' || boundary AS line FROM b UNION ALL SELECT repo, boundary, 2, '- Members: ' || members FROM b UNION ALL SELECT repo, b.boundary, 3, '- Forbidden dependency tokens: ' || tokens FROM b JOIN f USING (boundary)""")
def guideline_lines(spark: SparkSession, d: str) -> DataFrame:
    """Guidelines from the inferred boundaries: for each its heading, its size and what it must not depend on."""
    return structure.guidelines(structure.path_boundaries(graph(spark, d)[0]), graphs.PATH_RULES)


@query()
def snapshot_digests(spark: SparkSession, d: str) -> DataFrame:
    """One digest of the nodes of each repository's latest snapshot, by which equal states are known."""
    return resolve.fingerprint(graph(spark, d)[0], ["id", "kind", "name", "path", "line"], ["repo"])


@query(_DNA + " SELECT * FROM dna ORDER BY risk DESC, repo, id LIMIT 20")
def language_dna(spark: SparkSession, d: str) -> DataFrame:
    """The query language end to end: the twenty riskiest nodes."""
    from stratalens.plans import aql

    return aql.run(spark, d, "DNA LIMIT 20")
