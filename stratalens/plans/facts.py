"""Queries on history, contracts, federation, causal facts and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small, stage, table
from stratalens.operators import causality as c
from stratalens.operators import history, lane, resolve
from stratalens.plans import graphs, upkeep
from stratalens.plans.registry import registry
from stratalens.plans.views import FACTS_SQL, GRAPH_SQL, SPANS_SQL, facts, graph, spans

QUERIES, SQL, query = registry()


# imports and calls

_FILES = "WITH RECURSIVE f AS (SELECT repository AS repo, replace(path, chr(92), '/') AS path, imports, calls, exports, nodes FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL)"


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL").select(F.col("repository").alias("repo"), F.translate("path", "\\", "/").alias("path"), "imports", "calls", "exports", "nodes")


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("repo", "path", F.explode("imports").alias("i")).select("repo", "path", F.col("i.source_name").alias("source"), F.col("i.symbols").alias("symbols")).where("source IS NOT NULL AND source <> ''")


def known_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("repo", "path").unionByName(graph(spark, d)[0].select("repo", "path")).where("path IS NOT NULL").distinct()


_SUFFIX = "['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.py', '.go', '.rs', '.java', '/index.ts', '/index.tsx', '/index.js', '/index.py', '/mod.rs']"
_IMPORTS = f""", i AS (SELECT DISTINCT repo, path, s.source_name AS source FROM (SELECT repo, path, unnest(imports) AS s FROM f) WHERE s.source_name <> ''),
kf AS (SELECT repo, path FROM f UNION SELECT repo, path FROM nodes WHERE path IS NOT NULL),
tail0 AS (SELECT repo, path, string_split(path, '/') AS p FROM kf), tail AS (SELECT repo, path, array_to_string(p[k:len(p)], '/') AS suffix FROM (SELECT *, unnest(generate_series(1, len(p))) AS k FROM tail0)),
tt AS (SELECT repo, suffix, coalesce(max(path) FILTER (path = suffix), CASE WHEN count(*) = 1 THEN min(path) END) AS target FROM tail GROUP BY 1, 2),
up AS (SELECT *, len(regexp_extract(source, '^(\\.\\./)*')) // 3 AS ups, string_split(path, '/') AS pp, replace(regexp_replace(source, '^(crate::)*(self::)*(super::)*', ''), '::', '/') AS rust,
  CASE WHEN contains(source, '.') AND NOT contains(source, '/') THEN replace(source, '.', '/') ELSE ltrim(source, '/') END AS plain FROM i),
base AS (SELECT repo, path, source, unnest(b) AS b, generate_subscripts(b, 1) AS n FROM (SELECT *, CASE WHEN source LIKE '.%' THEN [array_to_string(list_concat(pp[1:greatest(len(pp) - 1 - ups, 0)], [regexp_replace(source, '^(\\./|\\.\\./)+', '')]), '/')]
  WHEN regexp_matches(source, '^(crate|self|super)::') THEN [CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) || '/src/' ELSE 'src/' END || rust] ELSE [plain, 'src/' || plain] END AS b FROM up)),
cand AS (SELECT repo, path, source, 15 * n + k AS k, b || ({_SUFFIX})[k] AS suffix FROM (SELECT *, unnest(generate_series(1, 15)) AS k FROM base)),
imp AS (SELECT i.repo, i.path, i.source, arg_min(t.target, c.k) AS target FROM i LEFT JOIN cand c ON c.repo = i.repo AND c.path = i.path AND c.source = i.source LEFT JOIN tt t ON t.repo = c.repo AND t.suffix = c.suffix AND t.target IS NOT NULL
  GROUP BY 1, 2, 3)"""
_GF = GRAPH_SQL + "," + _FILES.replace("WITH RECURSIVE ", " ")


@query(_GF + _IMPORTS.replace("arg_min(t.target, c.k)", "arg_min(t.target, c.k) FILTER (t.target IS NOT NULL)") + " SELECT * FROM imp")
def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolve.imports(known_files(spark, d), import_rows(spark, d))


@query(_GF + """, n AS (SELECT repo, id, name, lower(kind) AS kind FROM nodes), cl AS (SELECT DISTINCT repo, path, x.caller_name AS caller, x.callee_name AS callee FROM (SELECT repo, path, unnest(calls) AS x FROM f) WHERE x.caller_name IS NOT NULL AND x.callee_name IS NOT NULL),
nm AS (SELECT repo, name AS callee, id FROM n WHERE kind IN ('function', 'method') AND name IS NOT NULL UNION SELECT repo, string_split(id, '::')[-1], id FROM n WHERE kind IN ('function', 'method')), one AS (SELECT repo, callee, min(id) AS far FROM nm GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT c.repo, c.path, c.caller, c.callee, c.path || '::' || c.caller AS src, coalesce(l.id, o.far) AS dst FROM cl c JOIN n s ON s.repo = c.repo AND s.id = c.path || '::' || c.caller LEFT JOIN n l ON l.repo = c.repo AND l.id = c.path || '::' || c.callee
 LEFT JOIN one o ON o.repo = c.repo AND o.callee = c.callee WHERE coalesce(l.id, o.far) IS NOT NULL""")
def call_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select("repo", "path", F.explode("calls").alias("x")).select("repo", "path", F.col("x.caller_name").alias("caller"), F.col("x.callee_name").alias("callee")).where("caller IS NOT NULL AND callee IS NOT NULL")
    return resolve.calls(graph(spark, d)[0], rows)


@query(_FILES + """, i AS (SELECT repo, s.source_name AS source FROM (SELECT repo, unnest(imports) AS s FROM f)) SELECT DISTINCT repo, nullif(CASE WHEN source LIKE '@%' THEN regexp_extract(source, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(source, '^([^/.:]+)', 1) END, '') AS package
FROM i WHERE NOT regexp_matches(source, '^(\\.|/|crate::|self::|super::)') AND nullif(CASE WHEN source LIKE '@%' THEN regexp_extract(source, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(source, '^([^/.:]+)', 1) END, '') IS NOT NULL""")
def external_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return resolve.external_dependencies(import_rows(spark, d))


# history

_COMMITS = upkeep._P2.rstrip() + """, rows AS (SELECT f.snapshot_id AS id, split_part(record_id, '::', 1) AS path, CAST(change_type IN ('added', 'changed') AS INT) AS adds, CAST(change_type IN ('removed', 'changed') AS INT) AS dels FROM found f WHERE record_type = 'node'),
commits AS (SELECT s.repository AS repo, r.id, s.taken_at AS "at", count(DISTINCT path) AS files, CAST(sum(adds) AS BIGINT) AS adds, CAST(sum(dels) AS BIGINT) AS dels, greatest(""" + " + ".join(f"CAST(bool_or(contains(lower(path), '{z}')) AS INT)" for z in history.ZONES) + """ - 1, 0) AS drift FROM rows r JOIN s ON s.snapshot_id = r.id GROUP BY 1, 2, 3),
risky AS (SELECT *, round(least(least(ln(1 + adds + dels) / 10, 0.35) + least(files / 40, 0.25) + least(0.12 * drift, 0.4), 1.0), 6) AS risk FROM commits)"""


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot after a repository's first as a commit of its node changes."""
    once = table(spark, d, "snapshots").groupBy(F.col("snapshot_id").alias("id")).agg(F.min("repository").alias("repo"), F.min("taken_at").alias("at"))
    rows = upkeep._changes(spark, d).where("record_type = 'node'").select(
        F.col("snapshot_id").alias("id"), F.split("record_id", "::")[0].alias("path"), F.col("change_type").isin("added", "changed").cast("int").alias("adds"), F.col("change_type").isin("removed", "changed").cast("int").alias("dels"))
    return rows.join(small(once), "id")


@query(_COMMITS + " SELECT repo, id, files, adds, dels, drift, risk FROM risky")
def commit_risk(spark: SparkSession, d: str) -> DataFrame:
    return history.commit_risk(commits(spark, d)).drop("at")


@query(_COMMITS + """, rr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "at", id) AS a, row_number() OVER (PARTITION BY repo ORDER BY "at" DESC, id DESC) AS b FROM risky),
t AS (SELECT repo, count(*) AS commits, max(risk) AS worst, avg(risk) FILTER (b <= 5) - avg(risk) FILTER (a <= 5) AS diff FROM rr GROUP BY 1) SELECT repo, commits, worst, CASE WHEN commits < 6 THEN 'stable' WHEN diff > 0.08 THEN 'worsening' WHEN diff < -0.08 THEN 'improving' ELSE 'stable' END AS trend FROM t""")
def commit_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.trend(history.commit_risk(commits(spark, d)))


_HORIZON = 3 * 86_400_000_000
_SHIFT = SPANS_SQL + f""", win AS (SELECT CAST(floor(start / 86400000000000) AS BIGINT) * 86400000000 AS lo, (CAST(floor(start / 86400000000000) AS BIGINT) + 1) * 86400000000 AS hi, count(*) AS executions, avg(CASE WHEN err THEN 1.0 ELSE 0.0 END) AS rate FROM spans GROUP BY 1, 2),
dep AS (SELECT entity_id AS id, min(repository) AS repo, epoch_us(min(recorded_at)) AS ts FROM causal_entities WHERE kind IN ('service', 'job', 'config', 'api') GROUP BY 1),
sh AS (SELECT d.id, d.repo, (SELECT arg_max(executions, hi) FROM win w WHERE w.hi <= d.ts) AS before, (SELECT arg_max(rate, hi) FROM win w WHERE w.hi <= d.ts) AS rate_before,
 (SELECT arg_min(executions, lo) FROM win w WHERE w.lo >= d.ts AND w.lo <= d.ts + {_HORIZON}) AS after, (SELECT arg_min(rate, lo) FROM win w WHERE w.lo >= d.ts AND w.lo <= d.ts + {_HORIZON}) AS rate_after FROM dep d)"""


@query(_SHIFT + " SELECT id, repo, after - before AS executions_delta, round(rate_after - rate_before, 6) AS error_rate_delta FROM sh WHERE before IS NOT NULL AND after IS NOT NULL")
def deploy_shift(spark: SparkSession, d: str) -> DataFrame:
    """Each service, job, config or API as a deployment when first recorded: how the first day's window after it differs from the last one before it."""
    day = F.floor(F.col("start") / 86_400_000_000_000).cast("long")
    win = spans(spark, d).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("executions"), F.avg(F.when(F.col("err"), 1.0).otherwise(0.0)).alias("rate")).select(
        F.lit("all").alias("k"), (F.col("day") * 86_400_000_000).alias("lo"), ((F.col("day") + 1) * 86_400_000_000).alias("hi"), "executions", "rate")
    win = stage(win, "windows")
    dep = table(spark, d, "causal_entities").where(F.col("kind").isin("service", "job", "config", "api")).groupBy(F.col("entity_id").alias("id")).agg(
        F.min("repository").alias("repo"), F.unix_micros(F.min("recorded_at").cast("timestamp")).alias("at")).withColumn("k", F.lit("all"))
    was = history.asof(dep, win.select("k", "hi", F.col("executions").alias("before"), F.col("rate").alias("rate_before")), "k", "at", "hi", ["before", "rate_before"])
    now = history.asof(was, win.select("k", "lo", F.col("lo").alias("begin"), F.col("executions").alias("after"), F.col("rate").alias("rate_after")), "k", "at", "lo", ["begin", "after", "rate_after"], forward=True)
    return now.where((F.col("begin") <= F.col("at") + _HORIZON) & F.col("before").isNotNull()).select("id", "repo", (F.col("after") - F.col("before")).alias("executions_delta"), F.round(F.col("rate_after") - F.col("rate_before"), 6).alias("error_rate_delta"))


@query(FACTS_SQL + """, dep AS (SELECT snapshot_id AS id, min(repository) AS repo, epoch_ms(min(taken_at)) AS at FROM snapshots GROUP BY 1), inc AS (SELECT f.fact_id, e.repo, f.ms FROM facts f JOIN entities e ON e.id = f.src WHERE f.rel = 'observes' AND f.ms IS NOT NULL)
SELECT d.id, d.repo, count(i.fact_id) AS incidents FROM dep d JOIN inc i ON i.repo = d.repo AND i.ms >= d.at AND i.ms <= d.at + 86400000 * 3 GROUP BY 1, 2""")
def incident_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Observations recorded within three days after each deployment of their repository. Both are cut into spans of three days, so each meets two of them."""
    ent, fac = facts(spark, d)
    width = 3 * 86_400_000
    inc = fac.where("rel = 'observes' AND ms IS NOT NULL").join(ent.select(F.col("id").alias("src"), "repo"), "src").select("repo", "fact_id", "ms", F.floor(F.col("ms") / width).alias("slot"))
    dep = table(spark, d, "snapshots").groupBy(F.col("snapshot_id").alias("id")).agg(F.min("repository").alias("repo"), F.unix_millis(F.min("taken_at").cast("timestamp")).alias("at"))
    dep = dep.withColumn("slot", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) + 1)))
    return dep.join(inc, ["repo", "slot"]).where((F.col("ms") >= F.col("at")) & (F.col("ms") <= F.col("at") + width)).groupBy("id", "repo").agg(F.count(F.lit(1)).alias("incidents"))


@query(GRAPH_SQL + graphs._ALL + ", w AS (SELECT repo, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS points FROM violations GROUP BY 1), t AS (SELECT n.repo, count(*) AS nodes, round(least(100.0 * coalesce(any_value(points), 0) / count(*), 100.0), 1) AS debt FROM nodes n LEFT JOIN w USING (repo) GROUP BY 1) SELECT *, CASE WHEN debt > 15 THEN 'High' WHEN debt > 5 THEN 'Moderate' ELSE 'Low' END AS level FROM t")
def org_debt(spark: SparkSession, d: str) -> DataFrame:
    return history.debt(graphs.violations(spark, d), graph(spark, d)[0])


@query("WITH s AS (SELECT snapshot_id, min(repository) AS repo, epoch(max(delivered_at)) - epoch(min(taken_at)) AS secs, max(node_count) AS n FROM snapshots GROUP BY 1) SELECT repo, count(*) AS scans, CAST(sum(n) AS BIGINT) AS nodes, round(avg(n / secs) FILTER (secs > 0), 1) AS nodes_per_second FROM s GROUP BY 1")
def org_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each repository's snapshots, and the mean rate of those that took time."""
    us = lambda x: F.unix_micros(x.cast("timestamp")) / 1e6
    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("repository").alias("repo"), (us(F.max("delivered_at")) - us(F.min("taken_at"))).alias("secs"), F.max("node_count").alias("n"))
    return s.groupBy("repo").agg(F.count(F.lit(1)).alias("scans"), F.sum("n").alias("nodes"), F.round(F.avg(F.when(F.col("secs") > 0, F.col("n") / F.col("secs"))), 1).alias("nodes_per_second"))


@query(FACTS_SQL + " SELECT a.repo AS from_repo, b.repo AS to_repo, count(DISTINCT f.dst) AS targets FROM facts f JOIN entities a ON a.id = f.src JOIN entities b ON b.id = f.dst WHERE f.rel IN ('imports', 'depends_on') AND a.repo <> b.repo GROUP BY 1, 2")
def federation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which repository depends on which, through how many of its entities."""
    ent, fac = facts(spark, d)
    k = ent.select("id", "repo")
    rows = fac.where(F.col("rel").isin("imports", "depends_on")).join(k.select(F.col("id").alias("src"), F.col("repo").alias("from_repo")), "src").join(k.select(F.col("id").alias("dst"), F.col("repo").alias("to_repo")), "dst")
    return rows.where("from_repo <> to_repo").groupBy("from_repo", "to_repo").agg(F.countDistinct("dst").alias("targets"))


@query(_GF + _IMPORTS.replace("arg_min(t.target, c.k)", "arg_min(t.target, c.k) FILTER (t.target IS NOT NULL)") + """,
sym AS (SELECT DISTINCT repo, path AS consumer, s.source_name AS source, unnest(s.symbols) AS field FROM (SELECT repo, path, unnest(imports) AS s FROM f) WHERE s.source_name LIKE '.%'),
off AS (SELECT DISTINCT repo, path AS provider, unnest(list_transform(exports, lambda x: x.name)) AS field FROM f),
rel AS (SELECT DISTINCT i.repo, i.path AS consumer, i.source, i.target FROM imp i WHERE i.source LIKE '.%')
SELECT repo || '/' || consumer AS consumer, source AS key, 'missing_endpoint' AS kind, CAST(NULL AS VARCHAR) AS field, 'critical' AS severity FROM rel WHERE target IS NULL
UNION ALL SELECT r.repo || '/' || r.consumer, r.source, 'field_removed', min(s.field), 'high' FROM rel r JOIN sym s ON s.repo = r.repo AND s.consumer = r.consumer AND s.source = r.source WHERE r.target IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM off o WHERE o.repo = r.repo AND o.provider = r.target AND o.field = s.field) GROUP BY 1, 2""")
def contract_validate(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports as contracts: a file that isn't there, or the first imported symbol that it doesn't export."""
    rows = import_rows(spark, d).where("source LIKE '.%'")
    got = stage(resolve.imports(known_files(spark, d), rows), "imports")
    who = lambda: F.concat_ws("/", "repo", "path")
    key = F.concat_ws("\u0001", who(), F.col("source"))
    needs = got.select(who().alias("consumer"), key.alias("key"))
    offers = got.where("target IS NOT NULL").select(key.alias("key"), "repo", F.col("target").alias("provider"))
    need = rows.select(who().alias("consumer"), key.alias("key"), F.explode("symbols").alias("field")).where("field IS NOT NULL").distinct()
    have = files(spark, d).select("repo", F.col("path").alias("provider"), F.explode("exports").alias("e")).select("repo", "provider", F.col("e.name").alias("field"))
    out = history.validate_contracts(needs, offers.select("key"), need, offers.join(have, ["repo", "provider"]).select("key", "field"))
    return out.withColumn("key", F.split("key", "\u0001")[1])


@query(GRAPH_SQL + "," + _FILES.replace("WITH RECURSIVE ", " ") + """,
fields1 AS (SELECT s.repo, n.path AS id, x.name AS field, min(x.kind) AS type, coalesce(bool_or(x.is_public), false) AS required FROM (SELECT snapshot_id, path, unnest(exports) AS x FROM snapshot_nodes WHERE lower(kind) = 'file') n JOIN snap s USING (snapshot_id) WHERE x.name IS NOT NULL GROUP BY 1, 2, 3),
fields0 AS (SELECT repo, path AS id, x.name AS field, min(x.kind) AS type, coalesce(bool_or(x.is_public), false) AS required FROM (SELECT repo, path, unnest(exports) AS x FROM f) WHERE x.name IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT coalesce(x.repo, y.repo) AS repo, coalesce(x.id, y.id) AS id, coalesce(x.field, y.field) AS field, CASE WHEN y.field IS NULL THEN 'removed' WHEN x.field IS NULL AND y.required THEN 'added_required' WHEN x.field IS NULL THEN 'added_optional' WHEN x.type IS DISTINCT FROM y.type THEN 'type_changed' WHEN NOT x.required AND y.required THEN 'now_required' END AS change
FROM fields1 x FULL JOIN fields0 y ON x.repo = y.repo AND x.id = y.id AND x.field = y.field)
SELECT repo, id, field, change, CASE WHEN change IN ('removed', 'type_changed', 'now_required') THEN 'breaking' WHEN change = 'added_required' THEN 'potentially_breaking' ELSE 'compatible' END AS level FROM b WHERE change IS NOT NULL""")
def contract_diff(spark: SparkSession, d: str) -> DataFrame:
    """Exports of each file in its repository's latest snapshot against those of its analysis; public ones count as required."""
    from stratalens.plans.views import latest_snapshots

    def fields(rows: DataFrame) -> DataFrame:
        x = rows.select("repo", F.col("path").alias("id"), F.explode("exports").alias("x")).where("x.name IS NOT NULL")
        return x.groupBy("repo", "id", F.col("x.name").alias("field")).agg(F.min("x.kind").alias("type"), F.coalesce(F.max("x.is_public"), F.lit(False)).alias("required"))

    was = table(spark, d, "snapshot_nodes").where("lower(kind) = 'file'").join(small(latest_snapshots(spark, d)), "snapshot_id")
    return history.contract_diff(fields(was), fields(files(spark, d)), ["repo", "id"])


@query("""WITH s AS (SELECT snapshot_id, min(repository) AS repo, min(taken_at) AS ts, max(node_count) AS n FROM snapshots GROUP BY 1), g AS (SELECT repo, count(*) AS k, arg_min(n, ts) AS a, arg_max(n, ts) AS b FROM s WHERE n IS NOT NULL GROUP BY 1)
SELECT repo, CAST(step AS INT) AS step, round(greatest(b + CASE WHEN k > 1 THEN (b - a) / (k - 1) ELSE 0.0 END * step, 0.0), 6) AS value FROM (SELECT *, unnest([1, 2, 3]) AS step FROM g)""")
def drift_forecast(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("repository").alias("repo"), F.min("taken_at").alias("at"), F.max("node_count").alias("n")).where("n IS NOT NULL")
    return history.forecast(s, "repo", "at", "n")


_CUT = 1_773_300_000_000
_COLS = ["src", "rel", "dst", "ev", "cond"]


@query(FACTS_SQL + f""", a AS (SELECT DISTINCT src, rel, dst, ev, cond FROM facts WHERE coalesce(ms, 0) < {_CUT}), b AS (SELECT DISTINCT src, rel, dst, ev, cond FROM facts WHERE coalesce(ms, 0) >= {_CUT})
SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def fact_temporal_diff(spark: SparkSession, d: str) -> DataFrame:
    fac = stage(facts(spark, d)[1].select(*_COLS, F.coalesce("ms", F.lit(0)).alias("ms")), "facts")
    return c.temporal_diff(fac.where(F.col("ms") < _CUT), fac.where(F.col("ms") >= _CUT), _COLS)


# facts

#: Depths to which flows, flows between systems and impacts are followed: the defaults of the inventory's commands.
FLOW_DEPTH, FAR_DEPTH, IMPACT_DEPTH = 24, 32, 12


def _rel(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _seeds(*kinds: str):
    return F.col("kind").isin(*kinds)


def _flow_sql(seeds: str, relations: list[str] | None, depth: int, extra: str = "true") -> str:
    where = f"rel IN {_rel(relations)}" if relations else "true"
    return FACTS_SQL + f""", ok AS (SELECT * FROM facts WHERE {where} AND {extra}),
walk(id, depth) AS (SELECT id, 0 FROM entities WHERE {seeds} UNION SELECT k.dst, w.depth + 1 FROM walk w JOIN ok k ON k.src = w.id WHERE w.depth < {depth}),
near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1),
via AS (SELECT b.id, b.depth, arg_min(k.src, k.fact_id) AS src, arg_min(k.conf, k.fact_id) AS conf FROM near b JOIN ok k ON k.dst = b.id JOIN near a ON a.id = k.src AND a.depth = b.depth - 1 GROUP BY 1, 2),
flow(id, depth, confidence, source, lo, hi) AS (SELECT id, 0, CAST(1.0 AS DOUBLE), id, repo, repo FROM entities WHERE {seeds}
  UNION ALL SELECT v.id, v.depth, least(f.confidence, v.conf), f.source, least(f.lo, e.repo), greatest(f.hi, e.repo) FROM flow f JOIN via v ON v.src = f.id AND v.depth = f.depth + 1 JOIN entities e ON e.id = v.id)"""


_FLOW = " SELECT id, CAST(depth AS INT) AS depth, round(confidence, 6) AS confidence, source FROM flow"
ENTRIES = ("api", "topic", "queue")


@query(_flow_sql("kind IN ('api', 'topic', 'queue')", c.DATA_FLOW, FLOW_DEPTH) + _FLOW)
def data_flow(spark: SparkSession, d: str) -> DataFrame:
    """Where data goes from APIs, topics and queues."""
    ent, fac = facts(spark, d)
    return c.flow(fac, ent.where(_seeds(*ENTRIES)), c.DATA_FLOW, FLOW_DEPTH)


@query(_flow_sql("kind = 'service'", c.DISTRIBUTED, FAR_DEPTH) + _FLOW)
def distributed_flow(spark: SparkSession, d: str) -> DataFrame:
    """What services set off in other systems."""
    ent, fac = facts(spark, d)
    return c.flow(fac, ent.where(_seeds("service")), c.DISTRIBUTED, FAR_DEPTH)


@query(_flow_sql("kind = 'job'", None, FLOW_DEPTH, "(cond IS NULL OR cond = 'flag:search=on')") + _FLOW)
def reachable_under(spark: SparkSession, d: str) -> DataFrame:
    """What jobs reach when, of all conditions, only the search flag holds."""
    ent, fac = facts(spark, d)
    return c.flow(fac.where("cond IS NULL OR cond = 'flag:search=on'"), ent.where(_seeds("job")), None, FLOW_DEPTH)


@query(_flow_sql("kind IN ('api', 'topic', 'queue')", None, FAR_DEPTH) + " SELECT id, CAST(depth AS INT) AS depth, source FROM flow WHERE lo <> hi")
def cross_repo(spark: SparkSession, d: str) -> DataFrame:
    """What APIs, topics and queues lead to across repositories."""
    ent, fac = facts(spark, d)
    return c.cross_repository(fac, ent, ent.where(_seeds(*ENTRIES)), FAR_DEPTH)


_SINKS = "('table', 'column', 'secret')"


@query(FACTS_SQL + f""", ok AS (SELECT DISTINCT src, dst, rel = 'trust_boundary' AS crossed FROM facts WHERE rel IN {_rel([r for r in c.TAINT if r not in c.SANITISERS])} AND src NOT IN (SELECT id FROM entities WHERE kind IN {_SINKS})),
w(id, crossed, depth) AS (SELECT id, false, 0 FROM entities WHERE kind IN ('api', 'topic') UNION SELECT k.dst, w.crossed OR k.crossed, w.depth + 1 FROM w JOIN ok k ON k.src = w.id WHERE w.depth < {FLOW_DEPTH})
SELECT id AS sink, CAST(min(depth) AS INT) AS depth, bool_or(crossed) AS boundary FROM w WHERE depth > 0 AND id IN (SELECT id FROM entities WHERE kind IN {_SINKS}) GROUP BY 1""")
def taint(spark: SparkSession, d: str) -> DataFrame:
    """Tables, columns and secrets that APIs and topics reach unsanitised."""
    ent, fac = facts(spark, d)
    return c.taint(fac, ent.where(_seeds("api", "topic")), ent.where(_seeds("table", "column", "secret")), FLOW_DEPTH)


@query(_flow_sql("kind IN ('api', 'topic')", c.DATA_FLOW, FLOW_DEPTH) + f" SELECT id AS sink, source, CAST(depth AS INT) AS depth, round(confidence, 6) AS confidence FROM flow WHERE depth > 0 AND id IN (SELECT id FROM entities WHERE kind IN {_SINKS})")
def taint_by_flow(spark: SparkSession, d: str) -> DataFrame:
    """The older question: sinks at the end of any data flow, which can't see sanitisers or boundaries."""
    ent, fac = facts(spark, d)
    got = c.flow(fac, ent.where(_seeds("api", "topic")), c.DATA_FLOW, FLOW_DEPTH).where("depth > 0")
    return got.join(ent.where(_seeds("table", "column", "secret")).select("id"), "id", "left_semi").select(F.col("id").alias("sink"), "source", "depth", "confidence")


@query("WITH v AS (SELECT DISTINCT event_type AS variable, CASE WHEN user_id % 2 = 0 THEN '==' ELSE '!=' END AS op, CAST(user_id % 3 AS VARCHAR) AS value FROM events), g AS (SELECT variable, count(DISTINCT value) FILTER (op = '==') AS n, min(value) FILTER (op = '==') AS one, list(value) FILTER (op = '!=') AS never FROM v GROUP BY 1) SELECT variable, CASE WHEN n > 1 THEN 'several values' WHEN n = 1 AND list_contains(never, one) THEN 'value excluded' END AS conflict FROM g WHERE n > 1 OR (n = 1 AND list_contains(never, one))")
def constraint_conflicts(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("user_id") % 2 == 0, " == ").otherwise(" != ")
    return c.constraint_conflicts(table(spark, d, "events").select(F.concat("event_type", op, (F.col("user_id") % 3).cast("string")).alias("cond")))


@query(FACTS_SQL + """, wr AS (SELECT DISTINCT src, dst FROM facts WHERE rel = 'writes' AND dst IN (SELECT id FROM entities WHERE kind IN ('table', 'queue', 'topic', 'symbol', 'file'))), lk AS (SELECT DISTINCT src FROM facts WHERE rel = 'guards')
SELECT dst AS resource, count(*) AS writers FROM wr GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (src IN (SELECT src FROM lk)) = 0""")
def concurrency_hazards(spark: SparkSession, d: str) -> DataFrame:
    """Unguarded resources with their writers, and cycles of waiting with none."""
    ent, fac = facts(spark, d)
    return c.concurrency_hazards(fac, ent, ["table", "queue", "topic", "symbol", "file"], ["guards"]).select("resource", "writers")


@query(FACTS_SQL + " SELECT f.fact_id, CASE WHEN f.rel = 'calls' THEN 'no-call-to-file' ELSE 'no-owned-secret' END AS rule, f.src, f.dst FROM facts f JOIN entities a ON a.id = f.src JOIN entities b ON b.id = f.dst WHERE (f.rel = 'calls' AND a.kind = 'symbol' AND b.kind = 'file') OR (f.rel = 'owns' AND b.kind = 'secret')")
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    ent, fac = facts(spark, d)
    rules = spark.createDataFrame([("no-call-to-file", "calls", "symbol", "file"), ("no-owned-secret", "owns", None, "secret")], "rule string, rel string, from_kind string, to_kind string")
    return c.policy_violations(fac, ent, rules)


@query(FACTS_SQL + """, own AS (SELECT src AS who, dst AS id FROM facts WHERE rel IN ('owns', 'authored_by', 'reviews') UNION ALL SELECT dst, src FROM facts WHERE rel IN ('owns', 'authored_by', 'reviews')), h AS (SELECT id, count(DISTINCT who) AS owners FROM own WHERE who IN (SELECT id FROM entities WHERE kind IN ('team', 'symbol')) GROUP BY 1)
SELECT e.id, e.kind, coalesce(h.owners, 0) AS owners, CASE coalesce(h.owners, 0) WHEN 0 THEN 'unowned' WHEN 1 THEN 'critical' WHEN 2 THEN 'elevated' ELSE 'distributed' END AS risk FROM entities e LEFT JOIN h USING (id) WHERE e.kind IN ('service', 'file')""")
def ownership_risk(spark: SparkSession, d: str) -> DataFrame:
    ent, fac = facts(spark, d)
    return c.ownership_risk(fac, ent, ["service", "file"], ["team", "symbol"])


_FAN = FACTS_SQL + """, d AS (SELECT id, count(*) FILTER (i = 1) AS fan_in, count(*) FILTER (i = 0) AS fan_out FROM (SELECT src AS id, 0 AS i FROM facts UNION ALL SELECT dst, 1 FROM facts) GROUP BY 1),
fan AS (SELECT e.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM entities e LEFT JOIN d USING (id))"""


@query(_FAN + " SELECT id, fan_in, fan_out, CASE WHEN fan_in + fan_out > 0 THEN round(fan_out / (fan_in + fan_out), 6) ELSE 0.0 END AS instability FROM fan")
def quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    ent, fac = facts(spark, d)
    return c.fan(fac, ent)


#: Relations whose cycles count against quality.
CYCLIC = ["imports", "depends_on"]


@query(_FAN + f""", links AS (SELECT DISTINCT src, dst FROM facts WHERE rel IN {_rel(CYCLIC)}), clo(a, b) AS (SELECT src, dst FROM links UNION SELECT c.a, l.dst FROM clo c JOIN links l ON l.src = c.b),
scc AS (SELECT x.a AS id, least(min(x.b), x.a) AS component FROM clo x JOIN clo y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a), u AS (SELECT count(*) AS entities, avg(fan_in) AS mean_fan_in, avg(fan_out) AS mean_fan_out, max(fan_in) AS max_fan_in, max(fan_out) AS max_fan_out FROM fan)
SELECT 'entities' AS metric, CAST(entities AS DOUBLE) AS value FROM u UNION ALL SELECT 'mean_fan_in', round(mean_fan_in, 6) FROM u UNION ALL SELECT 'mean_fan_out', round(mean_fan_out, 6) FROM u UNION ALL SELECT 'max_fan_in', max_fan_in FROM u
UNION ALL SELECT 'max_fan_out', max_fan_out FROM u UNION ALL SELECT 'relations', count(*) FROM facts UNION ALL SELECT 'cyclic_groups', count(DISTINCT component) FROM scc""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    ent, fac = facts(spark, d)
    return c.quality(fac, ent, CYCLIC)


def _reach_sql(seeds: str, near: str, far: str, links: str, depth: int = IMPACT_DEPTH) -> str:
    return FACTS_SQL + f""", ok AS ({links}), w(id, depth) AS (SELECT id, 0 FROM entities WHERE {seeds} UNION SELECT k.{far}, w.depth + 1 FROM w JOIN ok k ON k.{near} = w.id WHERE w.depth < {depth}), near AS (SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY 1)"""


_LINKS = "SELECT DISTINCT src, dst FROM facts"


def _dependents(spark: SparkSession, d: str, seeds: tuple[str, ...], kinds: tuple[str, ...] | None) -> DataFrame:
    ent, fac = facts(spark, d)
    found = ent.where(_seeds(*kinds)) if kinds else ent
    return c.reach(fac, ent.where(_seeds(*seeds)), IMPACT_DEPTH, reverse=True).where("depth > 0").join(found.select("id", "kind"), "id")


@query(_reach_sql("kind IN ('table', 'column')", "dst", "src", _LINKS) + " SELECT n.id, n.depth, e.kind FROM near n JOIN entities e USING (id) WHERE n.depth > 0 AND e.kind IN ('symbol', 'api', 'test', 'migration', 'service')")
def schema_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on tables and columns."""
    return _dependents(spark, d, ("table", "column"), ("symbol", "api", "test", "migration", "service"))


@query(_reach_sql("kind IN ('queue', 'topic', 'secret')", "dst", "src", _LINKS) + " SELECT n.id, n.depth, e.kind FROM near n JOIN entities e USING (id) WHERE n.depth > 0 AND e.kind IN ('service', 'deployment', 'repository', 'runtime_resource')")
def infrastructure_impact(spark: SparkSession, d: str) -> DataFrame:
    """What is deployed on infrastructure."""
    return _dependents(spark, d, ("queue", "topic", "secret"), ("service", "deployment", "repository", "runtime_resource"))


@query(_reach_sql("kind IN ('config', 'feature_flag')", "dst", "src", _LINKS) + " SELECT n.id, n.depth, e.kind FROM near n JOIN entities e USING (id) WHERE n.depth > 0")
def config_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Everything that depends on configurations and flags."""
    return _dependents(spark, d, ("config", "feature_flag"), None)


@query(_reach_sql("kind = 'config'", "dst", "src", _LINKS) + """, nb AS (SELECT src AS key, dst AS id FROM facts UNION SELECT dst, src FROM facts), close_by AS (SELECT DISTINCT id FROM nb WHERE key IN (SELECT id FROM entities WHERE kind = 'config'))
SELECT e.id AS test, e.id IN (SELECT id FROM close_by) AS direct FROM entities e WHERE e.kind = 'test' AND (e.id IN (SELECT id FROM near WHERE depth > 0) OR e.id IN (SELECT id FROM close_by))""")
def tests_for_change(spark: SparkSession, d: str) -> DataFrame:
    """Tests that a change of the configurations calls for: those that depend on one, and direct neighbours."""
    ent, fac = facts(spark, d)
    seeds = ent.where(_seeds("config"))
    far = c.reach(fac, seeds, IMPACT_DEPTH, reverse=True).where("depth > 0").select("id", F.lit(False).alias("direct"))
    both = fac.select(F.col("src").alias("seed"), F.col("dst").alias("id")).unionByName(fac.select(F.col("dst").alias("seed"), F.col("src").alias("id"))).join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    every = far.unionByName(both.select("id", F.lit(True).alias("direct"))).join(ent.where(_seeds("test")).select("id"), "id", "left_semi")
    return every.groupBy(F.col("id").alias("test")).agg(F.max("direct").alias("direct"))


_PARTS = {"symbol": "code", "file": "code", "test": "tests", "api": "contracts", "schema": "contracts", "deployment": "deployments", "service": "deployments", "job": "deployments"}


@query(_reach_sql("kind = 'feature_flag'", "dst", "src", _LINKS) + " SELECT n.id, n.depth, CASE e.kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PARTS.items()) + " ELSE 'other' END AS part, CASE WHEN n.depth = 0 THEN (SELECT count(*) FROM facts f WHERE f.dst = n.id) ELSE 0 END AS lost, 'predicted' AS evidence FROM near n JOIN entities e USING (id)")
def simulate_change(spark: SparkSession, d: str) -> DataFrame:
    """Deleting the feature flags: what is affected, by sort, and how many facts lose a flag as their target. A prediction, never an observation."""
    ent, fac = facts(spark, d)
    part = F.lit("other")
    for kind, name in _PARTS.items():
        part = F.when(F.col("kind") == kind, name).otherwise(part)
    got = c.reach(fac, ent.where(_seeds("feature_flag")), IMPACT_DEPTH, reverse=True).join(ent.select("id", part.alias("part")), "id")
    lost = fac.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return got.join(lost, "id", "left").select("id", "depth", "part", F.when(F.col("depth") == 0, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("lost"), F.lit("predicted").alias("evidence"))


@query(_reach_sql("kind = 'service'", "src", "dst", f"SELECT DISTINCT dst AS src, src AS dst FROM facts WHERE rel IN {_rel(c.FAILS_BACK)} UNION SELECT src, dst FROM facts WHERE rel IN {_rel(c.FAILS_ON)}") + " SELECT id, depth FROM near")
def failure_propagation(spark: SparkSession, d: str) -> DataFrame:
    """What fails when services fail: callers against the direction of use, consumers along it."""
    ent, fac = facts(spark, d)
    links = c.linked(fac, c.FAILS_BACK).select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(c.linked(fac, c.FAILS_ON).select("src", "dst"))
    return c.reach(links, ent.where(_seeds("service")), IMPACT_DEPTH)


@query(_reach_sql("kind = 'service'", "src", "dst", f"SELECT DISTINCT src, dst FROM facts WHERE rel IN {_rel(c.FAILS_FORWARD)}") + " SELECT id, depth FROM near")
def failure_forward(spark: SparkSession, d: str) -> DataFrame:
    """The older question: what lies ahead of failing services along their own uses."""
    ent, fac = facts(spark, d)
    return c.reach(c.linked(fac, c.FAILS_FORWARD), ent.where(_seeds("service")), IMPACT_DEPTH)


@query(FACTS_SQL + " SELECT id, ['validation', 'runtime', 'static'][min(r) + 1] AS evidence, min(conf) AS confidence, count(*) AS facts FROM (SELECT src AS id, conf, CASE ev WHEN 'validation' THEN 0 WHEN 'runtime' THEN 1 ELSE 2 END AS r FROM facts UNION ALL SELECT dst, conf, CASE ev WHEN 'validation' THEN 0 WHEN 'runtime' THEN 1 ELSE 2 END FROM facts WHERE src <> dst) GROUP BY 1")
def lane_observe(spark: SparkSession, d: str) -> DataFrame:
    return lane.observe(facts(spark, d)[1])


@query(_COMMITS + ", a AS (SELECT r.path, repo AS author, count(DISTINCT r.id) AS n FROM rows r JOIN commits c ON c.id = r.id GROUP BY 1, 2) SELECT 'author:' || author AS src, 'file:' || path AS dst, round(greatest(0.2, least(1.0, n / 5)), 6) AS conf FROM a")
def fact_git_ownership(spark: SparkSession, d: str) -> DataFrame:
    """Who owns which file by commits; here a repository stands for its author."""
    rows = commits(spark, d).select(F.col("repo").alias("author"), "id", "at", "path")
    return c.git_facts(rows).where("rel = 'owns'").select("src", "dst", F.round("conf", 6).alias("conf"))


@query("SELECT target_node AS id, round(sum(CASE WHEN total_latency_ms IS NOT NULL AND invocation_count > 0 THEN total_latency_ms * invocation_count END) / sum(CASE WHEN total_latency_ms IS NOT NULL AND invocation_count > 0 THEN invocation_count END), 3) AS total_latency_ms FROM (SELECT DISTINCT * FROM runtime_edges) GROUP BY 1")
def resource_means(spark: SparkSession, d: str) -> DataFrame:
    got = c.weighted_means(table(spark, d, "runtime_edges").distinct(), "target_node", "invocation_count", ["total_latency_ms"])
    return got.select(F.col("target_node").alias("id"), F.round("total_latency_ms", 3).alias("total_latency_ms"))


@query(_FILES + ", x AS (SELECT repo || '/' || path AS owner, unnest(exports) AS e FROM f) SELECT owner, array_to_string(list_sort(list(DISTINCT concat_ws(':', e.name, e.kind))), ',') AS fields, count(*) FILTER (e.name IS NULL OR e.kind IS NULL) = 0 AS complete FROM x GROUP BY 1")
def contract_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select(F.concat_ws("/", "repo", "path").alias("owner"), F.explode("exports").alias("e")).select("owner", F.col("e.name").alias("field"), F.col("e.kind").alias("kind"))
    return c.contract_snapshots(rows)


@query(_FILES + """, i AS (SELECT DISTINCT repo, regexp_extract(s.source_name, '^([^/.:_]+)', 1) AS package FROM (SELECT repo, unnest(imports) AS s FROM f) WHERE NOT regexp_matches(s.source_name, '^(\\.|/|crate::|self::|super::|@)')),
own AS (SELECT DISTINCT repo, string_split(path, '/')[2] AS package FROM f WHERE path LIKE '%/%')
SELECT i.repo AS from_repo, o.repo AS to_repo, i.package FROM i JOIN own o ON o.package = i.package AND o.repo <> i.repo WHERE i.package <> ''""")
def manifest_links(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces of imported packages (before '_') that another repository has as a directory, by exact name."""
    deps = resolve.external_dependencies(import_rows(spark, d)).where("package NOT LIKE '@%'").select(F.col("repo").alias("from_repo"), F.split("package", "_")[0].alias("package")).distinct()
    own = files(spark, d).select(F.col("repo").alias("to_repo"), F.get(F.split("path", "/"), F.lit(1)).alias("package")).where("package IS NOT NULL").distinct()
    return deps.join(own, "package").where("from_repo <> to_repo").select("from_repo", "to_repo", "package")


#: What an edge of the graph means as a fact.
EDGE_RELATION = {"import": "imports", "calls": "calls", "returns": "returns", "parameter": "assigns"}


def _entity_id(file: bool) -> str:
    return "'repo:' || repo || '::file:' || replace(path, chr(92), '/')" if file else "'repo:' || repo || '::node:' || id"


def _kind_sql() -> str:
    test = {"contains": "contains({c}, '{x}')", "begins with": "starts_with({c}, '{x}')", "ends with": "ends_with({c}, '{x}')"}
    column = {"path": "lower(replace(path, chr(92), '/'))", "name": "lower(name)"}
    arms = []
    for kind, rule, words in c.KIND_RULES:
        what, how = rule.split(" ", 1)
        arms.append("WHEN " + " OR ".join(test[how].format(c=column[what], x=w) for w in words) + f" THEN '{kind}'")
    return "CASE " + " ".join(arms) + " " + " ".join(f"WHEN lower(kind) = '{k}' THEN '{v}'" for k, v in c.NODE_KINDS.items()) + " ELSE 'symbol' END"


_ENT = f", ent AS (SELECT repo, id AS raw, CASE WHEN lower(kind) = 'file' THEN {_entity_id(True)} ELSE {_entity_id(False)} END AS id, {_kind_sql()} AS kind, name FROM nodes)"


def graph_ids(nodes: DataFrame) -> DataFrame:
    """Nodes with their id and kind as entities, ids within their repository."""
    own = F.when(F.lower("kind") == "file", F.concat(F.lit("repo:"), "repo", F.lit("::file:"), F.translate("path", "\\", "/"))).otherwise(F.concat(F.lit("repo:"), "repo", F.lit("::node:"), "id"))
    return nodes.select("repo", F.col("id").alias("raw"), own.alias("id"), c.entity_kind(F.col("kind"), F.col("name"), F.col("path")).alias("kind"), "name")


@query(GRAPH_SQL + _ENT + " SELECT id, kind, name FROM ent")
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the graph as entities."""
    return graph_ids(graph(spark, d)[0]).select("id", "kind", "name")


@query(GRAPH_SQL + _ENT + " SELECT e.repo, a.id AS src, b.id AS dst, CASE e.kind WHEN 'import' THEN 'imports' WHEN 'calls' THEN 'calls' WHEN 'returns' THEN 'returns' WHEN 'parameter' THEN 'assigns' ELSE 'depends_on' END AS rel, greatest(0.0, least(1.0, e.weight)) AS conf FROM edges e JOIN ent a ON a.repo = e.repo AND a.raw = e.src JOIN ent b ON b.repo = e.repo AND b.raw = e.dst")
def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph as facts, as sure as their weight within 0..1."""
    rel = F.lit("depends_on")
    for k, v in EDGE_RELATION.items():
        rel = F.when(F.col("kind") == k, v).otherwise(rel)
    nodes, edges = graph(spark, d)
    ids = graph_ids(nodes).select("repo", "raw", "id")
    rows = edges.select("repo", "src", "dst", rel.alias("rel"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")).alias("conf"))
    rows = rows.join(ids.select("repo", F.col("raw").alias("src"), F.col("id").alias("a")), ["repo", "src"]).join(ids.select("repo", F.col("raw").alias("dst"), F.col("id").alias("b")), ["repo", "dst"])
    return rows.select("repo", F.col("a").alias("src"), F.col("b").alias("dst"), "rel", "conf")


# learning: order lines stand for outcomes

_OUT = """WITH o AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS strategy, l_discount * 10 - 0.4 AS reward, l_quantity > 20 AS accepted, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax < 0.05 END AS validated,
 CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity > 30 END AS improved, l_returnflag = 'R' AND l_quantity > 40 AS rollback, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_discount > 0.03 END AS approved FROM lineitem),
r AS (SELECT *, greatest(-1.0, least(1.0, greatest(-1.0, least(1.0, reward)) + CASE WHEN validated THEN 0.12 WHEN NOT validated THEN -0.30 ELSE 0 END + CASE WHEN improved THEN 0.15 WHEN NOT improved THEN -0.15 ELSE 0 END + CASE WHEN rollback THEN -0.35 ELSE 0 END + CASE WHEN approved THEN 0.08 WHEN NOT approved THEN -0.15 ELSE 0 END)) AS r FROM o),
g AS (SELECT strategy, count(*) AS attempts, count(*) FILTER (accepted AND NOT rollback) AS successes, avg(r) AS m, 1 - exp(-count(*) / 8) AS sure FROM r GROUP BY 1),
s AS (SELECT strategy, attempts, successes, round(m, 6) AS mean_reward, round(sure, 6) AS confidence, round(greatest(-1.0, least(1.0, m * 0.55 + successes / attempts * 0.35 + sure * 0.10)), 6) AS score FROM g)"""


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("strategy"), (F.col("l_discount") * 10 - 0.4).alias("reward"), (F.col("l_quantity") > 20).alias("accepted"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax") < 0.05).alias("validated"), F.when(F.col("l_linenumber") != 4, F.col("l_quantity") > 30).alias("improved"),
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("rollback"), F.when(F.col("l_linestatus") != "O", F.col("l_discount") > 0.03).alias("approved"))


@query(_OUT + " SELECT * FROM s")
def lane_strategies(spark: SparkSession, d: str) -> DataFrame:
    return lane.strategies(outcomes(spark, d))


@query(_OUT + " SELECT strategy, score, row_number() OVER (ORDER BY score DESC, strategy) AS rank FROM s ORDER BY rank LIMIT 10")
def lane_rank(spark: SparkSession, d: str) -> DataFrame:
    top = lane.strategies(outcomes(spark, d)).orderBy(F.col("score").desc(), "strategy").limit(10)
    return top.select("strategy", "score", F.row_number().over(W.orderBy(F.col("score").desc(), "strategy")).alias("rank"))


#: Outcomes in the order in which they came in.
_LATEST = "l_orderkey DESC, l_linenumber DESC"


@query(_OUT + f""", k AS (SELECT l_returnflag = 'R' AND l_quantity > 40 AS rollback FROM lineitem ORDER BY {_LATEST} LIMIT 50), u AS (SELECT count(*) FILTER (rollback) / 50 AS p FROM k),
v AS (SELECT count(*) FILTER (attempts >= 3 AND score >= 0.55) AS strong, count(*) FILTER (attempts >= 3 AND score <= 0.05) AS weak FROM s)
SELECT strong, weak, round(greatest(0.5, least(0.9, 0.65 + 0.2 * p + 0.01 * weak - 0.005 * strong)), 6) AS risk_threshold, CASE WHEN weak > strong THEN 1 ELSE 0 END AS depth_bias, round(least(1.5, 1 + 0.5 * p), 6) AS validation_weight, CAST(1.0 AS DOUBLE) AS runtime_weight FROM u, v""")
def lane_policy(spark: SparkSession, d: str) -> DataFrame:
    recent = lane.rollback_pressure(outcomes(spark, d), [F.col("order").desc(), F.col("line").desc()])
    return lane.policy(lane.strategies(outcomes(spark, d)), recent)


@query(_OUT + " SELECT count(*) AS episodes, round(avg(abs(greatest(-1.0, least(1.0, reward)) - r)), 6) AS mean_error FROM r WHERE reward IS NOT NULL")
def lane_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How far outcomes with all their signals lie from what their reward alone predicts."""
    bare = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("reward")))
    return lane.calibration(outcomes(spark, d).where("reward IS NOT NULL").select(bare.alias("predicted"), lane.reward(F.col("reward")).alias("observed")))


@query(_OUT + f""", w AS (SELECT strategy FROM s WHERE attempts >= 3 AND score < 0.35 ORDER BY score, strategy DESC LIMIT 5), e AS (SELECT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) AS strategy, l_orderkey AS id, row_number() OVER (PARTITION BY l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR) ORDER BY {_LATEST}) AS place FROM lineitem)
SELECT strategy, id, CAST(place AS INT) AS place FROM e WHERE strategy IN (SELECT strategy FROM w) AND place <= 12""")
def lane_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve outcomes of each weak strategy, on which a proposal rests."""
    rows = outcomes(spark, d)
    weak = lane.reflection(lane.strategies(rows), low=0.35).where("role = 'weak'")
    return lane.evidence(weak, rows.select("strategy", F.col("order").alias("id"), "line"), [F.col("id").desc(), F.col("line").desc()])


@query(_OUT + """, t AS (SELECT 'top' AS role, strategy, attempts, score, mean_reward FROM s WHERE attempts >= 3 AND score > 0.2 ORDER BY score DESC, strategy LIMIT 5), w AS (SELECT 'weak' AS role, strategy, attempts, score, mean_reward FROM s WHERE attempts >= 3 AND score < 0.15 ORDER BY score, strategy DESC LIMIT 5)
SELECT role, strategy, attempts, score, CASE WHEN role = 'weak' THEN round(greatest(-1.0, least(1.0, 0.25 - mean_reward)), 6) END AS expected_reward, false AS auto_apply FROM (SELECT * FROM t UNION ALL SELECT * FROM w)""")
def lane_reflection(spark: SparkSession, d: str) -> DataFrame:
    return lane.reflection(lane.strategies(outcomes(spark, d)), top=0.2)


@query(FACTS_SQL + """, e AS (SELECT fact_id AS id, concat_ws(' ', src, rel, dst) AS text, conf AS confidence, ev AS evidence, coalesce(ms, 0) AS created FROM facts),
s AS (SELECT *, CAST(contains(lower(text), 'router') AS INT) + CAST(contains(lower(text), 'ledger') AS INT) AS hits FROM e)
SELECT id, round(4 * hits + 2 * confidence + CASE evidence WHEN 'validation' THEN 1.0 WHEN 'runtime' THEN 0.9 WHEN 'human' THEN 0.85 WHEN 'static' THEN 0.75 WHEN 'history' THEN 0.65 WHEN 'predicted' THEN 0.25 ELSE 0.0 END, 6) AS score FROM s WHERE hits > 0 ORDER BY score DESC, created DESC, id LIMIT 50""")
def lane_recall(spark: SparkSession, d: str) -> DataFrame:
    fac = facts(spark, d)[1]
    rows = fac.select(F.col("fact_id").alias("id"), F.concat_ws(" ", "src", "rel", "dst").alias("text"), F.col("conf").alias("confidence"), F.col("ev").alias("evidence"), F.coalesce("ms", F.lit(0)).alias("created"))
    return lane.recall(rows, ["router", "ledger"], 50).select("id", "score")
