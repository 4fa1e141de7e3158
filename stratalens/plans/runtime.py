"""Queries over spans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import stage, table
from stratalens.functions.numbers import settle, settle_sql
from stratalens.operators import telemetry
from stratalens.plans.registry import registry
from stratalens.plans.views import GRAPH_SQL, SPANS_SQL, graph, spans

QUERIES, SQL, query = registry(lambda sql: re.sub("<<(.+?)>>", lambda m: settle_sql(m[1]), sql))


_MET = SPANS_SQL + """, met AS (SELECT node_id AS id, count(*) AS calls, avg(greatest(ms, 0)) AS ms, avg(CASE WHEN err THEN 1.0 ELSE 0.0 END) AS errors, count(*) > 500 AS hot FROM spans WHERE node_id IS NOT NULL GROUP BY 1)"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.aggregate(spans(spark, d))


@query(_MET + " SELECT id, calls, <<ms>> AS ms, round(errors, 6) AS errors, hot FROM met")
def span_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).select("id", "calls", settle(F.col("ms")).alias("ms"), F.round("errors", 6).alias("errors"), "hot")


@query(_MET + " SELECT count(*) AS identities, CAST(sum(calls) AS BIGINT) AS spans, count(*) FILTER (errors > 0) AS error_identities, count(*) FILTER (hot) AS hot, count(*) FILTER (id LIKE 'runtime-unresolved/%') AS unresolved FROM met")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).agg(
        F.count(F.lit(1)).alias("identities"), F.sum("calls").alias("spans"), F.count(F.when(F.col("errors") > 0, 1)).alias("error_identities"),
        F.count(F.when(F.col("hot"), 1)).alias("hot"), F.count(F.when(F.col("id").startswith("runtime-unresolved/"), 1)).alias("unresolved"),
    )


def _clean_sql(x: str) -> str:
    return f"nullif(substr(translate(replace(replace(trim({x}), chr(92), '/'), '::', '/'), chr(10) || chr(13) || chr(9), '   '), 1, 300), '')"


def _lost_sql(kind: str, *parts: str) -> str:
    return f"concat_ws('/', 'runtime-unresolved/{kind}', {', '.join(map(_clean_sql, parts))})"


#: Of columns path, base, fn, space and name.
IDENTITY_SQL = f"""CASE WHEN path IS NOT NULL THEN replace(path, chr(92), '/') || '::' || coalesce(fn, 'file') WHEN fn IS NOT NULL AND space IS NOT NULL THEN {_lost_sql('namespace-function', 'space', 'fn')} WHEN fn IS NOT NULL AND base IS NOT NULL THEN {_lost_sql('basename-function', 'base', 'fn')}
 WHEN fn IS NOT NULL THEN {_lost_sql('function', 'fn')} WHEN space IS NOT NULL THEN {_lost_sql('namespace-span', 'space', 'name')} WHEN base IS NOT NULL THEN {_lost_sql('basename-span', 'base', 'name')} ELSE {_lost_sql('span', 'name')} END"""
_ATTR = ", ".join(f"nullif(trim(element_at(attributes, '{k}')[1]), '') AS {n}" for k, n in (("code.file.path", "path"), ("code.file.name", "base"), ("code.function.name", "fn"), ("service.name", "space")))


@query(f"""WITH o AS (SELECT t, v, {_ATTR}, name, err FROM (SELECT lower(trim(trace_id)) AS t, lower(trim(span_id)) AS v, min(attributes) AS attributes, min(name) AS name, coalesce(bool_or(status.code = 2), false) AS err FROM (SELECT trace_id, span_id, name, status,
  map_from_entries(list_sort(map_entries(attributes))) AS attributes FROM otlp_spans) WHERE trace_id IS NOT NULL AND span_id IS NOT NULL GROUP BY 1, 2)), i AS (SELECT {IDENTITY_SQL} AS id, err FROM o)
SELECT id, count(*) AS spans, count(*) FILTER (err) AS errors FROM i GROUP BY 1""")
def span_identity(spark: SparkSession, d: str) -> DataFrame:
    """Raw spans to identities, repeated rows counting once."""
    raw = table(spark, d, "otlp_spans").where("trace_id IS NOT NULL AND span_id IS NOT NULL")
    # a map can't be compared, its sorted entries can
    entries = F.array_sort(F.map_entries("attributes"))
    one = raw.select(F.lower(F.trim("trace_id")).alias("t"), F.lower(F.trim("span_id")).alias("v"), "name", entries.alias("a"), telemetry.is_error(F.col("status.code")).alias("e")).groupBy("t", "v").agg(
        F.min("name").alias("name"), F.min("a").alias("a"), F.coalesce(F.max("e"), F.lit(False)).alias("err"))
    attributes = F.coalesce(F.map_from_entries("a"), F.create_map().cast("map<string,string>"))
    got = one.select(telemetry.identity(attributes, F.col("name")).alias("id"), "err")
    return got.groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.count(F.when(F.col("err"), 1)).alias("errors"))


@query(SPANS_SQL + """, b AS (SELECT node_id AS id, CAST(floor(start / 86400000000000) AS BIGINT) AS day, count(*) AS calls, avg(greatest(ms, 0)) AS ms, avg(CASE WHEN err THEN 1.0 ELSE 0.0 END) AS errors, count(*) > 500 AS hot FROM spans WHERE node_id IS NOT NULL GROUP BY 1, 2)
SELECT id, CAST(sum(calls) AS BIGINT) AS calls, <<sum(ms * calls) / sum(calls)>> AS ms, round(sum(errors * calls) / sum(calls), 6) AS errors, bool_or(hot) OR sum(calls) > 1000 AS hot FROM b GROUP BY 1""")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each day's metrics merged into one row per identity."""
    rows = spans(spark, d).where("node_id IS NOT NULL").withColumn("day", F.floor(F.col("start") / 86400000000000))
    daily = rows.groupBy(F.col("node_id").alias("id"), "day").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.greatest("ms", F.lit(0.0))).alias("ms"), F.avg(F.when(F.col("err"), 1.0).otherwise(0.0)).alias("errors")
    ).withColumn("hot", F.col("calls") > telemetry.HOT_LIMITS["batch"])
    return telemetry.merge_metrics(daily).select("id", "calls", settle(F.col("ms")).alias("ms"), F.round("errors", 6).alias("errors"), "hot")


_LINK = SPANS_SQL + """, link AS (SELECT a.node_id AS source, b.node_id AS target, b.t, b.v, b.err, b.ms, b.stop FROM spans b JOIN spans a ON a.t = b.t AND a.v = b.p WHERE a.node_id IS NOT NULL AND b.node_id IS NOT NULL)"""


@query(_LINK + " SELECT source, target, count(*) AS calls, count(*) FILTER (err) AS errors, <<sum(greatest(ms, 0))>> AS total_ms, max(stop) AS last_seen, arg_max(t, (coalesce(stop, -1), t)) AS last_trace FROM link GROUP BY 1, 2")
def runtime_links(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.edges(spans(spark, d)).withColumn("total_ms", settle(F.col("total_ms")))


_STEPS = SPANS_SQL + """, steps AS (SELECT b.*, a.node_id AS source, b.p IS NULL AS root, row_number() OVER (PARTITION BY b.t ORDER BY b.start NULLS FIRST, b.v) AS pos FROM spans b LEFT JOIN spans a ON a.t = b.t AND a.v = b.p)"""


@query(_STEPS + " SELECT t, v, pos, source, node_id AS target FROM steps WHERE source IS NOT NULL")
def trace_edges(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.trace_steps(spans(spark, d)).where("source IS NOT NULL").select("t", "v", "pos", "source", F.col("node_id").alias("target"))


@query(_STEPS + " SELECT t, v, node_id FROM steps WHERE root")
def trace_roots(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.trace_steps(spans(spark, d)).where("root").select("t", "v", "node_id")


@query(SPANS_SQL + """, keep AS (SELECT t, max(stop) AS last_seen FROM spans GROUP BY 1 ORDER BY 2 DESC NULLS LAST, t LIMIT 100)
SELECT t, v, row_number() OVER (PARTITION BY t ORDER BY start NULLS FIRST, v) AS pos FROM spans WHERE t IN (SELECT t FROM keep) QUALIFY row_number() OVER (PARTITION BY t ORDER BY start NULLS FIRST, v) <= 1000""")
def trace_retention(spark: SparkSession, d: str) -> DataFrame:
    """The 100 newest traces, 1,000 spans of each: retention is the feature."""
    return telemetry.retained(stage(spans(spark, d), "spans"), 100, 1000).select("t", "v", "pos")


@query(GRAPH_SQL + "," + _MET.replace("\nWITH RECURSIVE ", "") + " SELECT n.repo, n.id, m.calls, <<m.ms>> AS ms, m.calls IS NOT NULL AS observed FROM nodes n LEFT JOIN met m USING (id)")
def runtime_overlay(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph(spark, d)[0].select("repo", "id")
    return nodes.join(metrics(spark, d).select("id", "calls", settle(F.col("ms")).alias("ms")), "id", "left").withColumn("observed", F.col("calls").isNotNull())


_FUSE = _LINK + """, met AS (SELECT node_id AS id, count(*) AS calls, avg(greatest(ms, 0)) AS ms, avg(CASE WHEN err THEN 1.0 ELSE 0.0 END) AS errors FROM spans WHERE node_id IS NOT NULL GROUP BY 1),
i AS (SELECT target AS id, count(DISTINCT source) AS seen_in FROM link GROUP BY 1), o AS (SELECT source AS id, count(DISTINCT target) AS seen_out FROM link GROUP BY 1),
f AS (SELECT id, coalesce(calls, 0) AS calls, coalesce(ms, 0) AS ms, coalesce(errors, 0) AS errors, coalesce(seen_in, 0) AS seen_in, coalesce(seen_out, 0) AS seen_out FROM met FULL JOIN i USING (id) FULL JOIN o USING (id))"""


@query(_FUSE + """ SELECT id, calls, <<ms>> AS ms, round(errors, 6) AS errors, seen_in, seen_out, array_to_string(list_filter([CASE WHEN calls > 0 THEN 'observed' END, CASE WHEN calls >= 500 THEN 'hot' END, CASE WHEN ms >= 500 THEN 'slow' END, CASE WHEN errors >= 0.05 THEN 'unstable' END,
 CASE WHEN seen_out >= 6 THEN 'high-fan-out' END, CASE WHEN id LIKE 'runtime-unresolved/%' THEN 'unresolved-identity' END], lambda x: x IS NOT NULL), ',') AS signals FROM f""")
def runtime_fusion(spark: SparkSession, d: str) -> DataFrame:
    s = stage(spans(spark, d), "spans")
    return telemetry.fusion(telemetry.aggregate(s).drop("hot"), telemetry.edges(s)).withColumn("ms", settle(F.col("ms"))).withColumn("errors", F.round("errors", 6))


@query(GRAPH_SQL + " SELECT repo, id FROM nodes WHERE lower(kind) IN ('function', 'method') AND id NOT IN (SELECT node_id FROM observed_spans WHERE node_id IS NOT NULL) AND (SELECT max(start_unix_nano) > min(start_unix_nano) FROM observed_spans)")
def dead_code_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Functions never observed, if there is a window of observation at all."""
    seen = table(spark, d, "observed_spans")
    lo, hi = seen.agg(F.min("start_unix_nano"), F.max("start_unix_nano")).first()
    nodes = graph(spark, d)[0].where(F.lower("kind").isin("function", "method")).select("repo", "id")
    return nodes.join(seen.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti").where(F.lit(lo is not None and hi > lo))


NODE = "services/gateway/src/router.ts::routeRequest"


@query(_STEPS + f""", k AS (SELECT *, node_id = '{NODE}' OR coalesce(source = '{NODE}', false) AS touch FROM steps), q AS (SELECT *, max(CAST(coalesce(touch, false) AS INT)) OVER (PARTITION BY t ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sofar, max(CAST(coalesce(touch, false) AS INT)) OVER (PARTITION BY t) AS ever FROM k)
SELECT t, v, pos, CASE WHEN touch THEN 'touching' WHEN sofar = 1 THEN 'after' ELSE 'before' END AS phase FROM q WHERE ever = 1""")
def trace_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.neighbourhood(stage(telemetry.trace_steps(spans(spark, d)), "steps"), NODE)


@query(_STEPS + """, c AS (SELECT t, v, node_id, greatest(coalesce(ms, 0), 0) AS ms FROM steps), r AS (SELECT *, coalesce(sum(ms) OVER (PARTITION BY t ORDER BY ms DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(ms) OVER (PARTITION BY t) AS total FROM c)
SELECT t, v, node_id, round(ms, 6) AS ms FROM r WHERE before < 0.7 * total AND total > 0""")
def trace_critical_path(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.critical_path(telemetry.trace_steps(spans(spark, d)))


_PAIRS = """, roots AS (SELECT t, min(node_id) AS root, min(start) AS s FROM steps WHERE root AND node_id IS NOT NULL GROUP BY 1), ord AS (SELECT t, root, row_number() OVER (PARTITION BY root ORDER BY s, t) AS k FROM roots),
pair AS (SELECT a.t AS pair, a.t AS lt, b.t AS rt FROM ord a JOIN ord b ON b.root = a.root AND b.k = a.k + 1),
l AS (SELECT p.pair, s.* FROM pair p JOIN steps s ON s.t = p.lt), r AS (SELECT p.pair, s.* FROM pair p JOIN steps s ON s.t = p.rt),
al AS (SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.pos, r.pos) AS pos, CASE WHEN l.v IS NULL THEN 'missing-left' WHEN r.v IS NULL THEN 'missing-right' WHEN l.source IS DISTINCT FROM r.source OR l.node_id IS DISTINCT FROM r.node_id OR l.name IS DISTINCT FROM r.name THEN 'different-step'
  WHEN l.err IS DISTINCT FROM r.err THEN 'different-error' END AS why FROM l FULL JOIN r ON l.pair = r.pair AND l.pos = r.pos),
f AS (SELECT pair, min(pos) AS first_difference, arg_min(why, pos) AS reason FROM al WHERE why IS NOT NULL GROUP BY 1)
SELECT p.pair, (SELECT count(*) FROM l WHERE l.pair = p.pair) AS left_steps, (SELECT max(stop) - min(start) FROM l WHERE l.pair = p.pair) AS left_nanos, (SELECT count(*) FILTER (err) FROM l WHERE l.pair = p.pair) AS left_errors,
 (SELECT count(*) FROM r WHERE r.pair = p.pair) AS right_steps, (SELECT max(stop) - min(start) FROM r WHERE r.pair = p.pair) AS right_nanos, (SELECT count(*) FILTER (err) FROM r WHERE r.pair = p.pair) AS right_errors, first_difference, reason FROM pair p LEFT JOIN f USING (pair)"""


@query(_STEPS + _PAIRS)
def trace_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each trace against the next one with the same root node."""
    from pyspark.sql import Window as W

    steps = stage(telemetry.trace_steps(spans(spark, d)), "steps")
    roots = steps.where("root AND node_id IS NOT NULL").groupBy("t").agg(F.min("node_id").alias("root"), F.min("start").alias("s"))
    pairs = roots.select("t", F.lead("t").over(W.partitionBy("root").orderBy("s", "t")).alias("rt")).where("rt IS NOT NULL").select(F.col("t").alias("pair"), F.col("t").alias("lt"), "rt")
    left = steps.join(pairs.select("pair", F.col("lt").alias("t")), "t")
    right = steps.join(pairs.select("pair", F.col("rt").alias("t")), "t")
    return telemetry.compare_traces(left, right, "pair")


_CALLS = _LINK + """, c AS (SELECT t AS trace, split_part(source, '/', 2) AS source, split_part(target, '/', 2) AS target, CASE WHEN target LIKE '%gateway%' THEN 'http-server' WHEN target LIKE '%ledger%' THEN 'database' ELSE 'function' END AS flow, ms, err FROM link WHERE source <> '' AND target <> ''),
ok AS (SELECT * FROM c WHERE source <> '' AND target <> '')"""


def _service_calls(spark: SparkSession, d: str) -> DataFrame:
    s = spans(spark, d)
    up = s.select("t", F.col("v").alias("p"), F.col("node_id").alias("source"))
    link = s.where("p IS NOT NULL").join(up, ["t", "p"]).where("source IS NOT NULL AND node_id IS NOT NULL")
    part = lambda c: F.coalesce(F.get(F.split(c, "/"), F.lit(1)), F.lit(""))
    flow = F.when(F.col("node_id").contains("gateway"), "http-server").when(F.col("node_id").contains("ledger"), "database").otherwise("function")
    return link.select(F.col("t").alias("trace"), part("source").alias("source"), part("node_id").alias("target"), flow.alias("flow"), "ms", "err")


@query(_CALLS + ", e AS (SELECT source AS service, target AS peer, err FROM ok UNION ALL SELECT target, source, err FROM ok) SELECT service, count(*) AS calls, count(*) FILTER (err) AS errors, count(DISTINCT peer) AS peers FROM e GROUP BY 1")
def service_body(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.service_body(_service_calls(spark, d))[0]


@query(_CALLS + " SELECT source, target, flow, count(*) AS calls, <<sum(greatest(ms, 0))>> AS total_ms FROM ok GROUP BY 1, 2, 3")
def service_edges(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.service_body(_service_calls(spark, d))[1].withColumn("total_ms", settle(F.col("total_ms")))


@query("""WITH x AS (SELECT repository || '/' || replace(path, chr(92), '/') AS file, unnest(calls) AS c FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL)
SELECT file, count(*) AS rows, count(DISTINCT c.line) AS lines, count(*) AS hits FROM x WHERE c.line >= 1 GROUP BY 1""")
def line_report(spark: SparkSession, d: str) -> DataFrame:
    """Call sites as line executions of one hit each."""
    rows = table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL").select(F.concat_ws("/", "repository", F.translate("path", "\\", "/")).alias("file"), F.explode("calls").alias("c"))
    none = F.lit(None).cast("long")
    return telemetry.line_report(rows.select("file", F.col("c.line").alias("line"), F.lit(1).cast("long").alias("hits"), F.lit(False).alias("synthetic"), none.alias("observed_start"), none.alias("observed_end")))
