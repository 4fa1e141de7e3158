"""Queries over the property graph: reads, traversals, boundaries, drift, test gaps, clones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import stage, table
from stratalens.operators import structure, traverse
from stratalens.plans.registry import registry
from stratalens.plans.views import CHANGES_SQL, GRAPH_SQL, TWO_GRAPHS_SQL, _graph_sql, changes, graph

QUERIES, SQL, query = registry()


#: Rules for the test tables' paths and names.
PATH_RULES = {"apps": ["internal", "ledger"], "lib": ["services"], "core": ["apps", "services"], "packages": ["gateway"], "root": ["billing"]}
SUFFIXES = [("Quote", "presentation"), ("Order", "application"), ("Ledger", "domain"), ("Policy", "infrastructure"), ("Batch", "data")]
LAYER_ORDER = ["presentation", "application", "domain", "infrastructure", "data"]
LAYER_PATHS = [(n, p, s + [x for x, y in SUFFIXES if y == n], a) for n, p, s, a in structure.LAYERS]
GOD, UNSTABLE_IN, UNSTABLE = 8, 2, 0.3

_DEGREE = """,
deg AS (SELECT n.repo, n.id, n.kind, n.name, n.path, (SELECT count(*) FROM edges e WHERE e.repo = n.repo AND e.dst = n.id) AS fan_in, (SELECT count(*) FROM edges e WHERE e.repo = n.repo AND e.src = n.id) AS fan_out FROM nodes n)"""
_LOCATED = "," + CHANGES_SQL + """,
at_path AS (SELECT c.repo, c.path, c.line AS wanted, n.id, n.kind, n.line FROM changes c JOIN nodes n ON n.repo = c.repo AND (replace(n.path, chr(92), '/') = c.path OR ends_with(replace(n.path, chr(92), '/'), '/' || c.path))),
located AS (SELECT repo, path, wanted AS line, coalesce(arg_min(id, (-line, id)) FILTER (lower(kind) <> 'file' AND line <= wanted), min(id) FILTER (lower(kind) = 'file'),
   arg_min(id, (line, id))) AS id FROM at_path GROUP BY 1, 2, 3)"""
_HUBS = _DEGREE + ", hubs AS (SELECT repo, id FROM deg QUALIFY row_number() OVER (PARTITION BY repo ORDER BY fan_in DESC, id) = 1), roots AS (SELECT repo, id FROM deg QUALIFY row_number() OVER (PARTITION BY repo ORDER BY fan_out DESC, id) = 1)"


# Nothing in the test tables looks like a test by its path, so tests are here what the 'audit' team owns.
_GAPS = """, t AS (SELECT repo, id, path, kind, coalesce(owner = 'audit', false) AS test FROM nodes),
g AS (SELECT t.repo, t.id, t.path, count(e.src) AS callers, coalesce(bool_or(s.test), false) AS covered FROM t LEFT JOIN edges e ON e.repo = t.repo AND e.dst = t.id LEFT JOIN t s ON s.repo = e.repo AND s.id = e.src
  WHERE lower(t.kind) IN ('function', 'method') AND NOT t.test GROUP BY 1, 2, 3),
gaps AS (SELECT repo, id, path, callers, covered, NOT covered AND (callers >= 2 OR contains(lower(path), 'core') OR contains(lower(path), 'api')) AS critical, CAST(CASE WHEN covered THEN 0.0 ELSE round(least(callers * 0.25 + 0.3, 0.98), 6) END AS DOUBLE) AS risk FROM g)"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return structure.test_gaps(*graph(spark, d), F.coalesce(F.col("owner") == "audit", F.lit(False)))


def hubs(nodes: DataFrame, edges: DataFrame, by: str = "fan_in") -> DataFrame:
    """Each repository's node of the greatest degree."""
    return traverse.last(traverse.degrees(nodes, edges), ["repo"], [F.col(by).desc(), "id"]).select("repo", "id")


@query(GRAPH_SQL + " SELECT repo, id, kind, name, path, line FROM nodes")
def node_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)[0].select("repo", "id", "kind", "name", "path", "line")


@query(GRAPH_SQL + " SELECT repo, src, dst, kind, eid FROM edges")
def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)[1].select("repo", "src", "dst", "kind", "eid")


@query(GRAPH_SQL + " SELECT repo, (SELECT count(*) FROM edges e WHERE e.repo = n.repo) AS edges, count(*) AS nodes FROM nodes n GROUP BY repo")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges")), "repo", "left").fillna(0)


@query(GRAPH_SQL + _DEGREE + " SELECT repo, id, fan_in, fan_out FROM deg")
def degree_profile(spark: SparkSession, d: str) -> DataFrame:
    return traverse.degrees(*graph(spark, d)).select("repo", "id", "fan_in", "fan_out")


@query(GRAPH_SQL + _LOCATED + " SELECT repo, path, line, id FROM located")
def locate_declaration(spark: SparkSession, d: str) -> DataFrame:
    return traverse.locate(graph(spark, d)[0], changes(spark, d))


@query(GRAPH_SQL + _HUBS + " SELECT h.repo, h.id, e.src AS other, 'caller' AS side, e.kind FROM hubs h JOIN edges e ON e.repo = h.repo AND e.dst = h.id UNION ALL SELECT h.repo, h.id, e.dst, 'callee', e.kind FROM hubs h JOIN edges e ON e.repo = h.repo AND e.src = h.id")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    """Direct callers and callees of each repository's hub; parallel edges stay apart."""
    nodes, edges = graph(spark, d)
    h = hubs(nodes, edges)
    into = edges.join(h.withColumnRenamed("id", "dst"), ["repo", "dst"]).select("repo", F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("caller").alias("side"), "kind")
    out = edges.join(h.withColumnRenamed("id", "src"), ["repo", "src"]).select("repo", F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("callee").alias("side"), "kind")
    return into.unionByName(out)


@query(GRAPH_SQL + _LOCATED + " SELECT e.repo, e.src, e.dst, e.kind FROM edges e WHERE (e.repo, e.src) IN (SELECT repo, id FROM located) AND (e.repo, e.dst) IN (SELECT repo, id FROM located)")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    keep = traverse.locate(nodes, changes(spark, d)).select("repo", "id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(keep.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi").select("repo", "src", "dst", "kind")


def impact(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """What depends on the seeds (repo, id), at which depth, how sure, of which kind. Seeds themselves are left out."""
    keyed = edges.select(F.col("repo").alias("key"), "src", "dst")
    got = traverse.reach(keyed, seeds.select(F.col("repo").alias("key"), F.col("id").alias("node")), depth, reverse=True).where("depth > 0")
    sure = F.greatest(F.lit(0.95) * F.pow(F.lit(0.85), F.col("depth") - 1), F.lit(0.25))
    return got.select(
        F.col("key").alias("repo"), F.col("node").alias("id"), "depth", F.round(sure, 6).alias("confidence"),
        F.when(F.col("depth") == 1, "compile_break").otherwise("behavioural").alias("impact_kind"),
    )


def impact_summary_of(rows: DataFrame, key: str = "repo") -> DataFrame:
    direct, total, deepest = F.count(F.when(F.col("depth") == 1, 1)), F.count(F.lit(1)), F.max("depth")
    risk = F.least((2 * direct + (total - direct)) / 20 + F.least(0.08 * deepest, F.lit(0.24)), F.lit(1.0))
    out = rows.groupBy(key).agg(direct.alias("direct"), (total - direct).alias("indirect"), deepest.alias("depth"), F.round(risk, 6).alias("risk"))
    return out.withColumn("effort", F.when(F.col("risk") >= 0.7, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low"))


_IMPACT = _HUBS + """,
near(repo, id, depth) USING KEY (repo, id) AS (SELECT repo, id, 0 FROM hubs UNION SELECT w.repo, e.src, min(w.depth + 1) FROM near w JOIN edges e ON e.repo = w.repo AND e.dst = w.id LEFT JOIN recurring.near o ON o.repo = e.repo AND o.id = e.src WHERE o.id IS NULL GROUP BY 1, 2),
imp AS (SELECT repo, id, depth, round(greatest(0.95 * pow(0.85, depth - 1), 0.25), 6) AS confidence, CASE WHEN depth = 1 THEN 'compile_break' ELSE 'behavioural' END AS impact_kind FROM near WHERE depth > 0)"""
_SUMMARY = """ SELECT {key} AS repo, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect, max(depth) AS depth,
 round(least((2 * count(*) FILTER (depth = 1) + count(*) FILTER (depth > 1)) / 20 + least(0.08 * max(depth), 0.24), 1.0), 6) AS risk,
 CASE WHEN least((2 * count(*) FILTER (depth = 1) + count(*) FILTER (depth > 1)) / 20 + least(0.08 * max(depth), 0.24), 1.0) >= 0.7 THEN 'high'
  WHEN least((2 * count(*) FILTER (depth = 1) + count(*) FILTER (depth > 1)) / 20 + least(0.08 * max(depth), 0.24), 1.0) >= 0.3 THEN 'medium' ELSE 'low' END AS effort"""


@query(GRAPH_SQL + _IMPACT + " SELECT * FROM imp")
def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return impact(nodes, edges, hubs(nodes, edges))


@query(GRAPH_SQL + _IMPACT + " SELECT repo, id, depth FROM near")
def impact_by_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The impact of each hub by the frontier loop, which graphs too large to be walked whole take."""
    nodes, edges = graph(spark, d)
    seeds = hubs(nodes, edges).select(F.col("repo").alias("key"), F.col("id").alias("node"))
    return traverse.reach(edges.select(F.col("repo").alias("key"), "src", "dst"), seeds, reverse=True, group_edges=0).select(F.col("key").alias("repo"), F.col("node").alias("id"), "depth")


@query(GRAPH_SQL + _IMPACT + _SUMMARY.format(key="repo") + " FROM imp GROUP BY repo")
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return impact_summary_of(impact_bfs(spark, d))


_SESSION = _LOCATED + """,
seed AS (SELECT DISTINCT repo || ' ' || path AS key, repo, id FROM located),
near(key, repo, id, depth) USING KEY (key, repo, id) AS (SELECT key, repo, id, 0 FROM seed UNION SELECT w.key, w.repo, e.src, min(w.depth + 1) FROM near w JOIN edges e ON e.repo = w.repo AND e.dst = w.id LEFT JOIN recurring.near o ON o.key = w.key AND o.repo = e.repo AND o.id = e.src WHERE o.id IS NULL GROUP BY 1, 2, 3),
each AS (SELECT key, least((2 * count(*) FILTER (depth = 1) + count(*) FILTER (depth > 1)) / 20 + least(0.08 * max(depth), 0.24), 1.0) AS risk FROM near WHERE depth > 0 GROUP BY 1),
wide AS (SELECT repo, count(DISTINCT id) AS nodes, count(DISTINCT path) AS files, count(DISTINCT id) FILTER ((repo, id) IN (SELECT g.repo, g.path || '::' || n.name FROM gaps g JOIN nodes n USING (repo, id) WHERE g.critical)) AS untested
  FROM (SELECT DISTINCT n.repo, n.id, m.path FROM near n JOIN nodes m ON m.repo = n.repo AND m.id = n.id WHERE n.depth > 0) GROUP BY 1)
SELECT c.repo, count(*) AS changes, coalesce(any_value(w.nodes), 0) AS nodes, coalesce(any_value(w.files), 0) AS files, coalesce(any_value(w.untested), 0) AS untested, round(max(coalesce(r.risk, 0)), 6) AS max_risk, round(avg(coalesce(r.risk, 0)), 6) AS mean_risk
FROM changes c LEFT JOIN each r ON r.key = c.repo || ' ' || c.path LEFT JOIN wide w ON w.repo = c.repo GROUP BY c.repo"""


@query(GRAPH_SQL + _GAPS + _SESSION)
def session_impact(spark: SparkSession, d: str) -> DataFrame:
    """All changes of a repository as one session: whole impact of each, then distinct nodes and files, untested hot paths among them, worst and mean risk.

    A change without any impact counts as one of risk 0.
    """
    nodes, edges = graph(spark, d)
    changed = changes(spark, d)
    seeds = traverse.locate(nodes, changed).select(F.concat_ws(" ", "repo", "path").alias("key"), "repo", "id").distinct()
    got = stage(reach_each(edges, seeds).where("depth > 0"), "got")
    risk = F.least((2 * F.count(F.when(F.col("depth") == 1, 1)) + F.count(F.when(F.col("depth") > 1, 1))) / 20 + F.least(0.08 * F.max("depth"), F.lit(0.24)), F.lit(1.0))
    each = changed.select("repo", F.concat_ws(" ", "repo", "path").alias("key")).join(got.groupBy("key").agg(risk.alias("risk")), "key", "left").fillna(0.0, ["risk"])
    risky = _gaps(spark, d).where("critical").join(nodes.select("repo", "id", "name"), ["repo", "id"]).select("repo", F.concat_ws("::", "path", "name").alias("id"), F.lit(True).alias("untested")).distinct()
    wide = got.select("repo", "id").distinct().join(nodes.select("repo", "id", "path"), ["repo", "id"]).join(risky, ["repo", "id"], "left").groupBy("repo").agg(
        F.count(F.lit(1)).alias("nodes"), F.countDistinct("path").alias("files"), F.count("untested").alias("untested"))
    return each.groupBy("repo").agg(F.count(F.lit(1)).alias("changes"), F.round(F.max("risk"), 6).alias("max_risk"), F.round(F.avg("risk"), 6).alias("mean_risk")).join(wide, "repo", "left").fillna(0, ["nodes", "files", "untested"])


def reach_each(edges: DataFrame, seeds: DataFrame, most: int = 5_000_000) -> DataFrame:
    """(repo, key, id, depth): whole reverse reach of each key's seeds (key, repo, id) over its repository's edges, which are not copied for each key.

    Repositories with up to `most` edges times keys are walked whole in one task each, the others by the frontier loop.
    """
    links, seeds = stage(edges.select("repo", "src", "dst").distinct(), "links"), stage(seeds, "seeds")
    cost = seeds.groupBy("repo").agg(F.countDistinct("key").alias("keys")).join(links.groupBy("repo").agg(F.count(F.lit(1)).alias("n")), "repo")
    big = stage(cost.where(F.col("keys") * F.col("n") > most).select("repo"), "big")
    light = links.join(big, "repo", "left_anti").groupBy("repo").cogroup(seeds.join(big, "repo", "left_anti").groupBy("repo"))
    got = light.applyInPandas(_walk_each, "repo string, key string, id string, depth int")
    if big.isEmpty():
        return got
    node = lambda c: F.concat_ws("\u0001", "repo", c)
    far = reach_shared(links.join(big, "repo", "left_semi").select(node("src").alias("src"), node("dst").alias("dst")), seeds.join(big, "repo", "left_semi").select("key", node("id").alias("node")))
    return got.unionByName(far.select(F.split("node", "\u0001")[0].alias("repo"), "key", F.split("node", "\u0001")[1].alias("id"), "depth"))


def _walk_each(links: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    before: dict = {}
    for a, b in zip(links["src"], links["dst"]):
        before.setdefault(b, []).append(a)
    rows = []
    for (repo, key), part in seeds.groupby(["repo", "key"], sort=False):
        seen = dict.fromkeys(part["id"], 0)
        front, n = list(seen), 0
        while front:
            n, new = n + 1, []
            for at in front:
                for b in before.get(at, ()):
                    if b not in seen:
                        seen[b] = n
                        new.append(b)
            front = new
        rows += [(repo, key, v, m) for v, m in seen.items()]
    return pd.DataFrame(rows, columns=["repo", "key", "id", "depth"])


def reach_shared(links: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Reverse reach of many keys over one shared set of edges (src, dst), which is not copied for each key. Without depth, to the end."""
    steps = links.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    return traverse.spread(seeds.select("key", "node").distinct(), steps, ["node"], ["key", "node"], depth)


@query(GRAPH_SQL + _HUBS + """,
walk(repo, id, depth) AS (SELECT repo, id, 0 FROM hubs UNION SELECT w.repo, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.repo = w.repo AND e.dst = w.id WHERE w.depth < 32)
SELECT repo, id, min(depth) AS depth, (id IN (SELECT node_id FROM observed_spans)) AS observed FROM walk GROUP BY repo, id""")
def failure_cone(spark: SparkSession, d: str) -> DataFrame:
    """Everything that may fail with the hub, to the greatest depth of cones, and whether it was ever observed running."""
    nodes, edges = graph(spark, d)
    keyed = edges.select(F.col("repo").alias("key"), "src", "dst")
    got = traverse.reach(keyed, hubs(nodes, edges).select(F.col("repo").alias("key"), F.col("id").alias("node")), traverse.MOST_DEPTH, reverse=True)
    seen = table(spark, d, "observed_spans").select(F.col("node_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("observed", F.lit(True))
    return got.select(F.col("key").alias("repo"), F.col("node").alias("id"), "depth").join(seen, "id", "left").fillna(False, ["observed"])


#: Base confidence of an edge by kind; others have 0.94.
EDGE_CONFIDENCE = {"calls": 0.98, "import": 0.96, "extends": 0.99, "implements": 0.99, "instantiates": 0.98}


def causal_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """From each source the shortest path to everything within depth: length, confidence (product over its edges) and the path."""
    own = nodes.select("repo", "id", "path")
    base = F.lit(0.94)
    for kind, value in EDGE_CONFIDENCE.items():
        base = F.when(F.col("kind") == kind, value).otherwise(base)
    linked = edges.join(own.withColumnRenamed("id", "src").withColumnRenamed("path", "p1"), ["repo", "src"]).join(own.withColumnRenamed("id", "dst").withColumnRenamed("path", "p2"), ["repo", "dst"])
    sure = F.greatest(F.lit(0.5), F.least(F.lit(1.0), base + F.when(F.col("p1") == F.col("p2"), 0.01).otherwise(0.0)))
    steps = linked.select(F.col("repo").alias("key"), F.col("src").alias("node"), F.col("dst").alias("next"), F.col("eid").alias("seq"), sure.alias("c"))
    got = traverse.path_trees(steps, sources.select(F.col("repo").alias("key"), F.col("id").alias("node")), depth)
    return got.select(F.col("key").alias("repo"), F.col("node").alias("id"), "depth", F.round("confidence", 6).alias("confidence"), "path")


@query(GRAPH_SQL + _HUBS + """,
walk(repo, id, depth) AS (SELECT repo, id, 0 FROM roots UNION SELECT w.repo, e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.repo = w.repo AND e.src = w.id WHERE w.depth < 32),
near AS (SELECT repo, id, min(depth) AS depth FROM walk GROUP BY 1, 2),
via AS (SELECT b.repo, b.id, b.depth, arg_min(e.src, e.eid) AS src, arg_min(e.kind, e.eid) AS kind FROM near b JOIN edges e ON e.repo = b.repo AND e.dst = b.id JOIN near a ON a.repo = e.repo AND a.id = e.src AND a.depth = b.depth - 1 GROUP BY 1, 2, 3),
pth(repo, id, depth, confidence, path) AS (SELECT repo, id, 0, CAST(1.0 AS DOUBLE), id FROM roots UNION ALL SELECT v.repo, v.id, v.depth, p.confidence * greatest(0.5, least(1.0,
   CASE v.kind WHEN 'calls' THEN 0.98 WHEN 'import' THEN 0.96 WHEN 'extends' THEN 0.99 WHEN 'implements' THEN 0.99 WHEN 'instantiates' THEN 0.98 ELSE 0.94 END
   + CASE WHEN a.path = b.path THEN 0.01 ELSE 0.0 END)), p.path || ' > ' || v.id
  FROM pth p JOIN via v ON v.repo = p.repo AND v.src = p.id AND v.depth = p.depth + 1 JOIN nodes a ON a.repo = v.repo AND a.id = v.src JOIN nodes b ON b.repo = v.repo AND b.id = v.id)
SELECT repo, id, depth, round(confidence, 6) AS confidence, path FROM pth""")
def causal_path(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return causal_paths(nodes, edges, hubs(nodes, edges, "fan_out"), traverse.MOST_DEPTH)


def _scc_sql(where: str) -> str:
    return f""",
links AS (SELECT DISTINCT repo, src, dst FROM edges WHERE {where}),
clo(repo, a, b) AS (SELECT repo, src, dst FROM links UNION SELECT c.repo, c.a, l.dst FROM clo c JOIN links l ON l.repo = c.repo AND l.src = c.b),
scc AS (SELECT x.repo, x.a AS id, least(min(x.b), x.a) AS component FROM clo x JOIN clo y ON y.repo = x.repo AND y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.repo, x.a)"""


@query(GRAPH_SQL + _scc_sql("true") + " SELECT * FROM scc")
def scc_members(spark: SparkSession, d: str) -> DataFrame:
    return structure.cycles(graph(spark, d)[1])


@query(GRAPH_SQL + _scc_sql("kind IN ('import', 'extends', 'implements')") + " SELECT * FROM scc")
def architectural_scc(spark: SparkSession, d: str) -> DataFrame:
    return structure.cycles(graph(spark, d)[1], structure.STRUCTURAL_KINDS)


@query(GRAPH_SQL + """, links AS (SELECT DISTINCT repo, src, dst FROM edges WHERE kind IN ('import', 'extends', 'implements', 'property') AND src <> dst),
w(repo, start, tip, walk) AS (SELECT repo, src, dst, [src, dst] FROM links WHERE dst > src
  UNION ALL SELECT w.repo, w.start, l.dst, list_append(w.walk, l.dst) FROM w JOIN links l ON l.repo = w.repo AND l.src = w.tip WHERE l.dst > w.start AND NOT list_contains(w.walk, l.dst) AND len(w.walk) < 12)
SELECT w.repo, array_to_string(walk, ' -> ') AS cycle, CAST(len(walk) AS INT) AS n FROM w JOIN links l ON l.repo = w.repo AND l.src = w.tip AND l.dst = w.start""")
def simple_cycles(spark: SparkSession, d: str) -> DataFrame:
    links = graph(spark, d)[1].where(F.col("kind").isin(*structure.STRUCTURAL_KINDS, "property")).select(F.col("repo").alias("key"), "src", "dst")
    return traverse.simple_cycles(links).withColumnRenamed("key", "repo")


@query(GRAPH_SQL + _DEGREE + _scc_sql("true") + " SELECT repo, component, id, fan_in, fan_out FROM scc JOIN deg USING (repo, id)")
def decoupling_plan(spark: SparkSession, d: str) -> DataFrame:
    """Fan-in and fan-out of every node on a cycle."""
    nodes, edges = graph(spark, d)
    return structure.cycles(edges).join(traverse.degrees(nodes, edges), ["repo", "id"]).select("repo", "component", "id", "fan_in", "fan_out")


@query(GRAPH_SQL + """, asked AS (SELECT DISTINCT repository AS repo, array_to_string(p[greatest(len(p) - 1, 1):], '/') AS q FROM (SELECT repository, string_split(replace(path, chr(92), '/'), '/') AS p FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL)
  UNION SELECT repository, array_to_string(p[greatest(len(p) - 1, 1):], '/') || '::' || c.caller_name FROM (SELECT repository, string_split(replace(path, chr(92), '/'), '/') AS p, unnest(calls) AS c FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL) WHERE c.caller_name IS NOT NULL),
m AS (SELECT repo, id, replace(id, chr(92), '/') AS i, CASE WHEN lower(kind) = 'file' THEN replace(path, chr(92), '/') END AS p FROM nodes)
SELECT q.repo, q.q AS name, CASE WHEN count(m.id) = 1 THEN min(m.id) END AS id, count(m.id) AS candidates FROM asked q JOIN m ON m.repo = q.repo AND (m.i = q.q OR ends_with(m.i, '/' || q.q) OR m.p = q.q OR ends_with(m.p, '/' || q.q)) GROUP BY 1, 2""")
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    """Names to node ids: an id or its tail from a path part on, or a file by its path or a tail of it, if only one node has it. Asked are files and callers by their last two path parts."""
    files = table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL")
    parts = F.split(F.translate("path", "\\", "/"), "/")
    near = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    files = files.select(F.col("repository").alias("repo"), near.alias("near"), "calls")
    callers = files.select("repo", "near", F.explode("calls").alias("c")).where("c.caller_name IS NOT NULL").select("repo", F.concat_ws("::", "near", "c.caller_name").alias("name"))
    return traverse.resolve_ids(graph(spark, d)[0], files.select("repo", F.col("near").alias("name")).unionByName(callers).distinct())


@query(TWO_GRAPHS_SQL + """, a AS (SELECT repo, 'node' AS record, id AS key FROM nodes UNION SELECT repo, 'edge', lower(src || '->' || dst || '/' || kind) FROM edges),
b AS (SELECT repo, 'node' AS record, id AS key FROM nodes_was UNION SELECT repo, 'edge', lower(src || '->' || dst || '/' || kind) FROM edges_was)
SELECT repo, record, key, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT repo, record, key, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges that the latest snapshot has and the one before lacks, and the reverse."""

    def keys(back: int) -> DataFrame:
        nodes, edges = graph(spark, d, back)
        edge = F.lower(F.concat("src", F.lit("->"), "dst", F.lit("/"), "kind"))
        return nodes.select("repo", F.lit("node").alias("record"), F.col("id").alias("key")).unionByName(edges.select("repo", F.lit("edge").alias("record"), edge.alias("key")))

    now, was = keys(0), keys(1)
    return now.distinct().subtract(was).withColumn("change", F.lit("added")).unionByName(was.distinct().subtract(now).withColumn("change", F.lit("removed")))


# boundaries and drift

_RULES = ", rules(boundary, token, ord) AS (VALUES " + ", ".join(f"('{b}', '{t}', {i})" for b, ts in PATH_RULES.items() for i, t in enumerate(ts)) + ")"
_PATHB = """, pb0 AS (SELECT repo, id, CASE WHEN split_part(path, '/', 1) IN ('', 'src', '.') THEN 'root' ELSE split_part(path, '/', 1) END AS boundary FROM (SELECT repo, id, replace(path, chr(92), '/') AS path FROM nodes) WHERE path LIKE '%/%'),
pb AS (SELECT repo, boundary, id FROM pb0 QUALIFY count(*) OVER (PARTITION BY repo, boundary) > 1)"""
_NAMEB = ", nb AS (SELECT repo, id, CASE " + " ".join(f"WHEN name LIKE '%{s}' THEN '{b}'" for s, b in SUFFIXES) + " END AS boundary FROM nodes), mb AS (SELECT * FROM nb WHERE boundary IS NOT NULL)"


@query(GRAPH_SQL + _PATHB + " SELECT repo, boundary, count(*) AS members FROM pb GROUP BY 1, 2")
def path_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return structure.path_boundaries(graph(spark, d)[0]).groupBy("repo", "boundary").agg(F.count(F.lit(1)).alias("members"))


@query(GRAPH_SQL + _NAMEB + " SELECT repo, boundary, id FROM mb")
def naming_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return structure.naming_boundaries(graph(spark, d)[0], SUFFIXES)


def _layer_case() -> str:
    arms = []
    for name, paths, suffixes, _ in LAYER_PATHS:
        arms.append("WHEN " + " OR ".join([f"contains('/' || replace(path, chr(92), '/'), '{p}')" for p in paths] + [f"name LIKE '%{s}'" for s in suffixes]) + f" THEN '{name}'")
    return "CASE " + " ".join(arms) + " END"


@query(GRAPH_SQL + f""", l AS (SELECT repo, {_layer_case()} AS layer FROM nodes), c AS (SELECT repo, count(*) AS n, count(layer) AS k FROM l GROUP BY 1)
SELECT repo, layer, count(*) AS members, round((any_value(k / n) + CASE WHEN repo IN (SELECT repo FROM edges) THEN 1.0 ELSE 0.0 END) / 2, 6) AS confidence FROM l JOIN c USING (repo) WHERE layer IS NOT NULL GROUP BY 1, 2""")
def layered_pattern(spark: SparkSession, d: str) -> DataFrame:
    return structure.layered_pattern(*graph(spark, d), LAYER_PATHS)


@query(GRAPH_SQL + _PATHB + _RULES + " SELECT DISTINCT e.repo, e.src, e.dst, b.boundary, r.token FROM edges e JOIN pb b ON b.repo = e.repo AND b.id = e.src JOIN rules r USING (boundary) WHERE contains(e.dst, r.token)")
def drift_forbidden(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return structure.forbidden(edges, structure.path_boundaries(nodes), structure.rule_table(spark, PATH_RULES))


_SCAN = _PATHB + _RULES + """, crossing AS (SELECT e.repo, e.src, e.dst, b.boundary, arg_min(r.token, r.ord) AS token FROM edges e JOIN pb b ON b.repo = e.repo AND b.id = e.src JOIN rules r USING (boundary) JOIN nodes n ON n.repo = e.repo AND n.id = e.dst
 WHERE contains(lower(concat_ws(' ', n.name, n.path)), lower(r.token)) AND NOT EXISTS (SELECT 1 FROM pb x WHERE x.repo = e.repo AND x.boundary = b.boundary AND x.id = e.dst) GROUP BY 1, 2, 3, 4)"""


@query(GRAPH_SQL + _SCAN + _scc_sql("kind IN ('import', 'extends', 'implements')") + """, ring AS (SELECT repo, component, id, lead(id) OVER (PARTITION BY repo, component ORDER BY id) AS nxt FROM scc)
SELECT repo, src, dst, boundary, 'boundary_crossing' AS kind, 'warning' AS severity FROM crossing UNION ALL SELECT repo, id, nxt, NULL, 'circular_dependency', 'error' FROM ring WHERE nxt IS NOT NULL""")
def drift_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan's own drift: boundary crossings, and each cycle as pairs of neighbours in order of id."""
    nodes, edges = graph(spark, d)
    cross = structure.crossings(edges, structure.path_boundaries(nodes), nodes, structure.rule_table(spark, PATH_RULES))
    ring = structure.cycles(edges, structure.STRUCTURAL_KINDS).withColumn("dst", F.lead("id").over(W.partitionBy("repo", "component").orderBy("id"))).where("dst IS NOT NULL")
    return cross.select("repo", "src", "dst", "boundary", F.lit("boundary_crossing").alias("kind"), F.lit("warning").alias("severity")).unionByName(
        ring.select("repo", F.col("id").alias("src"), "dst", F.lit(None).cast("string").alias("boundary"), F.lit("circular_dependency").alias("kind"), F.lit("error").alias("severity"))
    )


_SKIP = _NAMEB + ", lay AS (SELECT repo, id, CASE boundary " + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(LAYER_ORDER)) + """ END AS layer FROM mb),
skips AS (SELECT e.repo, e.src, e.dst, e.kind, CAST(a.layer AS INT) AS from_layer, CAST(b.layer AS INT) AS to_layer FROM edges e JOIN lay a ON a.repo = e.repo AND a.id = e.src JOIN lay b ON b.repo = e.repo AND b.id = e.dst WHERE b.layer > a.layer + 1)"""


@query(GRAPH_SQL + _SKIP + " SELECT * FROM skips")
def drift_layer_skip(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return structure.layer_skips(edges, structure.naming_boundaries(nodes, SUFFIXES), LAYER_ORDER)


@query(GRAPH_SQL + _DEGREE + f" SELECT repo, id, fan_in, fan_out FROM deg WHERE fan_in > {GOD} OR fan_out > {GOD}")
def drift_god(spark: SparkSession, d: str) -> DataFrame:
    return structure.god_objects(*graph(spark, d), GOD)


@query(GRAPH_SQL + _DEGREE + f" SELECT repo, id, fan_in, fan_out, round(fan_out / (fan_in + fan_out), 6) AS instability FROM deg WHERE fan_in > {UNSTABLE_IN} AND fan_out / (fan_in + fan_out) > {UNSTABLE}")
def drift_unstable(spark: SparkSession, d: str) -> DataFrame:
    return structure.unstable(*graph(spark, d), UNSTABLE, UNSTABLE_IN)


@query(GRAPH_SQL + _scc_sql("kind IN ('import', 'extends', 'implements')") + " SELECT repo, component, string_agg(id, ', ' ORDER BY id) AS members, count(*) AS n FROM scc GROUP BY 1, 2")
def drift_circular(spark: SparkSession, d: str) -> DataFrame:
    got = structure.cycles(graph(spark, d)[1], structure.STRUCTURAL_KINDS)
    return got.groupBy("repo", "component").agg(F.concat_ws(", ", F.array_sort(F.collect_set("id"))).alias("members"), F.count(F.lit(1)).alias("n"))


def violations(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = (stage(x, "graph") for x in graph(spark, d))
    members = structure.path_boundaries(nodes).unionByName(structure.naming_boundaries(nodes, SUFFIXES))
    return structure.all_violations(nodes, edges, members, structure.rule_table(spark, PATH_RULES), LAYER_ORDER, GOD, UNSTABLE_IN, UNSTABLE)


_ALL = _DEGREE + _PATHB + _RULES + _SKIP + _scc_sql("kind IN ('import', 'extends', 'implements')") + f""",
violations AS (
SELECT repo, 'forbidden_dependency' AS kind, src, dst, boundary, 'error' AS severity, 2 AS rank FROM (SELECT DISTINCT e.repo, e.src, e.dst, b.boundary, r.token FROM edges e JOIN pb b ON b.repo = e.repo AND b.id = e.src JOIN rules r USING (boundary) WHERE contains(e.dst, r.token))
UNION ALL SELECT repo, 'circular_dependency', component, string_agg(id, ', ' ORDER BY id), NULL, 'critical', 3 FROM scc GROUP BY repo, component
UNION ALL SELECT DISTINCT repo, 'layer_skip', src, dst, CAST(NULL AS VARCHAR), 'warning', 1 FROM skips
UNION ALL SELECT repo, 'god_object', id, NULL, NULL, 'warning', 1 FROM deg WHERE fan_in > {GOD} OR fan_out > {GOD}
UNION ALL SELECT repo, 'unstable_dependency', id, NULL, NULL, 'info', 0 FROM deg WHERE fan_in > {UNSTABLE_IN} AND fan_out / (fan_in + fan_out) > {UNSTABLE})"""


@query(GRAPH_SQL + _ALL + " SELECT repo, kind, src, dst, boundary, severity, rank FROM violations")
def drift_severity(spark: SparkSession, d: str) -> DataFrame:
    return violations(spark, d)


@query(GRAPH_SQL + _ALL + f", pat AS (SELECT 1 FROM nodes WHERE {_layer_case()} IS NOT NULL LIMIT 1), advice(kind, priority, advice) AS (VALUES " + ", ".join(f"('{k}', CAST({p} AS DOUBLE), '{t}')" for k, (p, t) in structure.ADVICE.items())
 + ") SELECT kind, n, priority, advice FROM (SELECT kind, count(*) AS n FROM violations GROUP BY 1 UNION ALL SELECT 'no_pattern', 1 WHERE NOT EXISTS (SELECT 1 FROM pat)) JOIN advice USING (kind) ORDER BY priority DESC LIMIT 5")
def drift_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return structure.suggestions(violations(spark, d), structure.layered_pattern(*graph(spark, d), LAYER_PATHS))


@query(GRAPH_SQL + _ALL + " SELECT count(*) FILTER (rank >= 2) AS blocking, count(*) FILTER (rank >= 2) = 0 AS passed FROM violations")
def ci_gate(spark: SparkSession, d: str) -> DataFrame:
    return structure.gate(violations(spark, d))


@query(GRAPH_SQL + ", rules(rule, token) AS (VALUES ('no-gateway', 'gateway'), ('no-vendor', 'vendor')) SELECT n.repo, n.id, r.rule FROM nodes n JOIN rules r ON contains(n.id, r.token)")
def custom_rules(spark: SparkSession, d: str) -> DataFrame:
    return structure.custom_rules(graph(spark, d)[0], {"no-gateway": "gateway", "no-vendor": "vendor"})


@query(GRAPH_SQL + _ALL + " SELECT repo, kind, src, dst FROM violations WHERE contains(lower(concat_ws(' ', kind, src, dst, boundary)), 'ledger')")
def drift_search(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "kind", "src", "dst", "boundary"))
    return violations(spark, d).where(text.contains("ledger")).select("repo", "kind", "src", "dst")


@query(GRAPH_SQL + _ALL + f""", l AS (SELECT DISTINCT repo, {_layer_case()} AS layer FROM nodes) SELECT repo, 'pattern' AS type, layer AS what FROM l WHERE contains(layer, 'domain')
 UNION ALL SELECT repo, 'drift', concat_ws(' ', kind, src, dst) FROM violations WHERE contains(lower(concat_ws(' ', kind, src, dst, boundary)), 'domain')""")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Patterns and violations that mention a word."""
    return structure.search(violations(spark, d), structure.layered_pattern(*graph(spark, d), LAYER_PATHS), "domain")


_INCREMENTAL = "WITH RECURSIVE " + _graph_sql(0, "_all") + "," + CHANGES_SQL + """,
first AS (SELECT n.repo, arg_min(n.id, (lower(n.kind) <> 'file', n.line, n.id)) AS id FROM nodes_all n JOIN changes c ON c.repo = n.repo AND c.path = n.path GROUP BY n.repo, n.path),
part(repo, id) AS (SELECT repo, id FROM first UNION SELECT w.repo, e.dst FROM part w JOIN edges_all e ON e.repo = w.repo AND e.src = w.id),
nodes AS (SELECT n.* FROM nodes_all n JOIN part USING (repo, id)), edges AS (SELECT e.* FROM edges_all e JOIN part a ON a.repo = e.repo AND a.id = e.src JOIN part b ON b.repo = e.repo AND b.id = e.dst)""" + _ALL.replace("replace(path, chr(92), '/') AS path FROM nodes)", "replace(path, chr(92), '/') AS path FROM nodes_all)").replace("END AS boundary FROM nodes), mb", "END AS boundary FROM nodes_all), mb")


@query(_INCREMENTAL + " SELECT repo, kind, src, dst, boundary, severity, rank FROM violations")
def drift_incremental(spark: SparkSession, d: str) -> DataFrame:
    """All rules over only what the changed files lead to; boundaries are those of the whole."""
    nodes, edges = graph(spark, d)
    seeds = traverse.first_node(nodes, changes(spark, d)).select(F.col("repo").alias("key"), F.col("id").alias("node"))
    part = stage(traverse.reach(edges.select(F.col("repo").alias("key"), "src", "dst"), seeds).select(F.col("key").alias("repo"), F.col("node").alias("id")).distinct(), "part")
    sub = edges.join(part.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(part.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
    members = structure.path_boundaries(nodes).unionByName(structure.naming_boundaries(nodes, SUFFIXES))
    return structure.all_violations(nodes.join(part, ["repo", "id"], "left_semi"), stage(sub, "sub"), members, structure.rule_table(spark, PATH_RULES), LAYER_ORDER, GOD, UNSTABLE_IN, UNSTABLE)


@query(GRAPH_SQL + "," + CHANGES_SQL + " SELECT n.repo, n.path, arg_min(n.id, (lower(n.kind) <> 'file', n.line, n.id)) AS id FROM nodes n JOIN changes c ON c.repo = n.repo AND c.path = n.path GROUP BY 1, 2")
def find_by_path(spark: SparkSession, d: str) -> DataFrame:
    """The node that stands for each changed file."""
    return traverse.first_node(graph(spark, d)[0], changes(spark, d))


# test gaps and clones


@query(GRAPH_SQL + _GAPS + " SELECT * FROM gaps")
def test_gap_rows(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


@query(GRAPH_SQL + _GAPS + " SELECT repo, count(*) AS production, count(*) FILTER (covered) AS covered, round(100.0 * count(*) FILTER (covered) / count(*), 6) AS pct, count(*) FILTER (risk > 0.6) AS high_priority FROM gaps GROUP BY 1")
def test_gap_summary(spark: SparkSession, d: str) -> DataFrame:
    return structure.test_gap_summary(_gaps(spark, d))


_CLONES = """WITH f AS (SELECT file_id, regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n$', '') AS c FROM file_analyses WHERE content IS NOT NULL AND content <> ''),
l AS (SELECT file_id, list_transform(string_split(c, chr(10)), lambda x: array_to_string(list_transform(list_filter(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(13)), '\\s+'), lambda t: t <> ''),
   lambda t: CASE WHEN regexp_matches(t, '^["''`]') THEN 'STR' WHEN regexp_matches(t, '^[0-9]+$') THEN 'NUM' ELSE t END), ' ')) AS lines FROM f),
w AS (SELECT file_id, unnest(list_transform(generate_series(1, len(lines) - 7), lambda i: array_to_string(lines[i:i + 7], chr(10)))) AS body FROM l WHERE len(lines) >= 8),
c AS (SELECT md5(body) AS digest, count(*) AS places, count(DISTINCT file_id) AS files, min(substring(body, 1, 120)) AS snippet FROM w GROUP BY 1 HAVING count(*) > 1)"""


@query(_CLONES + " SELECT digest, places, files, snippet, 7 * (places - 1) AS duplicate_lines FROM c")
def clone_clusters(spark: SparkSession, d: str) -> DataFrame:
    return structure.clone_clusters(structure.clone_windows(table(spark, d, "file_analyses"), "file_id", "content"))


@query(_CLONES + " SELECT count(*) AS clusters, CAST(sum(7 * (places - 1)) AS BIGINT) AS duplicate_lines, round(least(99.0, 100.0 * sum(7 * (places - 1)) / (SELECT sum(len(lines)) FROM l)), 6) AS pct FROM c")
def clone_summary(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "file_analyses").where("content IS NOT NULL AND content <> ''")
    clean = F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), "\n\\z", "")
    total = files.agg(F.sum(F.size(F.split(clean, "\n"))).alias("lines")).first().lines or 0
    return clone_clusters(spark, d).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("duplicate_lines").alias("duplicate_lines"), F.round(F.least(F.lit(99.0), 100.0 * F.sum("duplicate_lines") / max(1, total)), 6).alias("pct")
    )
