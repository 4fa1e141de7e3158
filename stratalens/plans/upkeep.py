"""Queries for the data-upkeep problems: deliveries, snapshots, references, hierarchies.

Each has its SQL yardstick beside it where SQL can state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import small, table
from stratalens.operators import delivery, references, snapshots
from stratalens.operators.hierarchy import hierarchy, normal_spans

#: Runs in which a table of past deliveries enters the store.
RUNS = 2
SPAN_PAYLOAD = ["end_unix_nano", "received_at", "batch_id", "parent_span_id", "node_id", "name", "start_unix_nano", "duration_ms", "is_error"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    store = delivery.RunStore(spark, ["trace_id", "span_id"], ["end_unix_nano"], fold_case=True)
    store.load(table(spark, d, "observed_spans"), "batch_id", RUNS, ["end_unix_nano"])
    return store.compact().where("copies > 1").select("trace_id", "span_id", "end_unix_nano")


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message once, whole row."""
    store = delivery.RunStore(spark, ["trace_id", "span_id"], ["end_unix_nano", "received_at", "batch_id"], fold_case=True)
    store.load(table(spark, d, "observed_spans"), "batch_id", RUNS, SPAN_PAYLOAD)
    return store.compact()


P1_MESSAGES_SQL = """
SELECT lower(trace_id) AS trace_id, lower(span_id) AS span_id, end_unix_nano, received_at, batch_id, parent_span_id, node_id, name,
       start_unix_nano, duration_ms, is_error, count(*) OVER (PARTITION BY lower(trace_id), lower(span_id)) AS copies
FROM observed_spans WHERE trace_id IS NOT NULL AND span_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY lower(trace_id), lower(span_id) ORDER BY end_unix_nano DESC NULLS LAST, received_at DESC NULLS LAST,
  batch_id DESC NULLS LAST, parent_span_id DESC NULLS LAST, node_id DESC NULLS LAST, name DESC NULLS LAST, start_unix_nano DESC NULLS LAST,
  duration_ms DESC NULLS LAST, is_error DESC NULLS LAST) = 1
"""
P1_FOUND_SQL = """
SELECT lower(trace_id) AS trace_id, lower(span_id) AS span_id, max(end_unix_nano) AS end_unix_nano
FROM observed_spans WHERE trace_id IS NOT NULL AND span_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "snapshots")
    parts = [
        snapshots.snapshot_changes(table(spark, d, f"snapshot_{kind}s"), snaps, f"{kind}_id").withColumn("record_type", F.lit(kind))
        for kind in ("node", "edge")
    ]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("snapshot_id", "record_type", "record_id", "change_type")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_report(_changes(spark, d))


_P2 = """
WITH s AS (SELECT snapshot_id, min(repository) AS repository, min(taken_at) AS taken_at FROM snapshots GROUP BY 1),
o AS (SELECT snapshot_id, repository, row_number() OVER (PARTITION BY repository ORDER BY taken_at NULLS FIRST, snapshot_id) AS i FROM s),
pairs AS (SELECT b.snapshot_id, a.snapshot_id AS prev_id FROM o b JOIN o a ON a.repository = b.repository AND a.i = b.i - 1),
n AS (SELECT DISTINCT snapshot_id, node_id AS id, kind, name, path, line, col,
        list_sort(list_transform(exports, lambda x: CAST(x AS VARCHAR))) AS a,
        list_sort(list_transform(imports, lambda x: concat_ws('|', coalesce(x.source_name, chr(1)), coalesce(CAST(list_sort(x.symbols) AS VARCHAR), chr(1)), coalesce(x.kind, chr(1))))) AS b,
        list_sort(list_transform(map_entries(metadata), lambda x: CAST(x AS VARCHAR))) AS c FROM snapshot_nodes WHERE node_id IS NOT NULL),
e AS (SELECT DISTINCT snapshot_id, edge_id AS id, from_id, to_id, kind, weight,
        list_sort(list_transform(map_entries(metadata), lambda x: CAST(x AS VARCHAR))) AS c FROM snapshot_edges WHERE edge_id IS NOT NULL),
r AS (SELECT snapshot_id, 'node' AS record_type, id, CAST(row(kind, name, path, line, col, a, b, c) AS VARCHAR) AS h FROM n
      UNION ALL SELECT snapshot_id, 'edge', id, CAST(row(from_id, to_id, kind, weight, c) AS VARCHAR) FROM e),
now AS (SELECT p.snapshot_id, r.record_type, r.id, r.h FROM pairs p JOIN r ON r.snapshot_id = p.snapshot_id),
was AS (SELECT p.snapshot_id, r.record_type, r.id, r.h FROM pairs p JOIN r ON r.snapshot_id = p.prev_id),
found AS (SELECT coalesce(now.snapshot_id, was.snapshot_id) AS snapshot_id, coalesce(now.record_type, was.record_type) AS record_type,
  coalesce(now.id, was.id) AS record_id, CASE WHEN was.id IS NULL THEN 'added' WHEN now.id IS NULL THEN 'removed' ELSE 'changed' END AS change_type
FROM now FULL JOIN was ON now.snapshot_id = was.snapshot_id AND now.record_type = was.record_type AND now.id = was.id
WHERE was.id IS NULL OR now.id IS NULL OR now.h <> was.h)
"""
P2_FOUND_SQL = _P2 + "SELECT snapshot_id, record_type, record_id, change_type FROM found"
P2_REPORT_SQL = _P2 + "SELECT snapshot_id, record_type, change_type, count(*) AS n FROM found GROUP BY 1, 2, 3"


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    edges = references.dangling_edges(table(spark, d, "snapshot_edges"), table(spark, d, "snapshot_nodes"), table(spark, d, "snapshots"), once=False)
    days = table(spark, d, "snapshots").groupBy("snapshot_id").agg(day(F.min("taken_at")).alias("period_day"))
    edges = edges.join(small(days), "snapshot_id", "left").select(
        F.lit("snapshot_edges").alias("ref_table"), "period_day", F.col("edge_id").alias("record_id"), "ref_field"
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lives = table(spark, d, "causal_entities").select("entity_id", micros("recorded_at").alias("born"), micros("deleted_at").alias("gone"))
    facts = table(spark, d, "causal_facts").where("to_id IS NOT NULL AND NOT to_id RLIKE '^\\\\s*$'").select(
        F.col("to_id").alias("key"), micros("ingested_at").alias("at"), "fact_id", "ingested_at"
    )
    lost = references.orphans(facts, references.runs_of(references.lifetimes(lives, "entity_id", "born", "gone"), ["key"]), ["key"])
    lost = lost.select(
        F.lit("causal_facts").alias("ref_table"), day("ingested_at").alias("period_day"), F.col("fact_id").cast("string").alias("record_id"), F.lit("to_id").alias("ref_field")
    ).distinct()
    return edges.distinct().unionByName(lost)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and day."""
    return _orphans(spark, d).groupBy("ref_table", "ref_field", "period_day").agg(F.count(F.lit(1)).alias("n"))


_P3 = """
WITH ends AS (SELECT snapshot_id, edge_id, 'from_id' AS ref_field, from_id AS ref FROM snapshot_edges UNION ALL SELECT snapshot_id, edge_id, 'to_id', to_id FROM snapshot_edges),
found AS (
SELECT DISTINCT 'snapshot_edges' AS ref_table, strftime(s.taken_at, '%Y-%m-%d') AS period_day, edge_id AS record_id, ref_field
FROM ends LEFT JOIN (SELECT snapshot_id, min(taken_at) AS taken_at FROM snapshots GROUP BY 1) s USING (snapshot_id)
WHERE trim(ref) <> '' AND NOT EXISTS (SELECT 1 FROM snapshot_nodes n WHERE n.snapshot_id = ends.snapshot_id AND n.node_id = ends.ref)
UNION ALL
SELECT DISTINCT 'causal_facts', strftime(ingested_at, '%Y-%m-%d'), CAST(fact_id AS VARCHAR), 'to_id' FROM causal_facts f
WHERE regexp_matches(to_id, '\\S') AND NOT EXISTS (SELECT 1 FROM causal_entities e WHERE e.entity_id = f.to_id AND e.recorded_at <= f.ingested_at
  AND (e.deleted_at IS NULL OR e.deleted_at > f.ingested_at)))
"""
P3_FOUND_SQL = _P3 + "SELECT ref_table, period_day, record_id, ref_field FROM found"
P3_REPORT_SQL = _P3 + "SELECT ref_table, ref_field, period_day, count(*) AS n FROM found GROUP BY 1, 2, 3"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy(normal_spans(table(spark, d, "otlp_spans")), intervals=False)
    return h.where("depth >= 8 OR depth < 0").select("trace_id", "span_id", "root_span_id", "depth")


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every span: depth, root, path, subtree size, chain and the interval of preorder numbers of its descendants."""
    return hierarchy(normal_spans(table(spark, d, "otlp_spans")), intervals=True)


def hierarchy_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every span by joins, the way that traces too large to be solved whole take."""
    return hierarchy(normal_spans(table(spark, d, "otlp_spans")), intervals=False, scope_rows=0)


_P5 = """
WITH RECURSIVE n AS (SELECT lower(trim(trace_id)) AS t, lower(trim(span_id)) AS v, min(nullif(lower(trim(parent_span_id)), '')) AS p
  FROM otlp_spans WHERE trace_id IS NOT NULL AND span_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT t, v, v AS root, CAST(0 AS BIGINT) AS depth FROM n WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM n q WHERE q.t = n.t AND q.v = n.p)
  UNION ALL SELECT n.t, n.v, w.root, w.depth + 1 FROM w JOIN n ON n.t = w.t AND n.p = w.v)
"""
P5_FOUND_SQL = _P5 + """
SELECT t AS trace_id, v AS span_id, root AS root_span_id, depth FROM w WHERE depth >= 8
UNION ALL SELECT t, v, '', CAST(-1 AS BIGINT) FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.t = n.t AND w.v = n.v)
"""
HIERARCHY_BY_JOINS_SQL = _P5 + """
SELECT t AS trace_id, v AS span_id, root AS root_span_id, depth FROM w
UNION ALL SELECT t, v, '', CAST(-1 AS BIGINT) FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.t = n.t AND w.v = n.v)
"""
P5_HIERARCHY_SQL = _P5.rstrip() + """,
z AS (SELECT w.*, n.p FROM w JOIN n USING (t, v)),
up AS (SELECT t, v, v AS anc FROM w UNION ALL SELECT up.t, up.v, z.p FROM up JOIN z ON z.t = up.t AND z.v = up.anc WHERE z.depth > 0),
sz AS (SELECT t, anc AS v, count(*) AS size FROM up GROUP BY 1, 2),
sib AS (SELECT z.t, z.v, CASE WHEN z.depth > 0 THEN z.p END AS p, z.root, z.depth, sz.size, row_number() OVER k = 1 AND z.depth > 0 AS heavy,
    coalesce(sum(sz.size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM z JOIN sz USING (t, v) WINDOW k AS (PARTITION BY z.t, CASE WHEN z.depth > 0 THEN z.p END ORDER BY CASE WHEN z.depth > 0 THEN -sz.size ELSE 0 END, z.v)),
h AS (SELECT t, v, root, depth, size, v AS chain, CAST(0 AS BIGINT) AS chain_pos, CAST(ahead AS BIGINT) AS pre, v AS path FROM sib WHERE p IS NULL
  UNION ALL SELECT s.t, s.v, s.root, s.depth, s.size, CASE WHEN s.heavy THEN h.chain ELSE s.v END, CASE WHEN s.heavy THEN h.chain_pos + 1 ELSE 0 END, CAST(h.pre + 1 + s.ahead AS BIGINT), h.path || '/' || s.v
  FROM h JOIN sib s ON s.t = h.t AND s.p = h.v)
SELECT t AS trace_id, v AS span_id, root AS root_span_id, depth, size, chain, chain_pos, pre, path FROM h
UNION ALL SELECT t, v, '', CAST(-1 AS BIGINT), NULL, NULL, NULL, NULL, NULL FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.t = n.t AND w.v = n.v)
"""


QUERIES = {
    "p1_found": p1_found, "p1_messages": p1_messages, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_report": p3_report,
    "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "hierarchy_by_joins": hierarchy_by_joins,
}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_messages": P1_MESSAGES_SQL, "p2_found": P2_FOUND_SQL, "p2_report": P2_REPORT_SQL, "p3_found": P3_FOUND_SQL,
    "p3_report": P3_REPORT_SQL, "p5_found": P5_FOUND_SQL, "p5_hierarchy": P5_HIERARCHY_SQL, "hierarchy_by_joins": HIERARCHY_BY_JOINS_SQL,
}
