"""Model tables over the test tables: the property graph, spans, windows, facts. One SQL text beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small, table


def latest_snapshots(spark: SparkSession, d: str, back: int = 0) -> DataFrame:
    """(snapshot_id, repo): of each repository the latest snapshot, or the one `back` before it."""
    once = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.min("repository").alias("repo"), F.min("taken_at").alias("t"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.col("t").desc_nulls_last(), F.col("snapshot_id").desc()))
    return once.withColumn("r", rank).where(F.col("r") == back + 1).select("snapshot_id", "repo")


def graph(spark: SparkSession, d: str, back: int = 0) -> tuple[DataFrame, DataFrame]:
    """nodes(repo, id, kind, name, path, line, owner) and edges(repo, src, dst, kind, eid, call_line, weight) of the latest snapshots.

    One whole row per node id, and per edge (src, dst, kind); edges with both ends present.
    """
    snap = small(latest_snapshots(spark, d, back))
    nodes = first_rows(
        table(spark, d, "snapshot_nodes").where("node_id IS NOT NULL").join(snap, "snapshot_id").select("repo", F.col("node_id").alias("id"), "kind", "name", "path", "line", F.col("metadata")["owner"].alias("owner")), ["repo", "id"]
    )
    ends = nodes.select("repo", "id")
    edges = first_rows(
        table(spark, d, "snapshot_edges").join(snap, "snapshot_id").select("repo", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lower("kind").alias("kind"), F.col("edge_id").alias("eid"), F.col("metadata")["line"].alias("call_line"), "weight"),
        ["repo", "src", "dst", "kind"],
    ).join(ends.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
    return nodes, edges


def first_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One whole row for each key, the first in the order of its other columns, nulls last: copies that contradict each other are never mixed."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))])
    return df.groupBy(*keys).agg(F.min(order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def _first_sql(keys: str, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


def _graph_sql(back: int, suffix: str = "") -> str:
    return f"""
snap{suffix} AS (SELECT snapshot_id, repo FROM (SELECT snapshot_id, min(repository) AS repo, min(taken_at) AS t FROM snapshots GROUP BY 1)
  QUALIFY row_number() OVER (PARTITION BY repo ORDER BY t DESC NULLS LAST, snapshot_id DESC) = {back + 1}),
nodes{suffix} AS (SELECT repo, node_id AS id, kind, name, path, line, element_at(metadata, 'owner')[1] AS owner FROM snapshot_nodes JOIN snap{suffix} USING (snapshot_id) WHERE node_id IS NOT NULL
  {_first_sql('repo, node_id', "kind, name, path, line, element_at(metadata, 'owner')[1]")}),
edges{suffix} AS (SELECT * FROM (SELECT repo, from_id AS src, to_id AS dst, lower(e.kind) AS kind, edge_id AS eid, element_at(metadata, 'line')[1] AS call_line, weight FROM snapshot_edges e JOIN snap{suffix} USING (snapshot_id)) x
  WHERE EXISTS (SELECT 1 FROM nodes{suffix} n WHERE n.repo = x.repo AND n.id = x.src) AND EXISTS (SELECT 1 FROM nodes{suffix} n WHERE n.repo = x.repo AND n.id = x.dst) {_first_sql('repo, src, dst, kind', 'eid, call_line, weight')})"""


GRAPH_SQL = "WITH RECURSIVE " + _graph_sql(0)
TWO_GRAPHS_SQL = "WITH RECURSIVE " + _graph_sql(0) + "," + _graph_sql(1, "_was")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, line): one change for each analysed file, at the line of its first call (1 if it has none)."""
    files = table(spark, d, "file_analyses").where("path IS NOT NULL AND repository IS NOT NULL")
    line = F.coalesce(F.array_min(F.transform("calls", lambda c: c["line"])), F.lit(1))
    return files.groupBy(F.col("repository").alias("repo"), F.translate("path", "\\", "/").alias("path")).agg(F.min(line).cast("int").alias("line"))


CHANGES_SQL = """
changes AS (SELECT repository AS repo, replace(path, chr(92), '/') AS path, CAST(min(coalesce(list_min(list_transform(calls, lambda c: c.line)), 1)) AS INT) AS line
  FROM file_analyses WHERE path IS NOT NULL AND repository IS NOT NULL GROUP BY 1, 2)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Observed spans, one row per message: t, v, p, node_id, name, start, stop, ms, err."""
    from stratalens.operators.delivery import collapse

    once = collapse(
        table(spark, d, "observed_spans"), ["trace_id", "span_id"], ["end_unix_nano", "received_at", "batch_id"],
        ["end_unix_nano", "received_at", "batch_id", "parent_span_id", "node_id", "name", "start_unix_nano", "duration_ms", "is_error"], fold_case=True,
    )
    return once.select(
        F.col("trace_id").alias("t"), F.col("span_id").alias("v"), F.nullif(F.lower(F.trim("parent_span_id")), F.lit("")).alias("p"), "node_id",
        F.coalesce("name", F.lit("")).alias("name"), F.col("start_unix_nano").alias("start"), F.col("end_unix_nano").alias("stop"),
        F.col("duration_ms").alias("ms"), F.coalesce("is_error", F.lit(False)).alias("err"),
    )


SPANS_SQL = """
WITH RECURSIVE spans AS (SELECT lower(trace_id) AS t, lower(span_id) AS v, nullif(lower(trim(parent_span_id)), '') AS p, node_id, coalesce(name, '') AS name, start_unix_nano AS start, end_unix_nano AS stop,
    duration_ms AS ms, coalesce(is_error, false) AS err
  FROM observed_spans WHERE trace_id IS NOT NULL AND span_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trace_id), lower(span_id) ORDER BY end_unix_nano DESC NULLS LAST, received_at DESC NULLS LAST, batch_id DESC NULLS LAST,
    parent_span_id DESC NULLS LAST, node_id DESC NULLS LAST, name DESC NULLS LAST, start_unix_nano DESC NULLS LAST, duration_ms DESC NULLS LAST, is_error DESC NULLS LAST) = 1)"""


def facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """entities(id, kind, name, repo, path) and facts(fact_id, src, dst, rel, ev, conf, cond, ms), one whole row per id.

    Facts need a source and target that are known entities and a confidence from 0 to 1.
    """
    entities = first_rows(table(spark, d, "causal_entities").where("entity_id IS NOT NULL").select(F.col("entity_id").alias("id"), "kind", "name", F.col("repository").alias("repo"), "path"), ["id"])
    rows = first_rows(
        table(spark, d, "causal_facts").where("fact_id IS NOT NULL AND confidence >= 0 AND confidence <= 1")
        .select("fact_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("relation").alias("rel"), F.col("evidence").alias("ev"), F.col("confidence").alias("conf"), "cond", F.col("timestamp_ms").alias("ms")), ["fact_id"]
    )
    known = entities.select("id")
    rows = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return entities, rows


FACTS_SQL = f"""
WITH RECURSIVE entities AS (SELECT entity_id AS id, kind, name, repository AS repo, path FROM causal_entities WHERE entity_id IS NOT NULL {_first_sql('entity_id', 'kind, name, repository, path')}),
facts AS (SELECT * FROM (SELECT fact_id, from_id AS src, to_id AS dst, relation AS rel, evidence AS ev, confidence AS conf, cond, timestamp_ms AS ms
  FROM causal_facts WHERE confidence >= 0 AND confidence <= 1 AND fact_id IS NOT NULL {_first_sql('fact_id', 'from_id, to_id, relation, evidence, confidence, cond, timestamp_ms')})
  WHERE src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities))"""
