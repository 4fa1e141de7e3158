"""The architecture query language: eight verbs, parsed on the driver and run as plans.

    query   := verb body option*  |  free text, which means MEMORY with the whole text
    verb    := MEMORY | PATH | DEPENDENTS | IMPACT | DNA | HISTORY | DIFF | RUNTIME
    option  := DEPTH n | LIMIT n, anywhere, at most 32 and 250
    PATH, DIFF take  a -> b;  IMPACT takes  path[:line]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERBS = {"MEMORY", "PATH", "DEPENDENTS", "IMPACT", "DNA", "HISTORY", "DIFF", "RUNTIME"}
MOST_CHARS = 12_000


@dataclass(frozen=True)
class Query:
    verb: str
    body: str | None = None
    other: str | None = None
    line: int = 1
    depth: int = 12
    limit: int = 32


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def parse(text: str) -> Query:
    raw = text.strip()
    if not raw:
        raise ValueError("a query is required")
    if len(raw) > MOST_CHARS:
        raise ValueError("the query is too long")
    words = raw.split()
    options = {"DEPTH": (12, 32), "LIMIT": (32, 250)}
    value = {}
    for name, (usual, most) in options.items():
        after = next((b for a, b in zip(words, words[1:]) if a.upper() == name), None)
        n = _number(after) if after else None
        value[name] = min(most, max(1, usual if n is None else n))
    depth, limit = value["DEPTH"], value["LIMIT"]
    verb = words[0].upper()
    if verb not in VERBS:
        return Query("MEMORY", raw, depth=min(depth, 8), limit=limit)
    kept, rest = [], words[1:]
    while rest:
        if rest[0].upper() in options and len(rest) > 1 and _number(rest[1]) is not None:
            rest = rest[2:]
        else:
            kept.append(rest.pop(0))
    body = " ".join(kept)
    if verb == "MEMORY":
        return Query(verb, body or "architecture overview", depth=min(depth, 8), limit=limit)
    if verb in ("PATH", "DIFF"):
        sides = [s.strip() for s in body.split("->") if s.strip()]
        if len(sides) != 2:
            raise ValueError(f"{verb} takes two sides: {verb} a -> b")
        return Query(verb, sides[0], sides[1], depth=depth, limit=limit)
    if verb == "DEPENDENTS" and not body:
        raise ValueError("DEPENDENTS needs a node id")
    if verb == "IMPACT":
        head, colon, tail = body.rpartition(":")
        line = _number(tail) if colon else None
        path = head.strip() if line is not None else body
        if not path:
            raise ValueError("IMPACT needs a path")
        return Query(verb, path, line=max(1, line) if line is not None else 1, depth=depth, limit=limit)
    return Query(verb, body or None, depth=depth, limit=limit)


def run(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The plan for a query over the latest snapshots of the tables in `d`."""
    from stratalens.operators import scoring, traverse
    from stratalens.plans import graphs, runtime, scores
    from stratalens.plans.views import graph

    q = parse(text)
    nodes, edges = graph(spark, d)
    if q.verb == "MEMORY":
        p = scoring.activity_priority(scores.measured(spark, d))
        return scoring.recall_neighbourhood(scoring.recall_scores(p, q.body), p, edges, q.depth, q.limit)
    if q.verb == "PATH":
        return graphs.causal_paths(nodes, edges, nodes.where(F.col("id") == q.body).select("repo", "id"), q.depth).where(F.col("id") == q.other)
    if q.verb == "DEPENDENTS":
        return graphs.impact(nodes, edges, nodes.where(F.col("id") == q.body), q.depth)
    if q.verb == "IMPACT":
        changed = nodes.where((F.col("path") == q.body) | F.col("path").endswith("/" + q.body)).select("repo", "path").distinct().withColumn("line", F.lit(q.line))
        return graphs.impact(nodes, edges, traverse.locate(nodes, changed), q.depth)
    if q.verb == "DNA":
        dna = scores.code_dna(spark, d)
        return dna.where(F.col("id") == q.body) if q.body else dna.orderBy(F.col("risk").desc(), "repo", "id").limit(q.limit)
    if q.verb == "RUNTIME":
        got = runtime.runtime_fusion(spark, d)
        return got.where(F.col("id") == q.body) if q.body else got
    snaps = spark.read.parquet(f"{d}/snapshots.parquet").dropDuplicates(["snapshot_id"])
    if q.verb == "HISTORY":
        return snaps.where((F.col("snapshot_id") == q.body) | (F.col("repository") == q.body)) if q.body else snaps
    side = lambda s: spark.read.parquet(f"{d}/snapshot_nodes.parquet").where(F.col("snapshot_id") == s).select("node_id").distinct()
    return side(q.other).subtract(side(q.body)).withColumn("change", F.lit("added")).unionByName(side(q.body).subtract(side(q.other)).withColumn("change", F.lit("removed")))
