"""References to records that do not exist.

A parent exists at whole numbers: the positions of the snapshots that hold it in their repository's sequence, or the
microseconds of its lifetime. These sorted numbers are compressed into contiguous runs, from the parents alone, so a
node that lives through forty snapshots is one run. A reference brings a number of its own, whether or not its parent
exists, is matched as-of to the start of the preceding run, and is an orphan if there is none or its number lies
beyond that run's end.

Runs of a parent are packed in sorted arrays; runs beyond `pack` go to further rows, each holding the range of numbers
it answers for, so a reference still meets just one row. A parent to which a third of all rows refer makes many rows
of the references' side, which the adaptive planner splits; copies of a parent meet on the map side.

Defined results: null or blank references refer to nothing and are no orphans; repeated rows count once; a parent
without recorded_at never begins; deleted_at at or before recorded_at gives an empty run; a reference without a
time is an orphan (nothing is known to exist then), as is one without a snapshot. A snapshot that isn't listed is a
repository of its own. Empty tables give empty results, or all references if it is the parents that are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import key128, small
from stratalens.operators.snapshots import snapshot_order

#: Runs held in one array row.
PACK = 64
FOREVER = (1 << 63) - 1


def positions(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, seq, at): of each listed snapshot its repository's sequence and its place in it."""
    return snapshot_order(snapshots).select("snapshot_id", F.coalesce("repository", F.lit("")).alias("seq"), F.col("idx").alias("at"))


def placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with seq and at; a snapshot that isn't listed has a sequence of its own."""
    got = rows.join(small(places), "snapshot_id", "left")
    return got.withColumns({"seq": F.when(F.col("at").isNull(), F.concat(F.lit("?"), "snapshot_id")).otherwise(F.concat(F.lit("="), "seq")), "at": F.coalesce("at", F.lit(0)).cast("long")})


def dangling_edges(edges: DataFrame, nodes: DataFrame, snapshots: DataFrame, once: bool = True) -> DataFrame:
    """(snapshot_id, edge_id, ref_field): edge ends without a node of that id in the same snapshot; with `once`, each once."""
    places = positions(snapshots)
    h = lambda c: [x.alias(n) for x, n in zip(key128("seq", c), ("h1", "h2"))]
    parents = placed(nodes.where("node_id IS NOT NULL AND snapshot_id IS NOT NULL").select("snapshot_id", "node_id"), places).select(*h("node_id"), F.col("at").alias("s"), F.col("at").alias("e"))
    ends = placed(edges.select("snapshot_id", "edge_id", "from_id", "to_id"), places).select(
        "snapshot_id", "edge_id", "seq", "at",
        F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("ref")) for f in ("from_id", "to_id")])).alias("x"),
    ).where("x.ref IS NOT NULL AND trim(x.ref) <> ''")
    refs = ends.select("snapshot_id", "edge_id", "x.ref_field", *h("x.ref"), "at")
    found = orphans(refs, runs_of(parents, ["h1", "h2"]), ["h1", "h2"]).select("snapshot_id", "edge_id", "ref_field")
    return found.distinct() if once else found


def lifetimes(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, s, e): first and last microsecond of each lifetime that isn't empty."""
    return parents.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("key"), F.col(start).alias("s"), F.coalesce(F.col(end) - 1, F.lit(FOREVER)).alias("e")).where("e >= s")


def runs_of(parents: DataFrame, keys: list[str], pack: int = PACK) -> DataFrame:
    """From (keys..., s, e), the numbers s to e at which a parent exists: its disjoint runs, `pack` to a row (keys..., lo, hi, runs); a row answers for numbers in [lo, hi)."""
    span = parents.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    w = W.partitionBy(*keys).orderBy("s")
    # a run begins where nothing before it reaches up to its neighbour
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") - 1 > reach), 1).otherwise(0)
    runs = (
        span.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*keys, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .withColumn("chunk", F.floor((F.col("run") - 1) / pack))
    )
    rows = runs.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))
    by = W.partitionBy(*keys).orderBy("chunk")
    first = F.col("runs")[0]["s"]
    return rows.select(*keys, first.alias("lo"), F.coalesce(F.lead(first).over(by), F.lit(FOREVER)).alias("hi"), "runs")


def orphans(refs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `refs` (keys..., at, ...) whose key has no run that holds the number `at`."""
    packed = runs.select(*[F.col(k).alias(f"__{k}") for k in keys], "lo", "hi", "runs")
    on = (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    met = refs.join(packed, on, "left")
    preceding = F.element_at(F.filter("runs", lambda r: r["s"] <= F.col("at")), -1)
    return met.withColumn("run", F.when(F.col("lo").isNotNull(), preceding)).where(F.col("run").isNull() | (F.col("at") > F.col("run")["e"])).select(*refs.columns)
