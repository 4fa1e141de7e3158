"""What changed between full snapshots of a table.

Each record's key is windowed by the index of its snapshot within the repository. The lag of the content hash
reveals changes; gaps in the index reveal removals and later additions. So any number of snapshots takes one
shuffle by key, not one join for each pair of snapshots. Copies of a record meet on the map side; what then comes
together for a key is its snapshots, of each the distinct contents.

Defined results
* a snapshot listed in several rows counts once, with its least taken_at; snapshots of a repository are ordered
  by (taken_at, snapshot_id), null taken_at first; rows of unlisted snapshots are left out;
* repeated rows of a record count once; copies that contradict each other count as one state of their own (their
  least and greatest hash);
* a null is a value; order in maps and arrays, nested ones included, doesn't count, repeated elements do;
* rows with a null key name no record and are left out; a snapshot without rows has lost all its records;
* all columns but the key and snapshot_id are content, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.common import small


def canonical(col: Column, kind: T.DataType) -> Column:
    """The value with arrays and map entries sorted at every level, as something that can be compared and printed."""
    if isinstance(kind, T.MapType):
        col, kind = F.map_entries(col), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.ArrayType, T.MapType, T.StructType)):
            return F.array_sort(F.transform(col, lambda x: F.to_json(F.struct(canonical(x, inner).alias("v")), {"ignoreNullFields": "false"})))
        return F.sort_array(col)
    if isinstance(kind, T.StructType):
        parts = F.struct(*[canonical(col.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)])
        return F.when(col.isNull(), F.lit(None)).otherwise(parts)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return col + F.lit(0.0)
    return col


def content_hash(df: DataFrame, skip: list[str]) -> Column:
    fields = [f for f in df.schema.fields if f.name not in skip]
    text = F.to_json(F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"})
    return F.xxhash64(text)


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, repository, idx, last): position of each snapshot in its repository, from 1."""
    once = snapshots.where("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(F.min("repository").alias("repository"), F.min("taken_at").alias("taken_at"))
    w = W.partitionBy("repository").orderBy(F.col("taken_at").asc_nulls_first(), "snapshot_id")
    return once.select(
        "snapshot_id", "repository", F.row_number().over(w).alias("idx"), F.count(F.lit(1)).over(W.partitionBy("repository")).cast("int").alias("last")
    )


def snapshot_changes(records: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """(snapshot_id, record_id, change_type) of each record against the repository's previous snapshot.

    Snapshots become numbers before the shuffle. Each map task then holds a record's id once, with the set of its
    (number, hash) pairs, and the only exchange is the one by key, which the window works on too.
    """
    order = snapshot_order(snapshots)
    seen = (
        records.where(F.col(key).isNotNull())
        .select("snapshot_id", F.col(key).alias("record_id"), content_hash(records, [key, "snapshot_id"]).alias("h"))
        .join(small(order.select("snapshot_id", "repository", "idx", "last")), "snapshot_id")
        .groupBy("repository", "record_id").agg(F.collect_set(F.struct("idx", "h")).alias("states"), F.max("last").alias("last"))
        .select("repository", "record_id", "last", F.explode("states").alias("s"))
        .groupBy("repository", "record_id", F.col("s.idx").alias("idx")).agg(F.min("s.h").alias("h0"), F.max("s.h").alias("h1"), F.max("last").alias("last"))
    )
    w = W.partitionBy("repository", "record_id").orderBy("idx")
    prev, nxt = F.lag("idx").over(w), F.lead("idx").over(w)
    state = F.struct("h0", "h1")
    marked = seen.select(
        "repository", "record_id", "idx", "last", prev.alias("prev"), nxt.alias("nxt"), (F.lag(state).over(w) != state).alias("differs")
    )
    came = F.when((F.col("idx") > 1) & (F.col("prev").isNull() | (F.col("prev") < F.col("idx") - 1)), F.struct(F.col("idx").alias("idx"), F.lit("added").alias("change_type")))
    turned = F.when((F.col("prev") == F.col("idx") - 1) & F.col("differs"), F.struct(F.col("idx").alias("idx"), F.lit("changed").alias("change_type")))
    went = F.when((F.col("idx") < F.col("last")) & (F.col("nxt").isNull() | (F.col("nxt") > F.col("idx") + 1)), F.struct((F.col("idx") + 1).alias("idx"), F.lit("removed").alias("change_type")))
    events = marked.select("repository", "record_id", F.explode(F.array_compact(F.array(came, turned, went))).alias("e")).select("repository", "record_id", "e.idx", "e.change_type")
    return events.join(small(order.select("repository", "idx", "snapshot_id")), ["repository", "idx"]).select("snapshot_id", "record_id", "change_type")


def change_report(changes: DataFrame) -> DataFrame:
    """Counts per snapshot, record type and kind of change."""
    return changes.groupBy("snapshot_id", "record_type", "change_type").agg(F.count(F.lit(1)).alias("n"))
