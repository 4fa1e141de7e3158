"""Session helpers shared by every operator: tables, shared staging folder, size checks."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of a join are broadcast by hint only if they are below this many bytes in memory.
BROADCAST_BYTES = 8 << 20
#: Bytes in memory for a byte of estimate, at most: estimates of scans are sizes of compressed files.
EXPANSION = 4


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they may have no copy of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = shared_dir(spark)
    home = base.removeprefix("file://") if base.startswith("file:///") else tempfile.mkdtemp(prefix="stratalens-")
    os.makedirs(home, exist_ok=True)
    path = os.path.join(home, f"stratalens_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("stratalens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, lazily."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a folder of this machine serves sessions that run on this machine alone; elsewhere that is an
    error, as executors would write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="stratalens-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def staging_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stratalens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path of this application's own in the shared folder; `release` and the end of the application remove it."""
    root = staging_root(spark)
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove_at_exit, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


_ROOTS: set[str] = set()


def _remove_at_exit(spark: SparkSession, root: str) -> None:
    local = root.removeprefix("file://")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the JVM may be gone already
        remove(spark, root)


def release(spark: SparkSession) -> None:
    """Remove everything that this application has staged. Frames not yet consumed can't be read afterwards."""
    remove(spark, staging_root(spark))


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system), as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def make_dir(spark: SparkSession, path: str) -> None:
    where, fs = hadoop_path(spark, path)
    fs.mkdirs(where)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = hadoop_path(spark, path)
    fs.delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives the loss of executors.

    Used where a result is read more than once and recomputing it would cost a shuffle, or where row
    positions must not move between two readers. What is staged stays until `release` or the end of the application.
    """
    ship(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its size in memory is sure to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) * EXPANSION <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key128(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes that stand for a composite key; nulls and boundaries between columns count."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(c) if isinstance(c, str) else c), F.lit("n")) for c in cols])
    return [F.xxhash64(text), F.xxhash64(text, F.lit(7919))]


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` within `group` by `order`, without holding a group in one task.

    Rows are range-partitioned by (group, order), so one hot group spreads over many partitions; sums of whole
    partitions (at most one row for each partition and group) give each partition's offset. `order` must be
    total within the group; null values count as 0.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    width = shuffle_width(spark)
    placed = stage(
        df.repartitionByRange(width, *group, *order).withColumn("__pid", F.spark_partition_id()), "prefix"
    )
    whole = placed.groupBy("__pid", *group).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__part"))
    before = whole.withColumn(
        "__before",
        F.coalesce(F.sum("__part").over(W.partitionBy(*group).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("__part")
    w = W.partitionBy("__pid", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = placed.withColumn(out, F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(w), F.lit(0)))
    return running.join(before, ["__pid", *group]).withColumn(out, F.col(out) + F.col("__before")).drop("__pid", "__before")


#: Groups of up to so many rows are sorted in one task each.
HOT_ROWS = 1_000_000


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each row's place in its group by `order`, from 1, nulls first; `order` must be total within the group.

    Larger groups are range-partitioned over many tasks instead of being sorted in one.
    """
    from pyspark.sql import Window as W

    df = stage(df, "numbered")
    hot = stage(df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).select(*group), "hot")
    place = F.row_number().over(W.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in order])).cast("long")
    if hot.isEmpty():
        return df.withColumn(out, place)
    few, many = df.join(hot, group, "left_anti").withColumn(out, place), df.join(hot, group, "left_semi")
    spread = prefix_sum(many.withColumn("__one", F.lit(1).cast("long")), group, order, "__one", out)
    return few.unionByName(spread.withColumn(out, F.col(out) + 1).drop("__one"))
