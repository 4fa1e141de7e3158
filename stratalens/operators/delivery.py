"""Messages delivered at least once: keep exactly one row for each identifier.

`RunStore` is an idempotent upsert into hash-bucketed sorted storage. Each upsert collapses its own batch
(map-side first, so an identifier repeated in a third of all rows never meets in one task uncombined) and writes
one sorted run: one file per bucket. Compaction merges sorted runs two by two, bucket by bucket, without an exchange
or a sort, so that equal identifiers collapse to one row. An upsert under a run id that exists replaces that run, and
one under an id that has been merged changes nothing, so a batch that is replayed, before or after a compaction,
counts once.

Defined results
* identifiers are compared in lower case when `fold_case` is set (hexadecimal numbers), else as written;
* the kept copy is the one with the greatest `order` columns, nulls lowest; ties fall to the remaining payload
  columns from left to right, so the result doesn't depend on the order of rows;
* rows with a null in any key column name no message: `upsert` leaves them out, `collapse(keep_unkeyed=True)`
  passes each through with 1 copy;
* an empty batch makes an empty run; extra columns are payload if listed, else ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import hadoop_path, make_dir, new_path, remove, shuffle_width

COPIES = "copies"
#: Id of the run that compaction leaves.
MERGED = -1


def _keys(keys: list[str], fold_case: bool) -> list[Column]:
    return [(F.lower(F.col(k)) if fold_case else F.col(k)).alias(k) for k in keys]


def _named(keys: list[str]) -> str:
    return " AND ".join(f"`{k}` IS NOT NULL" for k in keys)


def collapse(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    payload: list[str] | None = None,
    fold_case: bool = False,
    copies: str = COPIES,
    weight: str | None = None,
    keep_unkeyed: bool = False,
) -> DataFrame:
    """One row per key: the greatest version by `order`, with the number of rows it stands for.

    A partial aggregate runs before the only shuffle. `weight` names a column that already counts copies.
    """
    payload = [c for c in (payload if payload is not None else df.columns) if c not in keys and c != weight]
    rest = [c for c in payload if c not in order]
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    keyed = df.select(*_keys(keys, fold_case), *order, *rest, *([weight] if weight else [])).where(_named(keys))
    if not rest and len(order) == 1:
        out = keyed.groupBy(*keys).agg(F.max(order[0]).alias(order[0]), count.alias(copies))
    else:
        best = F.max(F.struct(*order, *rest)).alias("__best")
        out = keyed.groupBy(*keys).agg(best, count.alias(copies)).select(*keys, "__best.*", copies)
    if keep_unkeyed:
        loose = df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).select(
            *_keys(keys, fold_case), *order, *rest, (F.col(weight) if weight else F.lit(1).cast("long")).alias(copies)
        )
        out = out.unionByName(loose)
    return out


class RunStore:
    """Sorted runs in hash buckets under one folder of the shared file system.

    A generation is one folder of runs. The manifest says which one counts, how it is laid out, and which runs the
    merged run (id -1) has taken in; its newest version is the store's state, written before the old generation goes,
    so a store can be opened again by its path, whatever broke off. One writer at a time.

    Runs have ids from 0. Writing an id again replaces that run; once a run has been merged, writing it again changes
    nothing, since the batch is there already.
    """

    def __init__(self, spark: SparkSession, keys: list[str], order: list[str], fold_case: bool = False, buckets: int | None = None, path: str | None = None):
        self.spark, self.keys, self.order, self.fold_case = spark, keys, order, fold_case
        self.path = (path or new_path(spark, "runs")).rstrip("/")
        self.generation, self.version, self.columns, self.table = 0, 0, None, None
        #: Merged run ids as ranges [first, last], so that the manifest doesn't grow with every run.
        self.merged: list[list[int]] = []
        self.buckets = buckets or shuffle_width(spark)
        self._open()

    # the manifest

    def _open(self) -> None:
        where, fs = hadoop_path(self.spark, f"{self.path}/manifest")
        found = [int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()] if fs.exists(where) else []
        if not found:
            return
        self.version = max(found)
        state = json.loads(self.spark.read.text(f"{self.path}/manifest/{self.version}", wholetext=True).first()[0])
        if state["keys"] != self.keys:
            raise ValueError(f"the store at {self.path} is keyed by {state['keys']}")
        self.generation, self.merged, self.columns, self.buckets = state["generation"], state["merged"], state["columns"], state["buckets"]
        self.table = self._attach(self.generation, ordered=True)
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _commit(self) -> None:
        """The state as the next version: written beside, then renamed, so that a reader sees a whole one."""
        state = {"generation": self.generation, "merged": self.merged, "columns": self.columns, "buckets": self.buckets, "keys": self.keys}
        self.version += 1
        make_dir(self.spark, f"{self.path}/manifest")
        part, fs = hadoop_path(self.spark, f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(json.dumps(state).encode())
        out.close()
        fs.rename(part, hadoop_path(self.spark, f"{self.path}/manifest/{self.version}")[0])
        if self.version > 1:
            remove(self.spark, f"{self.path}/manifest/{self.version - 1}")

    def _attach(self, generation: int, ordered: bool) -> str:
        """A catalog entry for a generation's folder. Entries are this object's own; what counts is in the folder."""
        name, at = f"runs_{uuid.uuid4().hex[:16]}", f"{self.path}/gen={generation}"
        make_dir(self.spark, at)
        by = ", ".join(f"`{k}`" for k in self.keys)
        fields = ", ".join(f"`{c}` {kind}" for c, kind in self.columns)
        self.spark.sql(
            f"CREATE TABLE {name} ({fields}, run_id INT) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run_id) "
            f"CLUSTERED BY ({by}) {f'SORTED BY ({by}) ' if ordered else ''}INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )
        return name

    def _begin(self, df: DataFrame) -> None:
        columns = [[f.name, f.dataType.simpleString()] for f in df.schema.fields if f.name != "run_id"]
        if self.table is None:
            self.columns = columns
            remove(self.spark, f"{self.path}/gen={self.generation}")
            self.table = self._attach(self.generation, ordered=True)
            self._commit()
        elif columns != self.columns:
            raise ValueError(f"a run has the columns {columns}, the store {self.columns}")

    # runs

    def _merged(self, run_id: int) -> bool:
        return any(a <= run_id <= b for a, b in self.merged)

    def run_ids(self) -> list[int]:
        """Runs not merged yet, and -1 if there is a merged one."""
        if self.table is None:
            return []
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect())

    def _insert(self, name: str, df: DataFrame, run_id: int | None) -> None:
        view = f"run_{uuid.uuid4().hex[:12]}"
        session = df.sparkSession  # a micro-batch has a session of its own
        df.createOrReplaceTempView(view)
        cols = ", ".join(f"`{c}`" for c, _ in self.columns)
        part = "PARTITION (run_id)" if run_id is None else f"PARTITION (run_id = {run_id})"
        mode = session.conf.get("spark.sql.sources.partitionOverwriteMode")
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            session.sql(f"INSERT OVERWRITE TABLE {name} {part} SELECT {cols}{', run_id' if run_id is None else ''} FROM {view}")
        finally:
            session.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
            session.catalog.dropTempView(view)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        # The aggregate's exchange already hashes by the keys into as many partitions as there are buckets, so each
        # bucket of a run is one sorted file; only another bucket count needs an exchange of its own.
        return df if self.buckets == shuffle_width(df.sparkSession) else df.repartition(self.buckets, *self.keys)

    def upsert(self, batch: DataFrame, run_id: int, payload: list[str] | None = None) -> bool:
        """Add a batch as sorted run `run_id`, in place of any earlier run of that id. False, and no change, if that run is merged already."""
        if run_id < 0:
            raise ValueError("run ids begin at 0")
        if self._merged(run_id):
            return False
        run = collapse(batch, self.keys, self.order, payload, self.fold_case)
        self._begin(run)
        self._insert(self.table, self._bucketed(run), run_id)
        return True

    def load(self, df: DataFrame, batch: str, runs: int, payload: list[str]) -> None:
        """A table of past deliveries as the first `runs` runs, in one pass: a row's run is its batch number modulo `runs`, 0 for null.

        One aggregate holds a state for each run, so copies meet on the map side and each row is shuffled at most once.
        """
        if self.run_ids() or self.merged:
            raise ValueError("only an empty store can be loaded at once")
        payload = [c for c in payload if c not in self.keys]
        rest = [c for c in payload if c not in self.order]
        run = F.coalesce(F.pmod(F.col(batch).cast("long"), F.lit(runs)), F.lit(0)).cast("int")
        keyed = df.select(*_keys(self.keys, self.fold_case), *self.order, *rest, run.alias("__run")).where(_named(self.keys))
        mine = lambda n: F.col("__run") == n
        version = F.col(self.order[0]) if not rest and len(self.order) == 1 else F.struct(*self.order, *rest)
        aggs = [a for n in range(runs) for a in (F.max(F.when(mine(n), version)).alias(f"__v{n}"), F.count(F.when(mine(n), 1)).alias(f"__n{n}"))]
        every = keyed.groupBy(*self.keys).agg(*aggs)
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("run_id"), F.col(f"__v{n}").alias("v"), F.col(f"__n{n}").alias(COPIES)) for n in range(runs)])).alias("__e")
        held = every.select(*self.keys, each).where(f"__e.{COPIES} > 0")
        cols = [F.col("__e.v").alias(self.order[0])] if not rest and len(self.order) == 1 else [F.col(f"__e.v.`{c}`").alias(c) for c in (*self.order, *rest)]
        out = held.select(*self.keys, *cols, f"__e.{COPIES}", "__e.run_id")
        self._begin(out)
        self._insert(self.table, self._bucketed(out), None)

    def _run(self, run_id: int, table: str | None = None) -> DataFrame:
        return self.spark.table(table or self.table).where(F.col("run_id") == run_id).drop("run_id")

    def read(self) -> DataFrame:
        """Merge on read: the runs of each bucket, collapsed. No exchange: the scan is bucketed by the keys."""
        if self.table is None:
            raise ValueError("nothing has been written yet")
        return collapse(self.spark.table(self.table).drop("run_id"), self.keys, self.order, weight=COPIES)

    # compaction

    def _merge_two(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs as one: a merge join of what is sorted already, equal keys becoming one row."""
        rest = [c for c, _ in self.columns if c not in (*self.keys, *self.order, COPIES)]
        version = lambda s: F.when(F.col(f"{s}.{COPIES}").isNotNull(), F.struct(*[F.col(f"{s}.`{c}`").alias(c) for c in (*self.order, *rest)]))
        on = [F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in self.keys]
        both = a.alias("a").join(b.alias("b").hint("merge"), on, "full_outer")
        best = F.greatest(version("a"), version("b")).alias("__best")
        n = (F.coalesce(F.col(f"a.{COPIES}"), F.lit(0)) + F.coalesce(F.col(f"b.{COPIES}"), F.lit(0))).alias(COPIES)
        return both.select(*[F.coalesce(f"a.`{k}`", f"b.`{k}`").alias(k) for k in self.keys], best, n).select(
            *[c if c in (*self.keys, COPIES) else F.col(f"__best.`{c}`").alias(c) for c, _ in self.columns]
        )

    def merge_plan(self, a: int, b: int) -> DataFrame:
        """Runs `a` and `b` merged, as `compact` does it."""
        with self._conf(_SORTED_SCAN):
            merged = self._merge_two(self._run(a), self._run(b))
            is_merge(merged)  # plans it under these settings
            return merged

    def compact(self) -> DataFrame:
        """Merge all runs into one sorted run of a new generation and return it. Frames read from older generations end with them.

        Runs are merged two by two, each bucket's files being read side by side in their order. A merge join gives its
        rows in the order of the keys, but a full join doesn't tell the planner, which would sort them again: what the
        plan shows to be merged is therefore written through an entry that asks for no order.
        """
        if self.table is None:
            raise ValueError("nothing has been written yet")
        todo = self.run_ids()
        taken = [r for r in todo if r != MERGED]
        if not taken and todo:
            return self._run(MERGED)
        first, step, source = self.generation, self.generation, self.table
        while todo != [MERGED]:
            step += 1
            remove(self.spark, f"{self.path}/gen={step}")
            sorted_, plain = self._attach(step, ordered=True), self._attach(step, ordered=False)
            done = []
            with self._conf(_SORTED_SCAN):
                for i in range(0, max(1, len(todo)), 2):
                    ids = todo[i : i + 2]
                    runs = [self._run(r, source) for r in ids] or [self.spark.table(source).drop("run_id")]
                    run = self._merge_two(*runs) if len(runs) == 2 else runs[0]
                    done.append(MERGED if len(todo) <= 2 else i // 2)
                    merges = len(runs) == 2 and is_merge(run)
                    with self._conf(_ONE_WRITER if merges else {}):
                        self._insert(plain if merges else sorted_, run, done[-1])
            self.spark.sql(f"DROP TABLE {plain}")
            self.spark.sql(f"ALTER TABLE {sorted_} RECOVER PARTITIONS")
            self.spark.sql(f"DROP TABLE {source}")
            source, todo = sorted_, done
        self.generation, self.table, self.merged = step, source, _with_ids(self.merged, taken)
        self._commit()
        for old in range(first, step):
            remove(self.spark, f"{self.path}/gen={old}")
        return self._run(MERGED)

    @contextlib.contextmanager
    def _conf(self, values: dict[str, str]):
        was = {k: self.spark.conf.get(k, None) for k in values}
        for k, v in values.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


#: Each bucket of a run is one file, so a scan of one run has the order of its files.
_SORTED_SCAN = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
#: A task of a merge writes one bucket, so its writer needs no sort by bucket.
_ONE_WRITER = {"spark.sql.maxConcurrentOutputFileWriters": "2"}


def is_merge(df: DataFrame) -> bool:
    """Whether the plan merges sorted runs: a merge join without any exchange or sort."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def _with_ids(ranges: list[list[int]], ids: list[int]) -> list[list[int]]:
    """Ranges of whole numbers with more numbers in them, joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted([*map(list, ranges), *[[i, i] for i in ids]]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
