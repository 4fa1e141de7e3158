import datetime as dt
import glob
import os

import pyarrow.parquet as pq
import pytest

from stratalens.operators.delivery import RunStore, collapse, is_merge

SCHEMA = "trace_id string, span_id string, end_unix_nano long, received_at timestamp, batch_id long, copies string, name string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(t, s, end, b, name="n", copies="x"):
    return (t, s, end, dt.datetime(2026, 3, 1) if b is None else dt.datetime(2026, 3, 1 + b), b, copies, name)


def test_one_copy_of_each_latest_end_wins(spark, rows):
    df = batch(spark, [row("AA", "1", 5, 0), row("aa", "1", 9, 1, "late"), row("aa", "1", None, 2), row("aa", "2", None, 0), row("bb", "1", 3, 0)])
    got = collapse(df, ["trace_id", "span_id"], ["end_unix_nano", "received_at", "batch_id"], ["end_unix_nano", "name"], fold_case=True, copies="n")
    assert rows(got, "trace_id", "span_id", "end_unix_nano", "name", "n") == [("aa", "1", 9, "late", 3), ("aa", "2", None, "n", 1), ("bb", "1", 3, "n", 1)]


def test_ties_fall_to_payload_whatever_the_order(spark, rows):
    data = [row("a", "1", 5, 0, name) for name in ("x", "z", "y")]
    for order in (data, data[::-1]):
        got = collapse(batch(spark, order), ["trace_id", "span_id"], ["end_unix_nano"], ["end_unix_nano", "name"], copies="n")
        assert rows(got, "name", "n") == [("z", 3)]


def test_rows_without_identifier(spark, rows):
    df = batch(spark, [row(None, "1", 5, 0), row(None, "1", 5, 0), row("a", None, 5, 0), row("a", "1", 5, 0)])
    keys = ["trace_id", "span_id"]
    assert collapse(df, keys, ["end_unix_nano"], copies="n").count() == 1
    assert collapse(df, keys, ["end_unix_nano"], copies="n", keep_unkeyed=True).count() == 4


KEYS = ["trace_id", "span_id"]
FIRST = [row("a", "1", 5, 0), row("a", "1", 4, 0), row("b", "1", 1, 0)]
SECOND = [row("A", "1", 7, 1), row("c", "1", 1, 1)]
BOTH = [("a", "1", 7, 3), ("b", "1", 1, 1), ("c", "1", 1, 1)]


@pytest.fixture
def two_runs(spark):
    store = RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True)
    for n, data in enumerate((FIRST, SECOND)):
        assert store.upsert(batch(spark, data), n, ["end_unix_nano"])
    return store


def test_store_is_idempotent_and_merges_runs(spark, rows, two_runs):
    assert two_runs.upsert(batch(spark, FIRST), 0, ["end_unix_nano"])
    assert rows(two_runs.read()) == BOTH
    assert "Exchange" not in two_runs.read()._jdf.queryExecution().executedPlan().toString()
    assert rows(two_runs.compact()) == BOTH == rows(two_runs.read()) == rows(two_runs.compact())


def test_compaction_merges_without_exchange_or_sort(spark, rows, two_runs):
    assert is_merge(two_runs.merge_plan(0, 1))
    assert rows(two_runs.merge_plan(0, 1)) == BOTH


def test_replay_after_compaction_changes_nothing(spark, rows, two_runs):
    two_runs.compact()
    for n, data in enumerate((FIRST, SECOND)):
        assert not two_runs.upsert(batch(spark, data), n, ["end_unix_nano"])
    assert rows(two_runs.read()) == BOTH
    assert two_runs.upsert(batch(spark, [row("b", "1", 0, 2), row("d", "1", None, 2)]), 2, ["end_unix_nano"])
    want = [("a", "1", 7, 3), ("b", "1", 1, 2), ("c", "1", 1, 1), ("d", "1", None, 1)]
    assert rows(two_runs.read()) == want == rows(two_runs.compact())


def test_reopened_store_goes_on(spark, rows, two_runs):
    assert rows(RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True, path=two_runs.path).read()) == BOTH
    two_runs.compact()
    again = RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True, path=two_runs.path, buckets=99)
    assert again.buckets == two_runs.buckets and not again.upsert(batch(spark, FIRST), 0, ["end_unix_nano"])
    assert again.upsert(batch(spark, SECOND), 7, ["end_unix_nano"])
    assert rows(again.compact()) == [("a", "1", 7, 4), ("b", "1", 1, 1), ("c", "1", 1, 2)]
    third = RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True, path=two_runs.path)
    assert rows(third.read()) == rows(again.read()) and third.merged == [[0, 1], [7, 7]]
    with pytest.raises(ValueError):
        RunStore(spark, ["span_id"], ["end_unix_nano"], path=two_runs.path)


def test_old_generations_go(spark, two_runs):
    two_runs.compact()
    folder = two_runs.path.removeprefix("file://")
    assert sorted(os.listdir(folder)) == [f"gen={two_runs.generation}", "manifest"]
    assert [f for f in os.listdir(f"{folder}/manifest") if not f.startswith(".")] == [str(two_runs.version)]


def test_merged_runs_are_sorted_files(spark, rows):
    store = RunStore(spark, KEYS, ["end_unix_nano"])
    data = [row(f"t{i % 37}", str(i % 11), i, i % 5) for i in range(2000)]
    for n in range(5):
        store.upsert(batch(spark, [r for r in data if r[4] == n]), n, ["end_unix_nano", "name"])
    got = store.compact()
    assert got.count() == 37 * 11 and got.agg({"copies": "sum"}).first()[0] == 2000
    files = glob.glob(f"{store.path.removeprefix('file://')}/gen=*/run_id=-1/*.parquet")
    assert 1 < len(files) <= store.buckets
    for f in files:
        keys = [tuple(r.values()) for r in pq.read_table(f, columns=KEYS, partitioning=None).to_pylist()]
        assert keys == sorted(keys)


def test_other_bucket_counts_and_loading_at_once(spark, rows):
    data = batch(spark, [row(f"t{i % 5}", str(i % 3), i, i % 4 if i % 7 else None) for i in range(60)])
    for runs, payload in ((3, ["end_unix_nano"]), (2, ["end_unix_nano", "name"]), (1, ["end_unix_nano"])):
        store = RunStore(spark, KEYS, ["end_unix_nano"], buckets=3)
        store.load(data, "batch_id", runs, payload)
        assert store.run_ids() == list(range(runs))
        got = store.compact()
        assert got.count() == 15 and got.agg({"copies": "sum"}).first()[0] == 60
        assert rows(got, *KEYS, "end_unix_nano") == rows(collapse(data, KEYS, ["end_unix_nano"], copies="n"), *KEYS, "end_unix_nano")
        with pytest.raises(ValueError):
            store.load(data, "batch_id", runs, payload)


def test_empty(spark):
    store = RunStore(spark, KEYS, ["end_unix_nano"])
    with pytest.raises(ValueError):
        store.read()
    store.load(batch(spark, []), "batch_id", 2, ["end_unix_nano"])
    assert store.compact().count() == 0
    other = RunStore(spark, KEYS, ["end_unix_nano"])
    assert other.upsert(batch(spark, []), 0, ["end_unix_nano"])
    assert other.upsert(batch(spark, FIRST), 1, ["end_unix_nano"])
    assert other.compact().count() == 2


def test_stream_that_restarts_adds_each_batch_once(spark, rows, tmp_path):
    from stratalens.streaming.telemetry import store_batches

    source, path = f"{tmp_path}/in", f"file://{tmp_path}/store"

    def run():
        store = RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True, path=path)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)
        q = stream.writeStream.foreachBatch(store_batches(store, ["end_unix_nano"])).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()
        return store

    batch(spark, FIRST).coalesce(1).write.mode("append").parquet(source)
    run().compact()
    batch(spark, SECOND).coalesce(1).write.mode("append").parquet(source)
    store = run()
    assert rows(store.read()) == BOTH
    # a stream that has lost its place begins again with batch 0, which is merged already
    store_batches(store, ["end_unix_nano"])(batch(spark, FIRST), 0)
    assert rows(store.compact()) == BOTH


def test_hot_identifier(spark, rows):
    data = spark.range(30_000).selectExpr("'t' AS trace_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS span_id", "id AS end_unix_nano")
    got = collapse(data, ["trace_id", "span_id"], ["end_unix_nano"], copies="n").where("n > 1")
    assert rows(got) == [("t", "hot", 29_997, 10_000)]


def test_compaction_that_broke_off_leaves_nothing_behind(spark, rows, two_runs):
    """Files of a compaction that never came to its end belong to no generation."""
    batch(spark, [row("zz", "9", 1, 0)]).select("trace_id", "span_id", "end_unix_nano").write.parquet(f"{two_runs.path}/gen=1/run_id=-1")
    again = RunStore(spark, KEYS, ["end_unix_nano"], fold_case=True, path=two_runs.path)
    assert rows(again.read()) == BOTH == rows(again.compact())
