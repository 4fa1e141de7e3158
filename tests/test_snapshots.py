import datetime as dt
import random

from stratalens.operators.snapshots import snapshot_changes

NODES = "snapshot_id string, node_id string, kind string, exports array<struct<name:string,kind:string>>, metadata map<string,string>, h0 int"
SNAPS = "snapshot_id string, repository string, taken_at timestamp"


def day(n):
    return dt.datetime(2026, 3, n)


def changes(spark, nodes, snaps):
    got = snapshot_changes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(snaps, SNAPS), "node_id")
    return sorted(tuple(r) for r in got.select("snapshot_id", "record_id", "change_type").collect())


def node(s, n, kind="f", exports=None, metadata=None, h0=1):
    return (s, n, kind, exports, metadata, h0)


def test_added_removed_changed_and_back(spark):
    snaps = [("s2", "r", day(2)), ("s1", "r", day(1)), ("s3", "r", day(3)), ("s3", "r", day(3)), ("q1", "q", day(1))]
    nodes = [node("s1", "a"), node("s3", "a"), node("s1", "b"), node("s2", "b", h0=None), node("s3", "b", h0=None), node("s2", "c"), node("q1", "a")]
    assert changes(spark, nodes, snaps) == [("s2", "a", "removed"), ("s2", "b", "changed"), ("s2", "c", "added"), ("s3", "a", "added"), ("s3", "c", "removed")]


def test_order_and_repetition_dont_count_nulls_do(spark):
    snaps = [("s1", "r", day(1)), ("s2", "r", day(2))]
    e = [("x", "F"), ("y", None)]
    nodes = [
        node("s1", "a", exports=e, metadata={"k": "1", "l": "2"}), node("s1", "a", exports=e[::-1], metadata={"l": "2", "k": "1"}), node("s2", "a", exports=e[::-1], metadata={"l": "2", "k": "1"}),
        node("s1", "b", metadata=None), node("s2", "b", metadata={}), node("s1", "c", metadata={"k": None}), node("s2", "c", metadata={"k": ""}),
        node("s1", "d", exports=[None]), node("s2", "d", exports=[]), node("s1", None), node("s2", "e", kind=None), node("s1", "e", kind=None),
    ]
    assert changes(spark, nodes, snaps) == [("s2", "b", "changed"), ("s2", "c", "changed"), ("s2", "d", "changed")]


def test_empty_snapshot_loses_everything(spark):
    snaps = [("s1", "r", day(1)), ("s2", "r", day(2)), ("s3", "r", None)]
    assert changes(spark, [node("s1", "a"), node("zz", "a")], snaps) == [("s1", "a", "added"), ("s2", "a", "removed")]
    assert changes(spark, [], snaps) == [] and changes(spark, [node("s1", "a")], []) == []


def test_against_sets(spark):
    rng = random.Random(4)
    snaps = [(f"s{i}", "r", day(i + 1)) for i in range(7)]
    content = [{f"n{k}": rng.randrange(2) for k in range(12) if rng.random() < 0.6} for _ in snaps]
    nodes = [node(f"s{i}", k, h0=v) for i, c in enumerate(content) for k, v in c.items() for _ in range(rng.randrange(1, 3))]
    want = []
    for i in range(1, 7):
        a, b = content[i - 1], content[i]
        want += [(f"s{i}", k, "added") for k in b.keys() - a.keys()] + [(f"s{i}", k, "removed") for k in a.keys() - b.keys()] + [(f"s{i}", k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    assert changes(spark, nodes, snaps) == sorted(want)
