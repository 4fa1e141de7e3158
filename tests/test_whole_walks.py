"""Walks go to their end: long chains beside brute force."""

import pytest

from pyspark.sql import functions as F

from stratalens.operators import traverse
from stratalens.plans import graphs

LONG = 45


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Repository 'back': n01 depends on n00, n02 on n01 and so on; repository 'on': n00 on n01, n01 on n02. Nobody depends on the last of 'back'."""
    d = str(tmp_path_factory.mktemp("chain"))
    ids, save = [f"n{i:02d}" for i in range(LONG)], lambda rows, kind, name: spark.createDataFrame(rows, kind).write.parquet(f"{d}/{name}.parquet")
    save([("s1", "back", 1), ("s2", "on", 1)], "snapshot_id string, repository string, taken_at long", "snapshots")
    save([(s, i, "function", i, f"{i}.ts", 1, {}) for s in ("s1", "s2") for i in ids], "snapshot_id string, node_id string, kind string, name string, path string, line int, metadata map<string,string>", "snapshot_nodes")
    pairs = [("s1", b, a) for a, b in zip(ids, ids[1:])] + [("s2", a, b) for a, b in zip(ids, ids[1:])]
    save([(s, a, b, "calls", f"{s}{a}{b}", {}) for s, a, b in pairs], "snapshot_id string, from_id string, to_id string, kind string, edge_id string, metadata map<string,string>", "snapshot_edges")
    files = [("back", "n00.ts"), ("back", f"{ids[-1]}.ts"), ("back", "gone.ts"), ("on", "n00.ts")]
    save([(r, p, []) for r, p in files], "repository string, path string, calls array<struct<line:int>>", "file_analyses")
    save([("n03",)], "node_id string", "observed_spans")
    return d


def test_session_impact_is_whole(spark, chain, rows):
    cols = ("repo", "changes", "nodes", "files", "max_risk", "mean_risk")
    # of three changes in 'back' one reaches all others and two nothing; nothing depends on n00 of 'on'
    assert rows(graphs.session_impact(spark, chain), *cols) == [("back", 3, LONG - 1, LONG - 1, 1.0, 0.333333), ("on", 1, 0, 0, 0.0, 0.0)]


def test_reach_each_both_ways(spark, rows):
    edges = spark.createDataFrame([("r", b, a) for a, b in zip("abcde", "bcdef")] + [("r", "a", "c"), ("q", "z", "y")], "repo string, src string, dst string")
    seeds = spark.createDataFrame([("k1", "r", "a"), ("k2", "r", "e"), ("k3", "q", "y")], "key string, repo string, id string")
    cols = ("key", "repo", "id", "depth")
    want = [("k1", "r", v, i) for i, v in enumerate("abcdef")] + [("k2", "r", "e", 0), ("k2", "r", "f", 1), ("k3", "q", "y", 0), ("k3", "q", "z", 1)]
    assert rows(graphs.reach_each(edges, seeds), *cols) == sorted(want) == rows(graphs.reach_each(edges, seeds, most=0), *cols)


def test_impact_is_whole(spark, chain, rows):
    # both hubs are the least of the nodes that one other depends on
    far = {(r.repo, r.id): r.depth for r in graphs.impact_bfs(spark, chain).collect()}
    assert far == {("back", f"n{i:02d}"): i for i in range(1, LONG)} | {("on", "n00"): 1}
    assert rows(graphs.impact_summary(spark, chain), "repo", "direct", "indirect", "depth") == [("back", 1, LONG - 2, LONG - 1), ("on", 1, 0, 1)]


def test_incremental_drift_is_whole(spark, chain, monkeypatch):
    monkeypatch.setattr(graphs, "GOD", 0)
    got = {r.src for r in graphs.drift_incremental(spark, chain).where("repo = 'on' AND kind = 'god_object'").collect()}
    assert got == {f"n{i:02d}" for i in range(LONG)}


def test_cones_and_paths_go_to_32(spark, chain):
    cone = {r.id: r.depth for r in graphs.failure_cone(spark, chain).where("repo = 'back'").collect()}
    assert cone == {f"n{i:02d}": i for i in range(33)}


def test_paths_go_beyond_six(spark, rows, monkeypatch):
    ids = [f"n{i}" for i in range(10)]
    nodes = spark.createDataFrame([("r", i, f"{i}.ts") for i in ids], "repo string, id string, path string")
    edges = spark.createDataFrame([("r", a, b, "calls", f"e{a}") for a, b in zip(ids, ids[1:])], "repo string, src string, dst string, kind string, eid string")
    monkeypatch.setattr(graphs, "graph", lambda spark, d: (nodes, edges))
    assert rows(graphs.causal_path(spark, ""), "id", "depth", "path") == [(v, i, " > ".join(ids[: i + 1])) for i, v in enumerate(ids)]


@pytest.mark.parametrize("group_edges", [10**6, 0])
def test_path_trees_both_ways(spark, rows, group_edges):
    """The edge of least seq decides between ways of equal length; edges behind the front aren't taken."""
    steps = [("r", "a", "b", 2, 0.5), ("r", "a", "c", 1, 0.5), ("r", "b", "d", 3, 0.5), ("r", "c", "d", 4, 0.25), ("r", "d", "a", 5, 1.0), ("q", "x", "y", 1, 1.0), ("q", "x", "y", 0, 0.5)]
    df = spark.createDataFrame(steps, "key string, node string, next string, seq int, c double")
    seeds = spark.createDataFrame([("r", "a"), ("q", "x"), ("r", "a"), ("none", "n")], "key string, node string")
    want = [("none", "n", 0, 1.0, "n"), ("q", "x", 0, 1.0, "x"), ("q", "y", 1, 0.5, "x > y"), ("r", "a", 0, 1.0, "a"), ("r", "b", 1, 0.5, "a > b"), ("r", "c", 1, 0.5, "a > c"), ("r", "d", 2, 0.25, "a > b > d")]
    got = traverse.path_trees(df, seeds, group_edges=group_edges)
    if group_edges == 0:
        want = want[1:]  # a key without edges leads nowhere, also not to itself, once keys are told apart by their edges
        got = got.where("key <> 'none'")
    assert rows(got, "key", "node", "depth", "confidence", "path") == want


def test_spread_carries_by_the_best_way(spark, rows):
    steps = spark.createDataFrame([("a", "b", 2, 7), ("a", "b", 1, 8), ("b", "c", 1, 1), ("c", "a", 1, 1)], "node string, next string, seq int, w int")
    front = spark.createDataFrame([("a", 0)], "node string, sum int")
    got = traverse.spread(front, steps, ["node"], ["node"], None, {"sum": F.col("sum") + F.col("w")}, F.col("seq"))
    assert rows(got, "node", "sum", "depth") == [("a", 0, 0), ("b", 8, 1), ("c", 9, 2)]


@pytest.mark.parametrize("group_edges", [10**6, 0])
def test_reach_both_ways(spark, rows, group_edges):
    edges = spark.createDataFrame([("k", a, b) for a, b in zip("abcdefg", "bcdefga")] + [("m", "a", "b")], "key string, src string, dst string")
    seeds = spark.createDataFrame([("k", "a"), ("m", "b")], "key string, node string")
    assert rows(traverse.reach(edges, seeds, 3, group_edges=group_edges), "key", "node", "depth") == [("k", "a", 0), ("k", "b", 1), ("k", "c", 2), ("k", "d", 3), ("m", "b", 0)]
    assert rows(traverse.reach(edges, seeds, reverse=True, group_edges=group_edges), "key", "node", "depth") == sorted([("k", v, (7 - i) % 7) for i, v in enumerate("abcdefg")] + [("m", "a", 1), ("m", "b", 0)])


def test_locate_by_tail_of_path(spark, rows):
    nodes = spark.createDataFrame([("r", "x/src/a.ts::f", "Function", "x/src/a.ts", 5), ("r", "x/src/a.ts::file", "File", "x/src/a.ts", 1), ("r", "b.ts::g", "Function", "b.ts", 9)], "repo string, id string, kind string, path string, line int")
    changes = spark.createDataFrame([("r", "src/a.ts", 7), ("r", "src\\a.ts", 2), ("r", "rc/a.ts", 7), ("r", "b.ts", 1)], "repo string, path string, line int")
    assert rows(traverse.locate(nodes, changes), "path", "line", "id") == [("b.ts", 1, "b.ts::g"), ("src/a.ts", 7, "x/src/a.ts::f"), ("src\\a.ts", 2, "x/src/a.ts::file")]
    names = spark.createDataFrame([("r", "src/a.ts::f"), ("r", "src/a.ts"), ("r", "ts"), ("r", "b.ts::g")], "repo string, name string")
    assert rows(traverse.resolve_ids(nodes, names), "name", "id", "candidates") == [("b.ts::g", "b.ts::g", 1), ("src/a.ts", "x/src/a.ts::file", 1), ("src/a.ts::f", "x/src/a.ts::f", 1)]
