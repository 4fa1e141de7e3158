import random

from stratalens.operators.references import dangling_edges, lifetimes, orphans, placed, positions, runs_of

EDGES = "snapshot_id string, edge_id string, from_id string, to_id string, h1 int, k string"


SNAPS = "snapshot_id string, repository string, taken_at int"


def snapshots(spark, ids="st"):
    return spark.createDataFrame([(s, "r", n) for n, s in enumerate(ids)], SNAPS)


def dangling(spark, edges, nodes, ids="st"):
    e = spark.createDataFrame([(*x, 1, "k") for x in edges], EDGES)
    n = spark.createDataFrame(nodes, "snapshot_id string, node_id string")
    return sorted((tuple(r) for r in dangling_edges(e, n, snapshots(spark, ids)).collect()), key=str)


def test_same_snapshot_only(spark):
    nodes = [("s", "a"), ("s", "a"), ("t", "b"), ("s", None), (None, "c")]
    edges = [("s", "1", "a", "b"), ("s", "1", "a", "b"), ("t", "2", "b", "b"), ("s", "3", None, " "), ("t", "4", "a", ""), ("s", "5", "A", "a "), (None, "6", "c", None)]
    want = [("s", "1", "to_id"), ("s", "5", "from_id"), ("s", "5", "to_id"), ("t", "4", "from_id"), (None, "6", "from_id")]
    for ids in ("st", "ts", "s", "", "xyz"):  # in one repository or each its own
        assert dangling(spark, edges, nodes, ids) == want
    assert dangling(spark, [], nodes) == [] and dangling(spark, [("s", "1", "a", None)], []) == [("s", "1", "from_id")]


def test_presence_against_sets(spark):
    rng = random.Random(7)
    ids = [f"s{i}" for i in range(12)]
    nodes = [(s, f"n{n}") for n in range(30) for s in ids if rng.random() < 0.8]
    edges = [(rng.choice(ids), str(i), f"n{rng.randrange(33)}", f"n{rng.randrange(33)}") for i in range(400)]
    have = set(nodes)
    want = sorted((s, e, f) for s, e, a, b in edges for f, x in (("from_id", a), ("to_id", b)) if (s, x) not in have)
    assert dangling(spark, edges, nodes, ids) == want


def test_parents_alone_become_runs(spark, rows):
    """A node's snapshots are compressed into runs of positions; references lie in, between, before and beyond them."""
    ids = [f"s{i}" for i in range(9)]
    nodes = spark.createDataFrame([(s, "a") for s in ids[2:5] + ids[6:8]], "snapshot_id string, node_id string")
    at = placed(nodes, positions(snapshots(spark, ids))).selectExpr("node_id", "at AS s", "at AS e")
    runs = runs_of(at, ["node_id"])
    assert [[tuple(x) for x in r.runs] for r in runs.collect()] == [[(3, 5), (7, 8)]]
    refs = spark.createDataFrame([("a", n) for n in range(1, 10)] + [("b", 4)], "node_id string, at long")
    assert rows(orphans(refs, runs, ["node_id"])) == [("a", 1), ("a", 2), ("a", 6), ("a", 9), ("b", 4)]


def test_lifetimes_against_brute_force(spark):
    rng = random.Random(1)
    lives = [(f"e{rng.randrange(4)}", s := rng.randrange(100), rng.choice([None, s, s + rng.randrange(1, 20)])) for _ in range(40)] + [("e0", None, 5), (None, 1, 2)]
    refs = [(f"e{rng.randrange(6)}", rng.choice([None, *range(-5, 130)]), i) for i in range(300)]
    p = spark.createDataFrame(lives, "id string, born long, gone long")
    r = spark.createDataFrame(refs, "key string, at long, lo long")
    want = sorted(i for k, at, i in refs if at is None or not any(e == k and s is not None and s <= at and (g is None or g > at) for e, s, g in lives))
    for pack in (1, 2, 64):
        got = orphans(r.withColumnRenamed("lo", "ref"), runs_of(lifetimes(p, "id", "born", "gone"), ["key"], pack), ["key"])
        assert sorted(x.ref for x in got.collect()) == want


def test_no_parents_or_references(spark):
    p = spark.createDataFrame([], "id string, born long, gone long")
    r = spark.createDataFrame([("a", 1, 1)], "key string, at long, ref long")
    assert orphans(r, runs_of(lifetimes(p, "id", "born", "gone"), ["key"]), ["key"]).count() == 1
    assert orphans(r.limit(0), runs_of(lifetimes(p, "id", "born", "gone"), ["key"]), ["key"]).count() == 0


def test_hot_key(spark):
    """A third of all ends name one node, and another third one that isn't there."""
    edges = spark.range(6000).selectExpr("'s' AS snapshot_id", "CAST(id AS STRING) AS edge_id", "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'gone' ELSE CAST(id % 50 AS STRING) END AS from_id", "'hot' AS to_id")
    nodes = spark.range(50).selectExpr("'s' AS snapshot_id", "CAST(id AS STRING) AS node_id").unionByName(spark.createDataFrame([("s", "hot")], "snapshot_id string, node_id string"))
    got = dangling_edges(edges, nodes, snapshots(spark))
    assert got.count() == 2000 and got.where("ref_field <> 'from_id' OR CAST(edge_id AS INT) % 3 <> 1").count() == 0
