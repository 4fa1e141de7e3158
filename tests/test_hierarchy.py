import random

import pytest

from stratalens.operators.hierarchy import hierarchy, normal_spans

COLS = ["trace_id", "span_id", "root_span_id", "depth", "size", "chain", "chain_pos", "pre", "path"]


def brute(nodes):
    """(trace, span) -> (root, depth, path, descendants)"""
    parent = {(t, v): (t, p) for t, v, p in nodes}
    out = {}
    for k in parent:
        walk, at = [k], k
        while parent[at] in parent and parent[at] not in walk:
            at = parent[at]
            walk.append(at)
        cyc = parent[at] in walk
        out[k] = ("", -1, None) if cyc else (at[1], len(walk) - 1, "/".join(v for _, v in walk[::-1]))
    return out


def check(spark, nodes, scope_rows):
    df = spark.createDataFrame(nodes, "t string, v string, p string")
    got = {(r.trace_id, r.span_id): r for r in hierarchy(df, scope_rows=scope_rows).collect()}
    want = brute(nodes)
    assert {k: (r.root_span_id, r.depth, r.path) for k, r in got.items()} == want
    for (t, v), r in got.items():
        if r.depth < 0:
            assert r.pre is None and r.chain is None
            continue
        inside = {k for k, x in got.items() if k[0] == t and x.pre is not None and r.pre <= x.pre < r.pre + r.size}
        below = {k for k, x in want.items() if k[0] == t and x[2] and f"/{x[2]}/".startswith(f"/{r.path}/")}
        assert inside == below
        assert got[t, r.chain].chain == r.chain and got[t, r.chain].depth + r.chain_pos == r.depth


@pytest.mark.parametrize("scope_rows", [10**6, 0, 15])
def test_against_brute_force(spark, scope_rows):
    rng = random.Random(3)
    nodes = []
    for t, n in (("a", 25), ("b", 12), ("c", 1), ("d", 9)):
        ids = [f"{t}{i:02d}" for i in range(n)]
        for i, v in enumerate(ids):
            nodes.append((t, v, rng.choice([None, "gone", *ids[:i], *ids[:i], *ids[max(0, i - 1) : i] * 6]) if rng.random() < 0.9 else rng.choice(ids)))
    nodes += [("e", "x", "x"), ("e", "y", "x"), ("f", "p", "q"), ("f", "q", "p"), ("f", "r", "q"), ("f", "s", None), ("g", "a00", "a01")]
    check(spark, nodes, scope_rows)


@pytest.mark.parametrize("scope_rows", [10**6, 0])
def test_deep_and_wide(spark, scope_rows):
    check(spark, [("t", f"{i:03d}", f"{i - 1:03d}") for i in range(70)] + [("u", f"{i:03d}", "000" if i else None) for i in range(40)], scope_rows)


def test_dirty_spans(spark):
    rows = [("AB", "01", ""), ("ab", "02", "01"), ("ab", "02", "01"), ("ab", "03", "  "), ("ab", "04", "0000000000000000"), (None, "1", None), ("ab", None, "01"), ("ab", "05", None), ("ab", "05", "02"), ("cd", "02", "01")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "trace_id string, span_id string, parent_span_id string, depth int, t string")
    got = {(r.trace_id, r.span_id): (r.root_span_id, r.depth) for r in hierarchy(normal_spans(df), intervals=False).collect()}
    assert got == {("ab", "01"): ("01", 0), ("ab", "02"): ("01", 1), ("ab", "03"): ("03", 0), ("ab", "04"): ("04", 0), ("ab", "05"): ("01", 2), ("cd", "02"): ("02", 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "t string, v string, p string")
    assert hierarchy(df).count() == 0 and hierarchy(df, scope_rows=0, intervals=False).count() == 0


def test_hot_parent_beyond_the_bound(spark, rows):
    """A third of all spans below one parent, in a trace too large to be solved whole."""
    hot = spark.range(3000).selectExpr("'t' AS t", "lpad(CAST(id AS STRING), 5, '0') AS v", "CASE WHEN id = 0 THEN NULL WHEN id % 3 = 0 THEN '00001' ELSE lpad(CAST(id div 2 AS STRING), 5, '0') END AS p")
    a, b = rows(hierarchy(hot, scope_rows=100), *COLS), rows(hierarchy(hot), *COLS)
    assert a == b and len(a) == 3000


def test_depth_comes_from_chains(monkeypatch):
    """Without the decomposition there is no depth: where sizes are missing, no chain has a head."""
    import numpy as np
    import pandas as pd

    from stratalens.operators import hierarchy as module

    rows = pd.DataFrame({"t": ["t"] * 4, "v": list("abcd"), "p": [None, "a", "b", "a"]})
    assert list(module.solve(rows, False)["depth"]) == [0, 1, 2, 1]
    monkeypatch.setattr(module, "subtree_sizes", lambda parent: np.zeros(len(parent), np.int64))
    assert list(module.solve(rows, False)["depth"]) == [-1] * 4
