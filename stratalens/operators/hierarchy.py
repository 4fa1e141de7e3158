"""Parent-child links to full hierarchies: path, depth, root, descendants, with cycles set apart.

Nodes belong to a scope (a trace) and name their parent in it. Heavy-path decomposition: every node's child with the
largest subtree continues its chain, so a root path crosses at most log2(n) chains. A node's path is the
concatenation of chain segments; numbering each chain's nodes consecutively (preorder, heavy child first) makes the
descendants of a node exactly the nodes of its scope with pre in [pre, pre + size).

Two executions of the same steps:
* scopes up to `scope_rows` nodes are grouped into buckets of bounded size and solved there with arrays;
* larger scopes are solved by joins. Pointer doubling separates cycles and gives subtree sizes in log2(depth) rounds
  (after round i each node knows its ancestor 2^i up and how many descendants lie nearer than 2^i), and again gives
  each node's chain and place in it; no scope is held in one task.

Either way, a chain's head is as deep as the node it hangs on plus one, chains being taken in rounds from the roots
down, and a node is as deep as its chain's head plus its place in the chain.

Cycle separation comes first: nodes whose parents never reach a root (on a cycle, or below one) get depth -1, an
empty root, and no path, chain or interval.

Defined results: a parent that is null, blank or not among the nodes of the scope makes a root; a node that is its
own parent is a cycle; repeated rows count once, of contradicting parents the least non-blank one counts; rows with
a null scope or node id are no nodes; equal subtree sizes are ordered by node id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.common import prefix_sum, shuffle_width, stage

SCOPE_ROWS = 50_000
BUCKET_ROWS = 100_000
BASIC = "t string, v string, root string, depth long"
FULL = BASIC + ", size long, chain string, chain_pos long, pre long, path string"


def normal_spans(spans: DataFrame) -> DataFrame:
    """(t, v, p): trace, span and parent ids in lower case, one row per span."""
    clean = lambda c: F.lower(F.trim(F.col(c)))
    return (
        spans.select(clean("trace_id").alias("t"), clean("span_id").alias("v"), F.when(clean("parent_span_id") != "", clean("parent_span_id")).alias("p"))
        .where("t IS NOT NULL AND v IS NOT NULL")
        .groupBy("t", "v").agg(F.min("p").alias("p"))
    )


def hierarchy(nodes: DataFrame, intervals: bool = True, scope_rows: int = SCOPE_ROWS) -> DataFrame:
    """All nodes with root_span_id and depth; with `intervals` also size, chain, chain_pos, pre and path."""
    nodes = stage(nodes, "nodes")
    scopes = nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    wide = scopes.where(F.col("n") > scope_rows).select("t")
    total, most = scopes.agg(F.sum("n"), F.max("n")).first()
    light = nodes
    parts = []
    if (most or 0) > scope_rows:
        light = nodes.join(wide, "t", "left_anti")
        parts.append(_by_joins(nodes.join(wide, "t", "left_semi"), intervals))
    buckets = max(shuffle_width(nodes.sparkSession), -(-(total or 0) // BUCKET_ROWS))
    parts.insert(
        0,
        light.groupBy(F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("b")).applyInPandas(lambda pdf: solve(pdf, intervals), FULL if intervals else BASIC),
    )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumnsRenamed({"t": "trace_id", "v": "span_id", "root": "root_span_id"})
    return out


def subtree_sizes(parent: np.ndarray) -> np.ndarray:
    """Nodes in each node's subtree, from the leaves up; 0 for those on cycles, which have no leaf below them that is the last to go."""
    n = len(parent)
    size, open_ = np.ones(n, np.int64), np.zeros(n, np.int64)
    has = parent >= 0
    np.add.at(open_, parent[has], 1)
    done = np.zeros(n, bool)
    leaves = np.flatnonzero(open_ == 0)
    while len(leaves):
        done[leaves] = True
        kids = leaves[parent[leaves] >= 0]
        up = parent[kids]
        np.add.at(size, up, size[kids])
        np.subtract.at(open_, up, 1)
        up = np.unique(up)
        leaves = up[open_[up] == 0]
    size[~done] = 0
    return size


def solve(pdf: pd.DataFrame, intervals: bool) -> pd.DataFrame:
    """Whole scopes in arrays."""
    pdf = pdf.sort_values(["t", "v"], ignore_index=True)
    n = len(pdf)
    at = pd.MultiIndex.from_arrays([pdf["t"], pdf["v"]])
    parent = at.get_indexer(pd.MultiIndex.from_arrays([pdf["t"], pdf["p"]]))
    parent[pdf["p"].isna().to_numpy()] = -1
    me, ids = np.arange(n), pdf["v"].to_numpy(object)
    size = subtree_sizes(parent)
    # Chains: the child with the largest subtree goes on with its parent's; ties by id. Nodes on cycles are in none.
    kids = np.flatnonzero((parent >= 0) & (size > 0))
    kids = kids[np.lexsort((kids, -size[kids], parent[kids]))]
    first = np.ones(len(kids), bool)
    first[1:] = parent[kids][1:] != parent[kids][:-1]
    heavy = np.zeros(n, bool)
    heavy[kids[first]] = True
    heavy[kids[size[parent[kids]] == 0]] = False  # below a cycle, every child begins a chain
    head, pos = np.where(heavy, parent, me), heavy.astype(np.int64)
    while True:
        nxt = head[head]
        if (nxt == head).all():
            break
        pos, head = pos + pos[head], nxt
    # Depth of each chain's head, chains that hang on known ones after those; the rest hang on cycles.
    heads = np.flatnonzero((head == me) & (size > 0))
    up = parent[heads]
    base, top = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    roots = heads[up < 0]
    base[roots], top[roots] = 0, roots
    levels = [roots]
    todo = heads[up >= 0]
    while len(todo):
        ready = top[head[parent[todo]]] >= 0
        if not ready.any():
            break
        new = todo[ready]
        above = parent[new]
        base[new], top[new] = base[head[above]] + pos[above] + 1, top[head[above]]
        levels.append(new)
        todo = todo[~ready]
    done = (size > 0) & (top[head] >= 0)
    depth = np.where(done, base[head] + pos, -1)
    root = np.where(done, ids[np.where(done, top[head], 0)], "") if n else ids
    out = {"t": pdf["t"], "v": pdf["v"], "root": root, "depth": depth}
    if not intervals:
        return pd.DataFrame(out)
    ahead = np.zeros(n, np.int64)  # sizes of the siblings that come before
    if len(kids):
        cum = np.cumsum(size[kids]) - size[kids]
        ahead[kids] = cum - np.maximum.accumulate(np.where(first, cum, 0))
    pre = np.zeros(n, np.int64)  # of heads: where their chain begins
    codes = pdf["t"].to_numpy(object)
    if len(roots):  # a scope's roots come one after the other
        cum = np.cumsum(size[roots]) - size[roots]
        new = np.ones(len(roots), bool)
        new[1:] = codes[roots][1:] != codes[roots][:-1]
        pre[roots] = cum - np.maximum.accumulate(np.where(new, cum, 0))
    # Chains as segments of one text each; a path is what is above the chain and the segment up to the node.
    order = np.lexsort((pos, head))
    order = order[done[order]]
    path = np.full(n, None, object)
    starts = np.flatnonzero(pos[order] == 0)
    members = {int(order[a]): order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])}
    for level in levels:
        for h in level:
            own = members[int(h)]
            segment, lengths = "/".join(ids[own]), np.cumsum([len(x) + 1 for x in ids[own]])
            above = path[parent[h]] + "/" if parent[h] >= 0 else ""
            path[own] = [above + segment[: k - 1] for k in lengths]
        if level is not roots:
            pre[level] = pre[head[parent[level]]] + pos[parent[level]] + 1 + ahead[level]
    blank = ~done
    out |= {
        "size": np.where(blank, 0, size), "chain": np.where(blank, None, ids[head]) if n else ids, "chain_pos": pd.array(pos, "Int64"),
        "pre": pd.array(pre[head] + pos, "Int64"), "path": path,
    }
    frame = pd.DataFrame(out)
    frame.loc[blank, ["size", "chain_pos", "pre"]] = pd.NA
    return frame


def _climb(frame: DataFrame, label: str, more) -> DataFrame:
    """Pointer doubling until every pointer is final or no round finishes another. `more(frame)` makes one round."""
    left = frame.where("NOT fin").count()
    while left:
        frame = stage(more(frame), label)
        now = frame.where("NOT fin").count()
        if now == left:
            break
        left = now
    return frame


def _by_joins(nodes: DataFrame, intervals: bool) -> DataFrame:
    have = nodes.select("t", F.col("v").alias("p"), F.lit(True).alias("has"))
    base = stage(nodes.join(have, ["t", "p"], "left").select("t", "v", F.when(F.col("has"), F.col("p")).alias("p")), "links")
    # a: ancestor `d` steps up, a root once fin; s: descendants nearer than the current stride, with the node itself
    start = base.select("t", "v", "p", F.coalesce("p", "v").alias("a"), F.col("p").isNotNull().cast("long").alias("d"), F.col("p").isNull().alias("fin"), F.lit(1).cast("long").alias("s"))
    rootish = start.select("t", F.col("v").alias("a"), F.col("fin").alias("top"))
    start = stage(start.drop("fin").join(rootish, ["t", "a"], "left").select("t", "v", "p", "a", "d", F.col("top").alias("fin"), "s"), "climb")
    stride = [1]

    def more(f: DataFrame) -> DataFrame:
        step = stride[0]
        stride[0] *= 2
        up = f.select("t", F.col("v").alias("a"), F.col("a").alias("a2"), F.col("d").alias("d2"), F.col("fin").alias("fin2"))
        moved = f.where("NOT fin").join(up, ["t", "a"]).select("t", "v", "p", F.col("a2").alias("a"), (F.col("d") + F.col("d2")).alias("d"), F.col("fin2").alias("fin"), "s")
        gain = f.where(F.col("d") == step).groupBy("t", "a").agg(F.sum("s").alias("g")).withColumnRenamed("a", "v")
        return f.where("fin").unionByName(moved).join(gain, ["t", "v"], "left").withColumn("s", F.col("s") + F.coalesce("g", F.lit(0))).drop("g")

    done = _climb(start, "climb", more)
    # The last strides may reach roots exactly: their sizes come from whole trees.
    whole = done.where("fin").groupBy("t", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("tree"))
    sized = stage(done.join(whole, ["t", "v"], "left").select("t", "v", "p", "fin", F.when(F.col("fin") & (F.col("d") == 0), F.col("tree")).otherwise(F.col("s")).alias("s")), "sizes")
    tree = sized.where("fin")
    chains = _chains(tree)
    heads = _chain_levels(chains, _ahead(tree) if intervals else None)
    # depth and preorder number go on along a chain from its head
    full = chains.join(heads, ["t", "chain"]).select(
        "t", "v", "root", (F.col("base") + F.col("chain_pos")).alias("depth"), F.col("s").alias("size"), "chain", "chain_pos", (F.col("pre") + F.col("chain_pos")).alias("pre"), "p"
    )
    cyclic = sized.where("NOT fin").select("t", "v", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"))
    if not intervals:
        return full.select("t", "v", "root", "depth").unionByName(cyclic)
    full = stage(full, "full")
    named = full.join(_paths(full), ["t", "v"], "left").drop("p")
    return named.unionByName(cyclic, allowMissingColumns=True).select([c.split()[0] for c in FULL.split(", ")])


def _chains(tree: DataFrame) -> DataFrame:
    """(t, v, p, s, chain, chain_pos): the child with the largest subtree continues its parent's chain; ties by id."""
    best = tree.where("p IS NOT NULL").groupBy("t", "p").agg(F.min(F.struct((-F.col("s")).alias("o"), "v")).alias("b")).select("t", F.col("b.v").alias("v"), F.lit(True).alias("heavy"))
    linked = tree.join(best, ["t", "v"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    start = linked.select("t", "v", "p", "s", F.when(F.col("heavy"), F.col("p")).otherwise(F.col("v")).alias("chain"), F.col("heavy").cast("long").alias("chain_pos"), (~F.col("heavy")).alias("fin"))

    def more(f: DataFrame) -> DataFrame:
        up = f.select("t", F.col("v").alias("chain"), F.col("chain").alias("chain2"), F.col("chain_pos").alias("pos2"), F.col("fin").alias("fin2"))
        moved = f.where("NOT fin").join(up, ["t", "chain"]).select("t", "v", "p", "s", F.col("chain2").alias("chain"), (F.col("chain_pos") + F.col("pos2")).alias("chain_pos"), F.col("fin2").alias("fin"))
        return f.where("fin").unionByName(moved)

    return _climb(stage(start, "chain"), "chain", more).drop("fin")


def _ahead(tree: DataFrame) -> DataFrame:
    """(t, v, ahead): sizes of the siblings that come before; children by falling size, roots by id."""
    kin = tree.select("t", F.coalesce("p", F.lit("")).alias("g"), "v", "s", F.when(F.col("p").isNull(), F.lit(0)).otherwise(-F.col("s")).alias("o"))
    return prefix_sum(kin, ["t", "g"], ["o", "v"], "s", "ahead").select("t", "v", "ahead")


def _chain_levels(chains: DataFrame, ahead: DataFrame | None) -> DataFrame:
    """(t, chain, base, root, pre) of each chain's head: chains on roots first, then those that hang on known ones; at most log2(n) rounds over heads alone."""
    hung = chains.where("chain_pos = 0").select("t", "chain", "p")
    hung = hung.join(ahead.withColumnRenamed("v", "chain"), ["t", "chain"]) if ahead is not None else hung.withColumn("ahead", F.lit(0).cast("long"))
    on = chains.select("t", F.col("v").alias("p"), F.col("chain").alias("above"), F.col("chain_pos").alias("at"))
    hung = stage(hung.join(on, ["t", "p"], "left").select("t", "chain", "p", "ahead", "above", "at"), "hung")
    front = stage(hung.where("p IS NULL").select("t", "chain", F.lit(0).cast("long").alias("base"), F.col("chain").alias("root"), F.col("ahead").alias("pre")), "heads")
    known, rest = front, hung.where("p IS NOT NULL")
    while not front.isEmpty():
        up = front.select("t", F.col("chain").alias("above"), F.col("base").alias("base0"), "root", F.col("pre").alias("pre0"))
        step = F.col("at") + 1
        front = stage(rest.join(up, ["t", "above"]).select("t", "chain", (F.col("base0") + step).alias("base"), "root", (F.col("pre0") + step + F.col("ahead")).alias("pre")), "heads")
        known = known.unionByName(front)
    return known


def _paths(chains: DataFrame) -> DataFrame:
    """Path texts: each chain's prefixes, joined below the path of the node that the chain hangs on, chain by chain down."""
    from pyspark.sql import Window as W

    w = W.partitionBy("t", "chain").orderBy("chain_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = stage(chains.select("t", "v", "chain", F.concat_ws("/", F.collect_list("v").over(w)).alias("segment")), "segments")
    hangs = chains.where("chain_pos = 0").select("t", F.col("v").alias("chain"), "p")
    todo = hangs.where("p IS NULL").select("t", "chain", F.lit("").alias("above"))
    found = None
    while True:
        got = stage(part.join(todo, ["t", "chain"]).select("t", "v", F.concat("above", "segment").alias("path")), "paths")
        if not got.take(1):
            break
        found = got if found is None else found.unionByName(got)
        todo = hangs.join(got.select("t", F.col("v").alias("p"), F.concat("path", F.lit("/")).alias("above")), ["t", "p"]).select("t", "chain", "above")
    return found if found is not None else part.select("t", "v", F.col("segment").alias("path")).limit(0)
