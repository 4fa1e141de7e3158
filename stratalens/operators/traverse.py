"""Bounded and unbounded traversals of keyed graphs: one frontier loop, strongly connected components, simple cycles.

Edges are (key, src, dst); several graphs (repositories, questions) live in one frame and are traversed together.
Each round joins the frontier with the edges, keeps what no earlier round reached, and writes it to the shared
folder, so lineage stays one round long and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import shuffle_width, stage
from stratalens.operators.resolve import suffixes

#: Depth to which paths and cones are followed, at most.
MOST_DEPTH = 32


#: Graphs of up to so many edges are solved whole, many to a task.
GROUP_EDGES = 200_000


def rounds(depth: int | None) -> Iterable[int]:
    """1, 2, ... up to depth; without end if it is None, for walks that stop when their frontier is empty."""
    return count(1) if depth is None else range(1, depth + 1)


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, reverse: bool = False, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(key, node, depth) of everything within `depth` steps of the seeds (key, node), or at any distance, seeds at depth 0.

    Keys with few edges are walked in bounded groups, all depths in one pass; the others by the frontier loop.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select("key", F.col(near).alias("node"), F.col(far).alias("next")).distinct()
    seeds = seeds.select("key", "node").distinct()
    steps = stage(steps, "steps")
    sizes = steps.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    parts = []
    light_steps, light_seeds = steps, seeds
    if (most or 0) > group_edges:
        big = stage(sizes.where(F.col("n") > group_edges).select("key"), "big")
        parts.append(spread(seeds.join(big, "key", "left_semi"), steps.join(big, "key", "left_semi"), ["key", "node"], ["key", "node"], depth))
        light_steps, light_seeds = steps.join(big, "key", "left_anti"), seeds.join(big, "key", "left_anti")
    kinds = dict(steps.dtypes)
    rows = light_steps.unionByName(light_seeds.withColumn("next", F.lit(None).cast(kinds["next"])))
    buckets = max(shuffle_width(edges.sparkSession), -(-(total or 0) // max(1, group_edges)))
    got = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("b")).applyInPandas(lambda pdf: _walk(pdf, depth), f"key {kinds['key']}, node {kinds['node']}, depth int")
    for p in parts:
        got = got.unionByName(p)
    return stage(got, "reach")


def _walk(pdf: pd.DataFrame, depth: int | None) -> pd.DataFrame:
    """Breadth first over whole graphs; rows without `next` are seeds."""
    is_seed = pdf["next"].isna()
    after: dict = {}
    for k, a, b in pdf.loc[~is_seed, ["key", "node", "next"]].itertuples(index=False):
        after.setdefault((k, a), []).append((k, b))
    seen = {(k, v): 0 for k, v in pdf.loc[is_seed, ["key", "node"]].itertuples(index=False)}
    front = list(seen)
    for n in rounds(depth):
        new = []
        for at in front:
            for b in after.get(at, ()):
                if b not in seen:
                    seen[b] = n
                    new.append(b)
        if not new:
            break
        front = new
    return pd.DataFrame([(k, v, n) for (k, v), n in seen.items()], columns=["key", "node", "depth"])


def spread(front: DataFrame, steps: DataFrame, on: list[str], state: list[str], depth: int | None = None, move: dict[str, Column] | None = None, best: Column | None = None) -> DataFrame:
    """`front` and all it leads to, breadth first, each state once, with its depth.

    Rows meet `steps` on the columns `on`; a step goes to its column `next`, which becomes the row's `node`. Columns of
    the front beyond `state` are carried along; `move` says how a step changes them. Of several ways that reach a
    state in the same round the one with the least `best` counts. Each round is written to the shared folder.
    """
    carried = [c for c in front.columns if c not in state]
    to = {"node": F.col("next")} | (move or {})
    front = stage(front.withColumn("depth", F.lit(0)), "front")
    seen = front
    for n in rounds(depth):
        rows = front.drop("depth").join(steps, on).select(*[to.get(c, F.col(c)).alias(c) for c in (*state, *carried)], *([best.alias("__order")] if carried else []))
        new = rows.groupBy(*state).agg(F.min_by(F.struct(*carried), "__order").alias("__c")).select(*state, "__c.*") if carried else rows.distinct()
        front = stage(new.join(seen.select(*state), state, "left_anti").withColumn("depth", F.lit(n)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def path_trees(steps: DataFrame, seeds: DataFrame, depth: int = MOST_DEPTH, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(key, node, depth, confidence, path): breadth-first trees from seeds (key, node) over steps (key, node, next, seq, c).

    A node's path comes over the edge of least seq among those that reach it first; its confidence is the product of c.
    Keys with few edges are walked whole, the others round by round, as in `reach`.
    """
    steps, seeds = stage(steps.select("key", "node", "next", "seq", "c"), "steps"), seeds.select("key", "node").distinct()
    sizes = steps.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    big = stage(sizes.where(F.col("n") > group_edges).select("key"), "big") if (most or 0) > group_edges else None
    few = lambda df: df.join(big, "key", "left_anti") if big is not None else df
    rows = few(steps).unionByName(few(seeds), allowMissingColumns=True)
    buckets = max(shuffle_width(steps.sparkSession), -(-(total or 0) // max(1, group_edges)))
    kinds = dict(steps.dtypes)
    got = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("b")).applyInPandas(lambda pdf: _walk_paths(pdf, depth), f"key {kinds['key']}, node {kinds['node']}, depth int, confidence double, path string")
    if big is not None:
        front = seeds.join(big, "key", "left_semi").select("key", "node", F.lit(1.0).alias("confidence"), F.col("node").alias("path"))
        move = {"confidence": F.col("confidence") * F.col("c"), "path": F.concat_ws(" > ", "path", "next")}
        got = got.unionByName(spread(front, steps.join(big, "key", "left_semi"), ["key", "node"], ["key", "node"], depth, move, F.col("seq")).select(*got.columns))
    return got


def _walk_paths(pdf: pd.DataFrame, depth: int) -> pd.DataFrame:
    is_seed = pdf["next"].isna()
    after: dict = {}
    for k, a, b, seq, c in pdf.loc[~is_seed, ["key", "node", "next", "seq", "c"]].itertuples(index=False):
        after.setdefault((k, a), []).append((b, seq, c))
    seen = {(k, v): (0, 1.0, v) for k, v in pdf.loc[is_seed, ["key", "node"]].itertuples(index=False)}
    front = list(seen)
    for n in range(1, depth + 1):
        best: dict = {}
        for at in front:
            for b, seq, c in after.get(at, ()):
                to = (at[0], b)
                if to not in seen and (to not in best or seq < best[to][0]):
                    best[to] = (seq, at, c)
        for to, (_, at, c) in best.items():
            seen[to] = (n, seen[at][1] * c, f"{seen[at][2]} > {to[1]}")
        front = list(best)
    return pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["key", "node", "depth", "confidence", "path"])


def components(edges: DataFrame, group_edges: int = 200_000) -> DataFrame:
    """(key, node, component): members of strongly connected components of more than one node; component = least member.

    Graphs of up to `group_edges` edges are solved whole, many to a task; larger ones by colouring: labels spread
    forward to a fixpoint, then members are gathered backward from each label's own node.
    """
    links = stage(edges.select("key", "src", "dst").where("src <> dst").distinct(), "links")
    sizes = links.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    big = sizes.where(F.col("n") > group_edges).select("key")
    light = links
    if (most or 0) > group_edges:
        light = links.join(big, "key", "left_anti")
    buckets = max(shuffle_width(edges.sparkSession), -(-(total or 0) // max(1, group_edges)))
    kinds = dict(links.dtypes)
    out = light.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("b")).applyInPandas(_tarjan, f"key {kinds['key']}, node {kinds['src']}, component {kinds['src']}")
    if (most or 0) > group_edges:
        out = out.unionByName(_colour(links.join(big, "key", "left_semi")))
    return out


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for key, part in pdf.groupby("key", sort=False):
        after: dict = {}
        for a, b in zip(part["src"], part["dst"]):
            after.setdefault(a, []).append(b)
        index, low, on, stack = {}, {}, set(), []
        for root in after:
            if root in index:
                continue
            work = [(root, iter(after[root]))]
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
            while work:
                v, it = work[-1]
                for w in it:
                    if w not in index:
                        index[w] = low[w] = len(index)
                        stack.append(w)
                        on.add(w)
                        work.append((w, iter(after.get(w, ()))))
                        break
                    if w in on:
                        low[v] = min(low[v], index[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        group = []
                        while True:
                            w = stack.pop()
                            on.discard(w)
                            group.append(w)
                            if w == v:
                                break
                        if len(group) > 1:
                            first = min(group)
                            rows += [(key, w, first) for w in group]
    return pd.DataFrame(rows, columns=["key", "node", "component"])


def _colour(links: DataFrame) -> DataFrame:
    links = stage(links, "links")
    found = None
    while True:
        # nodes without a way in or out lie on no cycle
        while True:
            before = links.count()
            ins, outs = links.select("key", F.col("dst").alias("src")).distinct(), links.select("key", F.col("src").alias("dst")).distinct()
            links = stage(links.join(ins, ["key", "src"], "left_semi").join(outs, ["key", "dst"], "left_semi"), "links")
            if links.count() == before:
                break
        if not before:
            break
        label = stage(links.select("key", F.col("src").alias("node")).distinct().withColumn("c", F.col("node")), "label")
        while True:
            given = links.join(label.select("key", F.col("node").alias("src"), "c"), ["key", "src"]).groupBy("key", F.col("dst").alias("node")).agg(F.max("c").alias("c2"))
            moved = stage(label.join(given, ["key", "node"], "left").select("key", "node", F.greatest("c", F.coalesce("c2", "c")).alias("c"), (F.coalesce("c2", "c") > F.col("c")).alias("up")), "label")
            label = moved.drop("up")
            if moved.where("up").isEmpty():
                break
        inside = links.join(label.select("key", F.col("node").alias("src"), F.col("c").alias("a")), ["key", "src"]).join(label.select("key", F.col("node").alias("dst"), F.col("c").alias("b")), ["key", "dst"]).where("a = b")
        own = inside.select(F.struct("key", "a").alias("key"), "src", "dst")
        roots = label.where("c = node").select(F.struct("key", F.col("c").alias("a")).alias("key"), "node")
        back = own.select("key", F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
        got = spread(roots, back, ["key", "node"], ["key", "node"]).select("key.key", "node", F.col("key.a").alias("c"))
        got = stage(got, "got")
        mates = got.groupBy("key", "c").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
        part = stage(got.join(mates, ["key", "c"]).select("key", "node", "component"), "component")
        found = part if found is None else found.unionByName(part)
        gone = got.select("key", "node")
        links = stage(links.join(gone.withColumnRenamed("node", "src"), ["key", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["key", "dst"], "left_anti"), "links")
    if found is None:
        found = links.select("key", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return found


def simple_cycles(edges: DataFrame, length: int = 12) -> DataFrame:
    """(key, cycle, n): simple cycles of up to `length` nodes, once each, written from their least node.

    Only edges inside strongly connected components are walked, and only to nodes above the start, so no rotation is
    walked twice.
    """
    links = stage(edges.select("key", "src", "dst").where("src <> dst").distinct(), "links")
    member = components(links)
    inner = stage(
        links.join(member.select("key", F.col("node").alias("src"), F.col("component").alias("a")), ["key", "src"])
        .join(member.select("key", F.col("node").alias("dst"), F.col("component").alias("b")), ["key", "dst"]).where("a = b").select("key", "src", "dst"), "inner"
    )
    walk = stage(inner.where("dst > src").select("key", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("walk")), "walk")
    found = None
    step = inner.select("key", F.col("src").alias("at"), F.col("dst").alias("next"))
    for _ in range(length - 1):
        on = stage(walk.join(step, ["key", "at"]).where("next >= start"), "step")
        closed = on.where("next = start").select("key", F.concat_ws(" -> ", "walk").alias("cycle"), F.size("walk").alias("n"))
        found = closed if found is None else found.unionByName(closed)
        walk = on.where(~F.array_contains("walk", F.col("next")) & (F.col("next") > F.col("start"))).select("key", "start", F.col("next").alias("at"), F.concat("walk", F.array("next")).alias("walk"))
        walk = walk.where(F.size("walk") <= length)
        if walk.isEmpty():
            break
    return found


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out; parallel edges of different kinds count each."""
    out = edges.groupBy("repo", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy("repo", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return nodes.join(into, ["repo", "id"], "left").join(out, ["repo", "id"], "left").fillna(0, ["fan_in", "fan_out"])


def first_node(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, path, id): the node that stands for a path (repo, path): its file's own node, else the first one in it."""
    pick = F.struct((F.lower("kind") != "file").alias("o"), "line", "id")
    return nodes.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.min(pick).alias("p")).select("repo", "path", F.col("p.id").alias("id"))


def resolve_ids(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, name, id, candidates): nodes whose id is the name or ends in it from a path part on, or files by path in the same way; an id only if there is one."""
    slashed = lambda c: F.translate(c, "\\", "/")
    known = nodes.select("repo", "id", slashed("id").alias("path")).unionByName(nodes.where("lower(kind) = 'file' AND path IS NOT NULL").select("repo", "id", slashed("path").alias("path")))
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    keys = known.select("repo", "id", F.explode(tails).alias("name")).distinct()
    asked = names.withColumn("name", slashed("name"))
    return asked.join(keys, ["repo", "name"]).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("id")).select("repo", "name", F.when(F.col("candidates") == 1, F.col("id")).alias("id"), "candidates")


def locate(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(repo, path, line, id): the nearest declaration at or before the line, else the file's own node, else its first one.

    A change's path may be the tail of a node's path, from a part on.
    """
    slashed = nodes.withColumn("path", F.translate("path", "\\", "/"))
    asked = changes.select("repo", F.translate("path", "\\", "/").alias("changed"), F.col("path").alias("given"), F.col("line").alias("at"))
    whole = suffixes(slashed.where("path IS NOT NULL").select("repo", "path").distinct()).withColumnRenamed("suffix", "changed")
    same = asked.join(whole, ["repo", "changed"]).join(slashed, ["repo", "path"])
    is_file = F.lower("kind") == "file"
    before = ~is_file & (F.col("line") <= F.col("at"))
    rank = F.when(before, 0).when(is_file, 1).otherwise(2)
    order = F.when(before, -F.col("line")).when(is_file, 0).otherwise(F.col("line"))
    pick = F.struct(rank.alias("rank"), order.alias("order"), "id")
    return same.groupBy("repo", F.col("given").alias("path"), F.col("at").alias("line")).agg(F.min(pick).alias("p")).select("repo", "path", "line", F.col("p.id").alias("id"))


def last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
