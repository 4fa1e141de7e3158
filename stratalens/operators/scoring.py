"""Scores over degrees and runtime metrics: activity, roles, code DNA, recall, context budgets, evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small, stage
from stratalens.functions.numbers import settle


def nlog(value: Column, most: Column) -> Column:
    """ln(1 + value) / ln(1 + most) within 0..1; 0 if either isn't positive."""
    return F.when((value > 0) & (most > 0), F.least(F.lit(1.0), F.log1p(value) / F.log1p(most))).otherwise(0.0)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def with_most(df: DataFrame, **most: Column) -> DataFrame:
    """Adds maxima over each repository and its number of nodes, null counting as 0. Maxima combine on the map side."""
    df = stage(df, "measured")
    top = df.groupBy("repo").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(n) for n, c in most.items()], F.count(F.lit(1)).alias("repo_nodes"))
    return df.join(small(top), "repo")


def measured(degrees: DataFrame, metrics: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Degrees with runtime metrics (id, calls, ms, errors, hot) and membership in cycles."""
    on = cyclic.select("repo", "id").distinct().withColumn("cyclic", F.lit(True))
    out = degrees.join(metrics, "id", "left").join(on, ["repo", "id"], "left")
    out = out.withColumn("observed", F.col("calls").isNotNull()).fillna(0, ["calls", "ms", "errors"]).fillna(False, ["hot", "cyclic"])
    return with_most(out, max_degree=F.col("fan_in") + F.col("fan_out"), max_calls=F.col("calls"), max_ms=F.col("ms"))


def activity(m: DataFrame) -> DataFrame:
    """Activity, change sensitivity and operational pressure of each node, and its role."""
    degree = F.col("fan_in") + F.col("fan_out")
    centrality = nlog(2 * F.col("fan_in") + F.col("fan_out"), F.greatest(2 * F.col("max_degree"), F.lit(1)))
    calls = nlog(F.col("calls"), F.col("max_calls"))
    slow = F.when(F.col("max_ms") > 0, clamp(F.col("ms") / F.col("max_ms"))).otherwise(0.0)
    err = clamp(F.col("errors"))
    hot = F.when(F.col("hot"), 1.0).otherwise(0.0)
    ring = F.when(F.col("cyclic"), 1.0).otherwise(0.0)
    return m.select(
        "repo", "id", "path", "fan_in", "fan_out", "observed", "cyclic", "hot",
        F.round(F.when(degree == 0, 0.0).otherwise(F.col("fan_out") / degree), 6).alias("instability"),
        F.round(centrality, 6).alias("centrality"),
        F.round(clamp(centrality * 0.34 + calls * 0.36 + slow * 0.10 + err * 0.15 + hot * 0.05), 6).alias("activity"),
        F.round(clamp(nlog(F.col("fan_in"), F.greatest("max_degree", F.lit(1))) * 0.48 + centrality * 0.24 + ring * 0.18 + calls * 0.10), 6).alias("sensitivity"),
        F.round(F.when(F.col("observed"), clamp(calls * 0.35 + slow * 0.25 + err * 0.30 + hot * 0.10)).otherwise(0.0), 6).alias("pressure"),
        role().alias("role"),
    )


def role(hub: int = 8) -> Column:
    i, o = F.col("fan_in"), F.col("fan_out")
    return (
        F.when(F.col("cyclic"), "cycle-core").when((i >= hub) & (o >= hub), "architecture-hub").when(i >= hub, "shared-contract").when(o >= hub, "orchestrator")
        .when(F.col("hot"), "runtime-hotpath").when((i == 0) & (o > 0), "entry-or-leaf-source").when((i > 0) & (o == 0), "terminal-dependency").otherwise("connected-symbol")
    )


LISTS = ["activity", "sensitivity", "pressure"]


def hotspots(scores: DataFrame, n: int = 40) -> DataFrame:
    """The n first nodes of each repository by each score."""
    out = None
    for name in LISTS:
        r = F.row_number().over(W.partitionBy("repo").orderBy(F.col(name).desc(), "id"))
        top = scores.select("repo", F.lit(name).alias("list"), "id", F.col(name).alias("score"), r.alias("rank")).where(F.col("rank") <= n)
        out = top if out is None else out.unionByName(top)
    return out


def memory_priority(spots: DataFrame, n: int = 96) -> DataFrame:
    """The three lists one after the other, each node at its first place, the first n."""
    order = F.array_position(F.lit(LISTS), F.col("list")) * 1000 + F.col("rank")
    first = spots.groupBy("repo", "id").agg(F.min(order).alias("o"))
    return first.withColumn("position", F.row_number().over(W.partitionBy("repo").orderBy("o"))).where(F.col("position") <= n).select("repo", "id", "position")


#: First path parts below which a boundary takes two parts.
TWO_PART_ROOTS = ["apps", "services", "packages", "libs", "crates", "modules"]


def boundary(path: Column) -> Column:
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(parts[0].isin(TWO_PART_ROOTS) & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def boundary_rollup(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Per boundary: nodes, mean activity, edges that enter and leave it."""
    at = scores.select("repo", "id", boundary(F.col("path")).alias("boundary"), "activity")
    a, b = at.select("repo", F.col("id").alias("src"), F.col("boundary").alias("ba")), at.select("repo", F.col("id").alias("dst"), F.col("boundary").alias("bb"))
    cross = edges.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).where("ba <> bb")
    sides = cross.select("repo", F.explode(F.array(F.struct(F.col("ba").alias("boundary"), F.lit(0).alias("into")), F.struct(F.col("bb").alias("boundary"), F.lit(1).alias("into")))).alias("s"))
    count = sides.groupBy("repo", "s.boundary").agg(F.sum("s.into").alias("edges_in"), F.sum(1 - F.col("s.into")).alias("edges_out"))
    return at.groupBy("repo", "boundary").agg(F.count(F.lit(1)).alias("nodes"), settle(F.avg("activity")).alias("activity")).join(count, ["repo", "boundary"], "left").fillna(0)


def code_dna(m: DataFrame) -> DataFrame:
    n = F.col("repo_nodes")
    weight = 2 * F.col("fan_in") + F.col("fan_out")
    central = F.least(F.lit(1.0), weight / F.greatest(F.lit(0.35) * n, F.lit(1.0)))
    degree = F.col("fan_in") + F.col("fan_out")
    unstable = F.when(degree == 0, 0.0).otherwise(F.col("fan_out") / degree)
    structural = 0.55 * central + 0.17 * unstable + 0.28 * F.when(F.col("cyclic"), 1.0).otherwise(0.0)
    runtime = (
        F.least(F.log10(F.col("calls") + 1) / 6, F.lit(0.25)) + F.least(F.col("ms") / 2500, F.lit(0.25)) + F.least(3 * F.col("errors"), F.lit(0.35))
        + F.when(F.col("hot"), 0.15).otherwise(0.0)
    )
    risk = clamp(0.68 * structural + 0.32 * runtime)
    return m.select("repo", "id", F.round(structural, 6).alias("structural"), F.round(runtime, 6).alias("runtime"), F.round(risk, 6).alias("risk"), F.round(100 * (1 - risk), 4).alias("health"))


def activity_priority(m: DataFrame) -> DataFrame:
    weight = 2 * F.col("fan_in") + F.col("fan_out")
    live = clamp(0.65 * F.col("errors") + F.when(F.col("hot"), 0.2).otherwise(0.0) + clamp(F.col("ms") / 5000, 0, 0.15))
    value = 0.5 * nlog(weight, 2 * F.col("max_degree")) + 0.3 * nlog(F.col("calls"), F.col("max_calls")) + 0.2 * live
    return m.select("repo", "id", "path", "name", "fan_in", "fan_out", F.round(value, 6).alias("priority"))


def failure_probability(m: DataFrame) -> DataFrame:
    p = (
        F.least((2 * F.col("fan_in") + F.col("fan_out")) / 30, F.lit(0.65)) + F.least(2.5 * F.col("errors"), F.lit(0.2)) + F.when(F.col("hot"), 0.1).otherwise(0.0)
        + F.least(F.col("ms") / 5000, F.lit(0.05))
    )
    return m.select("repo", "id", F.round(F.least(p, F.lit(0.99)), 6).alias("probability"))


def terms(text: str) -> list[str]:
    """Lower-case terms of letters, digits and . / : _ $ -, once each, in order."""
    import re

    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9_./:$-]+", text.lower()) if t))


def lexical(words: list[str]) -> Column:
    """Points of a node for query terms, by where each occurs."""
    i, n, p = F.lower("id"), F.lower("name"), F.lower("path")
    total = F.lit(0)
    for t in words:
        total = total + (
            F.when(i == t, 18).otherwise(0) + F.when(n == t, 15).otherwise(0) + F.when(i.endswith("::" + t), 12).otherwise(0) + F.when(p == t, 11).otherwise(0)
            + F.when(p.endswith(t), 8).otherwise(0) + F.when(p.contains(t), 6).otherwise(0) + F.when(F.concat_ws(" ", i, n, p).contains(t), 2).otherwise(0)
        )
    return total.cast("double")


def recall_scores(prioritised: DataFrame, question: str) -> DataFrame:
    words = terms(question)
    score = lexical(words) + 2 * F.col("priority") if words else 1 + 4 * F.col("priority")
    kept = lexical(words) > 0 if words else F.lit(True)
    return prioritised.where(kept).select("repo", "id", F.round(score, 6).alias("score"), "priority")


def recall_neighbourhood(scores: DataFrame, prioritised: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 12, beyond: bool = False) -> DataFrame:
    """Roots by score, then what lies around them in either direction, up to a cap that the best-connected fill first."""
    from stratalens.operators.traverse import reach

    roots = scores.withColumn("r", F.row_number().over(W.partitionBy("repo").orderBy(F.col("score").desc(), F.col("priority").desc(), "id"))).where(F.col("r") <= min(limit, 24))
    both = edges.select(F.col("repo").alias("key"), "src", "dst").unionByName(edges.select(F.col("repo").alias("key"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    got = reach(both, roots.select(F.col("repo").alias("key"), F.col("id").alias("node")), depth).select(F.col("key").alias("repo"), F.col("node").alias("id"), "depth")
    cap = min(2500, max(200, max(limit, 12) * 40))
    ranked = got.join(prioritised.select("repo", "id", "priority", (F.col("fan_in") + F.col("fan_out")).alias("degree")), ["repo", "id"])
    o = F.row_number().over(W.partitionBy("repo").orderBy("depth", F.col("degree").desc(), "id"))
    # one more than the cap, so that it can be seen whether anything was left out
    return ranked.withColumn("ordinal", o).where(F.col("ordinal") <= cap + (1 if beyond else 0)).select("repo", "id", "depth", "degree", "priority", "ordinal")


def recall_summary(around: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """From a neighbourhood with one row beyond the cap: nodes within it, edges among them, and whether it leaves anything out."""
    kept = around.where(F.col("ordinal") <= cap).select("repo", "id")
    inner = edges.join(kept.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(kept.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    return around.groupBy("repo").agg(F.count(F.when(F.col("ordinal") <= cap, 1)).alias("nodes"), (F.max("ordinal") > cap).alias("truncated")).join(inner, "repo", "left").fillna(0, ["edges"])


def compiled_context(sections: list[DataFrame], budget: int) -> DataFrame:
    """(repo, section, ord, text, used) from sections (repo, ord, text), in their order, until the budget of characters: each section stops at its first text that goes beyond what the ones before have left."""
    out, spent = None, None
    for n, rows in enumerate(sections):
        sized = rows.withColumn("length", F.length("text").cast("long"))
        own = W.partitionBy("repo").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = sized.withColumn("run", F.sum("length").over(own))
        run = run.join(small(spent), "repo", "left").fillna(0, ["spent"]) if spent is not None else run.withColumn("spent", F.lit(0).cast("long"))
        kept = stage(run.withColumn("used", F.col("run") + F.col("spent")).where(F.col("used") <= budget).select("repo", F.lit(n).alias("section"), "ord", "text", "used"), "section")
        last = kept.groupBy("repo").agg(F.max("used").alias("now"))
        spent = last.withColumnRenamed("now", "spent") if spent is None else stage(spent.join(last, "repo", "full_outer").select("repo", F.greatest("spent", "now").alias("spent")), "spent")
        out = kept if out is None else out.unionByName(kept)
    return out


def within_budget(rows: DataFrame, key: list[str], order: list, length: str, budget: int) -> DataFrame:
    """Rows in order until the first that would go beyond the budget."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.withColumn("used", F.sum(length).over(w))
    over = F.max(F.when(F.col("used") > budget, 1).otherwise(0)).over(w)
    return run.withColumn("over", over).where("over = 0").drop("over")


def observed_score(good: list[str], bad: list[str]) -> Column:
    """Mean over the booleans present; bad ones count inverted; null if none is."""
    parts = [F.when(F.col(c).isNull(), None).otherwise(F.when(F.col(c), 1.0).otherwise(0.0)) for c in good] + [
        F.when(F.col(c).isNull(), None).otherwise(F.when(F.col(c), 0.0).otherwise(1.0)) for c in bad
    ]
    kept = F.array_compact(F.array(*parts))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def blockers(checks: list[str], approval: str) -> Column:
    """Names of the checks that didn't pass, 'approval' if it lacks."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in [*checks, approval]]))
