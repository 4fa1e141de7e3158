"""Commits, deployments, federation, contracts, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small

#: Zones whose number a commit should keep low.
ZONES = ["core", "api", "ui", "web", "infra", "domain", "service", "controller", "database", "storage", "auth", "billing"]
#: Weight of each severity in the debt of a repository.
DEBT = {"critical": 4, "error": 3, "warning": 2, "info": 1}


def commit_risk(rows: DataFrame) -> DataFrame:
    """From (repo, id, at, path, adds, dels): files, churn, zones and risk of each commit."""
    hits = F.lit(0)
    for z in ZONES:
        hits = hits + F.max(F.when(F.lower("path").contains(z), 1).otherwise(0))
    got = rows.groupBy("repo", "id", "at").agg(F.countDistinct("path").alias("files"), F.sum("adds").alias("adds"), F.sum("dels").alias("dels"), F.greatest(hits - 1, F.lit(0)).alias("drift"))
    risk = F.least(F.log1p(F.col("adds") + F.col("dels")) / 10, F.lit(0.35)) + F.least(F.col("files") / 40, F.lit(0.25)) + F.least(0.12 * F.col("drift"), F.lit(0.4))
    return got.withColumn("risk", F.round(F.least(risk, F.lit(1.0)), 6))


def trend(commits: DataFrame, step: float = 0.08) -> DataFrame:
    """Per repository: worst risk and whether the last five commits are riskier than the first five; at least six are needed."""
    up, down = W.partitionBy("repo").orderBy("at", "id"), W.partitionBy("repo").orderBy(F.col("at").desc(), F.col("id").desc())
    r = commits.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down))
    got = r.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"), F.max("risk").alias("worst"), F.avg(F.when(F.col("a") <= 5, F.col("risk"))).alias("first"), F.avg(F.when(F.col("b") <= 5, F.col("risk"))).alias("last")
    )
    diff = F.col("last") - F.col("first")
    return got.select("repo", "commits", "worst", F.when(F.col("commits") < 6, "stable").when(diff > step, "worsening").when(diff < -step, "improving").otherwise("stable").alias("trend"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, by: str, keep: list[str], forward: bool = False, pack: int = 64) -> DataFrame:
    """`left` with the columns `keep` of the last row of `right` whose `by` is at or before `at` (or the first at or after).

    The right side is packed into sorted arrays of `pack` rows, each with the range of times it answers for, so every
    left row meets one row and no pairs are made; ties take the greatest of `keep`. Times are numbers.
    """
    sign = -1 if forward else 1
    w = W.partitionBy(key).orderBy("__t")
    once = right.where(F.col(key).isNotNull() & F.col(by).isNotNull()).groupBy(key, (sign * F.col(by)).alias("__t")).agg(F.max(F.struct(*keep)).alias("__v"))
    rows = once.withColumn("__c", F.floor((F.row_number().over(w) - 1) / pack)).groupBy(key, "__c").agg(F.array_sort(F.collect_list(F.struct("__t", "__v"))).alias("__rows"))
    lo = F.col("__rows")[0]["__t"]
    ranged = rows.select(F.col(key).alias("__k"), "__rows", lo.alias("__lo"), F.lead(lo).over(W.partitionBy(key).orderBy("__c")).alias("__hi"))
    here = sign * F.col(at)
    met = left.join(small(ranged), (F.col(key) == F.col("__k")) & (here >= F.col("__lo")) & (F.col("__hi").isNull() | (here < F.col("__hi"))), "left")
    hit = F.element_at(F.filter("__rows", lambda r: r["__t"] <= here), -1)["__v"]
    met = met.withColumn("__hit", F.when(F.col("__k").isNotNull(), hit))
    return met.select(*left.columns, *[F.col("__hit")[c].alias(c) for c in keep])


def validate_contracts(needs: DataFrame, offers: DataFrame, field_need: DataFrame, field_offer: DataFrame) -> DataFrame:
    """Consumers' keys without provider are critical; else the first needed field that the provider lacks is high."""
    missing = needs.join(offers.select("key").distinct(), "key", "left_anti").select("consumer", "key", F.lit("missing_endpoint").alias("kind"), F.lit(None).cast("string").alias("field"), F.lit("critical").alias("severity"))
    lacking = (
        field_need.join(offers.select("key").distinct(), "key", "left_semi").join(field_offer.select("key", "field").distinct(), ["key", "field"], "left_anti")
        .groupBy("consumer", "key").agg(F.min("field").alias("field")).select("consumer", "key", F.lit("field_removed").alias("kind"), "field", F.lit("high").alias("severity"))
    )
    return missing.unionByName(lacking)


def contract_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Fields (key..., field, type, required) before and after: what changed and whether it breaks consumers; the first reason counts."""
    a, b = before.select(*key, "field", F.col("type").alias("t0"), F.col("required").alias("r0"), F.lit(True).alias("was")), after.select(*key, "field", F.col("type").alias("t1"), F.col("required").alias("r1"), F.lit(True).alias("now"))
    both = a.join(b, [*key, "field"], "full_outer")
    change = (
        F.when(F.col("now").isNull(), "removed").when(F.col("was").isNull() & F.coalesce("r1", F.lit(False)), "added_required").when(F.col("was").isNull(), "added_optional")
        .when(~F.col("t0").eqNullSafe(F.col("t1")), "type_changed").when(~F.coalesce("r0", F.lit(False)) & F.coalesce("r1", F.lit(False)), "now_required")
    )
    level = F.when(F.col("change").isin("removed", "type_changed", "now_required"), "breaking").when(F.col("change") == "added_required", "potentially_breaking").otherwise("compatible")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*key, "field", "change", level.alias("level"))


def forecast(series: DataFrame, key: str, at: str, value: str, steps: int = 3) -> DataFrame:
    """The last value plus n times the mean step, not below 0; a single point stays flat."""
    got = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, at).alias("a"), F.max_by(value, at).alias("b"))
    slope = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1)).otherwise(0.0)
    return got.select(key, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "b", slope.alias("slope")).select(key, "step", F.round(F.greatest(F.col("b") + F.col("slope") * F.col("step"), F.lit(0.0)), 6).alias("value"))


def debt(violations: DataFrame, nodes: DataFrame) -> DataFrame:
    weight = F.lit(0)
    for s, v in DEBT.items():
        weight = F.when(F.col("severity") == s, v).otherwise(weight)
    total = violations.groupBy("repo").agg(F.sum(weight).alias("points"))
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    score = F.round(F.least(100.0 * F.coalesce("points", F.lit(0)) / F.col("nodes"), F.lit(100.0)), 1)
    return n.join(total, "repo", "left").select("repo", "nodes", score.alias("debt")).withColumn("level", F.when(F.col("debt") > 15, "High").when(F.col("debt") > 5, "Moderate").otherwise("Low"))
