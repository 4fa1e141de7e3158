"""Project-local learning: rewards, strategies, policy, reflection, recall. All sums, so the order of outcomes doesn't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What each signal adds to a reward when true, and when false.
SIGNALS = {"validated": (0.12, -0.30), "improved": (0.15, -0.15), "rollback": (-0.35, 0.0), "approved": (0.08, -0.15)}
#: Bonus of each evidence class in recall.
EVIDENCE_BONUS = {"validation": 1.0, "runtime": 0.9, "human": 0.85, "static": 0.75, "history": 0.65, "predicted": 0.25}


def reward(base: Column) -> Column:
    out = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base))
    for name, (yes, no) in SIGNALS.items():
        out = out + F.when(F.col(name), yes).when(~F.col(name), no).otherwise(0.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out))


def remember(episodes: DataFrame, project: str, cap: int = 2000) -> DataFrame:
    """Episodes of the project with an id and a confidence in 0..1; predictions carry no observation; an id counts once, the newest `cap` stay."""
    ok = episodes.where((F.col("project_id") == project) & F.col("id").isNotNull() & (F.trim("id") != "") & F.col("confidence").between(0, 1) & ~((F.col("evidence") == "predicted") & F.col("observed_score").isNotNull()))
    first = ok.withColumn("__r", F.row_number().over(W.partitionBy("id").orderBy("created_at_ms"))).where("__r = 1").drop("__r").withColumn("entities", F.array_sort(F.array_distinct("entities")))
    keep = min(20000, max(100, cap))
    return first.orderBy(F.col("created_at_ms").desc(), "id").limit(keep)


def strategies(outcomes: DataFrame) -> DataFrame:
    """From outcomes (strategy, reward, accepted, signals): attempts, successes, mean reward, confidence, ranking score."""
    won = F.coalesce(F.col("accepted"), F.lit(False)) & ~F.coalesce(F.col("rollback"), F.lit(False))
    got = outcomes.withColumn("r", reward(F.col("reward"))).groupBy("strategy").agg(F.count(F.lit(1)).alias("attempts"), F.count(F.when(won, 1)).alias("successes"), F.avg("r").alias("mean_reward"))
    sure = 1 - F.exp(-F.col("attempts") / 8)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mean_reward") * 0.55 + F.col("successes") / F.col("attempts") * 0.35 + sure * 0.10))
    return got.select("strategy", "attempts", "successes", F.round("mean_reward", 6).alias("mean_reward"), F.round(sure, 6).alias("confidence"), F.round(score, 6).alias("score"))


def rollback_pressure(outcomes: DataFrame, order: list[Column], last: int = 50) -> DataFrame:
    """One row: the share of rollbacks among the last outcomes, of which there count `last` even if there are fewer."""
    return outcomes.orderBy(*order).limit(last).agg((F.count(F.when(F.col("rollback"), 1)) / last).alias("pressure"))


def policy(ranked: DataFrame, pressure: DataFrame, invariants: int = 0, runtime: bool = False) -> DataFrame:
    """Risk threshold, depth bias and weights from strong and weak strategies, the share of recent rollbacks, and what else is known: stable invariants, runtime episodes."""
    strong, weak = F.count(F.when((F.col("attempts") >= 3) & (F.col("score") >= 0.55), 1)), F.count(F.when((F.col("attempts") >= 3) & (F.col("score") <= 0.05), 1))
    # each side is one row
    got = ranked.agg(strong.alias("strong"), weak.alias("weak")).withColumn("one", F.lit(1)).join(F.broadcast(pressure.withColumn("one", F.lit(1))), "one")
    risk = F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.65 + 0.2 * F.col("pressure") + 0.01 * F.col("weak") - 0.005 * F.col("strong")))
    bias = F.lit(-1) if invariants > 20 else F.when(F.col("weak") > F.col("strong"), 1).otherwise(0)
    return got.select(
        "strong", "weak", F.round(risk, 6).alias("risk_threshold"), bias.alias("depth_bias"), F.round(F.least(F.lit(1.5), 1 + 0.5 * F.col("pressure")), 6).alias("validation_weight"),
        F.lit(1.15 if runtime else 1.0).alias("runtime_weight"),
    )


def calibration(episodes: DataFrame) -> DataFrame:
    """One row: episodes, and the mean distance of predicted and observed scores where both are known."""
    return episodes.agg(F.count(F.lit(1)).alias("episodes"), F.round(F.avg(F.abs(F.col("predicted") - F.col("observed"))), 6).alias("mean_error"))


def evidence(weak: DataFrame, episodes: DataFrame, order: list[Column], last: int = 12) -> DataFrame:
    """(strategy, id, place): of each weak strategy the ids of its last episodes."""
    place = F.row_number().over(W.partitionBy("strategy").orderBy(*order))
    return episodes.join(weak.select("strategy"), "strategy", "left_semi").withColumn("place", place).where(F.col("place") <= last).select("strategy", "id", "place")


def reflection(ranked: DataFrame, top: float = 0.45, low: float = 0.15, n: int = 5) -> DataFrame:
    """The best and worst strategies with enough attempts; weak ones become proposals that only a guarded change may apply."""
    able = ranked.where("attempts >= 3")
    best = able.where(F.col("score") > top).orderBy(F.col("score").desc(), "strategy").limit(n).withColumn("role", F.lit("top"))
    worst = able.where(F.col("score") < low).orderBy("score", F.col("strategy").desc()).limit(n).withColumn("role", F.lit("weak"))
    expected = F.when(F.col("role") == "weak", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.25 - F.col("mean_reward"))), 6))
    return best.unionByName(worst).select("role", "strategy", "attempts", "score", expected.alias("expected_reward"), F.lit(False).alias("auto_apply"))


def recall(episodes: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Episodes (id, text, confidence, evidence, created) by words hit, confidence and evidence."""
    hits = F.lit(0)
    for w in words:
        hits = hits + F.lower("text").contains(w).cast("int")
    bonus = F.lit(0.0)
    for k, v in EVIDENCE_BONUS.items():
        bonus = F.when(F.col("evidence") == k, v).otherwise(bonus)
    got = episodes.withColumn("score", F.round(4 * hits + 2 * F.col("confidence") + bonus, 6))
    if words:
        got = got.where("score > 2").where(hits > 0)
    return got.orderBy(F.col("score").desc(), F.col("created").desc(), "id").limit(max(1, min(250, limit)))


def observe(facts: DataFrame) -> DataFrame:
    """Per entity that facts touch: its best evidence class (validation, runtime, else static) and least confidence."""
    ends = facts.select("ev", "conf", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    best = F.min(F.when(F.col("ev") == "validation", 0).when(F.col("ev") == "runtime", 1).otherwise(2))
    return ends.groupBy("id").agg(F.element_at(F.lit(["validation", "runtime", "static"]), best + 1).alias("evidence"), F.min("conf").alias("confidence"), F.count(F.lit(1)).alias("facts"))
