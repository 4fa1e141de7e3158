"""Questions to the facts about entities: flows, taint, hazards, ownership, simulation. Facts are (fact_id, src, dst, rel, ev, conf, cond)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import small, stage
from stratalens.operators import traverse

#: Relations that each traversal follows.
DATA_FLOW = ["assigns", "derives", "reads", "writes", "returns", "calls", "emits", "consumes", "routes_to"]
TAINT = DATA_FLOW + ["publishes", "subscribes", "sanitizes", "validates", "trust_boundary"]
SANITISERS = ["sanitizes", "validates"]
DISTRIBUTED = ["emits", "consumes", "publishes", "subscribes", "schedules", "routes_to", "retries", "calls", "writes"]
FAILS_BACK = ["calls", "depends_on", "imports", "reads", "connects_to", "routes_to", "subscribes", "waits_for", "deploys"]
WAITS = ["waits_for", "acquires"]
FAILS_FORWARD = ["depends_on", "calls", "routes_to", "consumes", "retries", "times_out", "connects_to"]
FAILS_ON = ["consumes", "retries", "times_out", "circuit_breaks"]
OWNS = ["owns", "authored_by", "reviews"]


def linked(facts: DataFrame, relations: list[str] | None = None) -> DataFrame:
    return facts.where(F.col("rel").isin(relations)) if relations else facts


def flow(facts: DataFrame, seeds: DataFrame, relations: list[str] | None, depth: int) -> DataFrame:
    """(id, depth, confidence, source): what any of the seeds leads to, by the shortest way from the nearest, ties by least fact id.

    The confidence is the least on that way. All seeds are one question, so rows grow with the facts, not with seeds times facts.
    """
    links = stage(linked(facts, relations).select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("fact_id").alias("seq"), "conf"), "links")
    front = seeds.select(F.col("id").alias("node"), F.lit(1.0).alias("confidence"), F.col("id").alias("source")).distinct()
    got = traverse.spread(front, links, ["node"], ["node"], depth, {"confidence": F.least("confidence", "conf")}, F.col("seq"))
    return got.select(F.col("node").alias("id"), "depth", F.round("confidence", 6).alias("confidence"), "source")


def cross_repository(facts: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, source): what seeds lead to by ways that touch more than one repository; entities without one don't count.

    Of the repositories on a way the least and the greatest are carried, which differ if there are several.
    """
    home = entities.select(F.col("id").alias("dst"), F.col("repo").alias("home"))
    links = stage(facts.join(home, "dst").select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("fact_id").alias("seq"), "home"), "links")
    front = seeds.select(F.col("id").alias("node"), F.col("id").alias("source"), F.col("repo").alias("lo"), F.col("repo").alias("hi")).distinct()
    got = traverse.spread(front, links, ["node"], ["node"], depth, {"lo": F.least("lo", "home"), "hi": F.greatest("hi", "home")}, F.col("seq"))
    return got.where("lo <> hi").select(F.col("node").alias("id"), "depth", "source")


def reach(links: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth): what any of the seeds reaches, seeds at depth 0."""
    got = traverse.reach(links.select(F.lit("").alias("key"), "src", "dst"), seeds.select(F.lit("").alias("key"), F.col("id").alias("node")), depth, reverse)
    return got.select(F.col("node").alias("id"), "depth")


def taint(facts: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """(sink, depth, boundary): sinks that any source reaches without a sanitiser on the way, ways ending at sinks.

    A state is a node and whether a trust boundary was crossed on the way; sanitised ways are not followed.
    """
    open_ = linked(facts, TAINT).where(~F.col("rel").isin(SANITISERS)).join(sinks.select(F.col("id").alias("src")), "src", "left_anti")
    steps = stage(open_.select(F.col("src").alias("node"), F.col("dst").alias("next"), (F.col("rel") == "trust_boundary").alias("cross")).distinct(), "steps")
    front = sources.select(F.col("id").alias("node"), F.lit(False).alias("crossed")).distinct()
    seen = traverse.spread(front, steps, ["node"], ["node", "crossed"], depth, {"crossed": F.col("crossed") | F.col("cross")})
    hit = seen.where("depth > 0").join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return hit.groupBy(F.col("node").alias("sink")).agg(F.min("depth").alias("depth"), F.max("crossed").alias("boundary"))


_CONSTRAINT = r"^\s*([^=!<>]+?)\s*(==|!=|>=|<=|=|>|<)\s*(.+?)\s*$"


def constraint_conflicts(constraints: DataFrame) -> DataFrame:
    """From texts like 'x >= 3' in column cond: variables that can't satisfy all of theirs. What can't be read is left out."""
    p = lambda i: F.regexp_extract("cond", _CONSTRAINT, i)
    rows = constraints.where(F.col("cond").rlike(_CONSTRAINT)).select(p(1).alias("variable"), p(2).alias("op"), p(3).alias("value")).distinct()
    num = F.expr("try_cast(value AS double)")
    rows = rows.withColumn("num", num).withColumn("equal", F.col("op").isin("=", "=="))
    lo = F.max(F.when(F.col("op").isin(">", ">="), F.struct("num", (F.col("op") == ">").cast("int").alias("open"))))
    hi = F.min(F.when(F.col("op").isin("<", "<="), F.struct("num", (-(F.col("op") == "<").cast("int")).alias("open"))))
    got = rows.groupBy("variable").agg(
        F.countDistinct(F.when(F.col("equal"), F.col("value"))).alias("values"), F.min(F.when(F.col("equal"), F.col("value"))).alias("one"), F.min(F.when(F.col("equal"), F.col("num"))).alias("n"),
        F.collect_set(F.when(F.col("op") == "!=", F.col("value"))).alias("never"), lo.alias("lo"), hi.alias("hi"),
    )
    why = (
        F.when(F.col("values") > 1, "several values").when((F.col("values") == 1) & F.array_contains("never", F.col("one")), "value excluded")
        .when((F.col("lo.num") > F.col("hi.num")) | (F.col("lo.num") == F.col("hi.num")) & ((F.col("lo.open") == 1) | (F.col("hi.open") == -1)), "empty range")
        .when((F.col("n") < F.col("lo.num")) | (F.col("n") > F.col("hi.num")) | (F.col("n") == F.col("lo.num")) & (F.col("lo.open") == 1) | (F.col("n") == F.col("hi.num")) & (F.col("hi.open") == -1), "value out of range")
    )
    return got.select("variable", why.alias("conflict")).where("conflict IS NOT NULL")


def concurrency_hazards(facts: DataFrame, entities: DataFrame, kinds: list[str], locks: list[str]) -> DataFrame:
    """(resource, writers, kind): resources that several writers write, none of them under a lock; cycles of waiting, which have no writers."""
    writes = linked(facts, ["writes"]).join(entities.where(F.col("kind").isin(kinds)).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    locked = linked(facts, locks).select("src").distinct().withColumn("locked", F.lit(1))
    got = writes.join(locked, "src", "left").groupBy(F.col("dst").alias("resource")).agg(F.count(F.lit(1)).alias("writers"), F.sum(F.coalesce("locked", F.lit(0))).alias("guarded"))
    shared = got.where("writers > 1 AND guarded = 0").select("resource", "writers", F.lit("unprotected_multi_writer").alias("kind"))
    waits = linked(facts, WAITS).select(F.lit("").alias("key"), "src", "dst")
    return shared.unionByName(traverse.simple_cycles(waits).select(F.col("cycle").alias("resource"), F.lit(0).cast("long").alias("writers"), F.lit("potential_deadlock").alias("kind")))


def policy_violations(facts: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Facts that a rule (rule, rel, from_kind, to_kind) forbids; a null kind matches any."""
    k = entities.select("id", "kind")
    rows = facts.join(k.select(F.col("id").alias("src"), F.col("kind").alias("a")), "src").join(k.select(F.col("id").alias("dst"), F.col("kind").alias("b")), "dst")
    r = small(rules.withColumnRenamed("rel", "rule_rel"))
    met = rows.join(r, (F.col("rel") == F.col("rule_rel")) & (F.col("from_kind").isNull() | (F.col("from_kind") == F.col("a"))) & (F.col("to_kind").isNull() | (F.col("to_kind") == F.col("b"))))
    return met.select("fact_id", "rule", "src", "dst")


def ownership_risk(facts: DataFrame, entities: DataFrame, subjects: list[str], owners: list[str]) -> DataFrame:
    own = linked(facts, OWNS)
    both = own.select(F.col("src").alias("who"), F.col("dst").alias("id")).unionByName(own.select(F.col("dst").alias("who"), F.col("src").alias("id")))
    held = both.join(entities.where(F.col("kind").isin(owners)).select(F.col("id").alias("who")), "who", "left_semi").groupBy("id").agg(F.countDistinct("who").alias("owners"))
    got = entities.where(F.col("kind").isin(subjects)).select("id", "kind").join(held, "id", "left").fillna(0, ["owners"])
    return got.withColumn("risk", F.when(F.col("owners") == 0, "unowned").when(F.col("owners") == 1, "critical").when(F.col("owners") == 2, "elevated").otherwise("distributed"))


def runtime_hotspots(rows: DataFrame) -> DataFrame:
    """From (id, attributes): how much processor time, memory, latency and errors tell; all-zero ones are left out."""
    n = lambda k: F.coalesce(F.expr(f"try_cast(attributes['runtime.{k}'] AS double)"), F.lit(0.0))
    pos = lambda x: F.when(x > 1, F.log10(x)).otherwise(0.0)
    cpu, mem, lat, err = n("cpu_ms"), n("memory_bytes"), n("latency_ms"), n("error_rate")
    score = pos(cpu) + 0.2 * F.log10(mem + 1) + pos(lat) + 10 * err
    return rows.where((cpu != 0) | (mem != 0) | (lat != 0) | (err != 0)).select("id", F.round(score, 6).alias("score"))


#: Kinds of entities by path and name in lower case; the first rule that holds counts.
KIND_RULES = [
    ("migration", "path contains", ["/migrations/", "/migration/"]), ("migration", "name contains", ["migration"]),
    ("schema", "path ends with", ["schema.prisma", ".sql"]), ("schema", "path contains", ["/schema/"]),
    ("infrastructure", "path ends with", ["docker-compose.yml", "docker-compose.yaml", "dockerfile", "compose.yml", "compose.yaml", ".tf", ".tf.json"]), ("infrastructure", "path contains", ["/k8s/", "/kubernetes/", "/helm/"]),
    ("deployment", "path contains", ["/.github/workflows/", "/deploy/", "/deployment/"]),
    ("test", "path contains", ["/test/", "/tests/", "/__tests__/"]), ("test", "path begins with", ["tests/"]), ("test", "path ends with", ["_test.go", "_test.rs", "_test.py", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx"]),
    ("feature_flag", "name begins with", ["feature_"]), ("feature_flag", "name contains", ["featureflag", "feature_flag"]),
    ("queue", "name contains", ["queue"]), ("topic", "name contains", ["topic"]), ("event", "name ends with", ["event"]), ("event", "name contains", ["event_"]),
    ("job", "name contains", ["cron", "scheduler"]), ("job", "name ends with", ["job"]), ("transaction", "name contains", ["transaction"]), ("lock", "name contains", ["mutex", "lock"]),
    ("api", "name ends with", ["controller", "route", "endpoint"]), ("service", "name ends with", ["service"]),
    ("configuration", "name contains", ["config"]), ("configuration", "name begins with", ["env_"]), ("secret", "name contains", ["secret", "token", "password", "api_key"]),
]
#: Kinds of entities by kind of node; others are symbols.
NODE_KINDS = {"file": "file", "module": "package", "namespace": "package", "variable": "value"}


def entity_kind(kind: Column, name: Column, path: Column) -> Column:
    """What a node of the graph is as an entity: by path and name, else by its kind."""
    p, n = F.lower(F.translate(path, "\\", "/")), F.lower(name)
    holds = {"contains": lambda c, x: c.contains(x), "begins with": lambda c, x: c.startswith(x), "ends with": lambda c, x: c.endswith(x)}
    out = None
    for result, rule, words in KIND_RULES:
        what, how = rule.split(" ", 1)
        hit = F.lit(False)
        for w in words:
            hit = hit | F.coalesce(holds[how](p if what == "path" else n, w), F.lit(False))
        out = F.when(hit, result) if out is None else out.when(hit, result)
    plain = F.create_map(*[F.lit(x) for kv in NODE_KINDS.items() for x in kv])[F.lower(kind)]
    return out.otherwise(F.coalesce(plain, F.lit("symbol")))


def fan(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, instability) of every entity, also those without facts."""
    ends = facts.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    got = entities.select("id").join(ends.groupBy("id").agg(F.sum("into").alias("fan_in"), F.sum(1 - F.col("into")).alias("fan_out")), "id", "left").fillna(0, ["fan_in", "fan_out"])
    return got.withColumn("instability", F.when(F.col("fan_in") + F.col("fan_out") > 0, F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 6)).otherwise(0.0))


def quality(facts: DataFrame, entities: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(metric, value): entities, relations, mean and greatest fan-in and fan-out, groups of entities on cycles.

    Cycles are counted as strongly connected groups; simple cycles, of which there may be exponentially many, are listed by `traverse.simple_cycles`.
    """
    n = F.count(F.lit(1)).cast("double")
    rows = lambda df, *aggs: df.agg(*[a.cast("double").alias(name) for name, a in aggs]).select(F.explode(F.create_map(*[x for name, _ in aggs for x in (F.lit(name), F.col(name))])).alias("metric", "value"))
    ends = rows(fan(facts, entities), ("entities", n), ("mean_fan_in", F.avg("fan_in")), ("mean_fan_out", F.avg("fan_out")), ("max_fan_in", F.max("fan_in")), ("max_fan_out", F.max("fan_out")))
    groups = traverse.components(linked(facts, relations).select(F.lit("").alias("key"), "src", "dst")).select("component").distinct()
    out = ends.unionByName(rows(facts, ("relations", n))).unionByName(rows(groups, ("cyclic_groups", n)))
    return out.select("metric", F.round("value", 6).alias("value"))


def temporal_diff(before: DataFrame, after: DataFrame, cols: list[str]) -> DataFrame:
    """Facts, as their columns say, that came or went. Nulls are values."""
    a, b = before.select(*cols).distinct(), after.select(*cols).distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def merge_entities(bundles: DataFrame) -> DataFrame:
    """Entities of several bundles (ord, id, kind, name, repo, path, attributes): each field's first value that isn't null; attributes of earlier bundles win."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    attrs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("ord")).alias("o"), F.map_entries("attributes").alias("m")))), lambda s: s["m"])
    pairs = F.aggregate(attrs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, m: F.concat(F.filter(acc, lambda x: ~F.exists(m, lambda y: y["key"] == x["key"])), F.coalesce(m, F.array().cast("array<struct<key:string,value:string>>"))))
    return bundles.groupBy("id").agg(*[first(c) for c in ("kind", "name", "repo", "path")], F.map_from_entries(pairs).alias("attributes"))


def accept_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts whose ends exist and whose confidence lies in 0..1; exact repetitions once."""
    known = entities.select("id").distinct()
    ok = facts.where("conf >= 0 AND conf <= 1").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ok.dropDuplicates([c for c in ok.columns if c != "fact_id"])


def git_facts(commits: DataFrame) -> DataFrame:
    """From (author, id, at, path): who wrote, what came after what, what changed what, who owns it how surely."""
    none = F.lit(1.0)
    wrote = commits.select(F.concat(F.lit("commit:"), "id").alias("src"), F.concat(F.lit("author:"), "author").alias("dst"), F.lit("authored_by").alias("rel"), none.alias("conf")).distinct()
    changed = commits.select(F.concat(F.lit("commit:"), "id").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("changes").alias("rel"), none.alias("conf")).distinct()
    prev = F.lag("id").over(W.partitionBy("path").orderBy("at", "id"))
    after = commits.select("path", "at", "id").distinct().withColumn("prev", prev).where("prev IS NOT NULL").select(
        F.concat(F.lit("commit:"), "id").alias("src"), F.concat(F.lit("commit:"), "prev").alias("dst"), F.lit("supersedes").alias("rel"), none.alias("conf")).distinct()
    owns = commits.groupBy("author", "path").agg(F.countDistinct("id").alias("n")).select(
        F.concat(F.lit("author:"), "author").alias("src"), F.concat(F.lit("file:"), "path").alias("dst"), F.lit("owns").alias("rel"), F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("n") / 5)).alias("conf"))
    return wrote.unionByName(changed).unionByName(after).unionByName(owns)


def weighted_means(samples: DataFrame, key: str, weight: str, values: list[str]) -> DataFrame:
    """Means over samples, each counted `weight` times; rows without a value or weight don't count for it."""
    ok = lambda v: F.col(v).isNotNull() & (F.col(weight) > 0)
    return samples.groupBy(key).agg(*[(F.sum(F.when(ok(v), F.col(v) * F.col(weight))) / F.sum(F.when(ok(v), F.col(weight)))).alias(v) for v in values])


def observations(samples: DataFrame, trace: str, entity: str, at: str) -> DataFrame:
    """(src, dst, rel, ev, conf, ms): each trace observes an entity once, first seen at the least time in ms; samples without a trace are traces of their own by entity and time."""
    own = F.coalesce(F.nullif(F.trim(trace), F.lit("")), F.concat_ws(":", F.lit("runtime:observation"), F.col(entity), F.coalesce(F.col(at), F.lit(0)).cast("string")))
    got = samples.where(F.col(entity).isNotNull()).groupBy(own.alias("src"), F.col(entity).alias("dst")).agg(F.min(at).alias("ms"))
    return got.select("src", "dst", F.lit("observes").alias("rel"), F.lit("runtime").alias("ev"), F.lit(1.0).alias("conf"), "ms")


def contract_snapshots(rows: DataFrame) -> DataFrame:
    """From (owner, field, kind): each owner's sorted fields, complete if none lacks a name or kind."""
    return rows.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "field", "kind"))), ",").alias("fields"), (F.count(F.when(F.col("field").isNull() | F.col("kind").isNull(), 1)) == 0).alias("complete"))
