"""Queries on scores, recall and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import stage, table
from stratalens.operators import scoring, structure, traverse
from stratalens.plans.graphs import _DEGREE, _scc_sql
from stratalens.plans.runtime import metrics
from stratalens.plans.registry import registry
from stratalens.plans.views import GRAPH_SQL, SPANS_SQL, graph

QUERIES, SQL, query = registry()


def measured(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph(spark, d)
    return scoring.measured(traverse.degrees(nodes, edges), metrics(spark, d), structure.cycles(edges))


_NLOG = "CASE WHEN ({v}) > 0 AND ({m}) > 0 THEN least(1.0, ln(1 + ({v})) / ln(1 + ({m}))) ELSE 0.0 END"


def _nlog(v: str, m: str) -> str:
    return _NLOG.format(v=v, m=m)


_CENTRAL = _nlog("2 * fan_in + fan_out", "greatest(2 * max_degree, 1)")
_CALLS = _nlog("calls", "max_calls")
_SLOW = "CASE WHEN max_ms > 0 THEN greatest(0.0, least(1.0, ms / max_ms)) ELSE 0.0 END"
_ERR = "greatest(0.0, least(1.0, errors))"
_HOT = "CASE WHEN hot THEN 1.0 ELSE 0.0 END"
_M = (
    GRAPH_SQL + "," + SPANS_SQL.replace("\nWITH RECURSIVE ", "") + _DEGREE + _scc_sql("true") + """,
met AS (SELECT node_id AS id, count(*) AS calls, avg(greatest(ms, 0)) AS ms, avg(CASE WHEN err THEN 1.0 ELSE 0.0 END) AS errors, count(*) > 500 AS hot FROM spans WHERE node_id IS NOT NULL GROUP BY 1),
m0 AS (SELECT d.*, met.id IS NOT NULL AS observed, coalesce(calls, 0) AS calls, coalesce(ms, 0) AS ms, coalesce(errors, 0) AS errors, coalesce(hot, false) AS hot,
   EXISTS (SELECT 1 FROM scc WHERE scc.repo = d.repo AND scc.id = d.id) AS cyclic FROM deg d LEFT JOIN met USING (id)),
m AS (SELECT *, max(fan_in + fan_out) OVER (PARTITION BY repo) AS max_degree, max(calls) OVER (PARTITION BY repo) AS max_calls, max(ms) OVER (PARTITION BY repo) AS max_ms FROM m0)"""
)
_ACT = _M + f""",
act AS (SELECT repo, id, path, fan_in, fan_out, observed, cyclic, hot, round(CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE fan_out / (fan_in + fan_out) END, 6) AS instability, round({_CENTRAL}, 6) AS centrality,
 round(greatest(0.0, least(1.0, {_CENTRAL} * 0.34 + {_CALLS} * 0.36 + {_SLOW} * 0.10 + {_ERR} * 0.15 + {_HOT} * 0.05)), 6) AS activity,
 round(greatest(0.0, least(1.0, {_nlog('fan_in', 'greatest(max_degree, 1)')} * 0.48 + {_CENTRAL} * 0.24 + CASE WHEN cyclic THEN 0.18 ELSE 0.0 END + {_CALLS} * 0.10)), 6) AS sensitivity,
 round(CASE WHEN observed THEN greatest(0.0, least(1.0, {_CALLS} * 0.35 + {_SLOW} * 0.25 + {_ERR} * 0.30 + {_HOT} * 0.10)) ELSE 0.0 END, 6) AS pressure,
 CASE WHEN cyclic THEN 'cycle-core' WHEN fan_in >= 8 AND fan_out >= 8 THEN 'architecture-hub' WHEN fan_in >= 8 THEN 'shared-contract' WHEN fan_out >= 8 THEN 'orchestrator' WHEN hot THEN 'runtime-hotpath'
  WHEN fan_in = 0 AND fan_out > 0 THEN 'entry-or-leaf-source' WHEN fan_in > 0 AND fan_out = 0 THEN 'terminal-dependency' ELSE 'connected-symbol' END AS role FROM m)"""


@query(_ACT + " SELECT * FROM act")
def activity_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.activity(measured(spark, d))


@query(_ACT + " SELECT repo, role, count(*) AS n FROM act GROUP BY 1, 2")
def activity_roles(spark: SparkSession, d: str) -> DataFrame:
    return activity_scores(spark, d).groupBy("repo", "role").agg(F.count(F.lit(1)).alias("n"))


_SPOTS = _ACT + ", spots AS (" + " UNION ALL ".join(
    f"(SELECT repo, '{n}' AS list, id, {n} AS score, row_number() OVER (PARTITION BY repo ORDER BY {n} DESC, id) AS rank FROM act QUALIFY row_number() OVER (PARTITION BY repo ORDER BY {n} DESC, id) <= 40)"
    for n in scoring.LISTS) + ")"


@query(_SPOTS + " SELECT * FROM spots")
def hotspots_top(spark: SparkSession, d: str) -> DataFrame:
    return scoring.hotspots(stage(activity_scores(spark, d), "activity"))


@query(_SPOTS + """, f AS (SELECT repo, id, min(list_position(['activity', 'sensitivity', 'pressure'], list) * 1000 + rank) AS o FROM spots GROUP BY 1, 2)
SELECT repo, id, row_number() OVER (PARTITION BY repo ORDER BY o) AS position FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY o) <= 96""")
def memory_priority(spark: SparkSession, d: str) -> DataFrame:
    return scoring.memory_priority(hotspots_top(spark, d))


_BND = "CASE WHEN split_part(replace(path, chr(92), '/'), '/', 1) IN ('apps', 'services', 'packages', 'libs', 'crates', 'modules') AND len(string_split(replace(path, chr(92), '/'), '/')) > 2 THEN split_part(replace(path, chr(92), '/'), '/', 1) || '/' || split_part(replace(path, chr(92), '/'), '/', 2) ELSE split_part(replace(path, chr(92), '/'), '/', 1) END"


@query(_ACT + f""", b AS (SELECT repo, id, activity, {_BND} AS boundary FROM act), x AS (SELECT e.repo, p.boundary AS ba, q.boundary AS bb FROM edges e JOIN b p ON p.repo = e.repo AND p.id = e.src JOIN b q ON q.repo = e.repo AND q.id = e.dst WHERE p.boundary <> q.boundary)
SELECT repo, boundary, count(*) AS nodes, floor(avg(activity) * 1e6 + 0.31830988) / 1e6 AS activity, (SELECT count(*) FROM x WHERE x.repo = b.repo AND x.bb = b.boundary) AS edges_in, (SELECT count(*) FROM x WHERE x.repo = b.repo AND x.ba = b.boundary) AS edges_out FROM b GROUP BY repo, boundary""")
def boundary_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.boundary_rollup(activity_scores(spark, d), graph(spark, d)[1])


_DNA = _M + """, st AS (SELECT repo, id, 0.55 * least(1.0, (2 * fan_in + fan_out) / greatest(0.35 * count(*) OVER (PARTITION BY repo), 1.0)) + 0.17 * CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE fan_out / (fan_in + fan_out) END
   + CASE WHEN cyclic THEN 0.28 ELSE 0.0 END AS s, least(log10(calls + 1) / 6, 0.25) + least(ms / 2500, 0.25) + least(3 * errors, 0.35) + CASE WHEN hot THEN 0.15 ELSE 0.0 END AS r FROM m),
dna AS (SELECT repo, id, round(s, 6) AS structural, round(r, 6) AS runtime, round(greatest(0.0, least(1.0, 0.68 * s + 0.32 * r)), 6) AS risk, round(100 * (1 - greatest(0.0, least(1.0, 0.68 * s + 0.32 * r))), 4) AS health FROM st)"""


@query(_DNA + " SELECT * FROM dna")
def code_dna(spark: SparkSession, d: str) -> DataFrame:
    return scoring.code_dna(measured(spark, d))


@query(_DNA + " SELECT repo, count(*) AS nodes, round(avg(health), 4) AS health, round(max(risk), 6) AS worst FROM dna GROUP BY 1")
def code_dna_summary(spark: SparkSession, d: str) -> DataFrame:
    return code_dna(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("health"), 4).alias("health"), F.round(F.max("risk"), 6).alias("worst"))


_PRIO = _M + f""", prio AS (SELECT repo, id, path, name, fan_in, fan_out, round(0.5 * {_nlog('2 * fan_in + fan_out', '2 * max_degree')} + 0.3 * {_CALLS}
  + 0.2 * greatest(0.0, least(1.0, 0.65 * errors + CASE WHEN hot THEN 0.2 ELSE 0.0 END + greatest(0.0, least(0.15, ms / 5000)))), 6) AS priority FROM m)"""


@query(_PRIO + " SELECT repo, id, priority FROM prio")
def activity_priority(spark: SparkSession, d: str) -> DataFrame:
    return scoring.activity_priority(measured(spark, d)).select("repo", "id", "priority")


@query(_M + " SELECT repo, id, round(least(least((2 * fan_in + fan_out) / 30, 0.65) + least(2.5 * errors, 0.2) + CASE WHEN hot THEN 0.1 ELSE 0.0 END + least(ms / 5000, 0.05), 0.99), 6) AS probability FROM m")
def failure_probability(spark: SparkSession, d: str) -> DataFrame:
    return scoring.failure_probability(measured(spark, d))


QUESTION = "router gateway routeRequest"


def _lexical_sql() -> str:
    one = "(CASE WHEN lower(id) = '{t}' THEN 18 ELSE 0 END + CASE WHEN lower(name) = '{t}' THEN 15 ELSE 0 END + CASE WHEN ends_with(lower(id), '::{t}') THEN 12 ELSE 0 END + CASE WHEN lower(path) = '{t}' THEN 11 ELSE 0 END + CASE WHEN ends_with(lower(path), '{t}') THEN 8 ELSE 0 END + CASE WHEN contains(lower(path), '{t}') THEN 6 ELSE 0 END + CASE WHEN contains(concat_ws(' ', lower(id), lower(name), lower(path)), '{t}') THEN 2 ELSE 0 END)"
    return " + ".join(one.format(t=t) for t in scoring.terms(QUESTION))


_RECALL = _PRIO + f", rec AS (SELECT repo, id, round(({_lexical_sql()}) + 2 * priority, 6) AS score, priority FROM prio WHERE {_lexical_sql()} > 0)"


@query(_RECALL + " SELECT * FROM rec")
def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.recall_scores(scoring.activity_priority(measured(spark, d)), QUESTION)


_AROUND = _RECALL + """, roots AS (SELECT repo, id FROM rec QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, priority DESC, id) <= 12),
un AS (SELECT repo, src AS a, dst AS b FROM edges UNION SELECT repo, dst, src FROM edges),
walk(repo, id, depth) AS (SELECT repo, id, 0 FROM roots UNION SELECT w.repo, u.b, w.depth + 1 FROM walk w JOIN un u ON u.repo = w.repo AND u.a = w.id WHERE w.depth < 2),
near AS (SELECT repo, id, min(depth) AS depth FROM walk GROUP BY 1, 2),
ord AS (SELECT n.repo, n.id, n.depth, p.fan_in + p.fan_out AS degree, p.priority, row_number() OVER (PARTITION BY n.repo ORDER BY depth, p.fan_in + p.fan_out DESC, n.id) AS ordinal FROM near n JOIN prio p ON p.repo = n.repo AND p.id = n.id)"""


@query(_AROUND + " SELECT * FROM ord WHERE ordinal <= 480")
def recall_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    p = stage(scoring.activity_priority(measured(spark, d)), "priority")
    return scoring.recall_neighbourhood(scoring.recall_scores(p, QUESTION), p, graph(spark, d)[1])


@query(_AROUND + """, kept AS (SELECT repo, id FROM ord WHERE ordinal <= 480) SELECT o.repo, count(*) FILTER (ordinal <= 480) AS nodes, max(ordinal) > 480 AS truncated,
 (SELECT count(*) FROM edges e WHERE e.repo = o.repo AND (e.repo, e.src) IN (SELECT repo, id FROM kept) AND (e.repo, e.dst) IN (SELECT repo, id FROM kept)) AS edges FROM ord o GROUP BY o.repo""")
def recall_summary(spark: SparkSession, d: str) -> DataFrame:
    """How much a question's neighbourhood holds in each repository, edges among its nodes included, and whether it was cut."""
    p, edges = stage(scoring.activity_priority(measured(spark, d)), "priority"), graph(spark, d)[1]
    around = stage(scoring.recall_neighbourhood(scoring.recall_scores(p, QUESTION), p, edges, beyond=True), "around")
    return scoring.recall_summary(around, edges, 480)


BUDGET = 4000


@query(_AROUND + f""", kept AS (SELECT repo, id, ordinal FROM ord WHERE ordinal <= 480),
s0 AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ordinal) AS ord, 'root ' || id AS text FROM ord WHERE depth = 0 AND ordinal <= 480), s1 AS (SELECT repo, ordinal AS ord, 'node ' || id AS text FROM kept),
s2 AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY src, dst, kind) AS ord, src || ' ' || kind || ' ' || dst AS text FROM edges e WHERE (e.repo, e.src) IN (SELECT repo, id FROM kept) AND (e.repo, e.dst) IN (SELECT repo, id FROM kept)),
c0 AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo ORDER BY ord) AS used FROM s0), k0 AS (SELECT * FROM c0 WHERE used <= {BUDGET}), t0 AS (SELECT repo, max(used) AS spent FROM k0 GROUP BY 1),
c1 AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo ORDER BY ord) + coalesce((SELECT spent FROM t0 WHERE t0.repo = s1.repo), 0) AS used FROM s1), k1 AS (SELECT * FROM c1 WHERE used <= {BUDGET}), t1 AS (SELECT repo, max(used) AS spent FROM (SELECT repo, used FROM k0 UNION ALL SELECT repo, used FROM k1) GROUP BY 1),
c2 AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo ORDER BY ord) + coalesce((SELECT spent FROM t1 WHERE t1.repo = s2.repo), 0) AS used FROM s2), k2 AS (SELECT * FROM c2 WHERE used <= {BUDGET})
SELECT repo, section, ord, text, CAST(used AS BIGINT) AS used FROM (SELECT 0 AS section, * FROM k0 UNION ALL SELECT 1, * FROM k1 UNION ALL SELECT 2, * FROM k2)""")
def context_compiled(spark: SparkSession, d: str) -> DataFrame:
    """A question's context for each repository, within a budget of characters: roots, then nodes, then edges among them."""
    p, edges = stage(scoring.activity_priority(measured(spark, d)), "priority"), stage(graph(spark, d)[1], "edges")
    around = stage(scoring.recall_neighbourhood(scoring.recall_scores(p, QUESTION), p, edges), "around")
    place = lambda *order: F.row_number().over(W.partitionBy("repo").orderBy(*order)).cast("int")
    kept = around.select("repo", "id")
    inner = edges.join(kept.withColumnRenamed("id", "src"), ["repo", "src"], "left_semi").join(kept.withColumnRenamed("id", "dst"), ["repo", "dst"], "left_semi")
    return scoring.compiled_context([
        around.where("depth = 0").select("repo", place("ordinal").alias("ord"), F.concat(F.lit("root "), "id").alias("text")), around.select("repo", F.col("ordinal").alias("ord"), F.concat(F.lit("node "), "id").alias("text")),
        inner.select("repo", place("src", "dst", "kind").alias("ord"), F.concat_ws(" ", "src", "kind", "dst").alias("text")),
    ], BUDGET)


@query(_PRIO + """, run AS (SELECT repo, id, CAST(length(id) + 40 AS BIGINT) AS chars, sum(length(id) + 40) OVER (PARTITION BY repo ORDER BY priority DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM prio)
SELECT repo, id, chars, CAST(used AS BIGINT) AS used FROM run WHERE used <= 4000""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """What of each repository fits a context of 4,000 characters, most important first."""
    rows = scoring.activity_priority(measured(spark, d)).withColumn("chars", (F.length("id") + 40).cast("long"))
    return scoring.within_budget(rows, ["repo"], [F.col("priority").desc(), "id"], "chars", 4000).select("repo", "id", "chars", "used")


#: Words that a question's terms leave out.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "does", "do", "did", "why", "what", "which", "how", "this", "that", "these", "those", "in", "on", "at", "to", "for", "of", "and", "or", "it", "its",
    "with", "from", "by", "as", "be", "has", "have", "had",
]


def question_terms(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[^\w]+", text.lower()) if len(t) > 2 and t not in STOP_WORDS]


@query(GRAPH_SQL + """, hit AS (SELECT repo, id, CAST(contains(lower(concat_ws(' ', id, name, path)), 'ledger') AS INT) + CAST(contains(lower(concat_ws(' ', id, name, path)), 'gateway') AS INT) + CAST(contains(lower(concat_ws(' ', id, name, path)), 'slow') AS INT) AS hits FROM nodes)
SELECT repo, id, hits FROM hit WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY hits DESC, id) <= 25""")
def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    """The 25 nodes of each repository that share most words with a question."""
    text = F.lower(F.concat_ws(" ", "id", "name", "path"))
    hits = F.lit(0)
    for t in question_terms("Why is the ledger gateway slow?"):
        hits = hits + text.contains(t).cast("int")
    rows = graph(spark, d)[0].select("repo", "id", hits.alias("hits")).where("hits > 0")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("repo").orderBy(F.col("hits").desc(), "id"))).where("r <= 25").drop("r")


# evaluations: orders stand for observed changes
_EV = """WITH ev AS (SELECT o_orderkey AS id, o_orderpriority AS task, o_orderstatus = 'F' AS validated, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 100000 END AS improved,
 CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 5 = 0 END AS regression, o_custkey % 11 = 0 AS rollback FROM orders),
sc AS (SELECT *, list_avg(list_filter([CASE WHEN validated THEN 1.0 WHEN validated IS NULL THEN NULL ELSE 0.0 END, CASE WHEN improved THEN 1.0 WHEN improved IS NULL THEN NULL ELSE 0.0 END,
 CASE WHEN regression THEN 0.0 WHEN regression IS NULL THEN NULL ELSE 1.0 END, CASE WHEN rollback THEN 0.0 WHEN rollback IS NULL THEN NULL ELSE 1.0 END], lambda x: x IS NOT NULL)) AS score FROM ev)"""


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), (F.col("o_orderstatus") == "F").alias("validated"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 100000).alias("improved"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 5 == 0).alias("regression"), (F.col("o_custkey") % 11 == 0).alias("rollback"),
    )


@query(_EV + " SELECT task, count(*) AS n, round(avg(score), 6) AS score, round(avg(CASE WHEN rollback THEN 1.0 ELSE 0.0 END), 6) AS rollback_rate FROM sc GROUP BY 1")
def evaluation_scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluations(spark, d).withColumn("score", scoring.observed_score(["validated", "improved"], ["regression", "rollback"]))
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg(F.when(F.col("rollback"), 1.0).otherwise(0.0)), 6).alias("rollback_rate"))


@query(_EV + ", b AS (SELECT array_to_string(list_filter([CASE WHEN coalesce(validated, false) THEN NULL ELSE 'validated' END, CASE WHEN coalesce(improved, false) THEN NULL ELSE 'improved' END, CASE WHEN coalesce(rollback, false) THEN NULL ELSE 'rollback' END], lambda x: x IS NOT NULL), ',') AS blockers FROM ev) SELECT blockers, count(*) AS n, false AS autonomous FROM b GROUP BY 1")
def promotion_blockers(spark: SparkSession, d: str) -> DataFrame:
    """What keeps proposals from promotion. Nothing is ever promoted without a person."""
    rows = evaluations(spark, d).select(F.array_join(scoring.blockers(["validated", "improved"], "rollback"), ",").alias("blockers"))
    return rows.groupBy("blockers").agg(F.count(F.lit(1)).alias("n")).withColumn("autonomous", F.lit(False))
