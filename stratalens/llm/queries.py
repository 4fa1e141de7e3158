"""Registered queries on training text, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.common import table
from stratalens.llm import handwritten, leakage, packing, quality, sketches
from stratalens.operators import delivery

#: Relative error of the percentile sketches.
ERROR = 0.01
QS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_analyses")).select("repository", "path")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "file_analyses"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    """One sketch for each node or pair of nodes and day. A repeated message or observation counts once."""
    once = delivery.collapse(
        table(spark, d, "observed_spans"), ["trace_id", "span_id"], ["end_unix_nano", "received_at", "batch_id"],
        ["end_unix_nano", "received_at", "batch_id", "node_id", "start_unix_nano", "duration_ms"], fold_case=True, keep_unkeyed=True,
    )
    nano_day = lambda c: F.date_format(F.timestamp_micros(F.floor(F.col(c) / 1000).cast("long")), "yyyy-MM-dd")
    spans = once.select(
        F.lit("observed_spans").alias("source"), F.col("node_id").alias("source_node"), F.lit(None).cast("string").alias("target_node"),
        nano_day("start_unix_nano").alias("day"), F.col("duration_ms").alias("value"),
    )
    edges = table(spark, d, "runtime_edges").distinct().select(
        F.lit("runtime_edges").alias("source"), "source_node", "target_node", nano_day("last_seen_unix_nano").alias("day"), F.col("total_latency_ms").alias("value")
    )
    return sketches.sketch(spans.unionByName(edges), ["source", "source_node", "target_node", "day"], "value", ERROR)


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per node or pair: each day's percentiles, and those of all days (scope 'all') by adding the days' sketches."""
    days = _days(spark, d)
    whole = sketches.merge(days, ["source", "source_node", "target_node"])
    both = days.withColumn("scope", F.lit("day")).unionByName(whole.withColumn("scope", F.lit("all")).withColumn("day", F.lit(None).cast("string")))
    out = sketches.percentiles(both, ["source", "source_node", "target_node", "scope", "day"], QS, ERROR)
    return out.select("source", "source_node", "target_node", "scope", "day", "n", *[F.round(q, 6).alias(q) for q in QS])


def p6_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The days' bucket counts themselves, to be kept and added to later ones."""
    return _days(spark, d)


_P6 = """
WITH m AS (SELECT node_id, start_unix_nano, duration_ms FROM observed_spans WHERE trace_id IS NOT NULL AND span_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trace_id), lower(span_id) ORDER BY end_unix_nano DESC NULLS LAST, received_at DESC NULLS LAST,
  batch_id DESC NULLS LAST, node_id DESC NULLS LAST, start_unix_nano DESC NULLS LAST, duration_ms DESC NULLS LAST) = 1
  UNION ALL SELECT node_id, start_unix_nano, duration_ms FROM observed_spans WHERE trace_id IS NULL OR span_id IS NULL),
v AS (SELECT 'observed_spans' AS source, node_id AS source_node, CAST(NULL AS VARCHAR) AS target_node, strftime(make_timestamp(CAST(floor(start_unix_nano / 1000) AS BIGINT)), '%Y-%m-%d') AS day, duration_ms AS x FROM m
  UNION ALL SELECT 'runtime_edges', source_node, target_node, strftime(make_timestamp(CAST(floor(last_seen_unix_nano / 1000) AS BIGINT)), '%Y-%m-%d'), total_latency_ms FROM (SELECT DISTINCT * FROM runtime_edges)),
b AS (SELECT source, source_node, target_node, day, CAST(CASE WHEN abs(x) < 2.3e-308 THEN 0 WHEN x > 0 THEN ceil(ln(x) / ln(1.01 / 0.99)) + 4194304 ELSE -(ceil(ln(-x) / ln(1.01 / 0.99)) + 4194304) END AS BIGINT) AS bucket
  FROM v WHERE x IS NOT NULL AND NOT isnan(x)),
"""
P6_SKETCHES_SQL = _P6.rstrip().rstrip(",") + " SELECT source, source_node, target_node, day, bucket, count(*) AS n FROM b GROUP BY ALL"
P6_PERCENTILES_SQL = _P6 + """
s AS (SELECT source, source_node, target_node, 'day' AS scope, day, bucket FROM b UNION ALL SELECT source, source_node, target_node, 'all', NULL, bucket FROM b),
r AS (SELECT source, source_node, target_node, scope, day, list_sort(list(bucket)) AS l, count(*) AS n FROM s GROUP BY ALL),
q AS (SELECT source, source_node, target_node, scope, day, n, unnest([0.5, 0.9, 0.99]) AS q, unnest(['p50', 'p90', 'p99']) AS name, l FROM r),
e AS (SELECT source, source_node, target_node, scope, day, n, name, l[CAST(floor(q * (n - 1)) AS BIGINT) + 1] AS k FROM q),
x AS (SELECT *, CASE WHEN k = 0 THEN 0.0 WHEN k > 0 THEN 2.0 * pow(1.01 / 0.99, k - 4194304) / (1.01 / 0.99 + 1) ELSE -2.0 * pow(1.01 / 0.99, -k - 4194304) / (1.01 / 0.99 + 1) END AS y FROM e)
SELECT source, source_node, target_node, scope, day, n, round(max(y) FILTER (name = 'p50'), 6) AS p50, round(max(y) FILTER (name = 'p90'), 6) AS p90, round(max(y) FILTER (name = 'p99'), 6) AS p99
FROM x GROUP BY ALL
"""


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    """How many containers have how much unused space, which doesn't depend on which of equal gaps an item goes to."""
    return p7_fill(spark, d).groupBy("unused").agg(F.count(F.lit(1)).alias("containers"))


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """What of each document has a place: its pieces, their tokens, and the containers they are in."""
    return p7_containers(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.countDistinct("container").alias("containers"))


#: Best fit item by item, over the list of gaps.
P7_UNUSED_SQL = """
WITH RECURSIVE n AS (SELECT greatest(coalesce(n_tokens, 0), 0) AS n FROM documents),
p AS (SELECT unnest(list_concat(list_transform(range(n // 1024), lambda x: 1024), CASE WHEN n % 1024 > 0 THEN [n % 1024] ELSE [] END)) AS size FROM n),
it AS (SELECT row_number() OVER (ORDER BY size DESC) AS i, CAST(size AS INT) AS size FROM p),
go(i, gaps) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INT[]) UNION ALL
  SELECT i, CASE WHEN g IS NULL THEN list_append(gaps, 1024 - size) ELSE list_append(list_concat(gaps[1:list_position(gaps, g) - 1], gaps[list_position(gaps, g) + 1:]), g - size) END
  FROM (SELECT it.i, it.size, go.gaps, list_min(list_filter(go.gaps, lambda x: x >= it.size)) AS g FROM go JOIN it ON it.i = go.i + 1)),
last AS (SELECT CASE WHEN len(gaps) = 0 AND (SELECT count(*) FROM n) > 0 THEN [1024] ELSE gaps END AS gaps FROM go ORDER BY i DESC LIMIT 1)
SELECT unused, count(*) AS containers FROM (SELECT CAST(unnest(gaps) AS BIGINT) AS unused FROM last) GROUP BY 1
"""
P7_PLACED_SQL = "SELECT doc_id, greatest((n + 1023) // 1024, 1) AS pieces, n AS tokens, greatest((n + 1023) // 1024, 1) AS containers FROM (SELECT doc_id, CAST(greatest(coalesce(n_tokens, 0), 0) AS BIGINT) AS n FROM documents)"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where in the original text each leak lies."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), spans=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return judged.where("outside_share > 0.5").select("doc_id").distinct()


def p9_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Distance from prose and what each statistic contributes to it, for every document."""
    judged = quality.quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return judged.select("doc_id", "language", F.round("outside_share", 6).alias("outside_share"), F.round("distance", 3).alias("distance"), "contributions")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The plain statistics of every document, without leaving the JVM: words, mean word length, symbols, line ends, and common words of the language that has most of them in the text."""
    # A fixed list; it becomes part of the plan, as sets in which each word is looked up.
    common = quality.common_table(table(spark, d, "common_words"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit("(\\p{L}+)"), 1)
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    out = docs.select(
        "doc_id",
        F.transform(words, lambda w: F.lower(w)).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace("text", "\\s", "")).alias("chars"),
        F.length(F.regexp_replace("text", "[\\p{L}\\p{N}\\s]", "")).alias("symbols"),
    )
    letters = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    n = F.size("words")
    among = lambda known: lambda w: w.isin(known)
    hits = [F.size(F.filter("words", among(sorted(known)))) for known in common.values()]
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return out.select(
        "doc_id",
        n.cast("long").alias("word_count"),
        share(letters, n).alias("mean_word_length"),
        share(F.col("symbols"), F.col("chars")).alias("symbol_ratio"),
        share(F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("[.!?:;,]$"))), F.size("lines")).alias("punctuated_lines"),
        share(F.greatest(F.lit(0), F.lit(0), *hits), n).alias("common_word_share"),
    )


P9_STATISTICS_SQL = """
WITH c AS (SELECT lang, list(DISTINCT lower(word)) AS common FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\p{L}+'), lambda x: lower(x)) AS words,
        list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x) <> '') AS lines,
        length(regexp_replace(text, '\\s', '', 'g')) AS chars, length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) AS symbols FROM t),
h AS (SELECT doc_id, max(hits) AS hits FROM (SELECT doc_id, len(list_filter(words, lambda x: list_contains(common, x))) AS hits FROM w, c) GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS word_count,
  round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / len(words) ELSE 0.0 END, 6) AS mean_word_length,
  round(CASE WHEN chars > 0 THEN symbols / chars ELSE 0.0 END, 6) AS symbol_ratio,
  round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '[.!?:;,]$'))) / len(lines) ELSE 0.0 END, 6) AS punctuated_lines,
  round(CASE WHEN len(words) > 0 THEN hits / len(words) ELSE 0.0 END, 6) AS common_word_share
FROM w JOIN h USING (doc_id)
"""

QUERIES = {
    "p4_found": p4_found, "p4_reasons": p4_reasons, "p6_percentiles": p6_percentiles, "p6_sketches": p6_sketches, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_unused": p7_unused, "p7_placed": p7_placed, "p8_found": p8_found, "p8_spans": p8_spans,
    "p9_found": p9_found, "p9_outliers": p9_outliers, "p9_statistics": p9_statistics,
}
SQL: dict[str, str] = {"p6_percentiles": P6_PERCENTILES_SQL, "p6_sketches": P6_SKETCHES_SQL, "p7_unused": P7_UNUSED_SQL, "p7_placed": P7_PLACED_SQL, "p9_statistics": P9_STATISTICS_SQL}
