"""Spans: normal form, identity, aggregates, edges, traces, fusion with the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.common import numbered

#: Thresholds of the live signals, and when a path counts as hot in each place that merges.
HOT, SLOW_MS, ERROR_RATE, FAN_OUT = 500, 500.0, 0.05, 6
HOT_LIMITS = {"batch": 500, "graph": 1000, "server": 500}


def is_error(code: Column) -> Column:
    """Status code 2, as number or text, or its names."""
    return F.upper(F.trim(code.cast("string"))).isin("2", "ERROR", "STATUS_CODE_ERROR")


def clean_part(text: Column) -> Column:
    """A part of an identity: slashes for backslashes and '::', blanks for tabs and line ends, at most 300 characters."""
    return F.substring(F.translate(F.replace(F.translate(F.trim(text), "\\", "/"), F.lit("::"), F.lit("/")), "\n\r\t", "   "), 1, 300)


def identity(attributes: Column, name: Column) -> Column:
    """path::function for spans that name their file's path; else runtime-unresolved/kind/parts. Nothing is guessed from a bare name: a file's name alone, which several files may have, only tells identities apart."""
    first = lambda *keys: F.coalesce(*[F.nullif(F.trim(attributes[k]), F.lit("")) for k in keys])
    path = F.translate(first("code.file.path", "code.filepath"), "\\", "/")
    base = first("code.file.name")
    fn = first("code.function.name", "code.function", "function.name")
    space = first("code.namespace", "service.name")
    lost = lambda kind, *parts: F.concat_ws("/", F.lit("runtime-unresolved"), F.lit(kind), *[F.nullif(clean_part(p), F.lit("")) for p in parts])
    span = F.when(space.isNotNull(), lost("namespace-span", space, name)).when(base.isNotNull(), lost("basename-span", base, name)).otherwise(lost("span", name))
    function = F.when(space.isNotNull(), lost("namespace-function", space, fn)).when(base.isNotNull(), lost("basename-function", base, fn)).otherwise(lost("function", fn))
    return F.when(path.isNotNull(), F.concat_ws("::", path, F.coalesce(fn, F.lit("file")))).when(fn.isNotNull(), function).otherwise(span)


def aggregate(spans: DataFrame, key: str = "node_id", hot: int = HOT_LIMITS["batch"]) -> DataFrame:
    """Per identity: calls, mean ms (negative counts as 0), error rate, hot."""
    return spans.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.greatest("ms", F.lit(0.0))).alias("ms"), F.avg(F.when(F.col("err"), 1.0).otherwise(0.0)).alias("errors")
    ).withColumn("hot", F.col("calls") > hot)


def merge_metrics(batches: DataFrame, hot: int = HOT_LIMITS["graph"]) -> DataFrame:
    """Batches (id, calls, ms, errors, hot) to one row per id: means weighted by calls; once hot, always hot."""
    n = F.sum("calls")
    return batches.groupBy("id").agg(
        n.alias("calls"), (F.sum(F.col("ms") * F.col("calls")) / n).alias("ms"), (F.sum(F.col("errors") * F.col("calls")) / n).alias("errors"), (F.max("hot") | (n > hot)).alias("hot")
    )


def edges(spans: DataFrame) -> DataFrame:
    """(source, target): calls, errors, total ms, last seen, last trace; children joined to parents within their trace."""
    up = spans.select("t", F.col("v").alias("p"), F.col("node_id").alias("source"))
    pairs = spans.where("p IS NOT NULL").join(up, ["t", "p"]).where("source IS NOT NULL AND node_id IS NOT NULL")
    return pairs.groupBy("source", F.col("node_id").alias("target")).agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("err"), 1)).alias("errors"), F.sum(F.greatest("ms", F.lit(0.0))).alias("total_ms"), F.max("stop").alias("last_seen"),
        F.max(F.struct("stop", "t")).getField("t").alias("last_trace"),
    )


def trace_steps(spans: DataFrame) -> DataFrame:
    """Spans with their position in the trace by start and span id, their source's node, and whether they have no parent."""
    placed = numbered(spans, ["t"], ["start", "v"], "pos")
    up = spans.select("t", F.col("v").alias("p"), F.col("node_id").alias("source"))
    return placed.join(up, ["t", "p"], "left").withColumn("root", F.col("p").isNull())


def retained(spans: DataFrame, traces: int, per_trace: int) -> DataFrame:
    """The newest traces, and of each the first spans by start."""
    seen = spans.groupBy("t").agg(F.max("stop").alias("last_seen"), F.min("start").alias("first_seen"), F.count(F.lit(1)).alias("spans"))
    newest = seen.orderBy(F.col("last_seen").desc_nulls_last(), "t").limit(traces)
    kept = spans.join(F.broadcast(newest.select("t")), "t").withColumn("pos", F.row_number().over(W.partitionBy("t").orderBy(F.col("start").asc_nulls_first(), "v"))).where(F.col("pos") <= per_trace)
    return kept


def fusion(metrics: DataFrame, links: DataFrame) -> DataFrame:
    """Identities from metrics or traces with their observed fan-in and fan-out and signals."""
    into = links.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("seen_in"))
    out = links.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("seen_out"))
    m = metrics.join(into, "id", "full_outer").join(out, "id", "full_outer").fillna(0, ["calls", "ms", "errors", "seen_in", "seen_out"])
    signals = F.array_compact(F.array(
        F.when(F.col("calls") > 0, F.lit("observed")), F.when(F.col("calls") >= HOT, F.lit("hot")), F.when(F.col("ms") >= SLOW_MS, F.lit("slow")),
        F.when(F.col("errors") >= ERROR_RATE, F.lit("unstable")), F.when(F.col("seen_out") >= FAN_OUT, F.lit("high-fan-out")), F.when(F.col("id").startswith("runtime-unresolved/"), F.lit("unresolved-identity")),
    ))
    return m.select("id", "calls", "ms", "errors", "seen_in", "seen_out", F.array_join(signals, ",").alias("signals"))


def neighbourhood(steps: DataFrame, node: str) -> DataFrame:
    """In traces that touch the node: what comes before the first touch, what touches, what comes after."""
    touch = (F.col("node_id") == node) | F.coalesce(F.col("source") == node, F.lit(False))
    first = steps.where(touch).groupBy("t").agg(F.min("pos").alias("first"))
    phase = F.when(touch, "touching").when(F.col("pos") > F.col("first"), "after").otherwise("before")
    return steps.join(first, "t").withColumn("phase", phase).select("t", "v", "pos", "phase")


def critical_path(steps: DataFrame, coverage: float = 0.7) -> DataFrame:
    """Of each trace the longest steps, until they cover the share of its total time."""
    ms = F.greatest(F.coalesce("ms", F.lit(0.0)), F.lit(0.0))
    rows = steps.withColumn("ms", ms)
    w = W.partitionBy("t").orderBy(F.col("ms").desc(), "v")
    before = F.coalesce(F.sum("ms").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("ms").over(W.partitionBy("t"))
    return rows.withColumn("before", before).withColumn("total", total).where((F.col("before") < coverage * F.col("total")) & (F.col("total") > 0)).select("t", "v", "node_id", F.round("ms", 6).alias("ms"))


def compare_traces(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two step lists aligned by position: where they first differ and how, lengths, spans of time, errors."""
    cols = ["pos", "source", "node_id", "name", "err"]
    side = lambda s, p: s.select(key, F.col("pos").alias("pos"), *[F.col(c).alias(p + c) for c in cols[1:]])
    both = side(left, "a_").join(side(right, "b_"), [key, "pos"], "full_outer")
    same = lambda c: F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    why = (
        F.when(F.col("a_name").isNull(), "missing-left").when(F.col("b_name").isNull(), "missing-right").when(~(same("source") & same("node_id") & same("name")), "different-step").when(~same("err"), "different-error")
    )
    first = both.withColumn("why", why).where("why IS NOT NULL").groupBy(key).agg(F.min(F.struct("pos", "why")).alias("f")).select(key, F.col("f.pos").alias("first_difference"), F.col("f.why").alias("reason"))
    sum_up = lambda s, p: s.groupBy(key).agg(F.count(F.lit(1)).alias(p + "steps"), (F.max("stop") - F.min("start")).alias(p + "nanos"), F.count(F.when(F.col("err"), 1)).alias(p + "errors"))
    return sum_up(left, "left_").join(sum_up(right, "right_"), key, "full_outer").join(first, key, "left")


def service_body(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (trace, source, target, flow, ms, err): services with calls, errors, peers; edges by flow with total ms."""
    ok = calls.where("trim(source) <> '' AND trim(target) <> '' AND trim(trace) <> ''").select(F.trim("trace").alias("trace"), F.trim("source").alias("source"), F.trim("target").alias("target"), "flow", "ms", "err")
    ends = ok.select("err", F.explode(F.array(F.struct(F.col("source").alias("service"), F.col("target").alias("peer")), F.struct(F.col("target").alias("service"), F.col("source").alias("peer")))).alias("e"))
    nodes = ends.groupBy("e.service").agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("err"), 1)).alias("errors"), F.countDistinct("e.peer").alias("peers"))
    links = ok.groupBy("source", "target", "flow").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.greatest("ms", F.lit(0.0))).alias("total_ms"))
    return nodes, links


def line_report(rows: DataFrame) -> DataFrame:
    """Valid line executions (file, line >= 1, hits >= 0, not synthetic, window in order) per file."""
    ok = rows.where("file IS NOT NULL AND trim(file) <> '' AND line >= 1 AND hits >= 0 AND NOT coalesce(synthetic, false) AND (observed_end IS NULL OR observed_start IS NULL OR observed_end >= observed_start)")
    return ok.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("line").alias("lines"), F.sum("hits").alias("hits"))


def valid_infrastructure(rows: DataFrame) -> DataFrame:
    """Infrastructure observations come from eBPF, name a subject, and never prove that source code ran."""
    return rows.where("lower(source) = 'ebpf' AND trim(subject) <> ''").withColumn("proves_source", F.lit(False))
