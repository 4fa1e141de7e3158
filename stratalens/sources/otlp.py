"""OTLP JSON documents to spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VALUE = T.StructType([T.StructField(n, T.StringType()) for n in ("stringValue", "intValue", "doubleValue", "boolValue")])
_PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", _VALUE)])
_NAMES = ["traceId", "trace_id", "spanId", "span_id", "parentSpanId", "parent_span_id", "name", "startTimeUnixNano", "start_time_unix_nano", "endTimeUnixNano", "end_time_unix_nano"]
_SPAN = T.StructType(
    [T.StructField(n, T.StringType()) for n in _NAMES]
    + [T.StructField("attributes", T.StringType()), T.StructField("status", T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())]))]
)
_SCOPES = T.ArrayType(T.StructType([T.StructField("spans", T.ArrayType(_SPAN))]))
_DOC = T.StructType([
    T.StructField("resourceSpans", T.ArrayType(T.StructType([T.StructField("scopeSpans", _SCOPES), T.StructField("instrumentationLibrarySpans", _SCOPES)]))), T.StructField("spans", T.ArrayType(_SPAN))
])


def decode_attributes(text: Column) -> Column:
    """A JSON object of scalars, or a list of key and typed value, as map of strings. Other values are left out."""
    pairs = F.from_json(text, T.ArrayType(_PAIR))
    listed = F.map_from_entries(F.filter(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.coalesce(*[p["value"][f.name] for f in _VALUE.fields]).alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull()))
    return F.when(F.ltrim(text).startswith("["), listed).otherwise(F.map_filter(F.from_json(text, T.MapType(T.StringType(), T.StringType())), lambda k, v: v.isNotNull()))


def spans_of(documents: DataFrame, column: str = "value") -> DataFrame:
    """Spans of JSON texts: documents of resources and scopes (either name), documents with bare spans, or arrays of spans."""
    doc = F.from_json(column, _DOC)
    scoped = F.flatten(F.transform(F.coalesce(doc["resourceSpans"], F.array()), lambda r: F.concat(F.coalesce(r["scopeSpans"], F.array().cast(_SCOPES)), F.coalesce(r["instrumentationLibrarySpans"], F.array().cast(_SCOPES)))))
    nested = F.flatten(F.transform(scoped, lambda s: F.coalesce(s["spans"], F.array().cast(T.ArrayType(_SPAN)))))
    bare = F.coalesce(doc["spans"], F.array().cast(T.ArrayType(_SPAN)))
    every = F.when(F.ltrim(F.col(column)).startswith("["), F.from_json(column, T.ArrayType(_SPAN))).otherwise(F.concat(nested, bare))
    s = documents.select(F.explode(every).alias("s")).where("s.name IS NOT NULL")  # a span has a name
    pick = lambda a, b: F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}"))
    nano = lambda a, b: F.expr(f"try_cast(coalesce(s.{a}, s.{b}) AS bigint)")
    return s.select(
        pick("traceId", "trace_id").alias("trace_id"), pick("spanId", "span_id").alias("span_id"), pick("parentSpanId", "parent_span_id").alias("parent_span_id"), F.col("s.name").alias("name"),
        nano("startTimeUnixNano", "start_time_unix_nano").alias("start_unix_nano"), nano("endTimeUnixNano", "end_time_unix_nano").alias("end_unix_nano"),
        F.col("s.status.code").alias("code"), decode_attributes(F.col("s.attributes")).alias("attributes"),
    )


def observed(spans: DataFrame) -> DataFrame:
    """Raw spans with identity, duration in ms (never negative) and error flag."""
    from stratalens.operators.telemetry import identity, is_error

    ms = F.greatest(F.col("end_unix_nano") - F.col("start_unix_nano"), F.lit(0)) / 1e6
    return spans.withColumns({"node_id": identity(F.coalesce("attributes", F.create_map().cast("map<string,string>")), F.col("name")), "duration_ms": ms, "is_error": F.coalesce(is_error(F.col("code")), F.lit(False))})


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Files of one document to a line; with `whole`, of one document each, which must fit one string."""
    return spans_of(spark.read.text(path, wholetext=whole).where("trim(value) <> ''"))
