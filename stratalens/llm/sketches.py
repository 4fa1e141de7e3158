"""Percentiles with a guaranteed relative error from counts in signed logarithmic buckets.

A value x > 0 falls in bucket ceil(log_g x) with g = (1 + a) / (1 - a); the bucket's answer 2 g^k / (g + 1) is within
a * x of every value in it. Negative values mirror that, zero has a bucket of its own. A sketch is just rows
(group, bucket, n), so sketches of partitions, days or clusters combine by adding n.

Defined results: nulls and NaN don't count; values closer to zero than 2.3e-308 count as zero; infinities keep a
bucket of their own and come back as infinities; a percentile q of n values is the value of rank floor(q (n - 1)),
counted from 0; a group without values has no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shifts bucket numbers so that those of positive values are positive; logs of doubles stay far below it.
SHIFT = 1 << 22
TINY = 2.3e-308


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float) -> Column:
    """Signed bucket number; it grows with the value. Null for null and NaN."""
    size = F.abs(value)
    k = F.when(size == float("inf"), F.lit(SHIFT - 1)).otherwise(F.ceil(F.log(size) / F.lit(math.log(gamma(error))))) + SHIFT
    signed = F.when(size < TINY, F.lit(0)).when(value > 0, k).otherwise(-k)
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).otherwise(signed).cast("long")


def value_of(bucket: Column, error: float) -> Column:
    g = gamma(error)
    k = F.abs(bucket) - SHIFT
    size = F.when(k >= SHIFT - 1, F.lit(float("inf"))).otherwise(F.lit(2.0) * F.pow(F.lit(g), k) / F.lit(g + 1))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def sketch(df: DataFrame, group: list[str], value: str, error: float) -> DataFrame:
    """(group..., bucket, n). Counting combines on the map side, so a hot group costs no more than its buckets."""
    return df.withColumn("bucket", bucket_of(F.col(value).cast("double"), error)).where("bucket IS NOT NULL").groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Add sketches up to a coarser group."""
    return sketches.groupBy(*group, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, group: list[str], qs: dict[str, float], error: float) -> DataFrame:
    """(group..., n, one column for each q). A group's window has at most its buckets, a few thousand rows."""
    w = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sketches.withColumn("__cum", F.sum("n").over(w)).withColumn("__all", F.sum("n").over(W.partitionBy(*group)))
    hit = [F.min(F.when(F.col("__cum") > F.floor(F.lit(q) * (F.col("__all") - 1)), F.col("bucket"))).alias(name) for name, q in qs.items()]
    out = run.groupBy(*group).agg(F.max("__all").alias("n"), *hit)
    return out.select(*group, "n", *[value_of(F.col(name), error).alias(name) for name in qs])
