import math

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm import sketches as s

ERROR = 0.01


def quantile(values, q):
    return sorted(values)[math.floor(q * (len(values) - 1))]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64).filter(lambda x: x == 0 or abs(x) > 1e-300), min_size=1, max_size=40))
def test_relative_error_and_merge(spark, values):
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "part int, x double")
    days = s.sketch(df, ["part"], "x", ERROR)
    qs = {"lo": 0.0, "mid": 0.5, "hi": 1.0}
    got = s.percentiles(s.merge(days, []), [], qs, ERROR).first()
    assert got.n == len(values)
    for name, q in qs.items():
        want = quantile(values, q)
        assert abs(got[name] - want) <= ERROR * abs(want) * (1 + 1e-9) or math.isinf(got[name]) and abs(want) > 1e308


def test_what_counts(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 0.0), ("b", -0.0), ("b", 1e-310), ("c", float("inf")), ("c", float("-inf")), (None, 4.0), ("d", -8.0)], "g string, x double")
    got = s.percentiles(s.sketch(df, ["g"], "x", ERROR), ["g"], {"bucket": 0.0, "top": 1.0}, ERROR)
    have = {r.g: (r.n, r.bucket, r.top) for r in got.collect()}
    assert set(have) == {"b", "c", "d", None} and have["b"] == (3, 0.0, 0.0) and have["c"] == (2, float("-inf"), float("inf"))
    assert abs(have["d"][1] + 8) < 0.08 and abs(have[None][1] - 4) < 0.04


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert s.percentiles(s.sketch(df, ["g"], "x", ERROR), ["g"], {"p50": 0.5}, ERROR).count() == 0


def test_sum_of_parts_is_the_whole(spark, rows):
    df = spark.range(5000).selectExpr("id % 7 AS g", "id % 5 AS day", "pow(1.003, id) - 20 AS x")
    whole = s.sketch(df, ["g"], "x", ERROR)
    assert rows(s.merge(s.sketch(df, ["g", "day"], "x", ERROR), ["g"])) == rows(whole)
