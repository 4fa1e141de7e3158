"""Every registered query of the core beside its SQL, on the smallest tables; and the query language end to end."""

import os

import pytest

import compare
from stratalens.plans import aql, catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(compare.norm(v) for v in r) for r in df.select(cols).collect()), key=str)
    if name in catalog.SQL:
        cur = con.execute(catalog.SQL[name])
        have = [c[0] for c in cur.description]
        assert sorted(have) == cols
        want = sorted((tuple(compare.norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
        assert got == want


@pytest.mark.parametrize("text", ["router gateway LIMIT 5", "DNA LIMIT 3", "RUNTIME", "HISTORY"])
def test_language_runs(spark, text):
    assert aql.run(spark, DIR, text).count() > 0


def test_language_on_nodes(spark):
    edge = catalog.QUERIES["edge_dedupe"](spark, DIR).first()
    path = aql.run(spark, DIR, f"PATH {edge.src} -> {edge.dst} DEPTH 2").first()
    assert path.depth == 1 and path.path == f"{edge.src} > {edge.dst}"
    assert aql.run(spark, DIR, f"DEPENDENTS {edge.dst}").where(f"id = '{edge.src}'").count() == 1
    assert aql.run(spark, DIR, f"IMPACT {edge.dst.split('::')[0]}:999").columns == ["repo", "id", "depth", "confidence", "impact_kind"]
    snaps = [r.snapshot_id for r in spark.read.parquet(f"{DIR}/snapshots.parquet").select("snapshot_id").distinct().collect()]
    assert aql.run(spark, DIR, f"DIFF {snaps[0]} -> {snaps[0]}").count() == 0
