"""Flows and impacts over facts go further than a few steps: chains of eight entities, reached to their end."""

import pytest

from stratalens.plans import facts

FAR = 7


@pytest.fixture(scope="module")
def chains(spark, tmp_path_factory):
    """From an api, a service and a job chains of calls lead on; to a table, a config, a flag and the service others lead back. The last of each: see `ends`."""
    d = str(tmp_path_factory.mktemp("chains"))
    ends = {"api": "table", "service": "symbol", "job": "symbol", "column": "symbol", "config": "test", "feature_flag": "test"}
    entities, links = [], []
    for kind, end in ends.items():
        ids = [f"{kind}{i}" for i in range(FAR + 1)]
        entities += [(v, kind if i == 0 else end if i == FAR else "file", v, "r2" if i == FAR else "r1", None) for i, v in enumerate(ids)]
        pairs = list(zip(ids, ids[1:]))
        links += pairs if kind in ("api", "service", "job") else [(b, a) for a, b in pairs]
    entities += [(f"caller{i}", "file", "x", "r1", None) for i in range(1, FAR + 1)]
    links += [(f"caller{i + 1}", f"caller{i}") for i in range(1, FAR)] + [("caller1", "service0")]
    spark.createDataFrame(entities, "entity_id string, kind string, name string, repository string, path string").write.parquet(f"{d}/causal_entities.parquet")
    spark.createDataFrame([(f"f{i:03d}", a, b, "calls", "static", 1.0, None, 0) for i, (a, b) in enumerate(links)], "fact_id string, from_id string, to_id string, relation string, evidence string, confidence double, cond string, timestamp_ms long").write.parquet(f"{d}/causal_facts.parquet")
    return d


@pytest.mark.parametrize("name, last", [("data_flow", f"api{FAR}"), ("distributed_flow", f"service{FAR}"), ("reachable_under", f"job{FAR}"), ("cross_repo", f"api{FAR}"), ("schema_impact", f"column{FAR}"), ("failure_propagation", f"caller{FAR}")])
def test_reaches_the_end(spark, chains, name, last):
    got = facts.QUERIES[name](spark, chains)
    assert [r.depth for r in got.where(f"id = '{last}'").collect()] == [FAR]


def test_taint_reaches_the_sink(spark, chains, rows):
    assert rows(facts.taint(spark, chains), "sink", "depth") == [(f"api{FAR}", FAR)]


def test_changes_reach_far_tests(spark, chains, rows):
    assert rows(facts.tests_for_change(spark, chains), "test", "direct") == [(f"config{FAR}", False)]
    got = facts.simulate_change(spark, chains).collect()
    assert sorted(r.part for r in got) == ["code"] * (FAR - 1) + ["other", "tests"]
    assert {r.id: r.lost for r in got if r.depth == 0} == {"feature_flag0": 1} and all(r.lost == 0 for r in got if r.depth)
