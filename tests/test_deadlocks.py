from stratalens.operators import causality


def test_cycles_of_waiting_are_hazards(spark, rows):
    links = [("a", "b", "waits_for"), ("b", "c", "acquires"), ("c", "a", "waits_for"), ("c", "d", "waits_for"), ("x", "t", "writes"), ("y", "t", "writes")]
    facts = spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(links)], "fact_id string, src string, dst string, rel string")
    entities = spark.createDataFrame([("t", "table")], "id string, kind string")
    got = causality.concurrency_hazards(facts, entities, ["table"], ["guards"])
    assert rows(got, "resource", "writers", "kind") == [("a -> b -> c", 0, "potential_deadlock"), ("t", 2, "unprotected_multi_writer")]
    none = causality.concurrency_hazards(facts.where("rel = 'writes'"), entities, ["table"], ["guards"])
    assert rows(none, "resource", "writers") == [("t", 2)]
