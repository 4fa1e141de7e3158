import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalens.llm.packing import fill, pack, superstep_plan


def best_fit(sizes, capacity):
    """Best-fit decreasing, item by item: containers' fill levels."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return sorted(capacity - g for g in gaps)


def filled(plan):
    level = Counter()
    for size, lo, hi, first, each in plan:
        for r in range(hi - lo):
            level[first + r // each] += size
    return sorted(level.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_supersteps_equal_best_fit(sizes):
    plan, opened = superstep_plan(Counter(sizes), 20)
    want = best_fit(sizes, 20)
    assert filled(plan) == want and opened == len(want)
    ranks = {s: sorted(r for z, lo, hi, _, _ in plan if z == s for r in range(lo, hi)) for s in set(sizes)}
    assert all(ranks[s] == list(range(n)) for s, n in Counter(sizes).items())


@pytest.mark.parametrize("n", [0, 1, 400])
def test_pack_places_everything_once(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 0, -3, 16, rng.randrange(1, 40), 16]), "x", i) for i in range(n)] + [(5, 7, "x", 0)] * (3 if n else 0)
    df = spark.createDataFrame(rows, "doc_id long, size int, tokens string, piece int")
    got = pack(df, "doc_id", "size", 16).collect()
    pieces = [p for _, s, _, _ in rows for p in ([16] * ((s or 0) // 16) + [(s or 0) % 16] if (s or 0) > 0 else [0])]
    pieces = [p for p in pieces if p] + [0 for _, s, _, _ in rows if not s or s < 0]
    assert sorted(r.tokens for r in got) == sorted(pieces)
    level = Counter()
    for r in got:
        level[r.container] += r.tokens
    assert sorted(v for v in level.values() if v) == best_fit([p for p in pieces if p], 16)
    by = Counter((r.doc_id, r.piece) for r in got if r.doc_id != 5)
    assert not by or max(by.values()) == 1
    assert fill(pack(df, "doc_id", "size", 16), 16).where("unused < 0").count() == 0


def test_sizeless_items_need_one_container(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, size int")
    assert {r.container for r in pack(df, "doc_id", "size").collect()} == {0}
