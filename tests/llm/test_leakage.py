import random

import pytest

from stratalens.llm import leakage

ITEM = "An engineer pins 12 tools at revision 340 and observes nine plugins whose hooks fail before the board stamps anything."


def found(spark, texts, items=((1, ITEM),), **kw):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, start int")
    its = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted(tuple(r) for r in leakage.find_leaks(docs, its, **kw).collect())


@pytest.mark.parametrize(
    "text",
    [
        ITEM, f"Before. {ITEM.upper()} After.", "  ".join(ITEM.split()), "\n * ".join(ITEM.split()), ITEM.replace(" ", "\u00a0").replace("fi", "\ufb01"), "**" + ITEM.replace(" ", "** **") + "**",
        ITEM.replace("observes", "<b>observes</b>").replace("12", "\uff11\uff12"), ITEM.replace("engineer", "engi-\n  neer").replace("observes", "obser-\r\n* ves"), ITEM.replace(" ", " , "),
        "x " * 3000 + ITEM + " y" * 3000, " ".join(ITEM.split()[3:13]), ITEM.replace("engineer", "en\u00adgineer"), ITEM.replace(" tools ", " &#116;ools "),
    ],
)
def test_layouts_that_leak(spark, text):
    assert found(spark, [text]) == [(0, 1)]


def test_what_does_not(spark):
    w = ITEM.split()
    texts = [None, "", " ", " ".join(w[:9]), " ".join(x for i in range(0, len(w), 3) for x in [*w[i : i + 3], "odd", "words"]), " ".join(w[::-1]), "".join(w)]
    assert found(spark, texts) == []


def test_offsets_lie_in_the_original(spark):
    text = "Caf\u00e9 \ufb01rst: <i>" + ITEM.replace("revision", "revi-\n sion") + "</i> tail"
    (got,) = found(spark, [text], spans=True)
    assert text[got[2] : got[3]] == ITEM.replace("revision", "revi-\n sion").rstrip(".") and got[4] == len(ITEM.split())


def test_blocks_short_items_repeats_and_nulls(spark):
    items = [(1, ITEM), (1, ITEM), (2, "too short an item"), (3, None), (None, ITEM), (4, "one " * 12)]
    texts = [ITEM, ITEM + " one" * 10, "one " * 9]
    want = [(0, 1), (1, 1), (1, 4)]
    assert found(spark, texts, items) == want and found(spark, texts, items, block_chars=50) == want
    assert found(spark, texts, []) == [] and found(spark, [], items) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(2, 9)))) for i in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(15)]
    runs = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    want = sorted((d, i) for d, t in enumerate(texts) for i, x in items if runs(t) & runs(x))
    assert found(spark, texts, items, words=4) == want
