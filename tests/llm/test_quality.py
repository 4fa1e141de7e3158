import random

import numpy as np
import pytest

from stratalens.llm import quality

WORDS = "the of and to in is that it was for on are as with they at be this have from or by not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my over did down only way find use may water long little very after words called just where most know".split()
NOUNS = "harbor mill ledger canal prism meadow lantern orchard parcel compass".split()


A = ["Many people would like to see how", "There are some who say that", "It has been a long time since", "We were told by the other two that", "Most of them know why", "No one can find out when", "You may call it a day after", "Their first use came up just as"]
B = ["the {} was moved over to the {}", "each {} is kept in its own {}", "a {} has more to do than any {}", "this {} will not go down with that {}", "our {} had been used for the {} then", "one very little {} could make way for another {}"]
C = ["and that is all we know about it.", "but these were never there.", "so they have to look at it now.", "or her part of the water is gone.", "while his words did not help.", "which is what you would find here.", "because how it looks is up to them.", "even if it was only two days long."]


def sentence(rng):
    return " ".join(rng.choice(x).format(rng.choice(NOUNS), rng.choice(NOUNS)) for x in (A, B, C))


def prose(rng, n=6):
    return " ".join(sentence(rng) for _ in range(n))


def junk(rng, kind):
    n = rng.choice(NOUNS)
    return {
        "table": "\n".join(f"| {rng.choice(NOUNS)} | {rng.randrange(999)} | {n} |" for _ in range(15)), "log": "\n".join(f"2031-04-{i:02d} 10:00:0{i % 9} INFO {n} took={i * 7}" for i in range(10, 25)),
        "code": "def f(x):\n    if not x:\n        return None\n    y = sum(i.w for i in x)\n    return y[0] + g(x, 3)\n" * 4, "salad": " ".join(rng.choice(WORDS) for _ in range(90)),
        "loop": f"and then the {n} is the {n} that is " * 20, "symbols": "".join(rng.choice("#$%^&*<>|=~_-") for _ in range(400)), "list": "\n".join(f"{i}. {rng.choice(NOUNS)} {n}" for i in range(1, 25)),
    }[kind]


KINDS = ["table", "log", "code", "salad", "loop", "symbols", "list"]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, 3 + i % 6)) for i in range(300)]
    docs += [(1000 + i, junk(rng, KINDS[(1000 + i) % 7])) for i in range(42)]
    docs += [(2000 + i, prose(rng, 2) + "\n\n" + junk(rng, KINDS[i % 3]) * 2) for i in range(9)] + [(3000 + i, prose(rng, 14) + "\n" + junk(rng, "table")[:200]) for i in range(9)]
    wrapped = prose(rng, 8).split()
    docs += [(4000, "\n".join(" ".join(wrapped[i : i + 9]) for i in range(0, len(wrapped), 9))), (4001, prose(rng).upper()), (4002, prose(rng).replace(" ", "\u00a0")), (4003, prose(rng, 4000))]
    docs += [(5000, None), (5001, ""), (5002, " \r\n "), (1, prose(rng))]
    df = spark.createDataFrame([(*d, "xx", 0.0) for d in docs], "doc_id long, text string, language string, distance double")
    words = spark.createDataFrame([("en", w) for w in WORDS] + [("de", w) for w in ("der", "die", "und")] + [("en", None)], "lang string, word string")
    return {r.doc_id: r for r in quality.quality(df, words).collect()}


def test_prose_and_junk_part(judged):
    wrong = {(i, judged[i].outside_share, max(judged[i].contributions.items(), key=lambda x: x[1])) for i in [*range(300), *range(3000, 3009), *range(4000, 4004)] if judged[i].outside_share >= 0.5}
    assert not wrong
    missed = {(i, KINDS[i % 7] if i < 2000 else KINDS[(i - 2000) % 3], round(judged[i].distance, 1)) for i in [*range(1000, 1042), *range(2000, 2009)] if judged[i].outside_share <= 0.5}
    assert not missed


def test_contributions_add_up(judged):
    for r in judged.values():
        assert set(r.contributions) == set(quality.NAMES) and abs(max(0, sum(r.contributions.values())) - r.distance**2) < 1e-6 * (1 + r.distance**2)


def test_blank_texts_have_no_row(judged):
    assert not judged.keys() & {5000, 5001, 5002}


def test_empty_and_tiny_tables(spark):
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.quality(none, words).count() == 0
    one = spark.createDataFrame([("a", "Just one short text."), ("b", "#")], "doc_id string, text string")
    assert {r.doc_id for r in quality.quality(one, words).collect()} == {"a", "b"}
    assert quality.quality(one, words.limit(0)).count() == 2


def test_pairs_of_words_within_segments():
    tokens = quality.Tokens({"en": frozenset(["of", "the"])})
    numbers = tokens.of("Of the, (of a/b the) the".split())[:, 1]
    at, pair, first = quality.word_pairs(numbers, np.array([0]))
    assert numbers[0] == numbers[2] and numbers[3] == 0 and list(at) == [0, 1, 4] and pair[0] != pair[1] and first[1] == first[2]
    assert list(quality.word_pairs(numbers, np.array([0, 1, 1]))[0]) == [1, 4]
    assert len(quality.word_pairs(numbers[:0], np.array([], int))[0]) == len(quality.word_pairs(numbers[:1], np.array([0]))[0]) == 0
    assert abs(quality.chi_squared(0.995, 12) - 28.2995) < 0.1


def test_pairs_never_seen_stay_near_zero_in_full_tables():
    """With eight times as many pairs as cells, what was never seen still counts next to nothing, and a frequent pair keeps its count."""
    rng = np.random.default_rng(1)
    size = 1 << 12
    hashes = quality.mixed(np.arange(1, 8 * size + 1, dtype=np.uint64))
    counts = rng.integers(1, 4, len(hashes))
    counts[0] = 5000
    rows = quality.expected([np.bincount(cells, counts, size) for cells in quality.buckets(hashes, size)])
    of = lambda h: np.minimum(*[row[c] for row, c in zip(rows, quality.buckets(h, size))])
    unseen = of(quality.mixed(np.arange(10**6, 10**6 + 2000, dtype=np.uint64)))
    assert np.median(np.maximum(unseen, 0)) == 0 and np.quantile(unseen, 0.9) < 10 and abs(of(hashes[:1])[0] - 5000) < 50


def test_short_segments_are_joined():
    short, long = (9, ["Home page"]), (50, ["x" * 50])
    assert quality.joined([short, short, long]) == [(18, ["Home page", "Home page"]), long]
    assert quality.joined([short, long, short]) == [(68, long[1])] and quality.joined([short]) == [short] and quality.joined([]) == []
    assert sum(n for n, _ in quality.joined([short, long, short, short, long, short])) == 136


def test_lists_in_short_blocks_weigh_in(spark):
    """A menu of short blocks isn't outvoted by one sentence of forty characters."""
    rng = random.Random(8)
    docs = [(i, prose(rng, 4)) for i in range(200)] + [(900, "\n\n".join(f"{n} > {m} | {i}" for i, (n, m) in enumerate(zip(NOUNS * 3, WORDS))) + "\n\nThis is what we know about it now, as they say.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    assert {r.doc_id for r in quality.quality(df, words).where("outside_share > 0.5").collect()} == {900}


def test_covariance_outweighs_its_floor(spark):
    """Where prose varies, its own variance is the larger part of what deviations are measured by."""
    rng = random.Random(3)
    df = spark.createDataFrame([(i, prose(rng, 2 + i % 5) if i % 9 else junk(rng, "table")) for i in range(400)], "doc_id long, text string")
    words = spark.createDataFrame([("en", w) for w in WORDS], "lang string, word string")
    fits = {}
    real = quality.fit_prose
    quality.fit_prose = lambda *a: fits.update(real(*a)) or fits
    try:
        quality.quality(df, words).count()
    finally:
        quality.fit_prose = real
    variance = np.diag(np.linalg.inv(fits["en"][1])) - quality.FLOOR**2
    for name in ("common_words", "sentence_length", "word_count"):
        assert variance[quality.NAMES.index(name)] > quality.FLOOR[quality.NAMES.index(name)] ** 2
    assert {"word_count", "punctuated_lines", "word_length", "symbols", "common_words"} <= set(quality.NAMES)
