import random

import pytest

from quern.llm.leakage import Patterns, ShiftSearch, find_leaks
from quern.llm.reading import words

ITEM = "One two three four five six seven eight nine ten eleven twelve 67th coefficient fine."


def frames(spark, texts, items):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, item_id long")
    return docs, spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, doc_id string")


def leaks(spark, texts, items, **options):
    return sorted(map(tuple, find_leaks(*frames(spark, texts, items), **options).collect()))


@pytest.mark.parametrize(
    "text",
    [
        "x " + ITEM,
        ITEM.upper() + "\ny",
        "> one two\n> three four five six seven\n> eight nine ten eleven\n> twelve",
        "<p>one <b>two</b> three<br>four five <a href='http://x.invalid/a b'>six</a> seven&nbsp;eight nine ten eleven twelve</p>",
        "one **two** three [four](http://x.invalid) five six seven eight nine ten eleven _twelve_ end",
        "two three four five six seven eight nine ten eleven twelve ６７ｔｈ coeﬃcient",
        "o​ne two th­ree four fi⁠ve six seven eight nine ten eleven twelve",
        "// one two three\n//   four five six\n// seven eight nine ten eleven twelve\ncode()",
        "one-two, three (four) five: six … seven “eight” nine ten eleven/twelve",
    ],
)
def test_seen_by_a_reader(spark, text):
    assert leaks(spark, [text], [(5, ITEM)]) == [(0, 5)]


@pytest.mark.parametrize(
    "text",
    [
        "one two three four five six seven eight nine ten eleven",  # eleven words
        "one two three four five six nope seven eight nine ten eleven twelve",
        "twelve eleven ten nine eight seven six five four three two one",
        "one two three four five six seven eightnine ten eleven twelve",
        "", None, "   ", "​",
    ],
)
def test_not_a_leak(spark, text):
    assert leaks(spark, [text], [(5, ITEM), (6, "too short an item"), (7, None), (8, "")]) == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(20)]
    texts = [" ".join(word() for _ in range(rng.choice([0, 4, 12, 200]))) for _ in range(60)]
    texts += [f"{texts[5]} {items[k][1]} {texts[6]}" for k in range(20)]
    for length in (5, 12):
        grams = lambda t: {tuple(w[i : i + length]) for w in [words(t)] for i in range(len(w) - length + 1)}
        want = sorted((d, i) for d, t in enumerate(texts) for i, x in items if grams(t) & grams(x))
        assert leaks(spark, texts, items, length=length) == want
        assert leaks(spark, texts, items, length=length, pass_words=50) == want  # several passes lose nothing


def test_empty_tables_and_repeats(spark):
    assert leaks(spark, [ITEM, ITEM], []) == []
    assert leaks(spark, [ITEM, ITEM], [(1, ITEM), (2, ITEM)]) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def engine(*items):
    patterns = Patterns()
    for item, text in items:
        patterns.add(item, words(text))
    return ShiftSearch(patterns)


def test_very_long_text():
    search = engine((1, ITEM))
    for before in (0, 1, 4084, 4085, 4090, 4096, 300_000):
        assert search.find([["filler"] * before + words(ITEM) + ["filler"] * 5_000, words(ITEM)]) == [(0, 1), (1, 1)]


def test_many_items_with_one_stretch():
    search = engine(*((i, f"start{i} " + ITEM) for i in range(3000)))
    assert search.find([words(ITEM)] * 500) == [(k, i) for k in range(500) for i in range(3000)]
