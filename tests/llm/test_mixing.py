import math
import random

import numpy as np
import pytest

from quern.llm import mixing

TARGETS = "source_name string, target_share double, max_repeats int, n_tokens long"
DOCS = "doc_id long, text string, source string, source_name string, n_tokens long"


def frames(spark, seed=1, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 12 + [" Big", "BI-G", "mid", "mid", "mid", "small", None, "other"])
        rows.append((i, rng.choice([None, "", "a b c d " * rng.randint(1, 30), "naïve Text! " * rng.randint(1, 9)]), source, "x", 3))
    targets = [("big", 0.5, 1, 0), ("mid", 0.3, 2, 0), ("small", 0.15, 3, 0), ("absent", 0.05, 2, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)


def test_shares_and_caps(spark):
    mix, report = mixing.mix_sources(*frames(spark))
    rows = mix.collect()
    got = {r.source_name: r for r in report.collect()}
    for name, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert got[name].reached_share == pytest.approx(share / 0.95, abs=0.03)
        assert got[name].most_repeats <= got[name].max_repeats
        assert got[name].mixed_records == sum(r.source_name == name for r in rows)
        assert got[name].mixed_tokens == sum(r.n_tokens for r in rows if r.source_name == name)
    assert got["absent"].mixed_records == 0
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert max(got.values(), key=lambda r: r.mixed_tokens / max(1, r.source_tokens * r.max_repeats)).reached_share > 0


def test_same_seed_same_mix(spark):
    docs, targets = frames(spark, n=300)
    key = lambda df: sorted((r.doc_id, r.copy_no) for r in df.collect())
    one, two = mixing.mix_sources(docs, targets)[0], mixing.mix_sources(docs.repartition(7), targets)[0]
    assert key(one) == key(two) != key(mixing.mix_sources(docs, targets, seed=4)[0])


def test_asking_for_more_than_there_is(spark):
    docs, targets = frames(spark, n=300)
    report = {r.source_name: r for r in mixing.mix_sources(docs, targets, total_tokens=10**9)[1].collect()}
    for r in report.values():
        assert r.mixed_tokens == r.source_tokens * r.max_repeats


def test_empty(spark):
    docs, targets = frames(spark)
    mix, report = mixing.mix_sources(docs.limit(0), targets)
    assert mix.isEmpty() and all(r.reached_share == 0 for r in report.collect())
    assert mixing.mix_sources(docs, targets.limit(0))[0].isEmpty()


def test_steps_invert_the_poisson_law():
    rng = np.random.default_rng(0)
    u = rng.random(200_000)
    steps = mixing.poisson_steps(1.7, 6)
    counts = sum((u >= s).astype(int) for s in steps)
    for k in range(5):
        assert (counts == k).mean() == pytest.approx(math.exp(-1.7) * 1.7**k / math.factorial(k), abs=0.005)


def test_tokens_are_whole_texts(spark):
    text = "The quick brown fox <|endoftext|> jumps.\n\n  Zwölf Boxkämpfer! " * 50
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df, "text", ["doc_id"]).collect()}
    code = mixing.encoder(mixing.read_vocabulary(mixing.VOCABULARY))
    assert got == {1: len(code.encode_ordinary(text)), 2: 0, 3: 0}
    assert code.decode(code.encode_ordinary(text)) == text
