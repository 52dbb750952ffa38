import html
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import subjects

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "text,count",
    [
        (None, 0),
        ("", 0),
        ("Hi all,\n\nThe cell divides.\n\nCheers", 1),
        ("<p>One here is long. Two here is long!</p>\n<pre><code>x = 1. Not text. At all.</code></pre><p>Three?</p>", 3),
        ("Text one.\n\n    code line one. two.\n    code line three.\n\nText two.", 2),
        ("```\ncode. here.\n```\nText one.", 1),
        ("> quoted line that goes\n> on here.\n\nOwn line.", 2),
        ("See [the page about cells. yes](http://x.invalid/a) now. http://x.invalid/b.c.d", 1),
        ("no mark at the end of this", 1),
        ("so​ft ce­lls.", 1),
    ],
)
def test_sentences(text, count):
    assert len(subjects.sentences(text)) == count


def test_unseen_characters_and_links_do_not_part_words():
    assert subjects.sentences("so​ft ce­lls &amp; [a link](http://cell.invalid).") == [["soft", "cells"]]


def test_very_long_text_is_read_to_its_end():
    assert len(subjects.sentences("One cell here. " * 50_000)) == 50_000


@pytest.fixture(scope="module")
def held_out(spark):
    """Subjects of labelled texts that the model was not told the labels of."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    examples = spark.read.parquet(f"{DATA}/subject_examples.parquet")
    tested = examples.where("example_id % 3 = 0").groupBy("example_id").agg(F.max("text").alias("text"), F.collect_set(F.lower(F.trim("subject"))).alias("labels"))
    both = documents.unionByName(tested.select((-F.col("example_id") - 1).alias("doc_id"), "text")).unionByName(
        spark.createDataFrame([(-10_000, None), (-10_001, ""), (-10_002, "+1"), (None, "The cell is acidic.")], "doc_id long, text string")
    )
    found, model, _ = subjects.document_subjects(both.withColumn("subject", F.lit("x")).withColumn("key", F.lit(1)), examples.where("example_id % 3 <> 0"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got, {-r.example_id - 1: set(r.labels) for r in tested.collect()}, model


def test_held_out_accuracy(held_out):
    got, labels, _ = held_out
    right = sum(len(got.get(d, set()) & labels[d]) for d in labels)
    told, true = sum(len(got.get(d, set())) for d in labels), sum(len(v) for v in labels.values())
    assert right / told > 0.85 and right / true > 0.85


def test_nothing_to_say(held_out):
    got, _, _ = held_out
    assert not {-10_000, -10_001, -10_002, None} & got.keys()


def test_leaves_are_labelled(held_out):
    model = held_out[2]
    assert len(model.leaf_terms) == subjects.LEAVES
    assert sum(float(m.max()) > 0.6 for m in model.mixtures) >= 8


def test_empty_tables(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    examples = spark.createDataFrame([], "example_id long, text string, subject string")
    assert subjects.document_subjects(documents, examples)[0].isEmpty()
    some = spark.createDataFrame([(1, "The cell is acidic. The cell is acidic.")], "doc_id long, text string")
    assert subjects.document_subjects(some, examples)[0].isEmpty()


def test_no_term_of_enough_documents_is_left_out(spark):
    text = " ".join("".join(chr(97 + (i // 26**p) % 26) for p in range(4)) for i in range(20_500)) + "."
    read = subjects.read_sentences(spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string"), "doc_id", "text")
    frequency, n_docs = subjects._frequencies(read)
    words = {w for s in subjects.sentences(text) for w in s}
    assert n_docs == 3 and len(words) == 20_500 and all(frequency[subjects.bucket(w)] == 3 for w in words)
    terms = np.flatnonzero(frequency >= 3)
    feature, weights = subjects._features(terms, frequency[terms], np.ones(len(terms)))
    assert (feature[terms] >= 0).all() and len(weights) == subjects.OWN_FEATURES + subjects.SHARED_FEATURES and (weights > 0).all()


def test_guards_lose_nothing(spark):
    """Each pattern is only tried where its signs stand: the same sentences as with all of them on every text."""
    s = subjects
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect():
        text = (r.text or "").replace("\r\n", "\n")
        text = s._LINKS.sub(" ", s._CODE.sub("\n\n", text))
        text = html.unescape(s._TAGS.sub("", s._BREAKS.sub("\n\n", text)))
        text = unicodedata.normalize("NFKC", s._UNSEEN.sub("", s._MARKS.sub("", text)))
        want = []
        for piece in re.split("(?<=[.!?…])[\"'”’)\\]]*\\s+|\\n\\s*\\n", text):
            listed = s._LETTERS.findall(piece.lower())
            if listed and (len(listed) >= 4 or piece.rstrip().endswith((".", "!", "?", "…"))):
                want.append(listed)
        assert s.sentences(r.text) == want
