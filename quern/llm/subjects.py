"""Subject areas of documents, from clusters of their vectors.

Documents become normalised vectors of their terms, which bisecting k-means (cosine distance) splits into
leaves. A leaf's discriminative terms, those far more frequent in it than elsewhere, are looked up among the
labelled examples and give it a mixture of subjects. A term inherits the mixtures of the leaves it stands
in, weighted by its documents there; rounds over the sentences of all documents sharpen terms and mixtures,
because a sentence is about one thing more often than a document is. A document may have the subjects that
have a part in its leaf's mixture, and has those of them that enough of its sentences are about.

Terms are told by a hash into BUCKETS buckets, so all tables are bounded whatever the corpus; terms that
share a bucket are one. Vectors, clusters, term counts and rounds run over all documents, as sums over
Arrow batches of bucket numbers; every bucket that stands in MIN_DOCUMENTS documents is counted, weighs in
the vectors and may speak for a subject. The labelled examples, bounded by MAX_EXAMPLES, are read on the
driver.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialize

#: Buckets terms are hashed into.
BUCKETS = 1 << 18
#: Features of the vectors: the buckets with the most weight over the corpus have one of their own, all others share the rest.
OWN_FEATURES, SHARED_FEATURES = 3_072, 1_024
#: Documents a term must stand in.
MIN_DOCUMENTS = 3
#: Labelled texts used, in the order of a hash of their ids.
MAX_EXAMPLES = 20_000
#: Leaves of the clustering.
LEAVES = 48
#: Rounds over the sentences.
ROUNDS = 3
#: Sentences that let a term speak for a subject which fewer than two examples have.
KNOWN = 8
#: A term that is this many times as frequent in a subject as elsewhere speaks for it.
TELLING = 2.5
#: Log odds a sentence needs for its subject, and over the next one.
NEEDED, AHEAD = math.log(TELLING), 0.3
#: Sentences with a word that goes along with its document's subjects less often than this are mentions in passing.
IN_PASSING = 0.5
#: Part of a leaf's sentences that a subject needs for the leaf's documents to have it.
LEAST_PART = 0.002

_CODE = re.compile(r"<pre\b.*?</pre\s*>|<code\b.*?</code\s*>|^(```|~~~).*?^\1[^\n]*$|(?:(?<=\n\n)|\A)(?:(?: {4}|\t)[^\n]*(?:\n|\Z)(?:[ \t]*\n(?= {4}|\t))*)+|`[^`\n]+`", re.S | re.M | re.I)
_LINKS = re.compile(r"<a\b[^>]*>.*?</a\s*>|!?\[[^\[\]]*\]\([^()\s]*\)|\b(?:https?://|www\.)\S+|\[(?:dead link|[a-z ]*link)\]", re.S | re.I)
_BREAKS = re.compile(r"</?(?:p|div|br|li|ul|ol|blockquote|h[1-6]|hr|tr|td|table)\b[^>]*>", re.I)
_TAGS = re.compile(r"</?[a-z][^<>]*>", re.I)
_MARKS = re.compile(r"^[ \t]*(?:>+[ \t]?)+", re.M)
_ENDS = re.compile(r"([.!?…])[\"'”’)\]]*\s+|\n\s*\n")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_PLAIN_LETTERS = re.compile(r"[a-z]{2,}")
_UNSEEN = re.compile("[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]")


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as lists of lower-case words, without code, links and markup.

    A stretch without an end mark counts as a sentence if it has four words or more, so that greetings and
    closings do not. Each pattern is tried only on texts that hold a sign of what it looks for.
    """
    if not text:
        return []
    text = text.replace("\r\n", "\n")
    low = text.lower()
    tagged = "<" in text
    if "`" in text or "    " in text or "\t" in text or "~~~" in text or (tagged and ("<pre" in low or "<code" in low)):
        text = _CODE.sub("\n\n", text)
    if "[" in text or "http" in low or "www." in low or (tagged and "<a" in low):
        text = _LINKS.sub(" ", text)
    if tagged:
        text = _TAGS.sub("", _BREAKS.sub("\n\n", text))
    if "&" in text:
        text = html.unescape(text)
    if ">" in text:
        text = _MARKS.sub("", text)
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    pattern = _PLAIN_LETTERS if plain else _LETTERS
    found = []
    pieces = _ENDS.split(text)
    for at in range(0, len(pieces), 2):
        listed = pattern.findall(pieces[at].lower())
        if listed and (len(listed) >= 4 or (at + 1 < len(pieces) and pieces[at + 1]) or pieces[at].rstrip().endswith((".", "!", "?", "…"))):
            found.append(listed)
    return found


def bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(word) % BUCKETS


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter((len(v) for v in values), dtype="int64", count=len(values))
    flat = [x for v in values for x in v]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), pa.array(flat, kind))


def read_sentences(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, ids, lens, names): each row's words as buckets, the numbers of words of its sentences, and "bucket:word"
    of words its task had not met before. Null and empty texts have no sentences. Rows with a null key are left out."""
    kept = [T.StructField("key", df.schema[key].dataType), *(df.schema[c] for c in keep)]
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([*kept, T.StructField("ids", whole), T.StructField("lens", whole), T.StructField("names", T.ArrayType(T.StringType()))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        for batch in batches:
            ids, lens, fresh = [], [], []
            for text in batch.column(len(kept)).to_pylist():
                listed = sentences(text)
                words = [w for s in listed for w in s]
                new = [w for w in dict.fromkeys(words) if w not in number]
                for w in new:
                    number[w] = bucket(w)
                ids.append([number[w] for w in words])
                lens.append([len(s) for s in listed])
                fresh.append([f"{number[w]}:{w}" for w in new])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], _lists(ids, pa.int32()), _lists(lens, pa.int32()), _lists(fresh, pa.string())], names)

    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *keep, F.col(text).alias("t")).mapInArrow(run, schema)


@dataclass
class Part:
    """An Arrow batch of documents: buckets of all words, the sentence of each word, the document of each sentence."""

    ids: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    n_docs: int

    @staticmethod
    def of(batch: pa.RecordBatch) -> Part:
        ids, lens = batch.column("ids"), batch.column("lens")
        per_sentence = lens.flatten().to_numpy(zero_copy_only=False)
        per_document = lens.value_lengths().to_numpy(zero_copy_only=False)
        document = np.repeat(np.arange(batch.num_rows), per_document)
        return Part(ids.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(per_sentence)), per_sentence), document, batch.num_rows)

    @property
    def n_sentences(self) -> int:
        return len(self.document)

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket), each pair once."""
        pair = np.unique(self.document[self.sentence].astype("int64") * BUCKETS + self.ids) if len(self.ids) else np.zeros(0, dtype="int64")
        return pair // BUCKETS, pair % BUCKETS


@dataclass
class Lexicon:
    """What each bucket says about the subjects: log lifts, one column a subject."""

    subjects: list[str]
    #: Row of each bucket in lift, -1 for those that say nothing.
    row: np.ndarray
    lift: np.ndarray
    #: Buckets of words of sentences that mention a subject only in passing.
    passing: np.ndarray

    def subject(self, part: Part, prior: np.ndarray) -> np.ndarray:
        """The subject each sentence speaks of, -1 if of none or of none clearly; prior has a row a document."""
        n, k = part.n_sentences, len(self.subjects)
        total, spoke = np.zeros((n, k)), np.zeros(n, dtype=bool)
        if not n or not k:
            return np.full(n, -1)
        row = self.row[part.ids]
        says = row >= 0
        sentence = part.sentence[says]
        if len(sentence):
            start = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            total[sentence[start]] = np.add.reduceat(self.lift[row[says]], start, axis=0)
            spoke[sentence[start]] = True
        whole = total + prior[part.document]
        each = np.arange(n)
        best = whole.argmax(axis=1)
        first = whole[each, best]
        whole[each, best] = -np.inf
        clear = spoke & (total[each, best] >= NEEDED) & (first - whole.max(axis=1) >= AHEAD)
        return np.where(clear, best, -1)

    def about(self, part: Part, prior: np.ndarray) -> np.ndarray:
        """As subject(), but mentions in passing are about nothing."""
        found = self.subject(part, prior)
        found[part.sentence[self.passing[part.ids]]] = -1
        return found


def make_lexicon(subjects: list[str], terms: np.ndarray, post: np.ndarray, base: np.ndarray) -> Lexicon:
    """Telling terms only: those whose best subject has TELLING times its share."""
    lift = np.clip(np.log(np.maximum(post, 1e-4) / base), -2.0, 3.0)
    telling = np.flatnonzero((post / base).max(axis=1) >= TELLING)
    row = np.full(BUCKETS, -1, dtype="int32")
    row[terms[telling]] = np.arange(len(telling))
    return Lexicon(subjects, row, lift[telling], np.zeros(BUCKETS, dtype=bool))


def read_examples(examples: DataFrame, key: str = "example_id", text: str = "text", subject: str = "subject") -> DataFrame:
    """(key, labels, ids, lens, names): MAX_EXAMPLES labelled texts; subjects are trimmed, in lower case, blank ones no label."""
    label = F.when(F.trim(subject) != "", F.lower(F.trim(subject)))
    once = examples.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(text).alias("t"), F.array_sort(F.collect_set(label)).alias("labels"))
    return read_sentences(once.orderBy(F.xxhash64(key), key).limit(MAX_EXAMPLES), key, "t", ("labels",))


@dataclass
class Model:
    """The fitted clusters: leaves with their mixtures and terms, and the lexicon."""

    lexicon: Lexicon
    #: Subjects of each leaf's sentences, after the rounds.
    mixtures: np.ndarray
    #: What a document's leaf adds to the scores of its sentences.
    priors: np.ndarray
    #: Buckets of each leaf's discriminative terms, the most telling first.
    leaf_terms: list[np.ndarray]
    assigned: DataFrame


#: Stands in every document with next to no weight, so that none has an empty vector.
ANY = "any"


def _example_counts(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """Subjects, and the examples each bucket stands in by subject; an example of two subjects counts half for each."""
    rows = examples.select("labels", "ids").collect()
    subjects = sorted({s for r in rows for s in r.labels})
    column = {s: i for i, s in enumerate(subjects)}
    counts = np.zeros((BUCKETS, len(subjects)))
    for r in rows:
        labels = [column[s] for s in r.labels]
        if labels and r.ids:
            counts[np.ix_(np.unique(r.ids), labels)] += 1 / len(labels)
    return subjects, counts


def _summed(df: DataFrame, tally: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]], rows: int, columns: int) -> np.ndarray:
    """A table of rows x columns, added up over all partitions from (column, rows, numbers); equal cells are combined in the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, at, n in tally(batches):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(np.full(len(at), column, dtype="int32")), pa.array(n.astype("int64"))], ["at", "c", "n"])

    found = df.mapInArrow(run, "at int, c int, n long").groupBy("at", "c").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((rows, columns), dtype="float32" if rows * columns > 4 * BUCKETS else "float64")
    table[found["at"].to_numpy(), found["c"].to_numpy()] = found["n"].to_numpy()
    return table


def _nonzero(column: int, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    return column, at, counts[at]


def _frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Documents each bucket stands in, and the number of all."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts, n = np.zeros(BUCKETS, dtype="int64"), 0
        for batch in batches:
            part = Part.of(batch)
            counts += np.bincount(part.terms()[1], minlength=BUCKETS)
            n += part.n_docs
        yield _nonzero(0, counts)
        yield 1, np.array([0]), np.array([n])

    table = _summed(documents.select("ids", "lens"), tally, BUCKETS, 2)
    return table[:, 0].astype("float64"), int(table[0, 1])


def _weights(n_docs: int, df: np.ndarray, seen: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Weight of each term in a vector: how rare it is, times how far it is from spread over all subjects.

    A term that no example has may still tell subjects apart if it is not common; it gets a little.
    """
    n_seen = seen.sum(axis=1)
    post = (seen + 2.0 * base) / (n_seen[:, None] + 2.0)
    spread = (post * np.log(post / base)).sum(axis=1) / math.log(max(2, len(base)))
    told = np.where(n_seen >= 2, spread, np.where(df < 0.02 * n_docs, 0.15, 0.0))
    return np.log((n_docs + 1.0) / df) * np.maximum(told - 0.02, 0.0)


def _features(terms: np.ndarray, df: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each bucket (-1 for those without weight), and the features' weights: of one's own the term's, of a shared one the mean."""
    order = np.argsort(-(weight * np.sqrt(df)), kind="stable")
    order = order[weight[order] > 0]
    own, rest = order[:OWN_FEATURES], order[OWN_FEATURES:]
    feature = np.full(BUCKETS, -1, dtype="int32")
    feature[terms[own]] = np.arange(len(own))
    shared = terms[rest] % SHARED_FEATURES
    feature[terms[rest]] = len(own) + shared
    total = np.bincount(shared, weights=df[rest], minlength=SHARED_FEATURES)
    mean = np.bincount(shared, weights=df[rest] * weight[rest], minlength=SHARED_FEATURES) / np.maximum(total, 1.0)
    return feature, np.r_[weight[own], mean if len(rest) else np.zeros(0)]


def _cluster(documents: DataFrame, feature: np.ndarray, weights: np.ndarray, leaves: int, seed: int) -> DataFrame:
    """(key, ids, lens, leaf) of every document."""
    # Here and not above: the Python workers read this module too and have no use for them.
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    shipped = documents.sparkSession.sparkContext.broadcast(feature)
    vocabulary = [*(str(i) for i in range(len(weights))), ANY]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(vocabulary)
        for batch in batches:
            part = Part.of(batch)
            document, ids = part.terms()
            at = shipped.value[ids]
            document, at = document[at >= 0], at[at >= 0]
            document, at = np.r_[document, np.arange(part.n_docs)], np.r_[at, np.full(part.n_docs, len(weights))]
            order = np.argsort(document, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(document, minlength=part.n_docs))]
            listed = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), names.take(pa.array(at[order])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "ids", "lens")), listed], ["key", "ids", "lens", "all"])

    source = documents.select("key", "ids", "lens")
    marked = source.mapInArrow(tokens, T.StructType([*source.schema.fields, T.StructField("all", T.ArrayType(T.StringType()))]))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="all", outputCol="counts")
    scale = ElementwiseProduct(scalingVec=Vectors.dense([*weights, 1e-3]), inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    vectors = unit.transform(scale.transform(counts.transform(marked)))
    clusters = BisectingKMeans(k=leaves, distanceMeasure="cosine", maxIter=8, seed=seed, minDivisibleClusterSize=4.0).fit(vectors.select("features"))
    return clusters.transform(vectors).select("key", "ids", "lens", F.col("prediction").alias("leaf"))


def _leaf_counts(assigned: DataFrame, leaves: int) -> np.ndarray:
    """Documents of each leaf that have each bucket."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        counts = np.zeros((leaves, BUCKETS), dtype="int32")
        for batch in batches:
            document, ids = Part.of(batch).terms()
            cell, n = np.unique(batch.column("leaf").to_numpy()[document].astype("int64") * BUCKETS + ids, return_counts=True)
            counts.flat[cell] += n.astype("int32")
        for leaf in range(leaves):
            yield _nonzero(leaf, counts[leaf])

    return _summed(assigned.select("ids", "lens", "leaf"), tally, BUCKETS, leaves)


def _mixtures(per_leaf: np.ndarray, df: np.ndarray, n_docs: int, seen: np.ndarray, base: np.ndarray, top: int = 40) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each leaf's mixture of subjects and its discriminative terms, by what the examples say of those."""
    n_seen = seen.sum(axis=1)
    post = (seen + 1.0 * base) / (n_seen[:, None] + 1.0)
    mixtures, terms = np.tile(base, (per_leaf.shape[1], 1)), []
    for leaf in range(per_leaf.shape[1]):
        n = per_leaf[:, leaf].astype("float64")
        size = max(n.max(initial=0.0), 1.0)
        lift = (n / size + 1e-9) / (df / n_docs)
        gain = np.where((n >= 2) & (lift > 1.5), n * np.log(np.maximum(lift, 1.0)), 0.0)
        best = np.argsort(-gain, kind="stable")[:top]
        best = best[gain[best] > 0]
        terms.append(best)
        known = best[n_seen[best] > 0]
        if len(known):
            mixtures[leaf] = (gain[known, None] * post[known]).sum(axis=0) / gain[known].sum()
    return mixtures, terms


def leaf_prior(mixture: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What a document's leaf adds to the scores of its sentences."""
    return 0.5 * np.log((mixture + 0.05) / (base + 0.05))


def _sentence_round(assigned: DataFrame, lexicon: Lexicon, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets by subject of their sentence over all documents; for each bucket the sentences of a subject it stands
    in, and those whose subject another sentence of the document shares; and the sentences of each leaf by subject."""
    k, leaves = len(lexicon.subjects), len(priors)
    shipped = assigned.sparkSession.sparkContext.broadcast((lexicon, priors))
    width = k + 2

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lexicon, priors = shipped.value
        counts, of_leaf = np.zeros((BUCKETS, width), dtype="int64"), np.zeros((leaves, k), dtype="int64")
        for batch in batches:
            part, leaf = Part.of(batch), batch.column("leaf").to_numpy()
            subject = lexicon.subject(part, priors[leaf])
            said = subject >= 0
            if not said.any():
                continue
            document = part.document[said]
            of_leaf += np.bincount(leaf[document] * k + subject[said], minlength=leaves * k).reshape(leaves, k)
            _, which, times = np.unique(document.astype("int64") * k + subject[said], return_inverse=True, return_counts=True)
            told, agrees = np.zeros(part.n_sentences, dtype=bool), np.zeros(part.n_sentences, dtype=bool)
            told[said] = np.bincount(document, minlength=part.n_docs)[document] >= 2
            agrees[said] = told[said] & (times[which] > 1)
            spoken = said[part.sentence]
            pair = np.unique(part.sentence[spoken].astype("int64") * BUCKETS + part.ids[spoken])
            sentence, at = pair // BUCKETS, pair % BUCKETS * width
            for cells in (at + subject[sentence], at[told[sentence]] + k, at[agrees[sentence]] + k + 1):
                cell, n = np.unique(cells, return_counts=True)
                counts.flat[cell] += n
        for column in range(width):
            yield _nonzero(column, counts[:, column])
        for column in range(k):
            yield _nonzero(width + column, of_leaf[:, column])

    table = _summed(assigned.select("ids", "lens", "leaf"), tally, BUCKETS, width + k).astype("float64")
    shipped.unpersist()
    return table[:, :k], table[:, k:width], table[:leaves, width:]


def fit(documents: DataFrame, examples: DataFrame, *, leaves: int = LEAVES, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Fit the model to sentences of documents (key, ids, lens) and of examples (ids, labels)."""
    frequency, n_docs = _frequencies(documents)
    terms = np.flatnonzero(frequency >= MIN_DOCUMENTS)
    df = frequency[terms]
    subjects, all_seen = _example_counts(examples)
    seen, k = all_seen[terms], len(subjects)
    if not k or not len(terms):
        nothing = make_lexicon(subjects, np.zeros(0, dtype="int64"), np.ones((0, max(1, k))), np.ones(max(1, k)))
        return Model(nothing, np.zeros((1, k)), np.zeros((1, k)), [terms[:0]], documents.select("key", "ids", "lens").withColumn("leaf", F.lit(0)))
    base = (seen.sum(axis=0) + 1.0) / (seen.sum() + k)

    feature, weights = _features(terms, df, _weights(n_docs, df, seen, base))
    assigned = materialize(_cluster(documents, feature, weights, leaves, seed), "leaves")

    per_leaf = _leaf_counts(assigned, leaves)[terms]
    mixtures, best = _mixtures(per_leaf, df, n_docs, seen, base)
    total = per_leaf.sum(axis=1, keepdims=True)
    inherited = per_leaf @ mixtures / np.maximum(total, 1.0)
    weight_leaf = np.minimum(total, 4.0)
    post = (weight_leaf * inherited + seen + base) / (weight_leaf + seen.sum(axis=1, keepdims=True) + 1.0)
    lexicon = make_lexicon(subjects, terms, post, base)

    priors = leaf_prior(mixtures, base)
    stray, passing = np.zeros(len(terms), dtype=bool), np.zeros(BUCKETS, dtype=bool)
    for _ in range(rounds):
        counts, agreement, of_leaf = _sentence_round(assigned, lexicon, priors)
        counts, agreement = counts[terms], agreement[terms]
        spoken = counts.sum(axis=0) + 1.0
        base_now = spoken / spoken.sum()
        n_spoken, n_seen = counts.sum(axis=1), seen.sum(axis=1)
        post = (counts + seen + 2.0 * base_now) / (n_spoken + n_seen + 2.0)[:, None]
        # What goes its own way in the documents it stands in is a manner of speaking, not a subject.
        stray |= (agreement[:, 0] >= 4) & (agreement[:, 1] < IN_PASSING * agreement[:, 0])
        sure = (agreement[:, 0] >= 2) & (agreement[:, 1] >= IN_PASSING * agreement[:, 0])
        usable = sure & ~stray & ((n_seen >= 2) | (n_spoken >= KNOWN))
        lexicon = make_lexicon(subjects, terms, np.where(usable[:, None], post, base_now), base_now)
        often = stray & (agreement[:, 0] >= 20) & (agreement[:, 1] < IN_PASSING * agreement[:, 0])
        passing[terms[often]] = True
        lexicon.passing = passing & (lexicon.row < 0)
        mixtures = (of_leaf + base_now) / (of_leaf.sum(axis=1, keepdims=True) + 1.0)
    return Model(lexicon, mixtures, priors, [terms[b] for b in best], assigned)


def leaf_words(documents: DataFrame, model: Model, most: int = 8) -> list[list[str]]:
    """The words of each leaf's first discriminative terms; of words that share a bucket the one met in the most tasks."""
    wanted = sorted({int(b) for terms in model.leaf_terms for b in terms[:most]})
    named = documents.select(F.explode("names").alias("n")).select(F.substring_index("n", ":", 1).cast("int").alias("b"), F.substring_index("n", ":", -1).alias("word"))
    counted = named.where(F.col("b").isin(wanted)).groupBy("b", "word").agg(F.count(F.lit(1)).alias("n"))
    word = {r.b: r.word for r in counted.groupBy("b").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("word")).collect()}
    return [[word[int(b)] for b in terms[:most]] for terms in model.leaf_terms]


def assign(model: Model) -> DataFrame:
    """(key, subject, n_about, n_sentences): the subjects of each fitted document.

    They are those with a part of LEAST_PART or more in the mixture of the document's leaf that two of its
    sentences are about, or its only one.
    """
    shipped = model.assigned.sparkSession.sparkContext.broadcast((model.lexicon, model.priors, model.mixtures >= LEAST_PART))
    key = model.assigned.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, priors, possible = shipped.value
        k = max(1, len(lexicon.subjects))
        names = pa.array(lexicon.subjects, pa.string())
        for batch in batches:
            part, leaf = Part.of(batch), batch.column("leaf").to_numpy()
            about = lexicon.about(part, priors[leaf])
            cell, n = np.unique(part.document[about >= 0].astype("int64") * k + about[about >= 0], return_counts=True)
            document, subject = cell // k, cell % k
            sentences_of = np.bincount(part.document, minlength=part.n_docs)[document]
            has = ((n >= 2) | (sentences_of == 1)) & possible[leaf[document], subject] if len(cell) else np.zeros(0, dtype=bool)
            columns = [batch.column("key").take(pa.array(document[has])), names.take(pa.array(subject[has])), pa.array(n[has].astype("int32")), pa.array(sentences_of[has].astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "subject", "n_about", "n_sentences"])

    return model.assigned.select("key", "leaf", "ids", "lens").mapInArrow(run, f"key {key}, subject string, n_about int, n_sentences int")


def document_subjects(
    documents: DataFrame, examples: DataFrame, doc_id: str = "doc_id", text: str = "text", *, leaves: int = LEAVES, seed: int = 5
) -> tuple[DataFrame, Model, DataFrame]:
    """(doc_id, subject, n_about, n_sentences), the model, and the sentences it was fitted to.

    A document has a subject if it has a part in its leaf and two of its sentences are about it or its only
    sentence is. Null and empty texts, and such without subject matter, have no row; equal texts get equal
    subjects; very long texts are read to their end. Without documents or labelled examples nothing has a
    subject. Each document is read once; its sentences lie in the shared folder.
    """
    read = materialize(read_sentences(documents, doc_id, text), "sentences")
    model = fit(read, read_examples(examples), leaves=leaves, seed=seed)
    return assign(model).withColumnRenamed("key", doc_id), model, read
