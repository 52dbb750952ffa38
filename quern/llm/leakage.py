"""Passages of held-out test texts inside a corpus, by multi-pattern search with block shifts.

The patterns are all runs of `length` consecutive words of the test texts. A table of blocks of words says
how far the end of the nearest pattern can be: a block that is in no pattern lets the search skip nearly a
whole pattern at once, so most words of most documents are never looked at. Where the shift is zero, the
bucket of the block lists the patterns that end with it, a hash of their first words cuts the bucket down,
and the words themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.reading import words
from quern.session import materialize

#: Consecutive words that make a leak.
LENGTH = 12
#: Words of a block; three rarely meet by chance, which keeps the shifts long.
BLOCK = 3
#: Words of test text searched for in one pass over the documents. More test text is searched in more passes, none is left out.
PASS_WORDS = 20_000_000
#: Words of a document searched as one lane; longer ones are cut into lanes that overlap by a pattern less a word.
LANE = 4096
#: Pairs of a place in a text and a pattern that are compared at once.
PAIRS_AT_ONCE = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Patterns:
    """Test texts as word numbers; a word's number is the order in which it was first seen, from 1."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.items: list[int] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, item: int, text: list[str]) -> None:
        number = self.number
        self.items.append(item)
        self.texts.append(np.array([number.setdefault(w, len(number) + 1) for w in text], dtype="int32"))
        self.size += len(text)


def _blocks(numbers: np.ndarray, block: int) -> np.ndarray:
    """A hash of the `block` words from each place on; equal hashes of other words do no harm, they are compared."""
    places = max(0, len(numbers) - block + 1)
    found = np.zeros(places, dtype="uint64")
    with np.errstate(over="ignore"):
        for i in range(block):
            found = (found ^ numbers[i : i + places].astype("uint64")) * _MIX
            found ^= found >> np.uint64(29)
    return found


def _edges(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the last and the first block of a pattern."""
    with np.errstate(over="ignore"):
        return (last ^ (first >> np.uint64(7))) * _MIX ^ first


class ShiftSearch:
    """Tables for one set of test texts, in flat arrays; built once and shared by all tasks of a process."""

    def __init__(self, patterns: Patterns, length: int = LENGTH, block: int = BLOCK) -> None:
        self.length, self.block, self.number = length, block, patterns.number
        long_enough = [(i, t) for i, t in zip(patterns.items, patterns.texts, strict=True) if len(t) >= length]
        sizes = np.array([len(t) for _, t in long_enough], dtype="int64")
        self.numbers = np.concatenate([t for _, t in long_enough]) if long_enough else np.zeros(0, dtype="int32")
        starts = np.cumsum(sizes) - sizes
        #: Item of each place, by its number in item_ids.
        self.item_ids = np.array([i for i, _ in long_enough], dtype="int64")
        self.first = starts
        hashes = _blocks(self.numbers, block)
        inside = np.arange(len(self.numbers), dtype="int64") - np.repeat(starts, sizes)
        whole = (inside + block <= np.repeat(sizes, sizes))[: len(hashes)]  # blocks that cross from one text into the next are none
        at, inside, hashes = np.flatnonzero(whole).astype("int32"), inside[: len(hashes)][whole], hashes[whole]
        # The nearest pattern that holds a block at this place ends so many words after it.
        shift = np.clip(length - block - inside, 0, length).astype("uint8")
        order = np.argsort(hashes, kind="stable")
        hashes, shift, at, inside = hashes[order], shift[order], at[order], inside[order]
        new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, dtype="int64")
        self.known = hashes[new]
        self.shift = np.minimum.reduceat(shift, new) if len(new) else shift
        # Buckets: the places at which patterns start, in order of a hash of their last and first blocks.
        ends = inside >= length - block
        start = (at[ends] + block - length).astype("int32")
        edges = _edges(hashes[ends], _blocks(self.numbers, block)[start])
        order = np.argsort(edges, kind="stable")
        self.edges, self.pattern_at = edges[order], start[order]

    def steps(self, hashes: np.ndarray) -> np.ndarray:
        """How far the search may move on after each block."""
        skip = self.length - self.block + 1
        if not len(self.known):
            return np.full(len(hashes), skip)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.shift[at].astype("int64"), skip)

    def find(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(place of the text, item) for every text and item that have a pattern in common."""
        get, length, block = self.number.get, self.length, self.block
        lanes, owner, base = [], [], 0
        pieces = []
        for k, text in enumerate(texts):
            if len(text) < length:
                continue
            pieces.append(np.array([get(w, 0) for w in text], dtype="int32"))
            for low in range(0, max(1, len(text) - length + 1), LANE):
                lanes.append((base + low, base + min(len(text), low + LANE + length - 1)))
                owner.append(k)
            base += len(text)
        if not lanes or not len(self.known):
            return []
        numbers = np.concatenate(pieces)
        hashes = _blocks(numbers, block)
        last = np.array([b for _, b in lanes])
        end = np.array([a for a, _ in lanes]) + length
        lane = np.arange(len(lanes))
        hits_lane, hits_end = [], []
        while len(lane):  # all lanes move on together, each by its own shift
            step = self.steps(hashes[end - block])
            hit = step == 0
            if hit.any():
                hits_lane.append(lane[hit])
                hits_end.append(end[hit])
            end = end + np.maximum(step, 1)
            going = end <= last[lane]
            end, lane = end[going], lane[going]
        if not hits_lane:
            return []
        text_of = np.array(owner)[np.concatenate(hits_lane)]
        return self._compare(numbers, hashes, text_of, np.concatenate(hits_end) - length)

    def _compare(self, numbers: np.ndarray, hashes: np.ndarray, text_of: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        edges = _edges(hashes[start + self.length - self.block], hashes[start])
        low_of = np.searchsorted(self.edges, edges, side="left")
        sizes = np.searchsorted(self.edges, edges, side="right") - low_of
        upto = np.cumsum(sizes)
        found: set[tuple[int, int]] = set()
        words_of = np.arange(self.length)
        for low in range(0, int(upto[-1]), PAIRS_AT_ONCE):
            pair = np.arange(low, min(low + PAIRS_AT_ONCE, int(upto[-1])))
            hit = np.searchsorted(upto, pair, side="right")
            pattern = self.pattern_at[low_of[hit] + pair - (upto[hit] - sizes[hit])].astype("int64")
            same = (self.numbers[pattern[:, None] + words_of] == numbers[start[hit][:, None] + words_of]).all(axis=1)
            items = self.item_ids[np.searchsorted(self.first, pattern[same], side="right") - 1]
            found.update(zip(text_of[hit[same]].tolist(), items.tolist(), strict=True))
        return sorted(found)


def _passes(items: DataFrame, item_id: str, text: str, pass_words: int) -> Iterator[Patterns]:
    """Test texts as word numbers, pass by pass; only one pass is held at a time."""
    held = Patterns()
    for row in items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).toLocalIterator():
        listed = words(row[1])
        if held.size and held.size + len(listed) > pass_words:
            yield held
            held = Patterns()
        held.add(row[0], listed)
    yield held


def find_leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    *, length: int = LENGTH, pass_words: int = PASS_WORDS,
) -> DataFrame:
    """(doc_id, item_id): documents that share `length` consecutive words with an item, each pair once.

    Words are compared as `reading.words` gives them. Null and empty texts hold nothing, items of fewer
    words than `length` cannot leak, items with the same text are all reported, documents are searched to
    their end however long they are. Rows with a null id are no documents or items. Only the two columns
    named of each table are read. The tables of one pass are built once, sent as a broadcast bounded by
    pass_words (about 30 bytes a word and the words' own vocabulary) and shared by the tasks of a process;
    the documents are read once a pass and never shuffled before their few hits. If there are several
    passes, each writes its hits into the shared folder and gives its tables back before the next.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])
    source = documents.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    context = documents.sparkSession.sparkContext
    written: list[DataFrame] = []

    def hits_of(patterns: Patterns) -> tuple[DataFrame, object]:
        tables = context.broadcast(ShiftSearch(patterns, length))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            engine = tables.value
            for pdf in batches:
                ids = pdf["d"].tolist()
                pairs = [(ids[k], i) for k, i in engine.find([words(t) for t in pdf["t"].tolist()])]
                yield pd.DataFrame(pairs, columns=["doc_id", "item_id"]).astype("int64")

        return source.mapInPandas(search, schema), tables

    passes = _passes(items, item_id, item_text, pass_words)
    waiting = next(passes)
    for following in passes:
        hits, tables = hits_of(waiting)
        written.append(materialize(hits.distinct(), "leaks"))
        tables.unpersist()
        waiting = following
    result = hits_of(waiting)[0]
    for hits in written:
        result = result.unionByName(hits)
    return result.distinct()
