"""Operator 10: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment of words.

Which seeds suffice follows from the score. An alignment of an item of L words with m matched words and e edits scores
2m - e, so a share ``least`` of 2L needs m >= least * L and, as every edit parts matched words at most once, at least
(2 * least - 1) * L - 1 pairs of words next to each other in both. Of an item's pairs (single words of an item too
short for that) all but one fewer than these can be left out, the most frequent ones: a copy still has one of the
rest. So no copy is missed, however the edits are spread, and frequent n-grams seed nothing they need not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import text_batches
from letterloom.shared import written

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that one pass holds in memory; a larger benchmark takes several passes over the documents.
ITEM_WORDS = 1_000_000
#: ASCII other than letters and digits separates words; further bytes of UTF-8 belong to them.
_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
#: Characters of scripts that are written without spaces; each is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str) -> list[bytes]:
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


class ItemIndex:
    """Test items as word numbers, where each of their n-grams stands, and how many of them a copy must have."""

    def __init__(self, items: list[tuple[int, str]], least: float):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(item, np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words_of(text)], np.int64)) for item, text in items]
        self.least, self.base = least, len(self.vocabulary) + 1
        self.counts = [np.unique(w, return_counts=True) for _, w in self.items]
        self.single = np.zeros(self.base, bool)
        self.need = np.zeros(len(self.items), np.int64)
        grams, item, place = [np.zeros(0, np.int64)] * 3
        parts = []
        for n, (_, w) in enumerate(self.items):
            pairs = math.ceil((2 * least - 1) * len(w) - 1 - 1e-9)
            if pairs > 0:
                self.need[n], keys = pairs, w[:-1] * self.base + w[1:]
            else:
                self.need[n], keys = max(1, math.ceil(least * len(w) - 1e-9)), self.base**2 + w
                self.single[w] = True
            parts.append((keys, np.full(len(keys), n), np.arange(len(keys))))
        if parts:
            grams, item, place = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(grams, kind="stable")
        self.known, self.first = np.unique(grams[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(order)))
        self.item, self.place = item[order], place[order]

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's word numbers (-1: in no item), and positions and numbers of the n-grams that items have."""
        words = words_of(text)
        w = np.fromiter(map(self.vocabulary.get, words, (-1,) * len(words)), np.int64, len(words))
        at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
        alone = np.flatnonzero(self.single[w])  # -1 is the last one, which no item has
        key = np.concatenate([w[at] * self.base + w[at + 1], self.base**2 + w[alone]])
        at = np.concatenate([at, alone])
        if not len(at) or not len(self.known):
            return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        ok = self.known[number] == key
        return w, at[ok], number[ok]

    def seeds(self, frequency: np.ndarray) -> np.ndarray:
        """Which of the places in items are seeds: all but the most frequent ones that a copy may have alone."""
        gram = np.repeat(np.arange(len(self.known)), self.many)
        order = np.lexsort((gram, frequency[gram], self.item))
        begins = np.searchsorted(self.item[order], np.arange(len(self.items)))
        rank = np.arange(len(order)) - begins[self.item[order]]
        size = np.bincount(self.item, minlength=len(self.items))
        seed = np.zeros(len(order), bool)
        seed[order] = rank < (size - self.need + 1)[self.item[order]]
        return seed


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its score as a share of the item's own, and the passage's words from and to."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        here = np.append(0, np.maximum(0, np.maximum(diagonal, up)))
        start = np.append(0, np.where(here[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:])))
        reach = here + steps  # gaps along the passage: a running maximum of what came before, less the way
        top = np.maximum.accumulate(reach)
        new = np.append(True, reach[1:] > top[:-1])
        source = np.maximum.accumulate(np.where(new, np.arange(n + 1), 0))
        row, origin = top - steps, start[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(origin[end]), end)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _matches(index: ItemIndex, seed: np.ndarray, seeding: np.ndarray, text: str) -> list[tuple]:
    """(item_id, score, first word, end) of every item that the text holds a copy of, the best place of each.

    An item is sought only if one of its seeds and as many of its n-grams as a copy must have are in the text, and a
    place is aligned only if enough of the item's words are there.
    """
    w, at, number = index.hits(text)
    if not seeding[number].any():
        return []
    many = index.many[number]
    row = np.repeat(np.arange(len(number)), many)
    entry = index.first[number][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    item, is_seed = index.item[entry], seed[entry]
    begin = at[row] - index.place[entry]
    found = np.bincount(index.item[np.unique(entry)], minlength=len(index.items))
    candidates = np.unique(item[is_seed])
    out = []
    for n in candidates[found[candidates] >= index.need[candidates]].tolist():
        name, words = index.items[n]
        margin = max(8, math.ceil((2 - 2 * index.least) * len(words)))  # words that a copy may have beyond the item's
        kinds, counts = index.counts[n]
        best = (0.0, 0, 0)
        low = high = None
        for s in [*np.unique(begin[is_seed & (item == n)]).tolist(), None]:
            if low is not None and (s is None or s - margin > high):
                a, b = max(0, low), max(0, high)
                here, times = np.unique(w[a:b], return_counts=True)
                where = np.minimum(np.searchsorted(here, kinds), len(here) - 1) if len(here) else np.zeros(0, np.int64)
                common = int(np.minimum(counts, np.where(here[where] == kinds, times[where], 0)).sum()) if len(here) else 0
                if common >= index.least * len(words) - 1e-9:
                    score, x, y = align(words, w[a:b])
                    best = max(best, (score, a + x, a + y), key=lambda v: (v[0], -v[1]))
                low = None
            if s is not None:
                low, high = (s - margin if low is None else low), s + len(words) + margin
        if best[0] >= index.least:
            out.append((name, *best))
    return out


def _passes(benchmark: DataFrame, item_words: int, least: float) -> Iterator[ItemIndex]:
    """Indexes of at most about ``item_words`` words each over all items with a word; an item is never cut."""
    run, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if n:
            run.append((r["item_id"], r["text"]))
            size += n
        if size >= item_words:
            yield ItemIndex(run, least)
            run, size = [], 0
    if run:
        yield ItemIndex(run, least)


def _prepared(docs: DataFrame, benchmark: DataFrame, least: float, item_words: int):
    """For each pass, a broadcast (index, seed places, seeding n-grams); document frequencies are counted over all documents.

    A pass's index is bounded by ``item_words``; the caller frees it once its rows are written.
    """
    spark = docs.sparkSession
    for index in _passes(benchmark, item_words, least):
        shared = spark.sparkContext.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(shared.value.known), np.int64)
            for batch in batches:
                for _, texts in text_batches(batch.column("text")):
                    for text in texts:
                        n[np.unique(shared.value.hits(text)[2])] += 1
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["gram", "n"])

        found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
        shared.destroy()
        frequency = np.zeros(len(index.known), np.int64)
        frequency[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
        seed = index.seeds(frequency)
        seeding = np.logical_or.reduceat(seed, index.first) if len(index.first) else np.zeros(0, bool)
        yield spark.sparkContext.broadcast((index, seed, seeding))


def find_copies(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): documents with a copy, edited or not, of a test item.

    ``docs`` (doc_id, text) are read whole, ``benchmark`` (item_id, text) too. ``score`` is the best alignment's share
    of a verbatim copy's; ``least`` of it makes a row, at the item's best place, of equal ones the first. A word is a
    run of letters and digits without regard to case; scripts without spaces have a word a character. An item of few
    words is found wherever it stands. Null and empty texts hold nothing, null or wordless items are found
    nowhere; repeated rows count each; without items or documents the result is empty. Items are held in memory
    ``item_words`` words at a time; the rows of all such passes but the last are written to the shared folder.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    out, here, last = docs.sparkSession.createDataFrame([], schema), None, None
    for shared in _prepared(docs, benchmark, least, item_words):
        if last is not None:
            out = out.unionByName(written(here, "copies"))
            last.destroy()

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, at = [], []
                for begin, texts in text_batches(batch.column("text")):
                    for k, text in enumerate(texts):
                        for m in _matches(*shared.value, text):
                            at.append(begin + k)
                            rows.append(m)
                if rows:
                    item, score, first, end = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column("doc_id").take(pa.array(at)), pa.array(item), pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        here, last = docs.select("doc_id", "text").mapInArrow(find, schema), shared
    return out if here is None else out.unionByName(here)


def drop_copies(docs: DataFrame, benchmark: DataFrame, least: float = 0.6, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` (text and any columns) without a copy of a test item (see ``find_copies``); nothing is shuffled.

    Rows with a null or empty text stay, repeated rows go or stay together. What all passes but the last leave is written to the shared folder.
    """
    last = None
    for shared in _prepared(docs, benchmark, least, item_words):
        if last is not None:
            docs = written(docs, "clean")
            last.destroy()

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not _matches(*shared.value, t) for _, texts in text_batches(batch.column("text")) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs, last = docs.mapInArrow(clean, docs.schema), shared
    return docs
