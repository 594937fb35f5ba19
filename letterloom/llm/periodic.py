"""Operator 13: periodic runs of words, found online by dyadic catchers of squares.

Words are appended to a stream. Each completed block of B = 2^k words sets a catcher, which watches for its block
to appear again B to 2B - 1 words later (the smallest blocks, of 8 words, 1 to 15): then a square with that period
may stand there. What comes back is compared word by word to both sides, as far as it goes and as words are
appended, and the squares of one period that overlap merge into one run. A stretch with period q and at least
max(24, 3q) words holds an aligned block of each catcher's size with its copy q words on, so no run is missed.

A block and the windows behind it are compared by 64-bit values that are put together from those of half the
length; equal blocks have equal values, and whatever meets is compared by its words, so results are exact. All
catchers of a size advance over the appended words in one array operation, n words a level, log n levels.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from letterloom.llm.common import group_bounds, text_batches

LEAST, POWER = 24, 3
#: Words of the smallest blocks, as a power of two. Matches of short runs cover 16 words, so a block of 8 with its copy.
FIRST = 3
#: Words appended to a stream at a time, at least, and texts' characters in a stream.
CHUNK, STREAM = 32_768, 2_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A value of two values in order."""
    v = (a * _MULTIPLY) ^ (b + (a >> np.uint64(29)))
    v = v * _TURN
    return v ^ (v >> np.uint64(32))


class SquareCatchers:
    """Stretches of a stream of word numbers that keep a period, found while words are appended.

    ``append`` takes words, ``finish`` returns (start, length, period) of all runs. Negative numbers stand once each:
    they equal nothing and so separate texts, none of which has more than ``longest`` words.
    """

    def __init__(self, longest: int) -> None:
        self.words = np.zeros(0, np.int64)
        sizes = max(1, longest // POWER).bit_length()  # the largest block isn't longer than the longest period
        #: per block size, the values of the windows known from ``at`` on, and the first block still watching
        self.levels = [{"at": 0, "values": np.zeros(0, np.uint64), "block": 0} for _ in range(max(sizes, FIRST + 1))]
        self.found: list[list[int]] = []  #: (start, end, period) of stretches that may be runs, or grow to be
        self.last: dict[int, list[int]] = {}  #: the last stretch of each period that was looked at

    def append(self, words: np.ndarray) -> None:
        before = len(self.words)
        self.words = np.concatenate([self.words, words])
        for stretch in self.found:
            if stretch[1] == before:  # it reached the last word
                stretch[1] = self._right(before, stretch[2])
        self.found = [s for s in self.found if self._may_count(s)]
        own = words.astype(np.uint64)
        values = _joined(own, own)
        for k, level in enumerate(self.levels):
            # values: those of the windows of 2^k words that the new words complete
            level["values"] = np.concatenate([level["values"], values])
            if k >= FIRST:
                self._advance(k)
            size, known = 1 << k, level["at"] + len(level["values"])
            keep = level["block"] << k if k >= FIRST else known
            if k + 1 < len(self.levels):
                above = self.levels[k + 1]
                high = above["at"] + len(above["values"])
                more = max(0, known - size - high)  # windows of twice the size that can be put together now
                near = high - level["at"]
                values = _joined(level["values"][near : near + more], level["values"][near + size : near + size + more])
                keep = min(keep, high + more)
            drop = max(0, keep - level["at"])
            level["values"], level["at"] = level["values"][drop:], level["at"] + drop

    def finish(self) -> list[tuple[int, int, int]]:
        """Runs by start, then period."""
        if len(self.words):  # the last catchers wait for words: let them see words that equal nothing
            least = min(0, int(self.words.min()))
            self.append(np.arange(least - 1, least - 1 - (3 << len(self.levels)), -1, dtype=np.int64))
        best: dict[tuple[int, int], int] = {}
        for start, end, q in self.found:
            if end - start >= max(LEAST, POWER * q):
                best[start, end] = min(q, best.get((start, end), q))
        return sorted((start, end - start, q) for (start, end), q in best.items())

    def _may_count(self, stretch: list[int]) -> bool:
        start, end, q = stretch
        return end == len(self.words) or end - start >= max(LEAST, POWER * q)

    def _advance(self, k: int) -> None:
        """Catchers of blocks of 2^k words whose whole watch is known see it, all at once."""
        level, size = self.levels[k], 1 << k
        first, v = level["block"], level["values"]
        blocks = (level["at"] + len(v)) // size - 1 - first  # block m watches the windows below (m + 2) * size
        if blocks <= 0:
            return
        level["block"] = first + blocks
        near = (first << k) - level["at"]
        own = v[near : near + blocks * size : size]
        if k > FIRST:
            later = v[near + size : near + size + blocks * size].reshape(blocks, size)
            block, shift = np.nonzero(later == own[:, None])
            self._caught((first + block) << k, shift + size, size)
            return
        for p in range(1, 2 * size):  # small periods first: their multiples are no periods of their own
            block = np.flatnonzero(v[near + p : near + p + (blocks - 1) * size + 1 : size] == own)
            self._caught((first + block) << k, np.full(len(block), p), size)

    def _caught(self, begin: np.ndarray, period: np.ndarray, size: int) -> None:
        """Blocks at ``begin`` that came back ``period`` words later."""
        begin, period = self._uncovered(begin, period, size)
        order = np.lexsort([begin, period])
        begin, period = begin[order], period[order]
        bounds = group_bounds(period).tolist()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            q, at = int(period[low]), low
            while at < high:
                b = int(begin[at])
                stretch = self.last.get(q)
                if stretch is None or b + size + q > stretch[1]:
                    stretch = self.last[q] = [self._left(b, q), self._right(b + size + q, q), q]
                    if self._may_count(stretch):
                        self.found.append(stretch)
                at += max(1, int(np.searchsorted(begin[at:high], stretch[1] - size - q, side="right")))

    def _uncovered(self, begin: np.ndarray, period: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Without what lies in a stretch of a smaller period that a block holds whole: its period is a multiple of that one."""
        least = min(size + 1, int(period.min(initial=size + 1)))
        known = sorted(s[:2] for s in self.found if s[2] < least) if len(begin) else []
        if not known:
            return begin, period
        spans = np.array(known)
        ends = np.maximum.accumulate(spans[:, 1])
        at = np.searchsorted(spans[:, 0], begin, side="right") - 1
        inside = (at >= 0) & (ends[np.maximum(at, 0)] >= begin + period + size)
        return begin[~inside], period[~inside]

    def _left(self, b: int, q: int) -> int:
        """Where the stretch that keeps period ``q`` around word b begins."""
        step = 32
        while b > 0:
            low = max(0, b - step)
            differs = np.flatnonzero(self.words[low:b] != self.words[low + q : b + q])
            if len(differs):
                return low + int(differs[-1]) + 1
            b, step = low, 2 * step
        return 0

    def _right(self, e: int, q: int) -> int:
        """Where the stretch that keeps period ``q`` before word e ends (exclusive)."""
        step, n = 32, len(self.words)
        while e < n:
            high = min(n, e + step)
            differs = np.flatnonzero(self.words[e:high] != self.words[e - q : high - q])
            if len(differs):
                return e + int(differs[0])
            e, step = high, 2 * step
        return n


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words: all lists go through one stream, apart by words of their own."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    catchers, pieces, held, starts, at = SquareCatchers(max(map(len, texts), default=0)), [], 0, [], 0
    for mark, words in enumerate(texts):
        starts.append(at)
        pieces.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        pieces.append(np.array([-1 - mark], np.int64))
        held += len(words) + 1
        at += len(words) + 1
        if held >= CHUNK:
            catchers.append(np.concatenate(pieces))
            pieces, held = [], 0
    if pieces:
        catchers.append(np.concatenate(pieces))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = np.array(starts, np.int64)
    for start, length, q in catchers.finish():
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[k].append((start - starts[k], length, q))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words but those that a run holds after its first ``period`` words."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _most(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; then the first, then the one of the smallest period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one in ten documents, chosen by crc32 of the number, made periodic from some word on: a known answer."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a : a + p]
    return words[:a] + (turn * ((n - a) // p + 1))[: n - a]


Words = Callable[[int | None, list[bytes]], list[bytes]]


def _streams(batches: Iterator[pa.RecordBatch], words_of: Words | None) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    for batch in batches:
        for begin, texts in text_batches(batch.column("text"), STREAM):
            part = batch.slice(begin, len(texts))
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at the six ASCII spaces alone
            if words_of:
                words = [words_of(d, w) for d, w in zip(part.column("doc_id").to_pylist(), words, strict=True)]
            yield part, words, runs_of_texts(words)


def find_runs(docs: DataFrame, words_of: Words | None = None) -> DataFrame:
    """doc_id and runs (array of start, length, period in words) of every row of ``docs`` (doc_id, text), from the whole text.

    Null, empty and wordless texts have none. Each row is worked on alone: repeated rows have each their runs, a null
    doc_id stays null, a very long text takes memory in proportion to its words. Other columns are not read. With
    ``words_of``, (doc_id, words) are replaced by its result first.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, runs in _streams(batches, words_of):
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
            yield pa.record_batch([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "runs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with each run in ``text`` cut to its first period; texts without runs stay as they are, others are joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, runs in _streams(batches, None):
            at = part.schema.get_field_index("text")
            old = part.column(at).to_pylist()
            new = [b" ".join(kept_words(w, r)).decode("utf-8", "surrogatepass") if r else t for t, w, r in zip(old, words, runs, strict=True)]
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def run_report(docs: DataFrame, words_of: Words | None = None) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), and digests of all runs and of the kept words.

    Without a run the four are null and the digest is that of an empty string. See ``find_runs`` for rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, runs in _streams(batches, words_of):
            best = [_most(r) if r else (None, None, None) for r in runs]
            columns = [
                pa.array([len(r) for r in runs], pa.int64()), *(pa.array([b[i] for b in best], pa.int64()) for i in range(3)),
                pa.array([1000 * b[1] // b[2] if b[2] else None for b in best], pa.int64()),
                pa.array([sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]),
                pa.array([sha256(b" ".join(kept_words(w, r))).hexdigest() for w, r in zip(words, runs, strict=True)]),
            ]
            yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
