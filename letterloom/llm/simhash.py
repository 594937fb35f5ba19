"""Operator 8: SimHash near-duplicates by multi-index hashing.

Three segments of 22, 21 and 21 bits: of two fingerprints within four bits, either the first or the second segment
differs in at most one bit, or the third not at all (2 + 2 + 1 > 4). A fingerprint is entered under each segment
and asks, in the first two, for the segment with one of its zero bits set: of two segments one bit apart, one asks
for the other. Whoever meets under one segment is compared in all 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import forest, group_bounds, split_hot, text_batches, whole_groups, written
from letterloom.llm.components import connected_components

SEED = 42
#: (first bit, bits, whether neighbours one bit apart are asked for)
SEGMENTS = ((42, 22, True), (21, 21, True), (0, 21, False))
DISTANCE = 4
#: Members of a segment's group that one task compares; larger groups are split into pairs of blocks.
GROUP = 20_000


def _shingle_hashes(text: str, shingle: int) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    digest, low, high = xxhash.xxh64_intdigest, begins[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(low, high, strict=True)], np.uint64)


def _majority(h: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of ``h`` (words of 64 bits), as words."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for part in range(0, len(h), 255):
        bits = np.unpackbits(h[part : part + 255].astype("<u8").view(np.uint8).reshape(-1, 8 * h.shape[1]), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash over word shingles, repeats included; zero without words."""
    h = _shingle_hashes(text, shingle)
    return int(_majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every row of ``docs`` (doc_id, text); a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, shingle) for _, texts in text_batches(batch.column("text")) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _entries(fps: DataFrame) -> DataFrame:
    """key (segment number and bits), fp, asks: each fingerprint's entries and the neighbours it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (first, bits, ask) in enumerate(SEGMENTS):
                part = (fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                keys, members, asks = [part], [fp], [np.zeros(len(fp), bool)]
                for bit in range(bits if ask else 0):
                    zero = (part >> np.uint64(bit)) & np.uint64(1) == 0
                    keys.append(part[zero] | np.uint64(1 << bit))
                    members.append(fp[zero])
                    asks.append(np.ones(int(zero.sum()), bool))
                key = np.concatenate(keys).astype(np.int64) | np.int64(number << 32)
                yield pa.record_batch([pa.array(key), pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(asks))], names=["key", "fp", "asks"])

    return fps.mapInArrow(run, "key long, fp long, asks boolean")


def local_forest(fp: np.ndarray, left: np.ndarray | None = None, distance: int = DISTANCE) -> np.ndarray:
    """For each of the distinct fingerprints (of one or more words), the number of the first one it is connected to within the group.

    Grows one component after another: what is near to the newest members is found among those not yet taken,
    so a dense group costs a few passes and no list of pairs is made. With ``left``, only pairs of one from
    each side count.
    """
    fp = fp.reshape(len(fp), -1)
    n = len(fp)
    root = np.full(n, -1, np.int64)
    free = np.arange(n)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        free = free[free != i]
        while front and len(free):
            x = front.pop()
            near = np.bitwise_count(fp[free] ^ fp[x]).sum(axis=1) <= distance
            if left is not None:
                near &= left[free] != left[x]
            if near.any():
                new = free[near]
                root[new] = i
                front += new.tolist()
                free = free[~near]
    return root


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) between distinct fingerprints: links that connect exactly what links within four bits connect.

    All candidates under a key meet, whatever their number; a task emits at most one link per member and key.
    """
    entries = split_hot(_entries(fps.select("fp").distinct()), "key", "fp", group)
    keys = ["key", "low_block", "high_block"]
    entries = entries.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in whole_groups(batches, keys):
            columns = [data.column(k).to_numpy() for k in keys]
            fp, asks, block = data.column("fp").to_numpy().view(np.uint64), data.column("asks").to_numpy(), data.column("block").to_numpy()
            bounds = group_bounds(*columns)
            size = np.diff(bounds)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            at = bounds[:-1][size == 2]  # most groups: compared together
            near = at[np.bitwise_count(fp[at] ^ fp[at + 1]) <= DISTANCE]
            a.append(fp[near])
            b.append(fp[near + 1])
            for k in np.flatnonzero(size > 2):
                s = slice(bounds[k], bounds[k + 1])
                if asks[s].all():
                    continue
                two = columns[1][s.start] != columns[2][s.start]
                root = local_forest(fp[s], block[s] if two else None)
                other = root != np.arange(len(root))
                a.append(fp[s][root[other]])
                b.append(fp[s][other])
            low, high = np.concatenate(a), np.concatenate(b)
            if len(low):
                yield pa.record_batch([pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["a", "b"])

    return entries.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text).

    Equal fingerprints are one; components are found between distinct fingerprints and given the smallest
    doc_id of all their rows. Texts without words share fingerprint zero. Rows without doc_id keep a null id
    and count as members, never as the smallest.
    """
    marked = written(fingerprints(docs, shingle), "fingerprints")
    return _with_components(marked, connected_components(links(marked)))


# --- by similarity ---------------------------------------------------------------------------------------------------
#: Bits of a segment, whatever the number of rows; the first ``CHECKED`` words of a wide fingerprint are compared.
WIDTH, CHECKED = 18, 4
#: Members of a key's group up to which all its pairs are compared at once.
SMALL = 64
#: Share of the pairs of exactly the similarity that meet under a segment; closer ones meet more surely.
RECALL = 0.99


def segment_count(similarity: float, recall: float = RECALL) -> int:
    """Segments in one of which at least two texts of the similarity agree with probability ``recall``."""
    agree = (1 - differing_share(similarity)) ** WIDTH
    return 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def words_for(similarity: float) -> int:
    """Words of a fingerprint that holds all segments."""
    return max(CHECKED, -(-segment_count(similarity) * WIDTH // 64))


def wide_fingerprint(h: np.ndarray, wide: int) -> np.ndarray:
    """SimHash of ``wide`` words: every distinct shingle's hash is spread over them by multiplication and shifts."""
    if not len(h):
        return np.zeros(wide, np.uint64)
    odd = (np.arange(wide, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16)) | np.uint64(1)
    out = np.zeros(wide, np.uint64)
    ones = np.zeros(64 * wide, np.int64)
    for part in range(0, len(h), 255):
        x = h[part : part + 255, None] * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    out[:] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")
    return out


def differing_share(similarity: float) -> float:
    """Share of bits in which texts of this shingle similarity (intersection by union) differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _allowed(q: float, bits: int, errors: float) -> int:
    """Bits of ``bits`` that may differ: the share ``q`` and so many standard errors."""
    return int(bits * (q + errors * math.sqrt(q * (1 - q) / bits)))


def similar_links(classes: DataFrame, similarity: float, group: int = GROUP) -> DataFrame:
    """(a, b) between distinct classes (fp, bits): candidates, connected as in ``links``.

    Two texts of the similarity agree in all bits of one of the many segments with probability ``RECALL``: at 0.8
    with 87 segments of 18 bits; closer ones more surely. Neither depends on the number of rows: chance meetings
    grow with it (10 million rows: 38 under a key), and cost one comparison each. Whoever meets is compared in 256
    bits, allowing 3.5 standard errors beyond the average share; ``verified_links`` decides.
    """
    segments, wide = segment_count(similarity), words_for(similarity)
    q = differing_share(similarity)
    most = _allowed(q, 64 * CHECKED, 3.5)
    checked = [f"v{k}" for k in range(CHECKED)]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<u8").reshape(-1, wide)
            bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8 * wide), axis=1, bitorder="little")
            for k in range(segments):
                part = bits[:, k * WIDTH : (k + 1) * WIDTH].astype(np.int64) @ (np.int64(1) << np.arange(WIDTH, dtype=np.int64))
                yield pa.record_batch([pa.array(part | (k << 40)), batch.column("fp"), *(pa.array(words[:, c].copy().view(np.int64)) for c in range(CHECKED))], names=["key", "fp", *checked])

    entries = classes.mapInArrow(enter, "key long, fp long, " + ", ".join(f"{c} long" for c in checked))
    entries = split_hot(entries, "key", "fp", group)
    keys = ["key", "low_block", "high_block"]
    entries = entries.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in whole_groups(batches, keys):
            columns = [data.column(k).to_numpy() for k in keys]
            fp, block = data.column("fp").to_numpy(), data.column("block").to_numpy()
            v = np.stack([data.column(c).to_numpy().view(np.uint64) for c in checked], axis=1)
            bounds = group_bounds(*columns)
            size = np.diff(bounds)
            number = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= SMALL, size)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lag in range(1, SMALL):  # small groups, all at once
                at = np.flatnonzero((number[lag:] == number[:-lag]) & small[lag:])
                if not len(at):
                    break
                at = at[np.bitwise_count(v[at] ^ v[at + lag]).sum(axis=1) <= most]
                low.append(at)
                high.append(at + lag)
            root = forest(len(fp), np.concatenate(low), np.concatenate(high))
            other = np.flatnonzero(root != np.arange(len(root)))
            a.append(fp[root[other]])
            b.append(fp[other])
            for k in np.flatnonzero(size > SMALL):
                s = slice(bounds[k], bounds[k + 1])
                two = columns[1][s.start] != columns[2][s.start]
                root = local_forest(v[s], block[s] if two else None, most)
                other = root != np.arange(len(root))
                a.append(fp[s][root[other]])
                b.append(fp[s][other])
            low, high = np.concatenate(a), np.concatenate(b)
            if len(low):
                yield pa.record_batch([pa.array(low), pa.array(high)], names=["a", "b"])

    return entries.mapInArrow(run, "a long, b long")


#: Texts of fewer distinct shingles are compared by these alone: their bits stray further from the average share.
FEW = 100


def exact_forest(sets: list[np.ndarray], bits: np.ndarray, similarity: float, left: np.ndarray | None = None) -> np.ndarray:
    """As ``local_forest``, of texts whose distinct shingles (sorted) have the similarity: intersection by union, exactly.

    All bits of the fingerprints are compared before, with 4.5 standard errors to spare.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    most = _allowed(differing_share(similarity), 64 * bits.shape[1], 4.5)
    root = np.full(n, -1, np.int64)
    free = np.arange(n)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        front = [i]
        free = free[free != i]
        while front and len(free):
            x = front.pop()
            near = np.minimum(size[free], size[x]) >= similarity * np.maximum(size[free], size[x]) - 1e-9
            near &= size[free] > 0
            if left is not None:
                near &= left[free] != left[x]
            at = np.flatnonzero(near)
            at = at[(np.minimum(size[free[at]], size[x]) <= FEW) | (np.bitwise_count(bits[free[at]] ^ bits[x]).sum(axis=1) <= most)]
            hit = np.zeros(len(free), bool)
            for part in range(0, len(at), 256):
                some = at[part : part + 256]
                other = np.concatenate([sets[k] for k in free[some]])
                place = np.minimum(np.searchsorted(sets[x], other), size[x] - 1)
                common = np.add.reduceat((sets[x][place] == other).astype(np.int64), np.append(0, np.cumsum(size[free[some]])[:-1]))
                hit[some] = common >= similarity * (size[free[some]] + size[x] - common) - 1e-9
            if hit.any():
                root[free[hit]] = i
                front += free[hit].tolist()
                free = free[~hit]
    return root


#: Classes of at most so many distinct shingles carry them, and meet by these.
SHORT = 15


def short_links(classes: DataFrame, similarity: float, group: int = 1_000) -> DataFrame:
    """(a, b): links that connect exactly the classes (fp, few: sorted distinct shingles) that have the similarity, of those that carry theirs.

    Two sets of a similarity share one of the first n - ceil(similarity * n) + 1 of their n shingles, in one order for
    all: each class has an entry for each of these, and whoever meets under a shingle is compared exactly.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, "<u8") for x in batch.column("few").to_pylist()]
            first = np.array([len(x) - math.ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0 for x in sets], np.int64)
            rows = np.repeat(np.arange(len(sets)), first)
            keys = np.concatenate([np.zeros(0, "<u8"), *(x[:k] for x, k in zip(sets, first.tolist(), strict=True))]).view(np.int64)
            yield pa.record_batch([pa.array(keys), *(batch.column(c).take(pa.array(rows)) for c in ("fp", "few"))], names=["key", "fp", "few"])

    entries = split_hot(classes.where("few is not null").select("fp", "few").mapInArrow(enter, "key long, fp long, few binary"), "key", "fp", group)
    keys = ["key", "low_block", "high_block"]
    entries = entries.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in whole_groups(batches, keys, 20_000):
            columns = [data.column(k).to_numpy() for k in keys]
            fp, block, sets = data.column("fp").to_numpy(), data.column("block").to_numpy(), data.column("few").to_pylist()
            bounds = group_bounds(*columns)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                own = [np.frombuffer(x, "<u8") for x in sets[low:high]]
                two = columns[1][low] != columns[2][low]
                root = exact_forest(own, np.zeros((len(own), 1), np.uint64), similarity, block[low:high] if two else None)
                other = root != np.arange(len(root))
                a.append(fp[low:high][root[other]])
                b.append(fp[low:high][other])
            first, second = np.concatenate(a), np.concatenate(b)
            if len(first):
                yield pa.record_batch([pa.array(first), pa.array(second)], names=["a", "b"])

    return entries.mapInArrow(run, "a long, b long")


def verified_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, shingle: int, similarity: float, group: int = 1_000) -> DataFrame:
    """(a, b): links that connect exactly what classes (fp, text_hash, bits) of one candidate component and of the similarity connect.

    The shingles of one text a class are joined to its candidate component (node, component); all texts of a
    component meet, in pairs of blocks where it is large.
    """
    wanted = classes.drop("few").join(candidates.withColumnRenamed("node", "fp"), "fp")
    texts = docs.select(_text_hash(), "text").groupBy("text_hash").agg(F.min("text").alias("text"))  # copies are combined before the shuffle

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_shingle_hashes(t, shingle)).astype("<u8").tobytes() for _, run in text_batches(batch.column("text")) for t in run]
            yield pa.record_batch([batch.column("component"), batch.column("fp"), batch.column("bits"), pa.array(own, pa.binary())], names=["component", "fp", "bits", "shingles"])

    members = written(texts.join(wanted, "text_hash").select("component", "fp", "bits", "text").mapInArrow(sets, "component long, fp long, bits binary, shingles binary"), "shingles")
    keys = ["component", "low_block", "high_block"]
    members = split_hot(members, "component", "fp", group).repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in whole_groups(batches, keys, 1_000):
            columns = [data.column(k).to_numpy() for k in keys]
            fp, block = data.column("fp").to_numpy(), data.column("block").to_numpy()
            bounds = group_bounds(*columns)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = data.slice(low, high - low)
                own = [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
                bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(len(own), -1)
                two = columns[1][low] != columns[2][low]
                root = exact_forest(own, bits, similarity, block[low:high] if two else None)
                other = root != np.arange(len(root))
                a.append(fp[low:high][root[other]])
                b.append(fp[low:high][other])
            first, second = np.concatenate(a), np.concatenate(b)
            if len(first):
                yield pa.record_batch([pa.array(first), pa.array(second)], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``near_duplicates``, for texts whose sets of word shingles are similar, which 64 bits cannot tell well.

    Candidates meet by wide fingerprints; links are verified exactly before components are formed. ``fp`` is a
    hash of the distinct shingles. Texts of fewer words than a shingle are one shingle; those without words are
    one class. The fingerprints of texts with few shingles differ by more than the average: texts of at most ``SHORT``
    distinct shingles meet by these as well, so that no pair of them escapes.
    """
    wide = words_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rows, few = [], [], []
            for _, texts in text_batches(batch.column("text")):
                for t in texts:
                    own = np.unique(_shingle_hashes(t, shingle))
                    fp.append(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED))
                    rows.append(wide_fingerprint(own, wide).astype("<u8").tobytes())
                    few.append(own.astype("<u8").tobytes() if 0 < len(own) <= SHORT else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(rows, pa.binary()), pa.array(few, pa.binary())], names=["doc_id", "text_hash", "fp", "bits", "few"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = written(docs.select("doc_id", _text_hash(), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, bits binary, few binary"), "wide-fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("text_hash").alias("text_hash"), F.first("bits").alias("bits"), F.first("few").alias("few")), "wide-classes")
    candidates = connected_components(similar_links(classes.select("fp", "bits"), similarity).unionByName(short_links(classes, similarity)))
    links = verified_links(docs, classes, candidates, shingle, similarity)
    return _with_components(marked.select("doc_id", "fp"), connected_components(links))


def _with_components(marked: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of ``marked`` (doc_id, fp, from a written table). Both sides of a join are written before, so
    that adaptive execution can split a fingerprint or component that very many rows have."""
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = written(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "linked-classes")
    smallest = written(linked.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    classes = written(linked.select("fp", "component").join(smallest, "component").select("fp", "component_id"), "found-classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
