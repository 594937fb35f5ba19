"""Operator 3: removal of passages that also stand in an earlier document, by merged Burrows-Wheeler transforms.

Sorting every suffix of a corpus in one order would move each byte many times, so the corpus is first dealt by
content. The key of a 50-byte string is the least hash of the 20-byte strings in it: equal strings have equal keys,
so only strings under one key can be equal, and a run of neighbouring strings shares its key. Keys that a single
document has cannot repeat. The runs of the others are gathered by key as short segments; the transforms of shards
of segments are merged by interleave refinement, whose blocks of 50 common bytes are the repeated strings.

A key that very many documents have, as at the ends of a passage that stands in each in other surroundings, is no
single task's: its segments are dealt by content, and the least document of each of their strings is found by a
Spark aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm import bwt
from letterloom.llm.common import partitions, text_batches, written

LENGTH = 50
SEED_SHARE = 0.4
#: Bytes of segments whose transforms are merged at once; keeps the arrays of a merge small.
MERGE_BYTES = 120_000
#: Documents that a key may have in one task; the strings of hotter keys are compared in Spark aggregations.
HOT_DOCS = 5_000
_LOW = np.uint64((1 << 40) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _windows(data: np.ndarray, size: int, combine) -> np.ndarray:
    """Combine every ``size`` neighbours, by doubling."""
    out, span, todo = None, 1, size
    power, at = data, 0
    while todo:
        if todo & 1:
            out = power if out is None else combine(out[: len(power) - at], power[at : at + len(out)], at)
            at += span
        todo >>= 1
        if todo:
            power = combine(power[:-span], power[span:], span)
            span *= 2
    return out


#: Bytes whose runs are found at once; keeps the arrays in a core's cache.
CHUNK_BYTES = 64_000


def keyed_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, number of strings, key) of runs of ``length``-byte strings with one key, in order."""
    parts, begin, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or k + 1 == len(texts):
            text, *rest = _runs_of_chunk(texts[begin : k + 1], length)
            parts.append((text + begin, *rest))
            begin, size = k + 1, 0
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else _runs_of_chunk([], length)


def _runs_of_chunk(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``keyed_runs``, of few texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    seed = max(1, int(length * SEED_SHARE))
    h = data.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)

    def chain(a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
        n = min(len(a), len(b))
        out = a[:n] * np.uint64(2 * span * span + 0x2545F4914F6CDD1D)
        out ^= b[:n] >> np.uint64(29)
        out += b[:n]
        return out

    h = _mix(_windows(h, seed, chain))
    key = _windows(h, length - seed + 1, lambda a, b, _: np.minimum(a[: len(b)], b[: len(a)]))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    new[begins[begins < len(key)]] = True
    stop = ends - length + 1  # strings from here on would run into the next text
    stop = stop[(stop >= 0) & (stop < len(key))]
    new[stop] = True
    at = np.flatnonzero(new)
    text = np.searchsorted(ends, at, side="right")
    count = np.diff(np.append(at, len(key)))
    count = np.minimum(count, ends[text] - length + 1 - at)
    ok = count > 0
    return text[ok], at[ok] - begins[text[ok]], count[ok], key[at[ok]]


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _deal(blobs: DataFrame, n: int) -> DataFrame:
    return blobs.repartitionById(n, F.col("bucket"))


def _keys_of_documents(docs: DataFrame, length: int, n: int) -> DataFrame:
    """(doc_id, key, hot): the keys of each document that another one has, too, and whether over ``HOT_DOCS`` have it. Keys travel packed by bucket."""
    most = HOT_DOCS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for begin, texts in text_batches(batch.column("text"), 1_500_000):
                text, _, _, key = keyed_runs([t.encode() for t in texts], length)
                bucket = _buckets(key, n)
                order = np.lexsort((key, text, bucket))
                text, key, bucket = text[order], key[order] & _LOW, bucket[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
                text, key, bucket = text[new], key[new], bucket[new]
                bounds = np.searchsorted(bucket, np.arange(n + 1))
                some = np.flatnonzero(np.diff(bounds))
                names, counts, keys = [], [], []
                for b in some:
                    s = slice(bounds[b], bounds[b + 1])
                    who, each = np.unique(text[s], return_counts=True)
                    names.append(ids[begin + who].astype("<i8").tobytes())
                    counts.append(each.astype("<u4").tobytes())
                    keys.append(key[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(names, pa.binary()), pa.array(counts, pa.binary()), pa.array(keys, pa.binary())], names=["bucket", "docs", "counts", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_, keys_, buckets_ = [], [], []
        for batch in batches:
            for b, d, c, k in zip(*(batch.column(x).to_pylist() for x in ("bucket", "docs", "counts", "keys")), strict=True):
                docs_.append(np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")))
                wide = np.zeros((len(k) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
                keys_.append(wide.view("<u8").ravel())
                buckets_.append(np.full(len(keys_[-1]), b))
        if not docs_:
            return
        doc, key, bucket = np.concatenate(docs_), np.concatenate(keys_), np.concatenate(buckets_)
        key = key | (bucket.astype(np.uint64) << np.uint64(40))
        order = np.argsort(key)
        doc, key = doc[order], key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        sizes = np.diff(np.append(starts, len(key)))
        keep, hot = np.repeat(several, sizes), np.repeat(sizes > most, sizes)
        doc, key, hot = doc[keep], key[keep].view(np.int64), hot[keep]
        for at in range(0, len(doc), 500_000):
            yield pa.record_batch([pa.array(doc[at : at + 500_000]), pa.array(key[at : at + 500_000]), pa.array(hot[at : at + 500_000])], names=["doc_id", "key", "hot"])

    blobs = docs.mapInArrow(pack, "bucket int, docs binary, counts binary, keys binary")
    return _deal(blobs, n).mapInArrow(meet, "doc_id long, key long, hot boolean")


def _segments(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Segments of each batch's documents (_key, text, text_hash, keys, hot_keys and others) under shared keys, distinct ones once, packed by bucket.

    Segments under hot keys are dealt by their content in rows of their own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids, hashes, lists = batch.column("_key").to_numpy(), batch.column("text_hash").to_numpy(), batch.column("keys")
            hot_lists = batch.column("hot_keys")
            for begin, strings in text_batches(batch.column("text"), 1_500_000):
                texts = [t.encode() for t in strings]
                text, start, count, key = keyed_runs(texts, length)
                bucket = _buckets(key, n)
                short = (key & _LOW) | (bucket.astype(np.uint64) << np.uint64(40))
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                keep, hot = np.zeros(len(text), bool), np.zeros(len(text), bool)
                for k in range(len(texts)):
                    s = slice(bounds[k], bounds[k + 1])
                    keep[s] = np.isin(short[s], lists[begin + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    if len(hot_lists[begin + k]):
                        hot[s] = np.isin(short[s], hot_lists[begin + k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                for r in np.flatnonzero(hot).tolist():
                    bucket[r] = xxhash.xxh64_intdigest(texts[text[r]][start[r] : start[r] + count[r] + length - 1]) % n
                out: list[tuple] = []
                for is_hot, at in ((False, np.flatnonzero(keep)), (True, np.flatnonzero(hot))):
                    at = at[np.argsort(bucket[at], kind="stable")]
                    where = np.searchsorted(bucket[at], np.arange(n + 1))
                    for b in np.flatnonzero(np.diff(where)).tolist():
                        runs = at[where[b] : where[b + 1]]
                        known: dict[tuple, int] = {}
                        which = []
                        for t, s, c, k in zip(text[runs].tolist(), start[runs].tolist(), count[runs].tolist(), short[runs].tolist(), strict=True):
                            which.append(known.setdefault((k, texts[t][s : s + c + length - 1]), len(known)))
                        keys, strings_ = zip(*known, strict=True)
                        own = begin + text[runs]
                        out.append((b, is_hot, np.array(keys, "<u8").tobytes(), np.array([len(x) for x in strings_], "<u4").tobytes(), b"".join(strings_), np.array(which, "<u4").tobytes(), ids[own].astype("<i8").tobytes(), hashes[own].astype("<i8").tobytes(), start[runs].astype("<u4").tobytes()))
                if out:
                    bucket, is_hot, *columns = zip(*out, strict=True)
                    yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(is_hot, pa.bool_()), *(pa.array(list(map(shrink, c)), pa.binary()) for c in columns)], names=["bucket", "hot", *_PACKED])

    return docs.mapInArrow(pack, "bucket int, hot boolean, " + ", ".join(f"{c} binary" for c in _PACKED))


_PACKED = ("keys", "sizes", "strings", "which", "docs", "hashes", "starts")
_SPAN = "doc_id long, text_hash long, begin long, end long"


def _earlier(strings: list[bytes], keys: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Per segment the least and the greatest of its strings' earliest documents, and the single ones where they differ.

    A key with one distinct segment needs no comparison: whoever has the segment has all its strings.
    """
    low, high, each = first.copy(), first.copy(), {}
    order = np.argsort(keys, kind="stable")
    bounds = np.append(np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])), len(order))
    batch: list[int] = []
    size = 0

    def settle() -> None:
        for k, least in zip(batch, bwt.repeated_minima([strings[k] for k in batch], first[batch], length), strict=True):
            low[k], high[k] = least.min(), least.max()
            if low[k] != high[k]:
                each[k] = least

    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a == 1:
            continue
        batch += order[a:b].tolist()
        size += sum(len(strings[k]) for k in order[a:b].tolist())
        if size >= MERGE_BYTES:
            settle()
            batch, size = [], 0
    if batch:
        settle()
    return low, high, each


def _spans_of_bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        which, docs, hashes, starts = [], [], [], []
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("hot")))
            for row in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
                keys, sizes, text, w, d, h, s = map(grow, row)
                ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
                own = np.array([known.setdefault((k, text[a:b]), len(known)) for k, a, b in zip(np.frombuffer(keys, "<u8").tolist(), [0, *ends[:-1]], ends, strict=True)], np.int64)
                which.append(own[np.frombuffer(w, "<u4")])
                docs.append(np.frombuffer(d, "<i8"))
                hashes.append(np.frombuffer(h, "<i8"))
                starts.append(np.frombuffer(s, "<u4").astype(np.int64))
        if not known:
            return
        which, docs, hashes, starts = (np.concatenate(x) for x in (which, docs, hashes, starts))
        keys, strings = zip(*known, strict=True)
        known = {}
        first = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(first, which, docs)
        sizes = np.array([len(s) for s in strings], np.int64)
        low, high, each = _earlier(list(strings), np.array(keys, np.uint64), first, length)
        whole = high[which] < docs
        rows = [(docs[whole], hashes[whole], starts[whole], starts[whole] + sizes[which[whole]])]
        partly = np.flatnonzero(~whole & (low[which] < docs))
        found: list[tuple] = []
        for k in partly.tolist():
            hit = np.flatnonzero(each[int(which[k])] < docs[k])
            cut = np.flatnonzero(np.diff(hit) > length)
            for a, b in zip(hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist(), strict=True):
                found.append((docs[k], hashes[k], starts[k] + a, starts[k] + b + length))
        if found:
            rows.append(tuple(np.array(c, np.int64) for c in zip(*found, strict=True)))
        doc, text, begin, end = (np.concatenate(c) for c in zip(*rows, strict=True))
        for at in range(0, len(doc), 500_000):
            yield pa.record_batch([pa.array(c[at : at + 500_000]) for c in (doc, text, begin, end)], names=["doc_id", "text_hash", "begin", "end"])

    return run


def _hot_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments under hot keys, one row a run; equal segments have one hash."""
    grow = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        batch = batch.filter(batch.column("hot"))
        for row in zip(*(batch.column(c).to_pylist() for c in _PACKED), strict=True):
            keys, sizes, text, which, docs, hashes, starts = map(grow, row)
            ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
            strings = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            marks = np.array([xxhash.xxh64_intdigest(x) for x in strings], np.uint64).view(np.int64)
            which = np.frombuffer(which, "<u4")
            yield pa.record_batch(
                [pa.array(np.frombuffer(keys, "<u8").view(np.int64)[which]), pa.array(marks[which]), pa.array(strings, pa.binary()).take(pa.array(which)), pa.array(np.frombuffer(docs, "<i8")), pa.array(np.frombuffer(hashes, "<i8")), pa.array(np.frombuffer(starts, "<u4").astype(np.int64))],
                names=["key", "mark", "segment", "doc_id", "text_hash", "begin"],
            )


def _hot_spans(dealt: DataFrame, length: int) -> DataFrame:
    """Spans under hot keys. No task gathers a key or a string: minima are combined before the shuffle, frequent ones broadcast."""
    runs = dealt.mapInArrow(_hot_runs, "key long, mark long, segment binary, doc_id long, text_hash long, begin long")
    # as many rows as hot keys, at most the runs divided by the limit
    keys = runs.groupBy("key").agg((F.min("mark") == F.max("mark")).alias("one"), F.min("doc_id").alias("least"))
    runs = runs.join(F.broadcast(keys), "key")
    end = (F.col("begin") + F.octet_length("segment")).alias("end")
    whole = runs.where("one and least < doc_id").select("doc_id", "text_hash", "begin", end)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            count = np.array([len(x) - length + 1 for x in segments], np.int64)
            strings = [xxhash.xxh3_128_digest(x[k : k + length]) for x in segments for k in range(len(x) - length + 1)]
            row = np.repeat(np.arange(len(count)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            doc, text, begin = (batch.column(c).to_numpy()[row] for c in ("doc_id", "text_hash", "begin"))
            yield pa.record_batch([pa.array(strings, pa.binary()), pa.array(doc), pa.array(text), pa.array(begin + offset)], names=["string", "doc_id", "text_hash", "begin"])

    strings = runs.where("not one").select("segment", "doc_id", "text_hash", "begin").mapInArrow(cut, "string binary, doc_id long, text_hash long, begin long")
    minima = strings.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count(F.lit(1)).alias("n")).where("least < greatest")
    frequent = F.broadcast(minima.where(F.col("n") > HOT_DOCS).select("string", "least"))
    rest = minima.where(F.col("n") <= HOT_DOCS).select("string", "least")
    met = strings.join(frequent, "string").unionByName(strings.join(frequent, "string", "left_anti").join(rest, "string"))
    return whole.unionByName(met.where("least < doc_id").select("doc_id", "text_hash", "begin", (F.col("begin") + length).alias("end")))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with text_hash and ``spans``: array of (text_hash, begin, end) byte ranges, null where nothing repeats.

    Columns text_hash, spans and _key of the input are replaced or dropped.
    A byte is in a span if a string of ``length`` bytes over it also starts in a document with a smaller doc_id.
    Texts are taken as UTF-8, whole; a null text is empty; rows with one doc_id are one document's, whose texts
    don't repeat each other; a row without doc_id is left alone and is no source. Spans may overlap and belong to
    the text with that hash.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.drop("text_hash", "spans", "_key").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    docs = docs.withColumn("_key", F.col("doc_id").cast("long"))
    long_enough = F.col("_key").isNotNull() & (F.octet_length(F.coalesce("text", F.lit(""))) >= length)
    texts = docs.where(long_enough)
    shared = _keys_of_documents(texts.select(F.col("_key").alias("doc_id"), "text"), length, n)
    shared = shared.groupBy("doc_id").agg(*(F.collect_list(F.when(F.col("hot") == F.lit(h), F.col("key"))).alias(c) for c, h in (("keys", False), ("hot_keys", True))))
    shared = written(shared, "shared-keys").withColumnRenamed("doc_id", "_key")
    # both joins read the same shuffle of the texts: nothing is selected before it, so the plans agree
    dealt = _deal(_segments(texts.join(shared.hint("shuffle_hash"), "_key"), length, n), n)
    spans = dealt.mapInArrow(_spans_of_bucket(length), _SPAN).unionByName(_hot_spans(dealt, length))
    spans = spans.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list(F.struct("text_hash", "begin", "end")).alias("spans"))
    marked = texts.join(spans.hint("shuffle_hash"), "_key", "left").drop("_key")
    return marked.unionByName(docs.where(~long_enough).drop("_key").withColumn("spans", F.lit(None).cast(marked.schema["spans"].dataType)))


def _kept(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What remains of a text, and how many separate ranges go."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.append(True, spans[1:, 0] > reach[:-1])
    begins = spans[first, 0]
    ends = reach[np.append(np.flatnonzero(first)[1:] - 1, len(reach) - 1)]
    parts = [text[a:b] for a, b in zip(np.append(0, ends), np.append(begins, len(text)), strict=True)]
    return b"".join(parts), len(begins)


def _remaining(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """(text, what remains, removed ranges) of each row."""
    for text, own, spans in zip(batch.column("text"), batch.column("text_hash").to_pylist(), batch.column("spans"), strict=True):
        data = (text.as_py() or "").encode()
        here = np.zeros((0, 2), np.int64)
        if spans.is_valid:
            v = spans.values
            mine = v.field("text_hash").to_numpy(zero_copy_only=False) == own
            here = np.stack([v.field(c).to_numpy(zero_copy_only=False)[mine] for c in ("begin", "end")], axis=1)
        yield (data, *(_kept(data, here) if len(here) else (data, 0)))


def removal_report(marked: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``repeated_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for t, k, n in _remaining(batch)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.select("doc_id", "text", "text_hash", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut from text; where a cut leaves a part of a character, that part goes, too.

    All rows and columns stay. A text that nothing was cut from, null included, is unchanged.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c_{c}") for c in rest)).alias("rest"))  # so no name can clash
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text")
            new = [k.decode(errors="ignore") if n else old[i].as_py() for i, (_, k, n) in enumerate(_remaining(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if c == "text" else batch.column(c) for c in names], names=names)

    cut = repeated_spans(plain, length).select(*names, "text_hash", "spans").mapInArrow(run, plain.schema)
    return cut.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest")[f"c_{c}"].alias(c) for c in docs.columns))
