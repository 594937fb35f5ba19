"""Values sought in all documents, also where the documents have lost their spaces.

A value can stand only in a text that holds any given piece of it. So each value is sought by a seed, the rarest of
some of its q-grams, counted over all documents; only documents with a seed are read again, each once per shard of
values whose seed it holds. A shard's values, of a bounded size together, make an Aho-Corasick automaton, which
finds all of them in one pass over a text. Both steps work on texts without spaces, since what stands in a text
stands in it without spaces, too; whether it stands with its spaces is tested on what was found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.shared import written

#: Bytes of a seed; shorter values are their own seed.
SEED = 8
#: Pieces of a value, evenly spread, of which the rarest becomes its seed.
PIECES = 16
#: Bytes of values in one automaton, and texts that one task searches with it; they pass one by one.
SHARD, TASK = 400_000, 20_000
#: Seeds and pieces are broadcast up to this number (8 bytes each), which is counted before; more of them are joined.
BROADCAST = 1_000_000


def _codes(data: bytes, size: int) -> np.ndarray:
    """The pieces of ``size`` bytes at all places as numbers; two equal pieces have one number."""
    if len(data) < size:
        return np.zeros(0, np.int64)
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), size)
    out = np.zeros(len(window), np.uint64)
    for k in range(size):
        out |= window[:, k].astype(np.uint64) << np.uint64(8 * k)
    return (out if size == SEED else out | np.uint64(size << 56)).view(np.int64)


def _bare(text: str) -> bytes:
    return text.replace(" ", "").encode("utf-8", "surrogatepass")


def _pieces(values: DataFrame) -> DataFrame:
    """value_id, piece, size: up to ``PIECES`` pieces of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces, sizes = [], [], []
            for value_id, needle in zip(batch.column("value_id").to_pylist(), batch.column("needle").to_pylist(), strict=True):
                data = _bare(needle)
                size = min(SEED, len(data))
                codes = _codes(data, size)
                chosen = np.unique(codes[np.linspace(0, len(codes) - 1, min(PIECES, len(codes))).astype(int)]).tolist()
                pieces += chosen
                ids += [value_id] * len(chosen)
                sizes += [size] * len(chosen)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pieces, pa.int64()), pa.array(sizes, pa.int32())], names=["value_id", "piece", "size"])

    return values.select("value_id", "needle").mapInArrow(run, "value_id long, piece long, size int")


def _held(hay: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, piece: the wanted pieces that each text holds."""
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # at most ``SEED``
    wanted = pieces.select("piece").distinct()
    few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
    known = np.sort(wanted.toPandas()["piece"].to_numpy(np.int64)) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = _bare(batch.column("hay")[row].as_py())
                codes = np.concatenate([_codes(data, size) for size in sizes]) if sizes else np.zeros(0, np.int64)
                if known is not None:
                    at = np.searchsorted(known, codes)
                    codes = codes[known[np.minimum(at, len(known) - 1)] == codes] if len(known) else codes[:0]
                codes = np.unique(codes)
                if len(codes):
                    yield pa.record_batch([pa.array(np.full(len(codes), batch.column("doc_id")[row].as_py(), np.int64)), pa.array(codes)], names=["doc_id", "piece"])

    held = hay.mapInArrow(run, "doc_id long, piece long")
    return held if few else held.join(wanted, "piece", "left_semi").select("doc_id", "piece")


def find_values(hay: DataFrame, needles: DataFrame, normal: Callable[[str], Column] = F.col) -> DataFrame:
    """doc_id, item_id, verdict of every pair whose ``hay.hay`` holds ``needles.needle``: ``found``, or ``found_without_spaces``.

    Texts are normalised by ``normal`` when they are read, the second time only those that are searched; values are
    normalised alike before. Null and empty needles are not sought, null texts hold nothing, and rows without
    doc_id are not searched; repeated rows of either side give a row each. A value that very many items share is
    sought once; a seed that very many documents hold costs each of them one search of their own text.
    """
    hay = hay.where("doc_id is not null and hay is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "hay")
    needles = needles.where("replace(needle, ' ', '') <> ''").select("item_id", "needle")
    values = written(needles.select("needle").distinct().withColumn("value_id", F.monotonically_increasing_id()), "values")
    pieces = written(_pieces(values), "pieces")
    held = written(_held(hay.select("doc_id", normal("hay").alias("hay")), pieces), "held")
    spread = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    seeds = pieces.join(spread, "piece").groupBy("value_id").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count(F.lit(1)).alias("known"))
    # a value one of whose pieces no document holds stands in none
    whole = pieces.groupBy("value_id").agg(F.count(F.lit(1)).alias("all"))
    seeds = seeds.join(whole, "value_id").where(F.col("known") == F.col("all")).select("value_id", "piece")
    size = values.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD))
    seeds = written(seeds.withColumn("shard", F.pmod(F.xxhash64("value_id"), F.lit(shards)).cast("int")), "seeds")
    routes = written(held.join(seeds.select("piece", "shard").distinct(), "piece").select("doc_id", "shard").distinct(), "routes")
    # each shard's texts are dealt over as many tasks as their number asks for, and its values go to each of these
    tasks = routes.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK).cast("int").alias("tasks"))
    texts = hay.join(routes.join(tasks, "shard"), "doc_id").withColumn("hay", normal("hay")).select("shard", F.pmod(F.xxhash64("doc_id", "hay"), F.col("tasks")).cast("int").alias("task"), F.lit(1).alias("kind"), F.col("doc_id").alias("id"), F.col("hay").alias("text"))
    sought = values.join(seeds, "value_id").join(tasks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), F.col("value_id").alias("id"), F.col("needle").alias("text"))
    rows = sought.unionByName(texts).repartition("shard", "task").sortWithinPartitions("shard", "task", "kind", "id")
    found = written(rows.mapInArrow(_search, "doc_id long, value_id long, spaced boolean"), "found")
    items = needles.join(values, "needle").select("item_id", "value_id")
    return found.join(items, "value_id").select("doc_id", "item_id", F.when(F.col("spaced"), "found").otherwise("found_without_spaces").alias("verdict"))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and task, values before texts: an automaton is made of the former and passed over the latter."""
    import ahocorasick

    key = automaton = None
    waiting: dict[str, list[tuple[int, str]]] = {}
    for batch in batches:
        docs, values, spaced = [], [], []
        for shard, task, kind, number, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "task", "kind", "id", "text")), strict=True):
            if key != (shard, task):
                key, automaton, waiting = (shard, task), None, {}
            if not kind:
                waiting.setdefault(text.replace(" ", ""), []).append((number, text))
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for bare, own in waiting.items():
                    automaton.add_word(bare, own)
                automaton.make_automaton()
            if not len(automaton):
                continue
            met = {id(own): own for _, own in automaton.iter(text.replace(" ", ""))}
            for own in met.values():
                for value_id, needle in own:
                    docs.append(number)
                    values.append(value_id)
                    spaced.append(needle in text)
        if docs:
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(values, pa.int64()), pa.array(spaced)], names=["doc_id", "value_id", "spaced"])
