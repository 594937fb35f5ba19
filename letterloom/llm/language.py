"""Operator 7: language identification with language-bitmask n-gram filters.

One filter holds the n-grams of all languages: each of its slots is a bit mask of languages, so one look-up gives
every language that may contain an n-gram. A text's hits per language, less those that the filter's fill
explains by chance, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import text_batches

GRAM = 5
#: Languages in one word of a mask; a filter has as many words a slot as its languages need.
WORD = 32
#: ASCII letters in lower case, other ASCII as a space, further bytes of UTF-8 as they are.
_FOLD = bytes(b if 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the byte n-grams of texts, and where each text's keys begin and end; none spans two texts."""
    folded = [b" " + t.lower().encode("utf-8", "replace").translate(_FOLD) + b" " * (GRAM - 1) for t in texts]
    data = np.frombuffer(b"".join(folded), np.uint8)
    ends = np.cumsum([len(f) for f in folded])
    begins = np.append(0, ends[:-1])
    wide = data.astype(np.uint64)
    keys = wide[: len(data) - GRAM + 1].copy()
    for k in range(1, GRAM):
        keys |= wide[k : len(data) - GRAM + 1 + k] << np.uint64(8 * k)
    return keys, begins, ends - GRAM + 1


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    common: int  #: the most frequent language, for texts without any known n-gram
    bits: int
    masks: np.ndarray  #: one bit mask of languages per slot, a row for every 32 languages
    chance: np.ndarray  #: per language, how often the filter says yes to an unknown n-gram

    @classmethod
    def build(cls, languages: list[str], common: int, grams: np.ndarray, masks: np.ndarray, slots_per_gram: int = 12) -> LanguageModel:
        bits = max(10, int(np.ceil(np.log2(max(1, len(grams)) * slots_per_gram))))
        masks = np.atleast_2d(masks)
        table = np.zeros((len(masks), 1 << bits), np.uint32)
        for m in _MULTIPLIERS:
            for row, mask in zip(table, masks, strict=True):
                np.bitwise_or.at(row, (grams * m) >> np.uint64(64 - bits), mask)
        fill = [float(np.mean((table[k // WORD] >> np.uint32(k % WORD)) & np.uint32(1))) for k in range(len(languages))]
        return cls(languages, common, bits, table, np.array(fill) ** len(_MULTIPLIERS))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Corrected hit counts, one row per text and one column per language."""
        keys, begins, ends = gram_keys(texts)
        shift = np.uint64(64 - self.bits)
        slots = [(keys * m) >> shift for m in _MULTIPLIERS]
        n = (ends - begins).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        for word, row in enumerate(self.masks):
            mask = row[slots[0]]
            for at in slots[1:]:
                mask &= row[at]
            for k in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                sums = np.append(0, np.cumsum((mask >> np.uint32(k % WORD)) & np.uint32(1), dtype=np.int64))
                chance = self.chance[k]
                out[:, k] = np.maximum(0, (sums[ends] - sums[begins] - n * chance) / max(1e-9, 1 - chance))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        scores = self.scores(texts)
        total = scores.sum(axis=1)
        best = np.where(total > 0, scores.argmax(axis=1), self.common)
        share = np.where(total > 0, scores.max(axis=1) / np.maximum(total, 1e-12), 1 / len(self.languages))
        lettered = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share, 0.0)


def train(docs: DataFrame, usable: Column, per_language: int = 2_000, least_share: float = 0.00125) -> LanguageModel:
    """Learn from text and lang of the ``usable`` rows of ``docs`` (doc_id, text, lang).

    At most about ``per_language`` rows of each language are read for it, taken by a hash of doc_id; an n-gram
    counts for a language if more than ``least_share`` of its sampled rows have it (3 of 2 000, 1 of fewer than 800:
    the same rule for any number of rows and whatever the other languages have). Only these n-grams, bounded by the sample, reach the driver. Rows without
    text, lang or doc_id teach nothing, repeated rows count each; there may be any number of languages. Without any
    such row every text is ``und``.
    """
    rows = docs.where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return LanguageModel(["und"], 0, 10, np.zeros((1, 1 << 10), np.uint32), np.zeros(1))
    languages = sorted(counts)
    number = {k: i for i, k in enumerate(languages)}
    known_as = F.create_map(*(F.lit(x) for k, i in number.items() for x in (k, i)))
    share = F.array(*(F.lit(int(min(1.0, per_language / counts[k]) * 1_000_000)) for k in languages))
    sample = rows.withColumn("language", known_as[F.col("lang")]).drop("lang")
    sample = sample.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < F.get(share, F.col("language")))
    sampled = {r["language"]: r["n"] for r in sample.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.array(*(F.lit(int(sampled.get(i, 0) * least_share) + 1) for i in range(len(languages))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[] for _ in languages]
        for batch in batches:
            langs = batch.column("language").to_pylist()
            for begin, texts in text_batches(batch.column("text"), 1_000_000):
                keys, begins, ends = gram_keys(texts)
                for k, (b, e) in enumerate(zip(begins, ends, strict=True)):
                    found[langs[begin + k]].append(np.unique(keys[b:e]))
        for k, lists in enumerate(found):
            if lists:
                gram, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), k, np.int32)), pa.array(n)], names=["gram", "language", "n"])

    known = (
        sample.mapInArrow(grams, "gram long, language int, n long").groupBy("gram", "language").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= F.get(least, F.col("language"))).withColumn("word", F.floor(F.col("language") / WORD).cast("int"))
        .groupBy("gram", "word").agg(F.bit_or(F.expr(f"shiftleft(1L, language % {WORD})")).alias("mask")).toPandas()
    )
    common = number[max(counts, key=lambda k: (counts[k], k))]
    every, at = np.unique(known["gram"].to_numpy(np.int64), return_inverse=True)
    masks = np.zeros((-(-len(languages) // WORD), len(every)), np.uint32)
    masks[known["word"].to_numpy(np.int64), at] = known["mask"].to_numpy(np.int64).astype(np.uint32)
    return LanguageModel.build(languages, common, every.view(np.uint64), masks)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text), from the whole text alone.

    A null text or one without a letter is ``und`` with score 0; of languages with equal counts the first by name is
    taken, and the most frequent one where a text has no known n-gram. Repeated rows are judged each, other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in text_batches(batch.column("text"), 1_000_000):
                n, s = shared.value.predict(texts)
                names += n
                scores += s.tolist()
            yield pa.record_batch([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
