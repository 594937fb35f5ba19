"""Operator 9: a quality classifier learned from positive and unlabelled documents.

Trusted positives and unlabelled text are enough: the risk of calling unlabelled text bad, less the share that
the class prior says is good, stands in for the risk on bad text; where that estimate turns negative it is
clipped and pushed back (non-negative unbiased risk), so the model can't win by memorising the positives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import text_batches

#: Character classes of UTF-8 bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 symbol; other bytes count as lower.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[:] = 7
_CLASSES[:32] = 0
_CLASSES[97:123] = 1
_CLASSES[128:] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[9, 32]] = 4
_CLASSES[[10, 13]] = 5
_CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 6
_TABLE = _CLASSES.tobytes()
SHAPES = 8**3
MEASURES = 14
KNOTS = 12


def features(text: str) -> np.ndarray:
    """Shares of character-class trigrams, then measures of words and lines, of the whole text."""
    data = text.encode("utf-8", "replace")
    out = np.zeros(SHAPES + MEASURES, np.float32)
    if len(data) >= 3:
        c = np.frombuffer(data.translate(_TABLE), np.uint8)
        shape = c[:-2].astype(np.int16) * 64 + c[1:-1].astype(np.int16) * 8 + c[2:]
        out[:SHAPES] = np.sqrt(np.bincount(shape, minlength=SHAPES) / len(shape))
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    if not words:
        return out
    n, counts = len(words), Counter(words)
    upper = sum(map(str.isupper, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[SHAPES:] = (
        np.log1p(len(data)), np.log1p(n), len(counts) / n, max(counts.values()) / n, pairs / max(1, n - 1), len(data) / n,
        upper / n, len(set(lines)) / max(1, len(lines)), max(Counter(lines).values(), default=0) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(not w[-1].isalnum() for w in words) / n, sum(w[0].isupper() for w in words) / n, max(map(len, words)) / len(data), sum(len(w) == 1 for w in words) / n,
    )
    return out


@dataclass
class QualityModel:
    knots: np.ndarray  #: per measure, the quantiles between which it is spread over indicator features
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        parts = [x]
        for k in range(MEASURES):
            at = np.searchsorted(self.knots[k], x[:, SHAPES + k], side="right")
            one = np.zeros((len(x), KNOTS + 1), np.float32)
            one[np.arange(len(x)), at] = 1
            parts.append(one)
        wide = np.concatenate(parts, axis=1)
        wide -= self.mean
        wide /= self.scale
        return wide

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weight + self.bias, -30, 30)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # keeps single precision


def risk_and_gradient(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """(risk on positives, estimated risk on the rest, gradient to follow) of a linear score with the logistic loss.

    The first is prior * E_p[l(f)], the second E_u[l(-f)] - prior * E_p[l(-f)]. Where that is negative its gradient
    alone is followed, reversed, as non-negative risk estimation prescribes. The gradient's last number is b's.
    """
    near = w.astype(p.dtype)
    sp, su = (_sigmoid(x @ near + p.dtype.type(b)) for x in (p, u))

    def mean(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.append(v @ x, v.sum()).astype(np.float64) / len(x)

    # the logistic loss of f has the derivative -(1 - s), that of -f has s
    good, bad = -prior * mean(p, 1 - sp), mean(u, su) - prior * mean(p, sp)
    sp, su = (np.clip(x.astype(np.float64), 1e-12, 1 - 1e-12) for x in (sp, su))
    on_good, on_bad = -prior * np.log(sp).mean(), -np.log1p(-su).mean() + prior * np.log1p(-sp).mean()
    return float(on_good), float(on_bad), good + bad if on_bad >= 0 else -bad


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> QualityModel:
    """Minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) by Adam; see ``risk_and_gradient``."""
    knots = np.quantile(np.concatenate([positive[:, SHAPES:], unlabelled[:, SHAPES:]]), np.linspace(0, 1, KNOTS + 2)[1:-1], axis=0).T.astype(np.float32)
    width = SHAPES + MEASURES + MEASURES * (KNOTS + 1)
    model = QualityModel(knots, np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), 0.0)
    wide = np.empty((len(positive) + len(unlabelled), width), np.float32)  # the driver holds the features once, and this
    for part, begin in ((positive, 0), (unlabelled, len(positive))):
        for at in range(0, len(part), 2_000):
            wide[begin + at : begin + min(at + 2_000, len(part))] = model.expand(part[at : at + 2_000])
    model.mean = wide.mean(axis=0)
    model.scale = np.maximum(np.concatenate([wide[:, at : at + 64].std(axis=0) for at in range(0, width, 64)]), np.float32(1e-2))
    wide -= model.mean
    wide /= model.scale
    p, u = wide[: len(positive)], wide[len(positive) :]
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        _, _, gradient = risk_and_gradient(p, u, prior, w, b)
        gradient[:-1] += decay * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weight, model.bias = w, float(b)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of good documents among the unlabelled ones, from these and the positives alone (best bin estimation).

    A first model is fitted on two thirds of both. Of the other third, the share of unlabelled scores above a
    threshold, divided by that of positive ones, bounds the prior from above, and comes near to it where few bad
    documents score so high; the threshold with the least bound is taken, with regard to how sure the shares are.
    """
    held_p, held_u = np.arange(len(positive)) % 3 == 2, np.arange(len(unlabelled)) % 3 == 2
    if not held_p.any() or not held_u.any() or held_p.all() or held_u.all():
        return 0.5
    model = fit(positive[~held_p], unlabelled[~held_u], 0.5, steps=120, rate=0.05)
    p, u = (np.sort(model.scores(x)) for x in (positive[held_p], unlabelled[held_u]))
    over_p, over_u = ((len(x) - np.searchsorted(x, p)) / len(x) for x in (p, u))
    slack = [np.sqrt(np.log(4 / confidence) / (2 * len(x))) for x in (u, p)]
    usable = over_p >= 0.05
    best = int(np.argmin(np.where(usable, (over_u + slack[0] + slack[1]) / np.maximum(over_p, 1e-9), np.inf)))
    return float(np.clip(over_u[best] / over_p[best], 0.02, 0.98))


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for _, texts in text_batches(batch.column("text")) for t in texts]
            yield pa.record_batch([batch.column("positive"), pa.array(rows, pa.binary())], names=["positive", "features"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, features binary")


def train(docs: DataFrame, labels: DataFrame, usable: Column | str, positives: int = 6_000, unlabelled: int = 12_000) -> QualityModel:
    """Fit on ``usable`` rows (a condition on doc_id that holds for both tables): at most about so many trusted positives (``labels.quality`` = 1) and unlabelled documents.

    Both samples are taken by a hash of doc_id, so they are bounded whatever the corpus and the same each time;
    repeated rows count each, null texts are empty, rows without doc_id or quality teach nothing, and labels other
    than 1 are not read. The class prior is estimated (see ``estimate_prior``) and kept within 0.02 and 0.98. Without
    positives or documents every score is 0.5.
    """
    usable = F.expr(usable) if isinstance(usable, str) else usable
    labels = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    labels = labels.where("quality = 1")
    known = labels.count()
    docs = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id", "text")
    total = docs.count()

    def share(column: str, salt: str, most: int, of: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1_000_000)) < int(min(1.0, most / max(1, of)) * 1_000_000)

    good = labels.where(share("doc_id", "positive", positives, known)).select("doc_id").distinct()
    rows = docs.join(F.broadcast(good), "doc_id").select(F.lit(True).alias("positive"), "text")  # bounded by ``positives``
    rows = rows.unionByName(docs.where(share("doc_id", "unlabelled", unlabelled, total)).select(F.lit(False).alias("positive"), "text"))
    sample = _feature_rows(rows).toArrow()
    x, at = np.empty((sample.num_rows, SHAPES + MEASURES), np.float32), 0
    for chunk in sample.column("features").chunks:
        x[at : at + len(chunk)] = np.frombuffer(b"".join(chunk.to_pylist()), np.float32).reshape(len(chunk), SHAPES + MEASURES)
        at += len(chunk)
    positive = np.array(sample.column("positive").to_pylist(), bool)
    del sample
    if not positive.any() or positive.all():
        width = SHAPES + MEASURES + MEASURES * (KNOTS + 1)
        return QualityModel(np.zeros((MEASURES, KNOTS), np.float32), np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width), 0.0)
    order = np.lexsort([*x[:, SHAPES : SHAPES + 4].T, positive])  # rows come in any order; sums shall not
    good, rest = x[order[positive[order]]], x[order[~positive[order]]]
    del x
    mixed = [np.random.default_rng(5).permutation(len(part)) for part in (good, rest)]  # the estimate holds out every third row
    good, rest = good[mixed[0]], rest[mixed[1]]
    return fit(good, rest, estimate_prior(good, rest))


def score(docs: DataFrame, model: QualityModel, output: str = "doc_id") -> DataFrame:
    """The ``output`` column and score (0 to 1, higher: better) of every row of ``docs``, from the whole text alone; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scores(np.stack([features(t) for t in texts])) for _, texts in text_batches(batch.column("text"))]
            yield pa.record_batch([batch.column(output), pa.array(np.concatenate(out) if out else [], pa.float64())], names=[output, "score"])

    return docs.select(output, "text").mapInArrow(run, f"`{output}` {docs.schema[output].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scores(np.stack([features(t) for t in texts])) >= threshold for _, texts in text_batches(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(out) if out else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
