"""Operator 12: whitening of embeddings by a polarisation covariance.

The variance of a sum is Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), so sums of squares alone give every covariance:
one per dimension and one per pair of dimensions. Entries are made whole numbers first, and centred by the whole
number next to their mean before they are squared, so the squares are small and their sums exact; what is left of
the mean, below one half, is settled exactly in whole numbers of any size on the driver, which gets dims * (dims + 1) / 2
sums whatever the number of rows. The eigenvectors of the assembled covariance whiten the rows, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers above this have no squares of sums that 38 digits hold for a thousand million rows.
LARGEST = 2**42
ROWS = 4_000


def _whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, whole numbers) of the usable vectors of a batch, by length."""
    column = batch.column("embedding")
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dims)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64(), safe=False)
        x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # null entries become NaN
        ok = np.isfinite(x).all(axis=1)
        x = np.floor(SCALE * x[ok]) + SHIFT
        if x.size and np.abs(x).max() > LARGEST:
            raise ValueError(f"an entry beyond {LARGEST / SCALE:g} has no exact sums")
        yield dims, rows[ok], x.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _sum_rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's exact sums, one row each."""
    for dims, sums in totals.items():
        numbers = pa.array([str(v) for v in sums.tolist()]).cast(pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(np.full(len(sums), dims, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), numbers], names=["dims", "place", "total"])


_SUMS = "dims int, place int, total decimal(38,0)"


def _added(parts: DataFrame) -> dict[int, list[int]]:
    """Sums over all tasks, per vector length, in order of place: as many as a length has places, not rows."""
    rows = parts.groupBy("dims", "place").agg(F.sum("total").alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["dims"], r["place"])):
        out.setdefault(r["dims"], []).append(int(r["total"]))
    return out


def column_sums(vectors: DataFrame) -> dict[int, list[int]]:
    """Per vector length: the number of usable vectors, then the sum of each dimension's whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            for dims, rows, x in _whole(batch):
                part = np.append(len(rows), x.sum(axis=0)).astype(object)  # 4 000 times 2 ** 42 fits 64 bits
                totals[dims] = totals.get(dims, 0) + part
        yield from _sum_rows(totals)

    return _added(vectors.select("embedding").mapInArrow(run, _SUMS))


def _squares(z: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the squares of z_i, then of z_i + z_j for i < j, as Python's whole numbers."""
    top = 2 * int(np.abs(z).max(initial=0))
    if len(z) * top * top < 2**53:
        z = z.astype(np.float64)  # every partial sum is a whole number that a double holds
    elif len(z) * top * top >= 2**63:
        z = z.astype(object)
    out = [(z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        w = z[:, i + 1 :] + z[:, i : i + 1]
        out.append((w * w).sum(axis=0) if w.dtype == object else np.einsum("ij,ij->j", w, w))
    return np.array([int(v) for part in out for v in part.tolist()], object)


@dataclass
class Fit:
    """What whitening needs of the vectors of one length."""

    n: int
    sums: list[int]
    centre: np.ndarray  #: the whole number next to each mean
    rest: list[int]  #: sums - n * centre
    values: np.ndarray  #: eigenvalues of the kept components, falling
    vectors: np.ndarray  #: their unit eigenvectors, as columns
    trace: float

    @property
    def usable(self) -> np.ndarray:
        """Components with a variance above rounding."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the square roots of their eigenvalues; NaN where there is no variance."""
        off = np.array([float(Fraction(r, self.n)) for r in self.rest])
        ok = self.usable
        return np.where(ok, (((x - self.centre) - off) @ self.vectors) / np.sqrt(np.where(ok, self.values, 1.0)), np.nan)


def covariance(n: int, squares: list[int], rest: list[int]) -> np.ndarray:
    """The covariance (divisor n) from sums of squares of values whose own sums are ``rest``, each entry rounded once."""
    dims = len(rest)
    # n * sum of (v - mean)^2 = n * sum of v^2 - (sum of v)^2, in whole numbers
    own = [n * q - r * r for q, r in zip(squares, rest, strict=False)]
    out = np.empty((dims, dims))
    at = dims
    for i in range(dims):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, dims):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**2)
            at += 1
    return out


def fit(vectors: DataFrame, components: int = 32) -> dict[int, Fit]:
    """A fit for each length of vectors (all of one length, as a rule)."""
    counted = column_sums(vectors)
    centres = {d: np.array([round(Fraction(s, c[0])) for s in c[1:]], np.int64) for d, c in counted.items() if c[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            for dims, rows, x in _whole(batch):
                if len(rows):
                    totals[dims] = totals.get(dims, 0) + _squares(x - centres[dims])
        yield from _sum_rows(totals)

    squares = _added(vectors.select("embedding").mapInArrow(run, _SUMS))
    out = {}
    for dims, centre in centres.items():
        n, sums = counted[dims][0], counted[dims][1:]
        rest = [s - n * int(m) for s, m in zip(sums, centre, strict=True)]
        v = covariance(n, squares[dims], rest)
        values, turned = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        turned = turned[:, order]
        turned = turned * np.where(turned[np.abs(turned).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # one sign everywhere
        out[dims] = Fit(n, sums, centre, rest, values[order], turned, float(np.trace(v)))
    return out


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Per length, the largest entry of |covariance of the whitened rows - identity|, measured over all rows.

    Components without variance are left out. A task centres by its own means; the sums of tasks are joined exactly
    as far as doubles go, since the means are next to zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        mean: dict[int, np.ndarray] = {}
        cross: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            for dims, rows, x in _whole(batch):
                if not len(rows):
                    continue
                y = fits[dims].whiten(x)[:, fits[dims].usable]
                m, n = y.mean(axis=0), count.get(dims, 0)
                c = (y - m).T @ (y - m)
                if n:
                    step = m - mean[dims]
                    c = c + cross[dims] + np.outer(step, step) * (n * len(y) / (n + len(y)))
                    m = mean[dims] + step * (len(y) / (n + len(y)))
                count[dims], mean[dims], cross[dims] = n + len(y), m, c
        for dims, n in count.items():
            # the task's share of the uncentred sums: their centre is zero up to rounding
            numbers = np.concatenate([n * mean[dims], (cross[dims] + n * np.outer(mean[dims], mean[dims])).ravel()])
            yield pa.record_batch([pa.array(np.full(len(numbers), dims, np.int32)), pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], names=["dims", "place", "total"])

    parts = vectors.select("embedding").mapInArrow(run, "dims int, place int, total double")
    found: dict[int, list] = {}
    for r in parts.groupBy("dims", "place").agg(F.sum("total").alias("total")).collect():
        found.setdefault(r["dims"], []).append((r["place"], r["total"]))
    out = dict.fromkeys(fits, 0.0)
    for dims, numbers in found.items():
        v = np.array([x for _, x in sorted(numbers)]) / fits[dims].n
        k = int(fits[dims].usable.sum())
        if k:
            out[dims] = float(np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k)).max())
    return out


def _deviation(x: np.ndarray, fitted: Fit) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2; None where it is no long."""
    z = x - fitted.centre
    about = (fitted.n * z.astype(np.float64) - np.array(fitted.rest, np.float64)) ** 2
    about = about.sum(axis=1)
    wrap = np.array([r % 2**64 for r in fitted.rest], np.uint64)
    off = z.astype(np.uint64) * np.uint64(fitted.n % 2**64) - wrap  # arithmetic modulo 2^64 is exact for sums that fit
    found = (off * off).sum(axis=1).tolist()
    unsure = np.abs(about - 2.0**63) < 2.0**63 * 1e-6
    out: list[int | None] = [v if a < 2.0**63 else None for v, a in zip(found, about.tolist(), strict=True)]
    for k in np.flatnonzero(unsure).tolist():
        exact = sum((fitted.n * v - r) ** 2 for v, r in zip(z[k].tolist(), fitted.rest, strict=True))
        out[k] = exact if exact < 2**63 else None
    return out


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row of ``vectors`` (vec_id, embedding) and component.

    Vectors that are null, empty or hold null or non-finite entries are left out. Vectors of different lengths have
    no common dimensions: each length is fitted and whitened by itself. A repeated row or vec_id counts each time, a
    null vec_id stays null. A component without variance (fewer different vectors than dimensions) has no direction:
    its ``whitened`` is null; without any variance ``explained`` is null, too. A ``deviation`` that no long holds is
    null. Entries beyond 2^36 raise. Other columns are not read.
    """
    vectors = vectors.select("vec_id", "embedding")
    fits = fit(vectors, components)
    errors = identity_errors(vectors, fits)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for dims, rows, x in _whole(batch):
                if not len(rows):
                    continue
                y = fits[dims].whiten(x)
                flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), flat)
                columns = [batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), dims, np.int32)), pa.array(_deviation(x, fits[dims]), pa.int64()), lists]
                yield pa.record_batch(columns, names=["vec_id", "dims", "deviation", "whitened"])

    rows = vectors.mapInArrow(run, f"vec_id {kind}, dims int, deviation long, whitened array<double>")
    rows = rows.select("dims", "vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    # one row a length and component, from the fits; as literals they need no join
    facts = {d: (f.n, errors[d], [float(e) / f.trace if f.trace > 0 else None for e in f.values]) for d, f in fits.items()}

    def of_length(pick, kind: str):
        found = F.lit(None).cast(kind)
        for d, fact in facts.items():
            found = F.when(F.col("dims") == d, pick(fact)).otherwise(found)
        return found

    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), of_length(lambda f: F.lit(f[0]).cast("long"), "long").alias("n"), "deviation", "whitened",
        of_length(lambda f: F.get(F.array(*(F.lit(e).cast("double") for e in f[2])), F.col("at")), "double").alias("explained"),
        of_length(lambda f: F.lit(f[1]), "double").alias("identity_error"),
    )
