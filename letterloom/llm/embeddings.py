"""Operator 4: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors within cosine c are within squared distance 2 - 2c. After a rotation that spreads variance, the
vector is split into blocks of few dimensions; of two close vectors at least one block is within that block's
proportional share of the squared distance. Each block is range-joined: its space is cut into cells by the signs of
its first coordinates, the coarse ones of which make the key that rows are dealt by and the fine ones more cells within
a task. A vector lives in one cell and visits all whose squared distance to it is within the block's budget; of any two
cells just one visits the other. What meets is tested in the block by its budget, then exactly. No pair escapes.

A ball of the whole budget touches most cells of a block, whatever cuts them, where vectors fill all directions: the
tests grow with the square of the rows. How finely a block is cut grows with the rows, up to a bound: a task holds the
rows that live in a part of a cell, and reads those that visit it one run after the other.

With a ``recall`` below 1 the reach of a visit is learned instead, from all vectors: of pairs at exactly the cosine, made
of each vector and fixed random directions, that share has a block within its budget whose cells meet; closer pairs meet
more surely. Spark counts what the pairs need in ``BINS`` steps, so what comes back does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import BROADCAST_ROWS, forest, group_bounds, written
from letterloom.llm.components import connected_components

BLOCK_DIMS = 16
#: Rows that live in a cell and that one task holds; larger cells are dealt into parts, each of which all visitors visit.
GROUP = 20_000
#: Visiting rows that are compared with them at a time, and links of pairs that are held before they are folded.
RUN, LINKS = 20_000, 1_000_000
#: Slack of the pruning tests, which run in rounded arithmetic; the exact test has none.
SLACK, SINGLE_SLACK = 1e-6, 1e-5
#: Coordinates whose signs make the key of a cell, and further ones that cut it within a task, where the reach is learned.
COARSE, FINE = 8, 5
#: As many where no pair may escape, at least and at most, and the rows that a coarse and a fine cell shall hold on average.
CUTS, LIVING = ((4, 8), (0, 6)), (16_384, 100)
#: Share of pairs at exactly the cosine that shall meet in a block within its budget, where the reach is learned.
RECALL = 0.99
#: Pairs that the reach is learned from at least, where ``PARTNERS`` for each vector are enough for that; every vector has one.
PAIRS, PARTNERS = 20_000, 10
#: Steps of the whole budget in which the needs of pairs are counted, and directions that partners are made with.
BINS, DIRECTIONS = 4_096, 4_096


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    return [(i, min(dims, i + BLOCK_DIMS)) for i in range(0, dims, BLOCK_DIMS)]


def cuts_of(rows: int) -> tuple[int, int]:
    """(coarse, fine) coordinates that cut a block of that many rows, where no pair may escape."""
    (least, most), (_, finest) = CUTS
    coarse = min(most, max(least, (-(-rows // LIVING[0]) - 1).bit_length()))
    return coarse, min(finest, max(0, (rows // LIVING[1]).bit_length() - 1 - coarse))


def cut(dims: int, cuts: tuple[int, int] = (COARSE, FINE)) -> tuple[int, int]:
    """Coarse and fine coordinates of a block of ``dims``."""
    coarse = min(cuts[0], dims)
    return coarse, min(cuts[1], dims - coarse)


def codes(part: np.ndarray, cuts: tuple[int, int] = (COARSE, FINE)) -> tuple[np.ndarray, np.ndarray]:
    """(coarse, fine) cell of each row of a block."""
    coarse, fine = cut(part.shape[1], cuts)
    bits = (part[:, : coarse + fine] > 0).astype(np.int64)
    return bits[:, :coarse] @ (1 << np.arange(coarse)[::-1]), bits[:, coarse:] @ (1 << np.arange(fine)[::-1])


def visits(from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of two different cells, whether the first visits: the higher is host when the sum of their numbers is even, else the lower, which spreads the visits."""
    return np.where((from_ + to) % 2 == 0, to > from_, to < from_)


def cells(part: np.ndarray, reach: float, cuts: tuple[int, int] = (COARSE, FINE)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coarse cell, mask of its fine cells) for each row's own coarse cell and those it visits.

    A cell is near if the squared distance to it, of the coordinates whose sign it changes, is within ``reach``.
    Between coarse cells the direction of visits is theirs, within one it is that of the fine cells.
    """
    coarse, fine = cut(part.shape[1], cuts)
    own_coarse, own_fine = codes(part, cuts)
    n, own = len(part), np.arange(len(part))
    spent = np.zeros((n, 1))
    for k in range(coarse + fine):  # a bit more of each cell's number
        x = part[:, k]
        up, square = x > 0, x * x
        sides = np.stack([np.where(up, square, 0), np.where(up, 0, square)], axis=1)
        spent = (spent[:, :, None] + sides[:, None, :]).reshape(n, -1)
    near = (spent <= reach).reshape(n, 1 << coarse, 1 << fine)
    inner = np.arange(1 << fine)
    home = near[own, own_coarse] & ((inner == own_fine[:, None]) | visits(own_fine[:, None], inner))
    near &= visits(own_coarse[:, None], np.arange(1 << coarse))[:, :, None]
    near[own, own_coarse] = home
    packed = np.zeros((n, 1 << coarse, 8), np.uint8)
    bits = np.packbits(near, axis=2, bitorder="little")
    packed[:, :, : bits.shape[2]] = bits
    mask = packed.view("<i8")[:, :, 0]
    rows, code = np.nonzero(mask)
    return rows, code, mask[rows, code]


def meets(a: np.ndarray, b: np.ndarray, reach: float, cuts: tuple[int, int] = (COARSE, FINE)) -> np.ndarray:
    """Whether the cells of rows a and b of a block meet: they are one, or the one that visits reaches the other."""
    coarse, fine = cut(a.shape[1], cuts)
    (ca, fa), (cb, fb) = codes(a, cuts), codes(b, cuts)
    first = np.where(ca == cb, visits(fa, fb), visits(ca, cb))
    spent = np.zeros(len(a))
    for k in range(coarse + fine):  # in the order of ``cells``, so that sums are the same
        x = np.where(first, a[:, k], b[:, k])
        spent = np.where((a[:, k] > 0) != (b[:, k] > 0), spent + x * x, spent)
    return ((ca == cb) & (fa == fb)) | (spent <= reach)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top  # against overflow and underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def needs(a: np.ndarray, w: np.ndarray, cosine: float, turn: np.ndarray) -> np.ndarray:
    """For unit vectors and partners at exactly ``cosine`` in directions ``w``: the least reach with which they meet in a block within its budget, else infinite."""
    dims = a.shape[1]
    w = w - (w * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * _unit(w)
    a, b = a @ turn, b @ turn
    need = np.full(len(a), np.inf)
    for low, high in blocks_of(dims):
        p, q = a[:, low:high], b[:, low:high]
        cuts = sum(cut(high - low))
        crossed = np.where((p[:, :cuts] > 0) != (q[:, :cuts] > 0), p[:, :cuts] ** 2, 0).sum(axis=1)
        near = ((p - q) ** 2).sum(axis=1) <= (2 - 2 * cosine) * (high - low) / dims + SLACK
        need = np.minimum(need, np.where(near, crossed, np.inf))
    return need


def choose_reach(x: np.ndarray, cosine: float, recall: float = RECALL, seed: int = 11) -> float:
    """The reach with which that share of pairs at exactly ``cosine`` meet in a block within its budget, for vectors at hand; see the module."""
    dims = x.shape[1]
    if dims < 2:
        return 0.0
    a = np.repeat(_unit(x), PARTNERS, axis=0)
    need = needs(a, np.random.default_rng(seed).standard_normal(a.shape), cosine, rotation(dims))
    return float(np.quantile(need, recall, method="higher")) + SLACK


def learned_reaches(classes: DataFrame, cosine: float, recall: float = RECALL) -> dict[int, float]:
    """As ``choose_reach`` from every row of ``classes`` (class_key, embedding), by length of vector, rounded up to a step of the budget."""
    partners = min(PARTNERS, max(1, -(-PAIRS // max(1, classes.count()))))
    budget = 2 - 2 * cosine
    step = max(budget, SLACK) / BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                part = whole.slice(at, 2_000)
                sizes = pc.list_value_length(part.column("embedding")).to_numpy(zero_copy_only=False)
                for dims in np.unique(sizes).tolist():
                    if dims not in turns:
                        directions = np.random.default_rng(11).standard_normal((min(DIRECTIONS, max(64, (1 << 22) // dims)), dims))
                        turns = {dims: (rotation(dims), directions)}
                    turn, directions = turns[dims]
                    batch = part.filter(pa.array(sizes == dims))
                    unit, place = _unit(_vectors(batch.column("embedding"), dims)), batch.column("place").to_numpy()
                    for k in range(partners):
                        need = needs(unit, directions[(place + k) % len(directions)], cosine, turn) if dims > 1 else np.zeros(len(unit))
                        bins, n = np.unique(np.ceil(np.minimum(need / step, BINS)).astype(np.int64), return_counts=True)
                        yield pa.record_batch([pa.array(np.full(len(bins), dims)), pa.array(bins), pa.array(n)], names=["dims", "bin", "n"])

    placed = classes.select("embedding", F.pmod(F.xxhash64("class_key"), F.lit(1 << 40)).alias("place"))
    counted = placed.mapInArrow(run, "dims long, bin long, n long").groupBy("dims", "bin").agg(F.sum("n").alias("n"))
    found: dict[int, list[tuple[int, int]]] = {}
    for r in counted.collect():  # BINS + 1 rows at most for each length
        found.setdefault(r["dims"], []).append((r["bin"], r["n"]))
    out = {}
    for dims, rows in found.items():
        bins, n = np.array(sorted(rows)).T
        enough = bins[np.searchsorted(np.cumsum(n), recall * n.sum())]
        out[dims] = float(enough * step) + SLACK if dims > 1 else 0.0
    return out


def budgets_of(dims: int, cosine: float) -> list[float]:
    """Each block's share of the squared distance, one of which two vectors of that cosine keep to."""
    return [(2 - 2 * cosine) * (high - low) / dims + SLACK for low, high in blocks_of(dims)]


def reaches_of(reaches: dict[int, float], dims: int, cosine: float) -> list[float]:
    """How far a row visits in each block: the learned reach of vectors of that length, else the whole budget, which no pair within it escapes."""
    return [reaches.get(dims, budget + SLACK) for budget in budgets_of(dims, cosine)]


def _by_length(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows with vectors of that length), ``rows`` at most at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            part = whole.slice(at, rows)
            sizes = pc.list_value_length(part.column("embedding")).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                yield dims, part.filter(pa.array(sizes == dims))


def _entries(vectors: DataFrame, cosine: float, reaches: dict[int, float], cuts: tuple[int, int]) -> DataFrame:
    """key (length, block and coarse cell), visits, mask of fine cells, own fine cell, node, members, embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for dims, batch in _by_length(batches, max(64, min(2_000, (1 << 20) >> sum(cuts)))):
            if dims not in turns:
                turns = {dims: rotation(dims)}
            turned, reach = _unit(_vectors(batch.column("embedding"), dims)) @ turns[dims], reaches_of(reaches, dims, cosine)
            for number, (low, high) in enumerate(blocks_of(dims)):
                block = turned[:, low:high]
                rows, code, mask = cells(block, reach[number], cuts)
                own, fine = codes(block, cuts)
                take = pa.array(rows)
                yield pa.record_batch([pa.array(code | (number << 16) | (dims << 36)), pa.array(code != own[rows]), pa.array(mask), pa.array(fine[rows].astype(np.int8)), *(batch.column(c).take(take) for c in ("node", "members", "embedding"))], names=["key", "visits", "mask", "fine", "node", "members", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("node", "members", "embedding").mapInArrow(run, f"key long, visits boolean, mask long, fine byte, node long, members long, embedding {kind}")


def _living(vectors: DataFrame, cuts: tuple[int, int]) -> DataFrame:
    """key, n: the rows that live in each coarse cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for dims, batch in _by_length(batches, 2_000):
            if dims not in turns:
                turns = {dims: rotation(dims)}
            turned = _unit(_vectors(batch.column("embedding"), dims)) @ turns[dims]
            for number, (low, high) in enumerate(blocks_of(dims)):
                code, n = np.unique(codes(turned[:, low:high], cuts)[0], return_counts=True)
                yield pa.record_batch([pa.array(code | (number << 16) | (dims << 36)), pa.array(n)], names=["key", "n"])

    return vectors.select("embedding").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _in_parts(entries: DataFrame, living: DataFrame, group: int) -> DataFrame:
    """Entries with ``part`` and ``guest``: rows living in a cell are dealt into parts of about ``group``, and are guests of its other parts, as visitors are of all."""
    hot = written(living.where(F.col("n") > group).select("key", F.ceil(F.col("n") / group).cast("int").alias("_parts")), "hot-cells")
    found = hot.count()  # at most the rows and blocks divided by the group
    if not found:
        return entries.withColumns({"part": F.lit(0), "guest": F.col("visits")})
    dealt = entries.join(F.broadcast(hot) if found <= BROADCAST_ROWS else hot, "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return dealt.select(*entries.columns, "part", (F.col("visits") | (F.col("part") != F.col("_own"))).alias("guest"))


class _Rows:
    """Rows of a cell: what a comparison needs of each."""

    def __init__(self, data: pa.Table, dims: int, low: int, high: int, turn: np.ndarray):
        self.node, self.members, self.mask, self.fine, self.foreign = (data.column(c).to_numpy() for c in ("node", "members", "mask", "fine", "visits"))
        self.x = _vectors(data.column("embedding").combine_chunks(), dims)
        self.block = np.empty((len(self.x), high - low))
        for at in range(0, len(self.x), 4_096):
            self.block[at : at + 4_096] = _unit(self.x[at : at + 4_096]) @ turn[:, low:high]
        single = self.block.astype(np.float32)
        square = (single * single).sum(axis=1, keepdims=True)
        one = np.ones_like(square)
        # the product of a row of the first and one of the second is their squared distance, about
        self.left, self.right = np.hstack([-2 * single, square, one]), np.hstack([single, one, square])


def _compare(homes: _Rows, others: _Rows, number: int, turn: np.ndarray, cosine: float, reach: list[float], cuts: tuple[int, int]) -> np.ndarray | None:
    """(node, node of its tree's root, members linked) of rows with links that block ``number`` is the first to show.

    A row of ``others`` is compared with the rows of ``homes`` that live in the fine cells of its mask, tile by tile:
    first the block's budget, then the exact cosine. Two rows of one fine cell would meet in both directions, so the
    direction from the greater to the smaller node counts.
    """
    dims = turn.shape[0]
    parts, budgets = blocks_of(dims), budgets_of(dims, cosine)
    n = len(homes.node) + (len(others.node) if others is not homes else 0)
    shift = n - len(others.node)  # rows of ``others`` have numbers behind those of ``homes``
    linked, root = np.zeros(n, np.int64), np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal root
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        np.add.at(linked, a, others.members[b])
        np.add.at(linked, b + shift, homes.members[a])
        trees = np.flatnonzero(root != np.arange(n))
        root = forest(n, np.append(a, trees), np.append(b + shift, root[trees]))

    for cell in np.unique(homes.fine).tolist():
        inside, comers = np.flatnonzero(homes.fine == cell), np.flatnonzero((others.mask >> cell) & 1)
        right = others.right[comers].T
        for i in range(0, len(inside), 1_024):
            rows = inside[i : i + 1_024]
            left = homes.left[rows]
            for j in range(0, len(comers), 2_048):
                near = left @ right[:, j : j + 2_048]
                at = np.flatnonzero(near <= budgets[number] + SINGLE_SLACK)
                a, b = rows[at // near.shape[1]], comers[j + at % near.shape[1]]
                keep = others.foreign[b] | (others.fine[b] != cell) | (homes.node[a] < others.node[b])
                a, b = a[keep], b[keep]
                for at in range(0, len(a), 20_000):
                    p, q = a[at : at + 20_000], b[at : at + 20_000]
                    ok = ((homes.block[p] - others.block[q]) ** 2).sum(axis=1) <= budgets[number]
                    p, q = p[ok], q[ok]
                    x, y = homes.x[p], others.x[q]
                    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                    sound = np.isfinite(norm).all() and norm.all()
                    u, v = _unit(x), _unit(y)
                    ok = ((x * y).sum(axis=1) / norm if sound else (u * v).sum(axis=1)) >= cosine
                    p, q, u, v = p[ok], q[ok], u[ok] @ turn, v[ok] @ turn
                    first = np.ones(len(p), bool)
                    for earlier in range(number):  # a pair that has met in an earlier block counts there
                        w, h = parts[earlier]
                        first &= (((u[:, w:h] - v[:, w:h]) ** 2).sum(axis=1) > budgets[earlier]) | ~meets(u[:, w:h], v[:, w:h], reach[earlier], cuts)
                    held.append((p[first], q[first]))
                    if sum(len(h[0]) for h in held) > LINKS:
                        fold()
    if held:
        fold()
    here = np.flatnonzero(linked)
    if not len(here):
        return None
    node = homes.node if others is homes else np.append(homes.node, others.node)
    return np.stack([node[here], node[root[here]], linked[here]])


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _links(found: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
    some = [f for f in found if f is not None]
    if some:
        yield pa.record_batch([pa.array(c) for c in np.concatenate(some, axis=1)], names=["a", "b", "linked"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, group: int = GROUP, recall: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding: array of numbers).

    Equal vectors are one class: each member links with all others, by count. Classes that meet under a key are
    compared exactly, in double precision; a link counts where it is first met, so nothing is counted twice and
    no list of all pairs is made: a task emits a count per member and the links of a spanning forest. All links are
    found, unless a ``recall`` below 1 is asked for, which learns a shorter reach (see the module). Null, empty,
    zero and non-finite vectors, those with null components and rows without vec_id link with nothing; vectors of
    different lengths have no cosine and don't link. Rows that repeat a vec_id are vectors of their own: each counts
    as a link of the others near it. Other columns are not read.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = F.expr("exists(embedding, x -> x is null or isnan(x) or abs(x) = double('Infinity')) or not exists(embedding, x -> x <> 0)")
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    usable = usable.withColumn("class_key", F.sha2(F.to_json("embedding").cast("binary"), 256))
    classes = usable.groupBy("class_key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members"), F.any_value("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    reaches, cuts = (learned_reaches(classes, cosine, recall), (COARSE, FINE)) if recall < 1 else ({}, cuts_of(classes.count()))
    entries = _in_parts(_entries(classes, cosine, reaches, cuts), _living(classes, cuts), group)
    keys = ["key", "part"]
    entries = entries.repartition(*keys).sortWithinPartitions(*keys, "guest", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        group_, living, homes = None, [], None

        def compare(kind: int, guests: pa.Table | None) -> np.ndarray | None:
            """Guests with the rows living here, or these among themselves."""
            nonlocal turns, homes
            dims, number = kind >> 36, (kind >> 16) & 0xFFFFF
            if dims not in turns:
                turns = {dims: rotation(dims)}
            turn, (low, high) = turns[dims], blocks_of(dims)[number]
            if homes is None:
                homes = _Rows(pa.concat_tables(living), dims, low, high, turn)
            others = homes if guests is None else _Rows(guests, dims, low, high, turn)
            return _compare(homes, others, number, turn, cosine, reaches_of(reaches, dims, cosine), cuts)

        for data in _runs(batches, RUN):
            columns, guest = [data.column(k).to_numpy() for k in keys], data.column("guest").to_numpy()
            out: list[np.ndarray | None] = []
            bounds = group_bounds(*columns, guest).tolist()
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                here = tuple(int(c[begin]) for c in columns)
                if here != group_:
                    if living and homes is None:  # nobody came
                        out.append(compare(group_[0], None))
                    group_, living, homes = here, [], None
                rows = data.slice(begin, end - begin)
                if not guest[begin]:
                    living.append(rows)
                elif living:
                    if homes is None:
                        out.append(compare(here[0], None))
                    out.append(compare(here[0], rows))
            yield from _links(out)
        if living and homes is None:
            yield from _links([compare(group_[0], None)])

    met = written(entries.mapInArrow(run, "a long, b long, linked long"), "met")
    linked = met.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    parts = connected_components(met.where("a <> b").select("a", "b"))
    # written before they are joined, so that adaptive execution can split a component or class that very many rows have
    marked = classes.join(linked, "node", "left").join(parts, "node", "left")
    marked = written(marked.select("class_key", "first", (F.coalesce("linked", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "linked-classes")
    smallest = written(marked.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    found = written(marked.join(smallest, "component").select("class_key", "n_links", "component_id"), "found-classes")
    found = usable.select("vec_id", "class_key").join(found, "class_key").select("vec_id", "n_links", "component_id")
    alone = vectors.where(F.col("vec_id").isNull() | F.col("embedding").isNull() | (F.size("embedding") <= 0) | F.coalesce(bad, F.lit(True)))
    out = found.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
