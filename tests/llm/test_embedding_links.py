"""Operator 4 on tables that have links: recall at the threshold, tests per pair, and the query."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from letterloom.llm import embeddings, queries


def at_cosine(u, cosine, rng):
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)


def met(a, b, reach, cosine=0.9):
    """Whether pairs of unit vectors meet in a block within its budget."""
    dims = a.shape[1]
    p, q, out = a @ embeddings.rotation(dims), b @ embeddings.rotation(dims), np.zeros(len(a), bool)
    for low, high in embeddings.blocks_of(dims):
        x, y = p[:, low:high], q[:, low:high]
        out |= (((x - y) ** 2).sum(axis=1) <= (2 - 2 * cosine) * (high - low) / dims + embeddings.SLACK) & embeddings.meets(x, y, reach)
    return out


def share_of_pairs_tested(x, reach):
    """Block tests for each pair of rows, counted from the cells."""
    turned, tests = embeddings._unit(x) @ embeddings.rotation(x.shape[1]), 0
    for low, high in embeddings.blocks_of(x.shape[1]):
        block = turned[:, low:high]
        rows, code, mask = embeddings.cells(block, reach)
        coarse, fine = embeddings.codes(block)
        for cell in np.unique(fine):
            homes = np.bincount(coarse[fine == cell], minlength=1 << embeddings.COARSE)
            comers = np.bincount(code[(mask >> cell) & 1 == 1], minlength=1 << embeddings.COARSE)
            tests += int((homes * comers).sum() - (homes * (homes + 1) // 2).sum())
    return tests / (len(x) * (len(x) - 1) / 2)


def test_recall_and_tests():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6_000, 64))
    u = embeddings._unit(x)
    reach = embeddings.choose_reach(x[:2_000], 0.9)
    assert met(u, at_cosine(u, 0.9, rng), reach).mean() > 0.98  # as bad as a link can be
    assert met(u, at_cosine(u, 0.92, rng), reach).mean() > 0.998
    assert met(u, at_cosine(u, 0.95, rng), reach).all()
    assert share_of_pairs_tested(x, reach) < 0.05
    # from one corner of space: the rotation spreads what it can
    skewed = x * np.linspace(2, 0.1, 64)
    s = embeddings._unit(skewed)
    assert met(s, at_cosine(s, 0.9, rng), embeddings.choose_reach(skewed[:2_000], 0.9)).mean() > 0.98


def test_cells_and_meetings_agree():
    x = np.random.default_rng(5).standard_normal((300, 16)) / 8
    reach = 0.01
    rows, code, mask = embeddings.cells(x, reach)
    coarse, fine = embeddings.codes(x)
    seen = {(r, c): m for r, c, m in zip(rows.tolist(), code.tolist(), mask.tolist(), strict=True)}
    a, b = np.triu_indices(len(x), 1)
    want = embeddings.meets(x[a], x[b], reach)
    comes = lambda i, j: (seen.get((i, int(coarse[j])), 0) >> int(fine[j])) & 1
    for i, j, w in zip(a.tolist(), b.tolist(), want.tolist(), strict=True):
        both = comes(i, j) + comes(j, i)
        assert both == (2 if (coarse[i], fine[i]) == (coarse[j], fine[j]) else int(w))


def test_query_on_a_table_with_links(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1_500, 64))
    u = embeddings._unit(base)
    near = np.concatenate([at_cosine(u[:200], c, rng) for c in (0.93, 0.97, 0.999)])
    x = np.concatenate([base, near * 3, np.repeat(base[:5], 30, axis=0)]).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.nulls(len(x), pa.int32())}), tmp_path / "embeddings.parquet")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(10):
        label = np.array([min(label[i], label[link[i]].min(initial=i)) for i in range(len(x))])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_embedding_dedup(spark, str(tmp_path)).collect()}
    wrong = [i for i in range(len(x)) if got[i] != (int(link[i].sum()), int(label[i]), bool(label[i] == i))]
    assert len(got) == len(x) and link.sum() > 1_500 and len(wrong) <= 0.005 * len(x)
    assert all(got[i][0] <= link[i].sum() for i in range(len(x)))  # no link below the threshold
