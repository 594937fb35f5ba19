"""Operator 4: no link is left out, also at the threshold itself, in cells of several parts and under any cuts of the blocks."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from letterloom.llm import embeddings, queries


def at_cosine(u, cosine, rng):
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)


def table(spark, x):
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))


def links(frame, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame, **options).collect()}


def test_every_pair_at_the_threshold_is_linked(spark, tmp_path):
    rng = np.random.default_rng(21)
    u = embeddings._unit(rng.standard_normal((4_000, 64)))
    x = np.concatenate([u, at_cosine(u, 0.9 + 1e-9, rng)])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}), tmp_path / "embeddings.parquet")
    got = queries.op4_embedding_dedup(spark, str(tmp_path)).collect()
    assert len(got) == 8_000 and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] % 4_000 for r in got)


@pytest.mark.parametrize(("cuts", "group"), [((4, 0), 20_000), ((4, 6), 20_000), ((5, 4), 7), ((8, 2), 3)])
def test_all_links_however_blocks_are_cut(spark, monkeypatch, cuts, group):
    rng = np.random.default_rng(22)
    base = rng.standard_normal((150, 40))
    x = np.concatenate([base, at_cosine(embeddings._unit(base), 0.901, rng) * 2, base[:1] + 0.3 * rng.standard_normal((60, 40))])
    near = embeddings._unit(x) @ embeddings._unit(x).T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
    monkeypatch.setattr(embeddings, "cuts_of", lambda rows: cuts)
    monkeypatch.setattr(embeddings, "RUN", 50)
    monkeypatch.setattr(embeddings, "LINKS", 10)
    assert links(table(spark, x), group=group) == {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))}


def test_a_learned_reach_is_asked_for(spark):
    rng = np.random.default_rng(23)
    u = embeddings._unit(rng.standard_normal((1_500, 64)))
    x = np.concatenate([u, at_cosine(u, 0.9 + 1e-9, rng)])
    found = sum(n for n, _ in links(table(spark, x), recall=0.9).values()) / 3_000
    assert 0.85 < found < 0.97


def test_blocks_are_cut_by_the_rows():
    assert [embeddings.cuts_of(n) for n in (0, 2_000, 51_282, 600_000, 10**9)] == [(4, 0), (4, 0), (4, 5), (6, 6), (8, 6)]
