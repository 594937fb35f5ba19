"""Every query of the training-data operators on the smallest tables, against plain code that follows its contract."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from letterloom.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(sql):
    return duckdb.sql(sql).fetchall()


@pytest.fixture(scope="module")
def documents():
    return sorted(rows_of(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'"))


def ids(name, text, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_token_files(spark, documents):
    want, start = [], 0
    for doc, text, _ in documents:
        own = ids(queries.BYTE_BPE, text, 2)
        want.append((doc, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, queries.op1_token_files(spark, SF).collect())) == want


def test_sharding(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_sharding(spark, SF).collect()}
    assert len(got) == len(documents)
    assert all(got[d]["n_bytes"] == len((t or "").encode()) and got[d]["text_crc32"] == zlib.crc32((t or "").encode()) for d, t, _ in documents if t is not None)
    assert all(queries.SHARDS[r["shard"]] == r["shard_name"] for r in got.values())


def test_repeats(spark, documents):
    seen, want = set(), {}
    for doc, text, _ in documents:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        own = [data[i : i + 50] for i in range(len(data) - 49)]
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + 50] = True
        seen.update(own)
        want[doc] = (len(data), int(gone.sum()), int(np.count_nonzero(np.diff(np.append(0, gone.astype(int))) == 1)))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in queries.op3_suffix_dedup(spark, SF).collect()} == want


def test_embeddings(spark):
    vectors = sorted(rows_of(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'"))
    x = np.array([v if v is not None and len(v) and np.isfinite(np.array(v, float)).all() else [0.0] * len(vectors[0][1]) for _, v in vectors], float)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.maximum(np.outer(size, size), 1e-300) >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    want = {v: (int(near[i].sum()), vectors[label[i]][0], label[i] == i) for i, (v, _) in enumerate(vectors)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op4_embedding_dedup(spark, SF).collect()} == want


def test_counts_and_packing(spark, documents):
    counts = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.op5_token_counts(spark, SF).collect()}
    want = {d: len(ids(queries.BYTE_BPE, t, 2)) - 1 for d, t, _ in documents}
    assert counts == {d: (n, n > 1024) for d, n in want.items()}
    packed = queries.op6_packing(spark, SF).collect()
    whole = {d: ids(queries.WORD_BPE, t, 1) for d, t, _ in documents}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packed} == {
        (d, p // 4096): (p, len(x[p : p + 4096]), zlib.crc32(x[p : p + 4096].tobytes())) for d, x in whole.items() for p in range(0, len(x), 4096)
    }
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 4096 and all(o == sum(n for p, n in b if p < o) for o, _ in b) for b in bins.values())
    assert len(bins) <= 1.02 * -(-sum(map(len, whole.values())) // 4096) + 1


def test_learned_queries(spark, documents):
    lang = {d: x for d, _, x in documents}
    got = queries.op7_language_id(spark, SF).collect()
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]]) > 0.9
    good = dict(rows_of(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL"))
    got = queries.op9_quality(spark, SF).collect()
    assert len(got) == len(documents) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in good]) > 0.8


def test_simhash_and_decontamination(spark, documents):
    got = queries.op8_simhash_dedup(spark, SF).collect()
    fp = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.array([r["doc_id"] for r in got])
    for _ in range(len(got)):
        label = np.array([label[near[i]].min() for i in range(len(got))])
    assert [r["component_id"] for r in got] == label.tolist() and len(got) == len(documents)
    items = rows_of(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'")
    verbatim = {(d, i) for d, t, _ in documents for i, x in items if x and x in (t or "")}
    assert verbatim <= {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, SF).collect()}


def test_sharding_of_no_rows_and_of_a_clashing_column(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    text, number = pa.array(["a", None, "b"]), pa.array([1, 2, None], pa.int64())
    whole = pa.table({"doc_id": number, "text": text, "shard_name": text, "slot": number})
    for n, folder in ((0, "none"), (3, "some")):
        (tmp_path / folder).mkdir()
        pq.write_table(whole.slice(0, n), tmp_path / folder / "documents.parquet")
        got = queries.op2_sharding(spark, str(tmp_path / folder)).collect()
        assert len(got) == n and all(r["shard_name"] == queries.SHARDS[r["shard"]] for r in got)
