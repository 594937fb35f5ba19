"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from letterloom.llm import bwt, components, dac, decontam, embeddings, language, packing, quality, repeats, sharding, simhash, token_counts, token_files
from letterloom.llm.common import scratch, split_hot, written

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RNG = np.random.default_rng(3)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmnoprstuvé"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCAB, n))


SHARED = prose(40)
TEXTS = [
    None, "", " ", "\n\t", "a", "x" * 50, "Hello, World. It's <|endoftext|> here", "  two  spaces \n line", "É. ﬁ İ Σ ſ 中文 😀 ½", prose(30), prose(2000),
    prose(20) + " " + SHARED + " " + prose(20), SHARED + " " + prose(10), prose(5) + " " + SHARED, "tail" + SHARED + "tail", "ab" * 400, "ab" * 399, prose(9000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 101, t, f"s{i}", float(i), "clash") for i, t in enumerate(TEXTS)]
    rows += [(500, TEXTS[9], "copy", 1.0, "clash"), (500, TEXTS[9], "copy", 1.0, "clash"), (None, TEXTS[11], "no id", 1.0, "clash"), (501, TEXTS[10], "copy", 2.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, spans string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def empty(docs):
    return docs.where("1 = 0")


# 1
@pytest.mark.parametrize("widths", [(12, 4), (8, 8), (1, 3), (5,)])
def test_dac_random_access(widths):
    ids = np.concatenate([RNG.integers(0, 50_257, 3_000), [0, 0, 65_535, 1]]).astype(np.uint32)
    file = dac.Reader(dac.encode(ids, [7, None, -3], np.array([10, 10, len(ids)]), widths))
    at = RNG.permutation(len(ids))
    assert (file[at] == ids[at]).all() and (file.span(0, len(ids)) == ids).all()
    assert file.doc_ids == [7, None, -3] and len(file.document(1)) == 0 and (file.document(2) == ids[10:]).all()
    assert [d.tolist() for d in file.documents(7)] == [file.document(k).tolist() for k in range(3)]
    for a, b in ((0, 0), (3, 4), (511, 513), (1000, 2999)):
        assert (file.span(a, b) == ids[a:b]).all()
    assert dac.Reader(dac.encode(np.zeros(0, np.uint32), [], np.zeros(0))).n_ids == 0


def test_token_files(spark, docs, rows):
    folder = scratch(spark, "t")
    token_files.write_token_files(docs, folder, BYTE, 2, ids_per_file=500)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, folder).collect())
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = np.array(ids_of(BYTE, t) + [2], "<u4")
        want.append((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    folder = scratch(spark, "t")
    token_files.write_token_files(empty(docs), folder, BYTE, 2)
    assert token_files.read_token_files(spark, folder).count() == 0


# 2
def test_sharding(spark, docs, rows):
    table = sharding.fill_table(["b", "a", "c"], 101)
    assert sorted(Counter(table.tolist()).values()) == [33, 34, 34]
    # brute force: turns by name, each walking its own order
    names, taken = ["a", "b", "c"], {}
    walks = {n: [(sharding._number(f"offset:{n}") % 101 + j * (sharding._number(f"skip:{n}") % 100 + 1)) % 101 for j in range(101)] for n in names}
    while len(taken) < 101:
        for n in names:
            free = [s for s in walks[n] if s not in taken]
            if free:
                taken[free[0]] = n
    assert [["b", "a", "c"][i] for i in table] == [taken[s] for s in range(101)]
    more = sharding.fill_table(["a", "b", "c", "d"], 101)
    moved = sum("bac"[x] != "abcd"[y] for x, y in zip(table, more, strict=True))
    assert moved <= 45
    got = sharding.assign_shards(docs.withColumnRenamed("source", "slot"), "doc_id", ["a", "b"], 101).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["slot"] == int(hashlib.md5(str("" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:15], 16) % 101
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


# 3
def brute_repeats(rows, n=50):
    first, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1) if d is not None else ():
            first[b[p : p + n]] = min(d, first.get(b[p : p + n], d))
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1) if d is not None else ():
            if first[b[p : p + n]] < d:
                gone[p : p + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_repeats(spark, docs, rows):
    report = repeats.removal_report(repeats.repeated_spans(docs))
    got = sorted(str(tuple(r)) for r in report.collect())
    assert got == brute_repeats(rows) and report.where("n_removed > 0").count() >= 5
    cleaned = repeats.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    assert cleaned.where("doc_id = 0").first()["text"] is None
    assert repeats.remove_repeats(empty(docs)).count() == 0


def test_merged_transforms():
    strings = [bytes(RNG.choice(list(b"ab"), RNG.integers(7, 40)).astype(np.uint8)) for _ in range(60)] + [b"abababab"] * 2
    values = RNG.integers(0, 1000, len(strings))
    for depth in (4, 7):
        for s, got in zip(strings, bwt.repeated_minima(strings, values, depth), strict=True):
            assert got.tolist() == [min(v for o, v in zip(strings, values, strict=True) if s[p : p + depth] in o) for p in range(len(s) - depth + 1)]
    assert bwt.repeated_minima([b"abcdefgh"], np.array([5]), 4)[0].tolist() == [5] * 5


# 4
def test_embeddings(spark, monkeypatch):
    base = RNG.standard_normal((120, 24))
    x = np.concatenate([base, base[:30] + 0.15 * RNG.standard_normal((30, 24)), base[:10] * 3, np.repeat(base[:1], 40, axis=0) + 0.05 * RNG.standard_normal((40, 24))]).astype(np.float32)
    data = [(i, v.tolist(), "kept") for i, v in enumerate(x)]
    odd = [(900, None, ""), (901, [0.0] * 24, ""), (902, [float("nan")] + [1.0] * 23, ""), (903, [None] + [1.0] * 23, ""), (904, [float("inf")] + [1.0] * 23, ""), (905, [], "")]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, kept string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(x))])
    want = {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))} | {i: (0, i) for i, *_ in odd}
    for group in (40_000, 20):  # and with groups split into pairs of blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(vectors, group=group).collect()}
        assert got == want
    assert embeddings.near_duplicates(vectors.where("vec_id > 899")).where("kept").count() == 6
    assert embeddings.near_duplicates(vectors.where("1 = 0")).count() == 0
    rows = [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0]), (4, [2.0, 4.0]), (4, [1.0, 2.1]), (4, [-1.0, 0.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])]  # lengths differ, ids and rows repeat
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 3, 2), (2, 3, 2), (3, 1, 1), (4, 0, 4), (4, 3, 2), (4, 3, 2)]


# 5
def test_token_counts(docs, rows):
    got = sorted(tuple(-1 if v is None else v for v in r) for r in token_counts.count_tokens(docs, BYTE).collect())
    want = sorted((-1 if d is None else d, len((t or "").encode()), n := len(ids_of(BYTE, t)), n > 1024) for d, t in rows)
    assert got == want
    proved = token_counts.whole_tokens(BYTE)
    tok = Tokenizer.from_file(BYTE)
    assert len(proved) > 40_000 and all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in list(proved)[::997])
    assert token_counts.count_tokens(empty(docs), BYTE).count() == 0


# 6
def test_packing(spark, docs, rows):
    capacity = 64
    pieces = written(packing.token_pieces(docs, WORD, 1, capacity), "p")
    packed = packing.pack(pieces, capacity).collect()
    per = {}
    for r in packed:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(ids_of(WORD, t)) + 1 for _, t in rows)
    assert sum(r["length"] for r in packed) == total and len(per) <= -(-total // capacity) + 1
    one = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u4").tolist() for r in packed}
    for d, t in rows:
        ids = ids_of(WORD, t) + [1]
        for p in range(0, len(ids), capacity):
            assert one[d, p] == ids[p : p + capacity]
    whole = packing.sequences(packing.pack(pieces, capacity)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(written(packing.token_pieces(empty(docs), WORD, 1), "p")).count() == 0


def test_plan_is_tight():
    for _ in range(20):
        counts = {int(k): int(v) for k, v in zip(RNG.integers(1, 101, 30), RNG.integers(1, 50, 30), strict=True)}
        runs, n = packing.plan_sequences(counts, 100)
        used = Counter()
        for length, first, each, sequence, offset in runs.tolist():
            assert first == used[length] or first <= counts[length]
        bins: list[int] = []
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):  # first fit decreasing
            at = next((i for i, gap in enumerate(bins) if gap >= length), None)
            if at is None:
                bins.append(100 - length)
            else:
                bins[at] -= length
        assert -(-sum(k * v for k, v in counts.items()) // 100) <= n <= len(bins) * 1.01 + 1
    # the smallest piece goes for two that close the gap: 60 + 30 leaves 10, 60 + 22 + 18 leaves none
    runs, n = packing.plan_sequences({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    assert n == 2 and {r[0] for r in runs.tolist() if r[3] == 0} == {60, 22, 18}


# 7
def test_language(spark):
    words = {"aa": ["kala", "miro", "tenso"], "bb": ["schn", "wurz", "dopfe"]}
    data = [(i, " ".join(RNG.choice(words[k], 20)), k, "clash") for i, k in enumerate(["aa", "bb"] * 40)] + [(100, "kala miro", None, ""), (101, None, "aa", ""), (102, "12 .", "bb", ""), (103, "", "aa", ""), (104, "éé", "bb", "")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = language.train(docs, docs["doc_id"] % 4 != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert all(got[i][0] == k for i, k in enumerate(["aa", "bb"] * 40)) and got[100][0] == "aa"
    assert [got[i][0] for i in (101, 102, 103)] == ["und"] * 3 and all(0 <= s <= 1 for _, s in got.values())
    assert language.identify(docs, language.train(docs, docs["doc_id"] < 0)).count() == len(data)
    keys, begins, ends = language.gram_keys(["Ab c", "", "x"])
    assert [int(e - b) for b, e in zip(begins, ends, strict=True)] == [5, 1, 2]


def test_language_filter_against_plain_sets():
    """Hits of a filter written with Python integers and sets, of over 32 languages, corrected by its measured fill."""
    names = [f"l{k:02d}" for k in range(40)]
    grams = np.unique(RNG.integers(0, 1 << 40, 300).astype(np.uint64))
    owners = [set(RNG.choice(40, RNG.integers(1, 4)).tolist()) for _ in grams]
    texts = ["Ab kala miro tenso", "", "x", "12 ab ab"]
    keys, begins, ends = language.gram_keys(texts)
    grams = np.unique(np.concatenate([grams, keys[::2]]))
    owners = [set(RNG.choice(40, RNG.integers(1, 4)).tolist()) for _ in grams]
    masks = np.array([[sum(1 << (k - 32 * word) for k in own if k // 32 == word) for own in owners] for word in (0, 1)], np.uint32)
    model = language.LanguageModel.build(names, 0, grams, masks)
    slots = {k: set() for k in range(40)}
    place = lambda g: [(int(g) * int(m) % 2**64) >> (64 - model.bits) for m in language._MULTIPLIERS]
    for g, own in zip(grams, owners, strict=True):
        for k in own:
            slots[k].update(place(g))
    got = model.scores(texts)
    for t in range(len(texts)):
        own = [int(g) for g in keys[begins[t] : ends[t]]]
        for k in range(40):
            chance = (len(slots[k]) / 2**model.bits) ** 3
            hits = sum(all(p in slots[k] for p in place(g)) for g in own)
            assert got[t, k] == pytest.approx(max(0, (hits - len(own) * chance) / (1 - chance)))


def test_rare_and_many_languages(spark):
    data = [(i, prose(30), f"l{i % 40:02d}") for i in range(400)]
    data += [(1000 + i, "zwq " * 5, "rare") for i in range(1)] + [(2000 + i, t, None) for i, t in enumerate(["zwq zwq", "x " * 200_000])] + [(None, "zwq", "other"), (3, prose(30), "l03")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(docs, docs["doc_id"] >= 0)
    assert len(model.languages) == 41 and "other" not in model.languages
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert got[2000] == "rare" and got[2001] in model.languages
    few = language.train(docs.where("lang in ('l00', 'l01')"), docs["doc_id"] >= 0)
    without = language.train(docs.where("lang in ('l00', 'l01') or lang = 'rare'"), docs["doc_id"] >= 0)
    assert len(without.languages) == 3 and few.languages == without.languages[:2]  # a rare language leaves the others' rule alone
    assert language.identify(empty(docs), model).count() == 0


# 8
def brute_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    ones = Counter(k for s in shingles for k in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> k & 1)
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def test_simhash(spark, docs, rows):
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(600 + i, prose(200) + " z") for i in range(5)] + [(700 + i, TEXTS[17] + f" end{i}") for i in range(30)], "doc_id long, text string"))
    every = [(r["doc_id"], r["text"]) for r in data.collect()]
    fp = np.array([brute_fingerprint(t, 4) for _, t in every], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        label = np.array([label[near[i]].min() for i in range(len(fp))])
    smallest = {c: min(d for (d, _), k in zip(every, label, strict=True) if k == c and d is not None) for c in set(label.tolist())}
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(data).collect())
    assert got == sorted((str(d), int(f), smallest[c]) for (d, _), f, c in zip(every, fp, label.tolist(), strict=True))
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_multi_index_links_are_whole(spark):
    base = RNG.integers(0, 2**63, 40, dtype=np.uint64)
    dense = base[0] ^ (RNG.integers(0, 2**10, 300, dtype=np.uint64) << np.uint64(30))
    fp = np.unique(np.concatenate([base, dense, *[base ^ sum((np.uint64(1) << np.uint64(b) for b in RNG.choice(64, 4, replace=False)), np.uint64(0)) for _ in range(3)]]))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = fp.view(np.int64).copy()
    for _ in range(60):
        label = np.array([label[near[i]].min() for i in range(len(fp))])
    frame = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    for group in (20_000, 25):
        parts = {r["node"]: r["component"] for r in components.connected_components(simhash.links(frame, group)).collect()}
        assert [parts.get(v, v) for v in fp.view(np.int64).tolist()] == label.tolist()


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (900, 900)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_leave_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions: each file costs a process on a local disk, a request elsewhere."""
    count, written_at = {}, components.written_at

    def counted(df, path):
        out = written_at(df, path)
        count[path.rpartition("/")[2].partition("-")[0]] = len(out.inputFiles())
        return out

    monkeypatch.setattr(components, "written_at", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(old, ("40", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        links = spark.range(300).selectExpr("id as a", "id + 1 as b")
        assert components.connected_components(links).agg({"component": "max"}).first()[0] == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(v for k, v in count.items() if k != "links") <= spark.sparkContext.defaultParallelism


def test_split_hot_meets_every_pair_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(23)] + [(2, 100)], "key long, member long")
    met = Counter()
    out = split_hot(df, "key", "member", 5).collect()
    for a in out:
        for b in out:
            same = (a["key"], a["low_block"], a["high_block"]) == (b["key"], b["low_block"], b["high_block"])
            if same and a["member"] < b["member"] and (a["low_block"] == a["high_block"] or a["block"] != b["block"]):
                met[a["member"], b["member"]] += 1
    assert len(met) == 23 * 22 // 2 and set(met.values()) == {1}


# 9
def test_quality(spark):
    good = [prose(60).capitalize() + "." for _ in range(150)]
    bad = [" ".join([w.upper() + "!!" for w in RNG.choice(VOCAB[:3], 60)]) for _ in range(50)]
    data = [(i, t, "clash") for i, t in enumerate(good + bad)] + [(900, None, ""), (901, "", ""), (902, prose(20_000), "")]
    data += [(5, good[5], "clash"), (None, good[6], "clash")]  # a repeated row, a row without id
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, "doc_id % 3 <> 1")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in range(200) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in held]) > 0.95 and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in got.items() if s >= 0.5}
    blank = quality.train(empty(docs), empty(labels), "doc_id >= 0")
    assert quality.score(docs, blank).count() == len(data) and quality.score(empty(docs), model).count() == 0


def test_quality_risk_against_plain_sums():
    p, u = RNG.normal(0.5, 1, (40, 5)), RNG.normal(0, 1, (70, 5))
    loss = lambda z: np.log1p(np.exp(-z))
    for prior in (0.3, 0.9):
        for w, b in ((np.zeros(5), 0.0), (RNG.normal(0, 2, 5), 0.3)):
            def parts(w, b):
                good = prior * np.mean([loss(x @ w + b) for x in p])
                bad = np.mean([loss(-(x @ w + b)) for x in u]) - prior * np.mean([loss(-(x @ w + b)) for x in p])
                return good, bad

            good, bad, gradient = quality.risk_and_gradient(p, u, prior, w, b)
            assert (good, bad) == pytest.approx(parts(w, b))
            follow = (lambda w, b: sum(parts(w, b))) if bad >= 0 else (lambda w, b: -parts(w, b)[1])
            step = 1e-5
            plain = [(follow(w + step * e, b) - follow(w - step * e, b)) / (2 * step) for e in np.eye(5)] + [(follow(w, b + step) - follow(w, b - step)) / (2 * step)]
            assert gradient == pytest.approx(np.array(plain), abs=1e-6)


def test_quality_prior_is_estimated():
    width = quality.SHAPES + quality.MEASURES
    def rows(n, good):
        x = np.zeros((n, width), np.float32)
        x[:, : 8] = RNG.normal(1.5 if good else -1.5, 1, (n, 8))
        return x

    for prior in (0.2, 0.6, 0.9):
        some = rows(3000, True)
        mixed = np.concatenate([rows(int(6000 * prior), True), rows(6000 - int(6000 * prior), False)])
        assert abs(quality.estimate_prior(some, mixed[RNG.permutation(6000)]) - prior) < 0.05


# 10
def test_decontamination(spark):
    items = [prose(30) for _ in range(6)]
    edited = items[1].split()
    edited[5], edited[17] = "qqqq", "wwww"
    data = [(1, prose(100) + " " + items[0] + ". " + prose(50)), (2, " ".join(edited[:20] + ["extra"] + edited[20:])), (3, prose(300)), (4, None), (5, ""), (6, items[2].upper()), (6, items[2].upper()), (7, " ".join(items[3].split()[:8]) + prose(60)), (8, items[4] + "\n" + items[5])]
    data += [(1000 + i, prose(20) + " " + items[0]) for i in range(60)]  # a copy in most documents is still found
    docs = spark.createDataFrame([(d, t, "clash") for d, t in data], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (92, "...")], "item_id long, text string")
    for words in (1_000_000, 40):  # and in several passes
        got = sorted((r["doc_id"], r["item_id"]) for r in decontam.find_copies(docs, bench, item_words=words).collect())
        assert got == sorted([(1, 0), (2, 1), (6, 2), (6, 2), (8, 4), (8, 5)] + [(1000 + i, 0) for i in range(60)])
    assert sorted(r["doc_id"] for r in decontam.drop_copies(docs, bench).collect()) == [3, 4, 5, 7]
    assert decontam.find_copies(docs, empty(bench)).count() == 0 and decontam.find_copies(empty(docs), bench).count() == 0


def test_no_copy_is_missed(spark):
    """Against alignment of every item with every whole document: short items, spread edits, repeated words."""
    few = VOCAB[:25]  # so that n-grams are frequent
    items = [" ".join(RNG.choice(few, n)) for n in (1, 2, 3, 4, 5, 6, 7, 9, 14, 22, 40)] + ["qqq www", "中文字句", "zz yy xx vv uu"]
    texts = [" ".join(RNG.choice(few, RNG.integers(5, 120))) for _ in range(60)]
    for item in items * 6:
        words = []
        for w in item.split():  # edits spread over the copy
            kind = RNG.integers(0, 6)
            words += [w, "new"] if kind == 0 else ["other"] if kind == 1 else [w]
        texts.append(" ".join([*RNG.choice(VOCAB, 10), *words, *RNG.choice(VOCAB, 10)]))
    texts += ["one qqq www two", "前文中文字句后文", "zz yy other vv uu", None, "", "x " * 30_000 + items[9]]
    index = decontam.ItemIndex(list(enumerate(items)), 0.6)
    number = lambda text: np.array([index.vocabulary.get(w, -1) for w in decontam.words_of(text or "")])
    expected = {}
    for d, text in enumerate(texts):
        for n, w in index.items:
            score = decontam.align(w, number(text))[0] if len(number(text)) else 0
            if score >= 0.6:
                expected[d, n] = score
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_copies(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == expected and len(expected) > 100


def test_alignment_against_brute_force():
    def plain(a, b):
        h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max() / (2 * len(a))

    for _ in range(200):
        a, b = RNG.integers(0, 5, RNG.integers(1, 12)), RNG.integers(0, 5, RNG.integers(0, 25))
        score, begin, end = decontam.align(a, b)
        assert score == plain(a, b) and 0 <= begin <= end <= len(b) and (not score or plain(a, b[begin:end]) == score)


def test_similar_texts(spark, docs):
    texts = []
    for g in range(12):
        words = RNG.choice(VOCAB, 300)
        for c in range(4):
            w = words.copy()
            w[RNG.choice(300, c, replace=False)] = "edited"
            texts.append((g, " ".join(w)))
    hot = RNG.choice(VOCAB, 200)
    for c in range(40):  # one large group of near copies
        w = hot.copy()
        w[RNG.integers(0, 200)] = f"z{c}"
        texts.append((99, " ".join(w)))
    frame = spark.createDataFrame([(1000 + i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] - 1000: r["component_id"] - 1000 for r in simhash.similar_texts(frame).collect()}
    first = {}
    for i, (g, _) in enumerate(texts):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, (g, _) in enumerate(texts)}
    assert simhash.similar_texts(docs).count() == docs.count() and simhash.similar_texts(empty(docs)).count() == 0


def test_recall_is_the_same_at_every_size(spark, monkeypatch):
    """Pairs at 0.8 by the model's own share of bits meet alike, however many rows the table is said to have."""
    pairs, q = 400, simhash.differing_share(0.8)
    rng = np.random.default_rng(11)
    one = rng.integers(0, 2, (pairs, 2048)).astype(np.uint8)
    two = one ^ (rng.random((pairs, 2048)) < q).astype(np.uint8)
    wide = getattr(simhash, "words_for", lambda _: 16)(0.8)
    rows = [(i, np.packbits(b[: 64 * wide], bitorder="little").tobytes()) for i, b in enumerate(np.concatenate([one, two]))]
    frame = spark.createDataFrame(rows, "fp long, bits binary")
    for n in (2 * pairs, 10_000_000):
        monkeypatch.setattr(type(frame), "count", lambda self, n=n: n if self.columns == ["fp", "bits"] else 0)
        found = {tuple(sorted(r)) for r in simhash.similar_links(frame, 0.8).collect()}
        assert sum((i, i + pairs) in found for i in range(pairs)) >= 0.91 * pairs


def test_similar_texts_against_brute_force(spark):
    """Pairs of similarity 0.6 to 0.9: only what is linked exactly at 0.8 is joined, and nearly all of it."""
    rng = np.random.default_rng(12)
    texts = []
    for edits in np.tile(np.arange(3, 17), 12):
        words = rng.choice(VOCAB, 300)
        other = words.copy()
        other[rng.choice(300, edits, replace=False)] = [f"e{k}" for k in range(edits)]
        texts += [" ".join(words), " ".join(other)]
    texts.append("again and again and still " * 60 + texts[0])  # repeated shingles count once

    def shingles(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[:-1:2], sets[1:-1:2], strict=True)]
    assert min(share) < 0.65 and max(share) > 0.88
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(frame).collect()}
    wrong = [s for i, s in enumerate(share) if s < 0.8 and got[2 * i] == got[2 * i + 1]]
    found = [got[2 * i] == got[2 * i + 1] for i, s in enumerate(share) if s >= 0.8]
    assert not wrong and np.mean(found) >= 0.98 and len(found) >= 50
    assert (got[len(texts) - 1] == got[0]) == (len(sets[-1] & sets[0]) >= 0.8 * len(sets[-1] | sets[0]))
    classes = [np.unique(simhash._shingle_hashes(t, 5)) for t in texts]
    wide = np.stack([simhash.wide_fingerprint(h, 25) for h in classes])
    assert (simhash.exact_forest(classes, wide, 0.8)[1:-1:2] == np.arange(0, len(texts) - 1, 2)).tolist() == [s >= 0.8 for s in share]


def test_repeats_of_a_passage_in_a_third_of_documents(spark, monkeypatch):
    """One passage with differing neighbours: no task gets all segments of its keys, and the result is the same."""
    rng = np.random.default_rng(13)

    def words(n):
        return " ".join(rng.choice(VOCAB, n))

    passage = words(30)
    data = [(i, words(25) + (" " + passage + " " + words(8) if i % 3 == 0 else "")) for i in range(240)]
    data += [(900, data[3][1]), (901, "tail of it " + passage[40:]), (902, passage + "x"), (902, passage + "x"), (None, passage)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(repeats, "HOT_DOCS", 20, raising=False)
    seen = spark.sparkContext.accumulator(0)
    earlier = repeats._earlier

    def watched(strings, keys, first, length):
        if len(keys):
            seen.add(int(np.unique(keys, return_counts=True)[1].max() > 30))
        return earlier(strings, keys, first, length)

    monkeypatch.setattr(repeats, "_earlier", watched)
    got = sorted(str(tuple(r)) for r in repeats.removal_report(repeats.repeated_spans(docs)).collect())
    assert got == brute_repeats(data) and seen.value == 0


def test_short_texts_meet_by_their_shingles(spark, monkeypatch):
    """All pairs of texts of up to 19 words that are similar enough are joined, and no others; also with groups split in blocks."""
    rng = np.random.default_rng(21)
    texts = []
    for n in np.tile(np.arange(5, 20), 12):
        words = [f"w{k}" for k in rng.integers(0, 4_000, n)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(["begin", *words]), " ".join([*words, "more", "words"])]
    texts += [f"always the same five words {k}" for k in range(30)] + ["one two", "one two", "three", ""]
    sets = [set(simhash._shingle_hashes(t, 5).tolist()) for t in texts]
    near = np.array([[bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets])
    label = np.arange(len(texts))
    for _ in range(8):
        label = np.array([min(label[i], label[near[i]].min(initial=i)) for i in range(len(texts))])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (1_000, 7):
        links = simhash.short_links
        monkeypatch.setattr(simhash, "short_links", lambda c, s, group=group, links=links: links(c, s, group))
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(frame).collect()}
        monkeypatch.undo()
        assert got == dict(enumerate(label.tolist())) and len(set(got.values())) < len(texts) - 100
