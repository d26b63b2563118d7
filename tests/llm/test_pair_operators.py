"""Near-duplicates, vector links, top-k search, mixing and the pipeline against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setgraph.llm import bagminhash, embeddings, mixing, pii, secrets, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# -- near-duplicate texts -----------------------------------------------------------------------------------------


def bag(text):
    w = (text or "").lower().split()
    return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similar(a, b):
    union = (a | b).total()
    return bool(union) and (a & b).total() / union >= 0.8


def family_rows(seed):
    """Texts with copies, near copies of many degrees, a passage that many share, repeats, and short ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150, 400]))]
        base += base[: len(base) // 2] * rng.choice([0, 0, 3])
        for _ in range(rng.randint(1, 14)):
            rate = rng.choice([0, 0, 0.005, 0.01, 0.02, 0.04])
            texts.append(" ".join(w if rng.random() > rate else rng.choice(words) for w in base))
    texts += [" ".join([rng.choice(words) for _ in range(rng.randint(5, 80))] + passage) for _ in range(40)]
    texts += ["a b", "a b", "A  B", "one", None, "", "", "x " * 30_000, "x " * 29_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = family_rows(seed)
    got = bagminhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]).withColumnsRenamed({"lang": "rep", "source": "band"}))
    bags = {i: bag(t) for i, t in rows}
    links = [(i, j) for i in bags for j in bags if i < j and similar(bags[i], bags[j])]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(bags, links)
    assert got.filter("kept != (doc_id = component_id)").count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Buckets larger than a block are dealt out in pairs of blocks."""
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    monkeypatch.setattr(bagminhash, "BLOCK_WORDS", 300)
    monkeypatch.setattr(bagminhash, "HOT_PART", 20)
    rows = family_rows(5)
    got = bagminhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in rows]))
    bags = {i: bag(t) for i, t in rows}
    links = [(i, j) for i in bags for j in bags if i < j and similar(bags[i], bags[j])]
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(bags, links)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(50))
    rows = [(1, long, "s"), (1, long, "s"), (2, long, "s"), (None, long, "s"), (3, None, "s"), (4, None, "s"), (5, "other words here and there", "s"), (5, long, "s")]
    got = bagminhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (5, 1, False)], key=str)
    assert bagminhash.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_are_unbiased():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(150):
        x = [rng.choice(words) for _ in range(rng.choice([8, 60, 300]))]
        x += x[: len(x) // 3] * rng.choice([0, 3])
        texts += [x, [w if rng.random() > 0.02 else rng.choice(words) for w in x]]
    registers, has, weight = bagminhash.sign([*texts, []])
    assert has.tolist() == [True] * 300 + [False] and weight[0] == bag(" ".join(texts[0])).total()
    estimate = (registers[:300:2] == registers[1:300:2]).mean(1)
    exact = np.array([bagminhash.overlap(" ".join(texts[i]), " ".join(texts[i + 1]), {}) for i in range(0, 300, 2)])
    error = estimate - exact
    assert abs(error.mean()) < 0.01 and error.std() < 1.3 * math.sqrt((exact * (1 - exact)).mean() / bagminhash.REGISTERS)


# -- vectors ------------------------------------------------------------------------------------------------------


def vector_rows(seed=3, width=24):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            centre = rng.normal(size=width)
            for _ in range(rng.integers(1, 9)):
                rows.append((at, (centre + rng.normal(size=width) * rng.choice([0.0, 0.1, 0.2, 0.28])).tolist(), label))
                at += 1
    rows += [(at, rows[0][1], 0), (at + 1, rows[0][1], None), (at + 2, None, 0), (at + 3, [0.0] * width, 0), (at + 4, [float("nan")] * width, 0), (at + 5, [None] * width, 0), (at + 6, [x * 3 for x in rows[0][1]], 0), (5, rows[5][1], rows[5][2]), (None, rows[0][1], 0), (at + 7, [], 1)]
    return rows


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_vector_links_match_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = embeddings.linked_vectors(df).collect()
    unit = [np.array(v) / np.linalg.norm(v) if usable(v) and label is not None and i is not None else None for i, v, label in rows]
    linked = {a: [b for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93] for a in range(len(rows))}
    near = [abs(unit[a] @ unit[b] - 0.93) for a in linked for b in linked if a < b and unit[a] is not None and unit[b] is not None]
    assert min(near) > 1e-9
    component = components([r[0] for r in rows if r[0] is not None], [(rows[a][0], rows[b][0]) for a in linked for b in linked[a]])
    wanted = sorted(((rows[a][0], len(linked[a]), component.get(rows[a][0])) for a in linked), key=str)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == wanted
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddings.linked_vectors(df.filter("false")).count() == 0


def test_vector_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    monkeypatch.setattr(embeddings, "HOT_BLOCK", 4)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(30)]
    got = embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(29, 0)}


def test_hot_and_cool_buckets_count_a_pair_once(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 6)
    monkeypatch.setattr(embeddings, "HOT_BLOCK", 5)
    rows = [(i, v, label) for i, v, label in vector_rows(seed=8, width=16) if i is not None and usable(v) and label is not None and len(v) == 16]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    wanted = sorted((r[0], int(near[at].sum()) - 1) for at, r in enumerate(rows))
    got = embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == wanted


def test_ids_in_several_classes_join_what_they_reach(spark):
    """Row 7 is in two classes; what either links to is reached through the id."""
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(3, x, 1), (7, x, 1), (7, y, 1), (5, y, 1), (9, [1.0, 0.0], 1)]
    got = embeddings.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(3, 1, 3), (5, 1, 3), (7, 1, 3), (7, 1, 3), (9, 0, 9)]


@pytest.mark.parametrize("width", [16, 64, 256])
def test_planted_pairs_share_a_bucket_and_have_near_sketches(width):
    """At a cosine of exactly 0.93, the worst case of a link, at least 0.99 of pairs are candidates."""
    rng = np.random.default_rng(width)
    x, z = (rng.normal(size=(600, width)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = embeddings.bucket_codes(x), embeddings.bucket_codes(y)
    shared = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    near = np.bitwise_count((embeddings.sketches(x) ^ embeddings.sketches(y)).view(np.uint64)) <= embeddings.MOST_SIGNS
    assert (shared & near).mean() >= 0.99


def brute_top(rows, queries, k):
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in rows if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "shard", "spread"), [(1024, 8192, 30), (7, 40, 3), (50, 25, 5000)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, shard, spread):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "SMALL", 100)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-spread, spread + 1, 12).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, df.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, {i: v for i, v in rows if i % 20 == 0}, 20)


def test_top_k_with_many_rows_of_the_own_id(spark):
    """60 high copies of the query's id must not prove that others are out of the top."""
    rng = np.random.default_rng(4)
    rows = [(0, [100] * 12)] * 60 + [(i, rng.integers(-9, 10, 12).tolist()) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, df.filter("vec_id = 0"), 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows, {0: [100] * 12}, 20)


def test_segments_stop_on_proof_and_save_products():
    """On vectors with few large components most vectors are never scored exactly, and the answers are exact."""
    rng = np.random.default_rng(6)
    vectors = np.where(rng.random((3000, 32)) < 0.1, rng.integers(-60, 61, (3000, 32)), rng.integers(-1, 2, (3000, 32)))
    index = topk.ImpactIndex(np.arange(3000), vectors)
    q, ids, score = index.search(vectors[:40], np.arange(40), 20)
    assert index.products < 0.5 * 40 * 3000 * 32
    for at in range(40):
        exact = vectors @ vectors[at]
        wanted = [(-s, i) for s, i in sorted((-s, i) for i, s in enumerate(exact.tolist()) if i != at)[:20]]
        assert list(zip(score[q == at].tolist(), ids[q == at].tolist(), strict=True)) == wanted


def test_top_k_of_large_components_and_lengths(spark):
    """Components too large for exact sums are scored exactly from the start; short vectors are padded."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-(2**29), 2**29, rng.choice([3, 8])).tolist()) for i in range(60)] + [(61, [1, 2]), (61, [1, 2]), (61, [2, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    padded = [(i, v + [0] * (8 - len(v))) for i, v in rows]
    asked = {i: v for i, v in padded if i % 20 == 0}
    assert sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 20).collect()) == brute_top(padded, asked, 20)


def test_top_k_of_odd_rows(spark):
    rows = [(0, [0.5, -0.01]), (20, [1.0, 1.0]), (3, None), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0])]
    ints = topk.integer_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"))
    assert {r["vec_id"]: r["v"] for r in ints.collect()} == {0: [32, -1], 20: [64, 64], 7: [-64, 0]}
    got = sorted(tuple(r) for r in topk.top_k(ints, ints.filter("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 1984), (0, 2, 7, -2048), (20, 1, 0, 1984), (20, 2, 7, -4096)]
    assert topk.top_k(ints.filter("false"), ints.filter("false"), 5).count() == 0


# -- mixing -------------------------------------------------------------------------------------------------------


def test_schedule_stays_within_a_block_of_the_shares():
    rng = random.Random(1)
    for _ in range(60):
        weights = {f"s{i}": rng.choice([1, rng.random(), rng.random() ** 4 * 50]) for i in range(rng.randint(1, 30))}
        slots = mixing.shares(weights, rng.choice([10, 100, 1000]))
        period, count = sum(slots.values()), dict.fromkeys(slots, 0)
        for t, source in enumerate(mixing.schedule(slots), 1):
            count[source] += 1
            assert all(abs(count[s] - slots[s] * t / period) < 1 for s in slots)
        assert count == slots


def test_mix(spark):
    rows = [(i, "t", "big" if i < 600 else "mid" if i < 900 else "low" if i < 960 else None) for i in range(1000)]
    docs = documents(spark, rows)
    placed = mixing.mix(docs, {"big": 1.0, "mid": 1.0, "low": 0.2, None: 0.2}, block_docs=4).collect()
    assert len(placed) == 1000
    blocks = {}
    for r in placed:
        blocks.setdefault((r["source"], r["_block"]), []).append(r["_slot"])
    assert all(len(set(s)) == 1 and len(s) <= 4 for s in blocks.values())
    slot_of = {k: v[0] for k, v in blocks.items()}
    assert len(set(slot_of.values())) == len(slot_of)
    slots = mixing.shares({"big": 1.0, "mid": 1.0, "low": 0.2, "\0": 0.2})
    sequence = [s or "\0" for (s, _), _ in sorted(slot_of.items(), key=lambda x: x[1])]
    until = min(slot_of["low", max(b for s, b in slot_of if s == "low")], slot_of[None, max(b for s, b in slot_of if s is None)])
    count = Counter()
    for t, s in enumerate(sequence[:until], 1):
        count[s] += 1
        assert all(abs(count[x] - slots[x] * t / 1000) < 1 for x in slots)
    mixed = Counter(r["source"] for r in placed if r["_mixed"])
    # The mix ends with the last block of "low", which has one slot of twelve, so "big" goes on for some blocks.
    assert mixed["mid"] == 300 and mixed["low"] == 60 and 290 <= mixed["big"] <= 300 + 4 * 12
    assert mixing.mix(documents(spark, [])).count() == 0
    some = mixing.mix(documents(spark, [(None, None, None), (None, None, None), (3, "x", "s")]))
    assert some.count() == 3
    unweighted = mixing.mix(docs, {"mid": 1.0}).filter("_slot IS NULL")
    assert unweighted.count() == 700 and unweighted.filter("_mixed").count() == 0


def test_slots_stay_within_a_block_of_the_exact_weights():
    rng = random.Random(5)
    for _ in range(60):
        given = {f"s{i}": rng.choice([1, rng.random() + 0.01, 3]) for i in range(rng.randint(1, 20))}
        weights = list(mixing.whole_weights(given).values())
        total, at = sum(weights), 0
        before, length = [0] * len(weights), -(-total // min(weights)) + 2
        count = list(before)
        for _ in range(4):
            after = mixing.blocks_before(at + length, at, weights, total)
            for t, (s, k) in enumerate(mixing.stretch(at, at + length, before, after, weights, total), at + 1):
                assert k == count[s]
                count[s] += 1
                assert all(abs(c * total - w * t) < total for c, w in zip(count, weights, strict=True))
            assert count == after
            before, at = after, at + length


def test_mix_keeps_small_weights(spark):
    docs = documents(spark, [(i, "t", "large" if i < 3000 else "tiny") for i in range(3002)])
    placed = mixing.mix(docs, {"large": 1 - 1e-4, "tiny": 1e-4}, block_docs=1).collect()
    tiny = sorted(r["_slot"] for r in placed if r["source"] == "tiny")
    assert 0 <= tiny[0] < 10_001 and 9_998 <= tiny[1] < 20_002  # windows of 10,000 slots, not of the 1000 of a period
    large = {r["_block"]: r["_slot"] for r in placed if r["source"] == "large"}
    assert len(large) == 3000 and all(abs(k + 1 - (1 - 1e-4) * (slot + 1)) < 1 for k, slot in large.items())


# -- pipeline -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(4, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(15, 60))]
        toxic = i % 5 == 0
        if toxic:
            text[rng.randrange(len(text))] = "grobnik"
        if i % 7 == 1:
            text.append("password=abcdefgh12")
        rows.append((i, " ".join(text), "en", f"s{i % 3}" if i % 2 else "hot", 0))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "hot", 0) for i in range(0, 60, 4)] + [(2000, None, None, None, None), (None, "no id here at all", "en", "hot", 0), (3, rows[3][1], "en", "hot", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_stages(spark, small_corpus):
    folder, rows = small_corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
        if name != "encoding":
            assert docs.columns == columns
        steps[name] = docs.collect()
    clean = [r for r in rows if "grobnik" not in (r[1] or "")]
    assert sorted(str(r["doc_id"]) for r in steps["toxicity"]) == sorted(str(r[0]) for r in clean)
    kept = {r["doc_id"] for r in steps["near_duplicates"]}
    bags = {r[0]: bag(r[1]) for r in clean if r[0] is not None}
    component = components(bags, [(i, j) for i in bags for j in bags if i < j and similar(bags[i], bags[j])])
    assert kept == {i for i in bags if component[i] == i} | {None} and len(steps["near_duplicates"]) == len(kept)
    before = {r["doc_id"]: r["text"] for r in steps["near_duplicates"]}
    after = {r["doc_id"]: r for r in steps["secrets"]}
    assert set(before) == set(after)
    for i, text in before.items():
        assert after[i]["text"] == (None if text is None else text.replace("password=abcdefgh12", "[SECRET]"))
    mixed = [r["doc_id"] for r in steps["mixing"]]
    assert len(mixed) == len(kept) and set(mixed) == kept
    slots = {r["doc_id"]: r["_slot"] for r in mixing.mix(spark.read.parquet(f"{folder}/2")).collect()}
    assert {r["doc_id"]: r["slot"] for r in steps["encoding"]} == slots and len(steps["encoding"]) == len(kept)
    texts = {r["doc_id"]: r["text"] or "" for r in steps["secrets"]}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in steps["encoding"])
    whole, staged = (x.select("doc_id", "slot", "ids_sha256") for x in (corpus_pipeline.run(spark, folder), docs))
    assert whole.exceptAll(staged).count() == staged.exceptAll(whole).count() == 0


def test_encoded_rows_are_in_the_order_of_their_slots(spark):
    """Whatever the order of the files that the mix was written to."""
    docs = documents(spark, [(i, f"text {i}", f"s{i % 3}") for i in range(3000)])
    mixed = corpus_pipeline.mix_sources(spark, docs, "").orderBy(F.desc("doc_id"))
    parts = corpus_pipeline.encode(spark, mixed, "").withColumn("part", F.spark_partition_id()).collect()
    assert [r["slot"] for r in sorted(parts, key=lambda r: r["part"])] == sorted(r["slot"] for r in parts)


def test_pipeline_of_no_documents(spark, tmp_path):
    """An empty table goes through all stages; columns beyond those of documents don't reach the end."""
    documents(spark, []).withColumns({"slot": F.lit(1), "ids": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_mixes_all_documents_of_a_hot_source(spark):
    docs = documents(spark, [(i, "t", "hot" if i < 900 else f"s{i % 4}") for i in range(980)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == list(range(980))


def test_shared_constants():
    assert [r.kind for r in secrets.RULES if r.base] == ["assign", "access", "hex"] and pii.KINDS == ("email", "ip", "card", "phone")
