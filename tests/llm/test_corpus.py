"""Operators on whole corpora against brute force: SimHash, mixing, embeddings, classifiers, and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import embed_dedup, mixing, quality_knn, queries, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    prints = [plain_fingerprint(r.text) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = groups(len(rows), linked)
    names = {}
    for root, r in zip(roots, rows):
        if r.doc_id is not None:
            names[root] = min(names.get(root, r.doc_id), r.doc_id)
    return Counter((r.doc_id, f"{p:016x}", names.get(root)) for r, p, root in zip(rows, prints, roots))


def test_simhash_equals_brute_force(spark, few, odd, none):
    for df in (few, odd):
        rows = df.select("doc_id", "text").collect()
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_classes(df).collect())
        assert got == plain_classes(rows)
    assert simhash.simhash_classes(none).count() == 0


@pytest.mark.parametrize("rows", [3, 50])
def test_simhash_with_small_trees_and_hot_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "TREE_ROWS", rows)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = []
    for i in range(300):
        x = int(base[i % 4])
        for b in rng.integers(0, 20, i % 5):
            x ^= 1 << int(b)
        prints.append(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.classes(df, 2).collect()}
    roots = groups(300, [(i, j) for i in range(300) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert got == dict(enumerate(roots))


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2**12, (400, 1)).astype(np.uint64)
    tree = simhash.BKTree(np.unique(rows, axis=0))
    found = {(int(tree.rows[n, 0]), int(q)) for nodes, near in tree.probe(rows, 3) for n, q in zip(nodes, near)}
    children = dict(zip(tree.keys.tolist(), tree.children.tolist()))
    for key, child in children.items():  # a child hangs on the edge of its distance to its parent
        parent, edge = divmod(key, tree.width)
        assert int(tree.rows[parent, 0] ^ tree.rows[child, 0]).bit_count() == edge
    assert sorted([0, *children.values()]) == list(range(len(tree.rows)))
    rows_of = {int(x) for x in rows[:, 0]}
    found = {(a, int(rows[q, 0])) for a, q in found}
    assert found == {(a, b) for a in rows_of for b in rows_of if (a ^ b).bit_count() <= 3}


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 2**14, (300, 1)).astype(np.uint64), axis=0)
    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(i) if int(rows[i, 0] ^ rows[j, 0]).bit_count() <= 2]
    a, b = simhash.forest(simhash.BKTree(rows), rows, 2, True)
    assert len(a) < n and groups(n, zip(a.tolist(), b.tolist())) == groups(n, linked)
    assert all(int(rows[i, 0] ^ rows[j, 0]).bit_count() <= 2 for i, j in zip(a, b))


def test_similar_classes_catch_near_copies_and_leave_others(spark, odd, none):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(3000)]
    rows, want = [], {}
    for g in range(40):
        text = list(rng.choice(words, 300))
        for c in range(3):
            copy = list(text)
            for at in rng.integers(0, 300, 2 * c):
                copy[at] = "edited"
            rows.append((len(rows), " ".join(copy)))
            want[len(rows) - 1] = g * 3
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == [1, 2, 4, 5, 8, 9, 11]  # 3 and 7 are empty like 2; 10 is 9 in other case
    assert simhash.keep_one(none).count() == 0


def test_subset_sum_is_the_best_there_is():
    rng = np.random.default_rng(5)
    for _ in range(100):
        lengths, stock = sorted(set(rng.integers(1, 30, 5).tolist())), None
        stock = rng.integers(0, 4, len(lengths)).tolist()
        budget = int(rng.integers(0, 120))
        taken = mixing.bounded_subset_sum(lengths, stock, budget)
        sums = {0}
        for size, count in zip(lengths, stock):
            sums = {s + k * size for s in sums for k in range(count + 1)}
        assert all(0 <= t <= s for t, s in zip(taken, stock))
        assert sum(t * x for t, x in zip(taken, lengths)) == max(s for s in sums if s <= budget)


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Share by weight, cap, and share the excess again until none is above its cap."""
    left, targets, free = share * sum(sizes), [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s]
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > most * sizes[k]]
        for k in over or free:
            targets[k] = most * sizes[k] if over else left * weights[k] / total
        if not over:
            break
        left -= sum(targets[k] for k in over)
        free = [k for k in free if k not in over]
    return targets


def test_targets_equal_sharing_again_and_again(spark, none):
    rng = np.random.default_rng(7)
    for _ in range(4):
        n = int(rng.integers(1, 30))
        sizes = [int(x) for x in rng.integers(0, 10 ** int(rng.integers(2, 7)), n)]
        names = sorted({f"{chr(int(c))}{k}" for k, c in enumerate(rng.integers(65, 0x4FF, n))}, key=lambda s: s.encode())
        rows = list(zip([*names[: n - 1], None], sizes))
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, words long").repartition(3), (5, 2, 1)).collect()}
        want = plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(n)])
        assert all(got[s] == pytest.approx(t, rel=1e-9, abs=1e-6) for (s, _), t in zip(rows, want))
    assert mixing.source_targets(none.selectExpr("source", "doc_id AS words"), (5, 2, 1)).count() == 0


def test_no_length_is_favoured():
    rng = np.random.default_rng(9)
    for share in (0.3, 0.7, 1.5, 1.8):
        lengths = np.sort(rng.choice(np.arange(1, 60_000), 400, replace=False))
        counts = np.ones(400, np.int64)
        total = int(lengths.sum())
        taken = np.mean([mixing.fit_lengths(lengths, counts, share * total, 2, seed) for seed in range(60)], axis=0)
        for part in np.split(taken, 4):
            assert abs(part.mean() - share) < 0.06
        assert abs(taken[-3:].mean() - share) < 0.2  # the three longest too
        short = np.arange(20, 420)
        for s in range(10):
            assert abs(int((short * mixing.fit_lengths(short, counts, share * int(short.sum()), 2, s)).sum()) - share * short.sum()) <= 2


def test_mixing_meets_targets_and_reruns_agree(spark, few, odd, none):
    rows = queries.op7_mixing(spark, FOLDER).collect()
    source = {r.doc_id: r.source for r in few.collect()}
    taken, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    for s in target:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= max(20, 0.01 * target[s])
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix(few.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}
    strange = mixing.mix(odd).collect()
    assert len(strange) == odd.count() and mixing.mix(none).count() == 0
    words = {r.source: r.source_size for r in strange}
    assert None in words and sum(words.values()) == sum(len((r.text or "").encode().split()) for r in odd.collect())
    assert mixing.take(odd).columns == odd.columns
    assert mixing.take(few).count() == sum(r.taken // r.size for r in rows if r.size)


def plain_links(vectors, least):
    n = len(vectors)
    unit = [None if v is None or not all(x is not None and np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float)) for v in vectors]
    return [(i, j) for i in range(n) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]


@pytest.mark.parametrize("block", [7, 2048])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 64))
    rows = [(i, [float(np.float32(x)) for x in base[i % 20] + 0.13 * (i % 3) * rng.standard_normal(64) / 8]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] + [1.0] * 63), (303, [float("inf")] * 64), (304, [None] + [1.0] * 63), (None, rows[0][1])]
    rows += [(400 + i, [float(np.float32(x)) for x in base[i % 3][:16] * (1 + i)]) for i in range(9)]  # of another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit(2))
    got = embed_dedup.near_duplicates(df, 0.95).collect()
    links = plain_links([v for _, v in rows], 0.95)
    degree = Counter(x for pair in links for x in pair)
    roots = groups(len(rows), links)
    names = {}
    for root, (i, _) in zip(roots, rows):
        if i is not None:
            names[root] = min(names.get(root, i), i)
    want = Counter((i, degree[k], names.get(roots[k]), i is not None and i == names.get(roots[k])) for k, (i, _) in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_embedding_recall_and_precision_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    links = plain = 0
    unit = np.array([r.embedding for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    degree = {r.vec_id: int((unit @ u >= 0.95).sum()) - 1 for r, u in zip(rows, unit)}
    got = {r.vec_id: r.n_links for r in queries.op10_embedding_dedup(spark, "/root/testdata/sf0.1").collect()}
    links, plain = sum(got.values()), sum(degree.values())
    assert all(got[i] <= degree[i] for i in degree) and links >= 0.9 * plain


def test_embeddings_of_extreme_size_and_repeated_rows(spark):
    rows = [(1, [1e200] * 4), (2, [1.1e200] * 4), (3, [1e-300, 1e-300, 0.0, 0.0]), (4, [2e-310, 2e-310, 0.0, 0.0]), (5, [1.0, -1.0, 0.0, 0.0]), (6, [1.0, -1.0]), (6, [1.0, -1.0])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True)}


def test_embeddings_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def held_accuracy(spark, query, label):
    folder = "/root/testdata/sf0.01"
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows), max(np.mean([r[label] for r in rows]), 1 - np.mean([r[label] for r in rows]))


def test_toxicity_on_held_out_texts(spark):
    accuracy, _ = held_accuracy(spark, queries.op1_toxicity, "toxic")
    assert accuracy >= 0.95


def test_quality_on_held_out_texts(spark):
    accuracy, _ = held_accuracy(spark, queries.op9_quality_neighbours, "quality")
    assert accuracy >= 0.95


def test_classifiers_on_odd_and_missing_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (8, 1, 1), (99, 0, 0), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for run in (toxicity.toxicity, quality_knn.quality):
        for known in (labels, empty):
            rows = run(odd, known).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert run(none, labels).count() == 0
    import zlib

    for r in toxicity.toxicity(odd, labels).collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_neighbour_votes_are_the_exact_nearest():
    rng = np.random.default_rng(8)
    vectors = quality_knn.unit(rng.standard_normal((300, 8)).astype(np.float32))
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality_knn.Model(np.full(quality_knn._WORDS + (1 << quality_knn.BITS), -1), np.zeros((1, 8), np.float32), vectors, labels, 0.5)
    points = quality_knn.unit(rng.standard_normal((20, 8)).astype(np.float32))
    model.latent = lambda texts: points
    for p, s in zip(points, model.score(["x"] * 20)):
        near = vectors @ p
        top = np.argsort(-near)[: quality_knn.NEIGHBOURS]
        w = np.maximum(near[top], 0) ** quality_knn.SHARPNESS
        assert s == pytest.approx((w * labels[top]).sum() / w.sum(), abs=1e-5)


def test_ties_go_to_the_first_labelled_rows():
    vectors = np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 10, np.float32)
    labels = np.array([1.0] * 30 + [0.0] * 20)
    model = quality_knn.Model(np.full(quality_knn._WORDS + (1 << quality_knn.BITS), -1), np.zeros((1, 2), np.float32), vectors, labels, 0.5)
    model.latent = lambda texts: np.array([[1.0, 0.0]], np.float32)
    assert model.score(["x"])[0] == 1.0  # of forty that tie, the first 25


def test_repeated_ids_add_nothing_to_the_labelled_sample(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i} of some words") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    every = lambda i: F.lit(True)
    assert quality_knn.labelled_terms(docs, labels, "quality", every, 3).count() == 3
    assert toxicity.labelled_sample(docs, labels, "toxic", every, 2).count() == 4


def test_pipeline_stages_do_what_they_say(spark, odd, none):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "pii_surrogates", "mixing", "byte_bpe"]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, FOLDER).cache()
        assert out.columns == docs.columns and out.count() > 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, out, FOLDER)
    assert tokens.count() == out.count()
    whole = corpus_pipeline.run(spark, FOLDER)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, tokens.collect()))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, FOLDER).collect()
        assert stage(spark, none, FOLDER).count() == 0


def test_taking_repeated_rows_takes_what_the_mix_says(spark):
    rows = [(i % 7 if i % 3 else None, f"{'w ' * (1 + i % 4)}", None if i % 5 == 0 else f"s{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.take(docs).collect())
    assert got == +want


def plain_jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_only_texts_of_the_wanted_similarity_are_linked(spark):
    words = [f"v{i}" for i in range(200)]
    passage = " ".join(words[:10])
    rows = []
    for g in range(30):  # a shared passage: similarity 0.72 to 0.79; and copies of 0.8 or more with a repeated passage
        start = [f"g{g}w{i}" for i in range(300)]
        rows.append((len(rows), " ".join(start)))
        rows.append((len(rows), " ".join(start[: 252 + g % 3] + [f"h{g}w{i}" for i in range(48 - g % 3)])))
        rows.append((len(rows), " ".join([passage] * 40 + [f"r{g}w{i}" for i in range(300)])))
        rows.append((len(rows), " ".join([passage] + [f"r{g}w{i}" for i in range(300)])))
    low = [plain_jaccard(rows[4 * g][1], rows[4 * g + 1][1]) for g in range(30)]
    high = [plain_jaccard(rows[4 * g + 2][1], rows[4 * g + 3][1]) for g in range(30)]
    assert 0.65 < min(low) and max(low) < 0.8 <= min(high)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - (i % 4 == 3) for i in range(120)}


def test_rows_of_one_id_in_two_classes_both_stay(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (1, " ".join(f"b{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60)))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept) == sorted(rows[:2])
