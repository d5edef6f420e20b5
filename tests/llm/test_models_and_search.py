"""SimHash components, nearest neighbours, language, quality and LM scoring."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from incidentlens.llm import attention_lm as lm
from incidentlens.llm import language_mixture, projection_forest, quality_rules, simhash_trees
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, reach):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= reach:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("reach", [0, 2, 3])
def test_links_connect_what_all_pairs_connect(reach):
    rng = random.Random(reach)
    values = {rng.getrandbits(64) for _ in range(400)}
    for v in list(values)[:150]:
        for _ in range(3):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    centre = rng.getrandbits(64)  # a dense ball that no radius splits well
    values |= {centre ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(30)}
    values = sorted(values)
    points = np.array(values, np.uint64)
    tree, _ = simhash_trees.fit_tree(points[::3], 6, reach)
    index, shard, home = simhash_trees.route(tree, points, reach)
    assert home.sum() == len(points)
    forest = simhash_trees.Forest()
    for s in np.unique(shard):
        here = shard == s
        forest.add(*simhash_trees.links(points[index[here & home]], points[index[here]], reach))
    a, b = forest.edges()
    place = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = sorted((find(place[x]), find(place[y])))
        root[q] = p
    assert [find(i) for i in range(len(values))] == brute_components(values, reach)


def test_midpoints_find_the_same():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 1 << 20, 3000).astype(np.uint64))
    assert len(points) > simhash_trees.DENSE
    found = simhash_trees.Forest(most=100)
    simhash_trees._compare(points, points[:50], 2, found)
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= 2)
    want = simhash_trees.Forest()
    want.add(points[i[i != j]], points[j[i != j]])
    assert [sorted(x.tolist()) for x in found.edges()][0] == [sorted(x.tolist()) for x in want.edges()][0]


def dense_ball(rng, n, loose):
    """Fingerprints up to four bits from one centre, in `loose` of its bits."""
    flips = rng.integers(0, loose, (n, 4))
    masks = np.bitwise_or.reduce(np.where(rng.random((n, 4)) < 0.8, np.uint64(1) << flips.astype(np.uint64), 0).astype(
        np.uint64), axis=1)
    return np.uint64(0x5A5A_1234_9876_F0F0) ^ masks


def test_a_dense_ball_is_dealt_by_midpoints(corpus):
    """Links of a ball next to random fingerprints are those of all pairs, and few rows are sent for it."""
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([dense_ball(rng, 6000, 64), rng.integers(0, 1 << 63, 2000).astype(np.uint64)]))
    table = corpus.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(4)
    got = simhash_trees.fingerprint_links(table, shard_rows=400, sample=8000).toPandas()
    tree, filled = simhash_trees.fit_tree(points[::8], len(points) // 400, 2)
    assert filled.max() > simhash_trees.DENSE_SHARDS
    assert len(simhash_trees.route(tree, points)[0]) < 3 * len(points)
    forest, want = simhash_trees.Forest(), simhash_trees.Forest()
    forest.add(got.a.to_numpy().view(np.uint64), got.b.to_numpy().view(np.uint64))
    for s in range(0, len(points), 500):
        i, j = np.nonzero(np.bitwise_count(points[s:s + 500, None] ^ points) <= 2)
        want.add(points[s + i][points[s + i] != points[j]], points[j][points[s + i] != points[j]])
    assert [x.tolist() for x in forest.edges()] == [x.tolist() for x in want.edges()]


def test_long_texts_have_the_same_fingerprint(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(n)) for n in (5000, 3, 0, 1, 700)]
    want = [brute_fingerprint(t) for t in texts]
    for step in (1 << 15, 97):
        monkeypatch.setattr(simhash_trees, "STEP", step)
        assert simhash_trees.fingerprints_of(pa.chunked_array([texts])).tolist() == want


def test_components_and_representatives(corpus):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklm") * rng.randint(1, 4) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.upper() if i % 2 else t + " tail") for i, t in enumerate(base)]
    rows += [(200, None), (201, ""), (202, " \n"), (3, rows[3][1]), (203, "One"), (204, "one two"), (None, rows[9][1])]
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("fp", F.lit("own")).repartition(3)
    got = simhash_trees.components(docs).withColumn("hex", simhash_trees.hex_fingerprint(F.col("fp"))).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints, 2)
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    want = sorted(((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=repr) == want
    kept = simhash_trees.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash_trees.components(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(corpus):
    """Different texts under one id, rows without an id, and a near copy whose id is a representative elsewhere."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 99)) for _ in range(60))
                  for _ in range(4))
    rows = [(1, a, "p"), (1, b, "q"), (2, a.upper(), "r"), (3, c, "s"), (1, c, "t"), (None, d, "u"), (None, d, "v"),
            (None, a, "w"), (5, None, "x"), (5, None, "y")]
    docs = corpus.createDataFrame(rows, "doc_id BIGINT, text STRING, key STRING")
    kept = [tuple(r) for r in simhash_trees.keep_representatives(docs).collect()]
    assert set(kept) <= set(rows) and len(kept) == 5
    assert {r[:2] for r in kept} == {(1, a), (1, b), (1, c), (None, d), (5, None)}
    again = simhash_trees.keep_representatives(docs.repartition(3)).collect()
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in again)


def test_negative_ids_and_repeated_query_ids(corpus):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(-3, (v[0] + 0.01).tolist()), (-50, v[1].tolist())]
    rows += [(50, v[2].tolist())]  # an id with two vectors asks with the smallest
    table = corpus.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = projection_forest.nearest(table, table.filter("vec_id % 50 = 0")).collect()
    first = {r.query_id: r.vec_id for r in got if r["rank"] == 1}
    assert first[0] == -3 and first[-50] == 1
    assert first[50] == (2 if v[2].tolist() < v[50].tolist() else [r for r in got if r.query_id == 50][0].vec_id)


def test_recall_where_the_share_of_leaves_decides(corpus, monkeypatch):
    monkeypatch.setattr(projection_forest, "MIN_PROBES", 1)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(4000, 16)).astype(np.float32)
    table = corpus.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = projection_forest.nearest(table, table.filter("vec_id % 50 = 0"), leaf_rows=60).toPandas()
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, part in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(part.vec_id))
    assert 0.9 * len(got) <= hits


def test_nearest_neighbours(corpus):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 12)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[7].tolist()) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [1.0, 2.0]), (2004, []),
             (2005, [float("inf")] * 12), (2006, [None] + [1.0] * 11), (None, v[3].tolist())]
    table = corpus.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    asked = table.filter("vec_id % 50 = 0")
    got = projection_forest.nearest(table, asked, 5, trees=8, leaf_rows=60, block_rows=40).collect()
    good = [(i, np.array(x, float)) for i, x in rows if i is not None and (i < 2000)]
    unit = {i: x / np.sqrt((x * x).sum()) for i, x in good}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(found) == {i for i, _ in good if i % 50 == 0}
    for q, best in found.items():
        best.sort()
        assert [b[0] for b in best] == [1, 2, 3, 4, 5]
        for _, i, s in best:
            assert i != q and abs(s - unit[q] @ unit[i]) < 1e-12
        want = sorted((-round(float(unit[q] @ unit[i]), 12), i) for i, _ in good if i != q)[:5]
        hits += len({i for _, i in want} & {b[1] for b in best})
    assert hits >= 0.95 * 5 * len(found)
    copies = [i for _, i, _ in sorted(found[1000])]
    assert copies == [7, 1001, 1002, 1003, 1004]
    few = table.filter("vec_id in (1, 2, 50)")
    assert projection_forest.nearest(few, few.filter("vec_id = 50")).count() == 2
    assert projection_forest.nearest(table.limit(0), table.limit(0)).count() == 0


def test_recall_on_the_given_vectors(corpus):
    table = corpus.read.parquet(f"{DATA}/embeddings.parquet")
    got = projection_forest.nearest(table, table.filter("vec_id % 50 = 0")).toPandas()
    rows = table.toPandas()
    v = np.stack(rows.embedding.to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(part.vec_id))
    assert hits >= 0.9 * len(got)


def test_language_on_held_out_documents(corpus):
    docs = corpus.read.parquet(f"{DATA}/documents.parquet")
    remainder = language_mixture.remainder("doc_id", 4)
    model = language_mixture.learn(docs.filter(remainder != 2))
    extra = corpus.createDataFrame([(-1, None), (-2, ""), (-3, "12 345 !"), (-4, "世界"), (-5, "½ ² ① Ⅷ")], "doc_id BIGINT, text STRING")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in language_mixture.predict(both, model).collect()}
    held = [r for r in docs.filter(remainder == 2).collect()]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (-1, -2, -3, -5)] == ["und"] * 4 and got[-4].lang_pred in model[0]
    nothing = language_mixture.learn(docs.limit(0))
    assert {r.lang_pred for r in language_mixture.predict(docs, nothing).collect()} == {"und"}


def test_mixture_is_plain_expectation_maximisation():
    rng = np.random.default_rng(3)
    probability = rng.dirichlet(np.ones(40), 3)
    counts = rng.integers(0, 5, (6, 40)).astype(np.float32)
    got, fit = language_mixture.mixture(counts, probability, np.full((6, 3), 1 / 3), 20)
    for row, shares, value in zip(counts, got, fit, strict=True):
        plain = [1 / 3] * 3
        for _ in range(20):
            total = [0.0] * 3
            for bin_, n in enumerate(row):
                joint = [plain[k] * probability[k][bin_] for k in range(3)]
                for k in range(3):
                    total[k] += n * joint[k] / sum(joint)
            plain = [t / sum(total) for t in total]
        assert np.allclose(shares, plain, atol=1e-4)
        want = sum(n * math.log(sum(plain[k] * probability[k][b] for k in range(3))) for b, n in enumerate(row))
        assert abs(value - want) < 1e-2 * abs(want)


def test_of_equal_languages_the_first_is_dropped_first(corpus):
    docs = corpus.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "aa")], "doc_id long, text string, lang string")
    model = language_mixture.learn(docs)
    got = language_mixture.predict(docs.withColumn("score", F.lit(1)), model).collect()
    assert {r.lang_pred for r in got} == {"zz"}


def test_mixtures_are_recovered(corpus):
    docs = corpus.read.parquet(f"{DATA}/documents.parquet").filter("lang in ('en', 'fr')")
    model = language_mixture.learn(docs)
    by = {lang: [r.text for r in docs.filter(F.col("lang") == lang).limit(30).collect()] for lang in ("en", "fr")}
    long = {lang: [t[:1500] for t in texts if len(t) >= 1500] for lang, texts in by.items()}
    texts = [a + " " + b for a, b in zip(long["en"], long["fr"], strict=False)]
    shares = language_mixture.choose(language_mixture.trigram_counts(texts), model[1])
    assert len(texts) > 3 and np.abs(shares - 0.5).max() < 0.15
    single = language_mixture.choose(language_mixture.trigram_counts([t for t in by["en"] if len(t) > 1000]), model[1])
    assert np.median(single.max(1)) == 1
    counts = language_mixture.trigram_counts(texts)
    start = np.full((len(texts), 2), 0.5)
    fits = [language_mixture.mixture(counts, model[1], start, n)[1] for n in (0, 1, 4, 20)]
    assert all((b >= a - 1e-3 * np.abs(a)).all() for a, b in zip(fits[:-1], fits[1:], strict=True))


def test_rules_are_the_paths_of_trees():
    text = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 1 <= 0.5)
     If (feature 0 <= 2.0)
      Predict: 0.0
     Else (feature 0 > 2.0)
      Predict: 1.0
    Else (feature 1 > 0.5)
     Predict: 1.0
"""
    assert {r.conditions for r in quality_rules.rules_of(text)} == {
        ((1, False, 0.5),), ((0, False, 2.0), (1, False, 0.5)), ((0, True, 2.0), (1, False, 0.5)), ((1, True, 0.5),)}


def test_quality_on_held_out_labels(corpus):
    docs = corpus.read.parquet(f"{DATA}/documents.parquet")
    labels = corpus.read.parquet(f"{DATA}/labels.parquet")
    remainder = language_mixture.remainder("doc_id", 5)
    odd = corpus.createDataFrame([(-1, None, "x"), (-2, "", "x")], "doc_id BIGINT, text STRING, stats STRING")
    both = docs.select("doc_id", "text", F.lit("x").alias("stats")).unionByName(odd)
    got = {r.doc_id: r for r in quality_rules.score_documents(both, labels, remainder != 0).collect()}
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = labels.filter(remainder == 0).collect()
    good = [got[r.doc_id].score for r in held if r.quality == 1]
    bad = [got[r.doc_id].score for r in held if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    none = quality_rules.score_documents(both, labels.limit(0), remainder != 0)
    assert {r.score for r in none.collect()} == {0.5}
    ones = quality_rules.score_documents(both, labels.filter("quality = 1"), remainder != 0)
    assert min(r.score for r in ones.collect()) > 0.99
    assert quality_rules.score_documents(both.limit(0), labels, remainder != 0).count() == 0
    kept = quality_rules.keep_good(both, labels, remainder != 0)
    assert kept.columns == both.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    klass = rng.integers(0, lm.CLASSES, lm.N_IDS)
    counts = rng.random(lm.N_IDS)
    inside = np.log(counts) - np.log(np.bincount(klass, counts, lm.CLASSES))[klass]
    pairs = np.unique(rng.integers(0, 200, 3000) * lm.N_IDS + rng.integers(0, 5000, 3000))
    given = lm._given_before(pairs, rng.integers(1, 9, len(pairs)), klass, inside)
    prior = np.log(rng.dirichlet(np.ones(lm.CLASSES), lm.N_IDS) + 1e-6).astype(np.float32)
    return lm.Model(rng.integers(0, lm.OWN_ROWS, lm.N_IDS), klass, inside, prior, *given,
                    rng.normal(0, 0.5, (lm.OWN_ROWS + lm.CLASSES, 3 * lm.WIDTH)).astype(np.float32),
                    rng.normal(0, 0.5, lm.WINDOW).astype(np.float32),
                    rng.normal(0, 0.5, (lm.WIDTH, lm.CLASSES)).astype(np.float32))


def plain_score(model, ids):
    """One document, one id at a time, in double precision."""
    total, rows = 0.0, model.table[model.row[ids]].astype(float)
    q, k, v = (rows[:, i * lm.WIDTH:(i + 1) * lm.WIDTH] for i in range(3))
    for p in range(1, len(ids)):
        begin = 0
        while p - 1 - begin >= lm.WINDOW:
            begin += lm.STRIDE
        i = p - 1
        s = np.array([q[i] @ k[j] + model.near[i - j] for j in range(begin, i + 1)])
        a = np.exp(s) / np.exp(s).sum()
        logits = a @ v[begin:i + 1] @ model.out + model.prior[ids[i]]
        total += logits[model.klass[ids[p]]] - math.log(np.exp(logits).sum())
        total += lm.within_class(model, ids[p - 1:p], ids[p:p + 1])[0]
    return total


def test_every_id_is_scored_once_with_its_window():
    rng, model = np.random.default_rng(4), small_model()
    lengths = np.array([1, 2, 15, 16, 17, 28, 29, 200])
    docs = [np.concatenate([[lm.BOUNDARY], rng.integers(0, 5000, n - 1), [lm.BOUNDARY]]) for n in lengths]
    got = lm.score_ids(model, np.concatenate(docs), lengths)
    assert np.allclose(got, [plain_score(model, d) for d in docs], rtol=1e-4, atol=1e-2)
    everything = np.arange(lm.N_IDS)
    for before in (3, 150, 40_000):  # each class's ids add up to one
        total = np.bincount(model.klass, np.exp(lm.within_class(model, np.full(lm.N_IDS, before), everything)))
        assert np.allclose(total, 1, atol=1e-4)


def test_training_follows_the_gradient():
    ids = np.concatenate([[lm.BOUNDARY, *([7, 9, 11] * 20), lm.BOUNDARY] for _ in range(200)])
    lengths = np.full(200, 61)
    model = small_model(1)
    none = np.zeros(len(ids))  # the classes' part alone
    before = lm.score_ids(model, ids, lengths, none).sum()
    memory = None
    for turn in range(40):
        memory = lm.train_pass(model, ids, lengths, turn, memory)
    after = lm.score_ids(model, ids, lengths, none).sum()
    assert after > 0.2 * before and np.isfinite(after)


def test_gradients_are_differences_of_the_loss():
    rng, model = np.random.default_rng(7), small_model(2)
    ids = rng.integers(0, 5000, (4, lm.WINDOW + 1))
    x, after = model.row[ids[:, :-1]], model.klass[ids[:, 1:]]
    counted = np.arange(lm.WINDOW) < np.array([lm.WINDOW, 5, 1, 9])[:, None]
    parts, near, out = lm.gradients(model, x, ids[:, :-1], after, counted)

    def loss(name, place, step):
        held = getattr(model, name)
        changed = held.astype(float)
        changed[place] += step
        setattr(model, name, changed.astype(np.float32))
        logits = lm._classes(model, lm._attend(model, lm._mask(model.near), x)[0].reshape(-1, lm.WIDTH), ids[:, :-1].ravel())
        setattr(model, name, held)
        logits = logits.astype(float)
        value = np.log(np.exp(logits).sum(1)) - logits[np.arange(len(logits)), after.ravel()]
        return value[counted.ravel()].sum()

    table = np.zeros_like(model.table)
    np.add.at(table, x.ravel(), parts)
    for name, gradient in (("table", table), ("near", near), ("out", out)):
        largest = np.argsort(-np.abs(gradient).ravel())[:12]
        for place in zip(*np.unravel_index(largest, gradient.shape), strict=True):
            slope = (loss(name, place, 0.01) - loss(name, place, -0.01)) / 0.02
            assert math.isclose(slope, gradient[place], rel_tol=0.05, abs_tol=0.02)


def test_the_model_beats_counts_on_held_out_documents(corpus, monkeypatch):
    """Held-out documents: above the class and pair counts that it starts from, and above a proper unigram
    over words that spells the unseen ones by their ids."""
    docs = corpus.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    remainder = language_mixture.remainder("doc_id", 7)
    models = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    scores = {r.doc_id: r.score for r in lm.score_documents(docs, remainder != 2).collect()}
    encode = lm.Encoder(*lm.vocabulary())
    words, ids, held = Counter(), Counter(), []
    for r in docs.collect():
        tokens = [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()), None]
        if zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            held.append((r.doc_id, r.text or "", tokens))
        else:
            words.update(tokens)
            ids.update([*encode(r.text or ""), lm.BOUNDARY])
    n, new, total = sum(words.values()), len(words), sum(ids.values()) + lm.N_IDS

    def spelled(word):
        return sum(math.log10((ids[i] + 1) / total) for i in [*encode(" " + word), lm.BOUNDARY])

    unigram = sum(math.log10(words[t] / (n + new)) if words[t] else math.log10(new / (n + new)) + spelled(t)
                  for _, _, tokens in held for t in tokens)
    assert sum(scores[doc] for doc, _, _ in held) > unigram
    # The same counts without attention: the classes' part of the score, with and without its output.
    parts = [np.array([lm.BOUNDARY, *encode(text), lm.BOUNDARY]) for _, text, _ in held]
    lengths, flat = np.array([len(p) - 1 for p in parts]), np.concatenate(parts)
    trained = lm.score_ids(models[0][0], flat, lengths, np.zeros(len(flat))).sum()
    models[0][0].out = np.zeros_like(models[0][0].out)
    assert trained > lm.score_ids(models[0][0], flat, lengths, np.zeros(len(flat))).sum()


def test_scores(corpus):
    docs = corpus.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(300)
    odd = corpus.createDataFrame([(-1, None), (-2, ""), (None, "A b")], "doc_id BIGINT, text STRING")
    both = docs.unionByName(odd).unionByName(docs.limit(1))
    rows = both.collect()
    remainder = language_mixture.remainder("doc_id", 7)
    got = lm.score_documents(both, remainder != 2).collect()

    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]

    counts = Counter()
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id is None, r.doc_id or 0, len(tokens(r.text)), sum(counts[t] > 0 for t in tokens(r.text)), n,
                   round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 6)) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score_documents(both.limit(0), remainder != 2).count() == 0


def test_every_pair_of_the_training_documents_counts(corpus, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "tea", "pot"]) + str(rng.randrange(40))
                         for _ in range(rng.randrange(60)))) for i in range(120)] + [(None, "lost row"), (500, None)]
    learned = [d for d in docs if d[0] is not None and d[0] % 3]
    seen = []
    start = lm._start
    monkeypatch.setattr(lm, "_start", lambda pairs: seen.append(pairs) or start(pairs))
    monkeypatch.setattr(lm, "STEP_BYTES", 2000)
    models = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    table = corpus.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(4)
    got = {r.doc_id: r.score for r in lm.score_documents(table, F.col("doc_id") % 3 != 0).collect()}
    encode = lm.Encoder(*lm.vocabulary())
    want = Counter()
    for _, text in learned:
        ids = [lm.BOUNDARY, *encode(text or ""), lm.BOUNDARY]
        want.update(a * lm.N_IDS + b for a, b in zip(ids, ids[1:]))
    cells, counts, kinds = lm._counted(seen[0], lambda before, ids, n: (before * lm.N_IDS + ids, n))
    assert dict(zip(cells.tolist(), counts.tolist(), strict=True)) == want and set(kinds) == {1}
    # Scores are those of a model that holds every pair itself.
    model = models[0][0]
    keys = np.array(sorted(want))
    model.pairs, model.left = lm._given_before(keys, np.array([want[k] for k in keys.tolist()]), model.klass, model.inside)
    for doc, text in docs:
        ids = np.array([lm.BOUNDARY, *encode(text or ""), lm.BOUNDARY])
        assert math.isclose(got[doc] * math.log(10), plain_score(model, ids), rel_tol=1e-4, abs_tol=1e-2)


def test_tasks_get_the_same_model(corpus):
    rng, model = np.random.default_rng(3), small_model(3)
    model.totals = np.where(rng.random(model.left.shape) < 0.01, 7.0, 0.0)
    model.left = np.where(model.totals > 0, -1.5, 0.0)
    model.prior = lm._prior(model.totals)
    copy = pickle.loads(pickle.dumps(model))
    for name in ("row", "klass", "inside", "prior", "left", "totals", "table", "near", "out"):
        assert np.array_equal(getattr(copy, name), getattr(model, name)), name


def test_a_lookup_loses_no_key():
    rng = np.random.default_rng(8)
    keys = rng.permutation(np.unique(rng.integers(0, lm.N_IDS ** 2, 200_000)))
    value, there = lm.Lookup(keys, keys / 2)(keys)
    assert there.all() and (value == keys / 2).all()
    assert not lm.Lookup(keys, keys / 2)(keys + lm.N_IDS ** 2)[1].any()
