"""Whitening, toxicity and centroids against plain versions, on edge cases and on whole tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import rows

from fanchart.llm import centroids, queries, toxicity, whitening

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, index int, x string, cluster string"


def vectors(spark, data):
    """(vec_id, embedding) with extra columns whose names clash with those that operators make."""
    return rows.table(spark, [(i, v, 1, 3, "x", "y") for i, v in data], VECTORS)


def gaussian(seed, n, size, first=0):
    rng = np.random.default_rng(seed)
    scales = np.linspace(0.02, 0.3, size)
    return [(first + i, [float(np.float32(c)) for c in rng.normal(size=size) * scales]) for i in range(n)]


# Whitening


def plain_whitening(data, used=8):
    kept = [(i, v) for i, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] + [100000] * (size - len(v)) for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    centred = off.astype(float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    used = min(used, size)
    with np.errstate(all="ignore"):
        z = centred @ turn[:, :used] / np.sqrt(values[:used])
    return [i for i, _ in kept], n, (off**2).sum(axis=1), z, values[:used] / values.sum(), values


def compare_whitening(got, data, used):
    ids, n, deviation, z, explained, _ = plain_whitening(data)
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    assert len(got) == len(ids) * z.shape[1]
    for c in range(used):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == c + 1)
        wanted = sorted((str(i), d, v) for i, d, v in zip(ids, deviation, z[:, c]))
        turned = sorted((str(i), d, -v) for i, d, v in zip(ids, deviation, z[:, c]))
        close = [all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(mine, w)) for w in (wanted, turned)]
        assert any(close), c
    assert {r.n for r in got} == {n}
    assert all(abs(r.explained - explained[r.component - 1]) <= 1e-9 for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_query_against_numpy(spark, sf_dir):
    got = queries.op11_whitening(spark, sf_dir).collect()
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare_whitening(got, data, 8)
    first = [r for r in got if r.component == 1]
    assert all(type(r.deviation) is int and type(r.component) is int for r in first)


@pytest.mark.parametrize("split", [32, 1])
def test_whitening_in_several_blocks(spark, monkeypatch, split):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 4)
    monkeypatch.setattr(whitening, "SPLIT", split)
    data = gaussian(1, 100, 10)
    compare_whitening(whitening.whitened_rows(vectors(spark, data)).collect(), data, 8)


def test_whitening_edges(spark):
    odd = [(900, None), (901, [0.1, None]), (902, [NAN] * 6), (903, [INF] * 6), (904, [-INF, 0.0])]
    data = gaussian(2, 60, 6) + odd + [(None, [0.1] * 6), (7, [0.2] * 6), (7, [0.2] * 6), (950, []), (951, [0.5])]
    got = whitening.whitened_rows(vectors(spark, data)).collect()
    compare_whitening(got, data, 6)
    assert not {r.vec_id for r in got} & {900, 901, 902, 903, 904}


def test_whitening_of_flat_directions(spark):
    data = [(i, [0.1 * i, 0.2 * i, 0.5]) for i in range(20)]
    got = whitening.whitened_rows(vectors(spark, data)).collect()
    flat = {r.component for r in got if r.whitened is None}
    assert 3 in flat and 1 not in flat and {r.component for r in got} == {1, 2, 3}
    assert got[0].identity_error < 1e-6
    one = whitening.whitened_rows(vectors(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]


def test_whitening_of_nothing(spark):
    for data in ([], [(1, None)], [(1, [])]):
        got = whitening.whitened_rows(vectors(spark, data))
        assert got.count() == 0 and "identity_error" in got.columns


def test_whitening_refuses_what_sums_cannot_hold(spark):
    with pytest.raises(Exception, match="too large"):
        whitening.whitened_rows(vectors(spark, [(1, [1e30])])).collect()


# Toxicity

BAD = ["vilewort", "grimlout", "foulknave"]


def plain_ngrams(text):
    padded = " " + " ".join((text or "").lower().split()) + " "
    found = set()
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        found |= {padded[i : i + n] for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]}
    return found


def test_ngrams():
    ngrams = toxicity.Ngrams(22)
    for text in ["ab", "Abc abd", "x  \n yz", "ÉcOlE des", *rows.EDGES, rows.prose(4, 200)]:
        got, wanted = ngrams(text).tolist(), plain_ngrams(text)
        # A bucket may hold several n-grams, hardly ever in one text, and no flag is left behind.
        assert sorted(set(got)) == got and 0.98 * len(wanted) <= len(got) <= len(wanted)
        assert not ngrams.seen.any()
    assert set(ngrams("grim lout").tolist()) <= set(ngrams("a grim lout b").tolist())
    assert not len(ngrams("")) and not len(ngrams(None)) and not len(ngrams(" \n "))


def test_pieces_of_long_texts_miss_nothing(monkeypatch):
    text = rows.prose(8, 400)
    whole = toxicity.Ngrams()(text).tolist()
    monkeypatch.setattr(toxicity, "PIECE", 11)
    assert toxicity.Ngrams()(text).tolist() == whole


def toxic_texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 40))] + ([rng.choice(BAD)] if bad else [])
        rng.shuffle(words)
        out.append((i, " ".join(words), int(bad)))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def both(spark, data):
    docs = rows.table(spark, [(i, t, 0.5, "s") for i, t, _ in data], "doc_id bigint, text string, score double, toxic string")
    return docs, rows.table(spark, [(i, y) for i, _, y in data], "doc_id bigint, toxic int")


def test_toxicity_on_held_out_rows(spark):
    data = toxic_texts(600)
    docs, labels = both(spark, data)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(data)
    assert all(got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.5) for i, _, _ in data)
    unseen = [(got[i].predicted, y) for i, _, y in data if held(i)]
    assert len(unseen) > 80 and all(p == y for p, y in unseen)
    # Labels of held-out rows change nothing.
    turned, labels = both(spark, [(i, t, 1 - y if held(i) else y) for i, t, y in data])
    again = {r.doc_id: r.score for r in toxicity.toxicity(turned, labels).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in again)


def test_fit_is_the_lowest_point_of_the_loss(spark):
    data = toxic_texts(300, 3)
    docs, labels = both(spark, data)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    ngrams = toxicity.Ngrams()
    learnt = [(ngrams(t), y) for i, t, y in data if not held(i)]
    counts = np.zeros((2, 1 << toxicity.BITS))
    for b, y in learnt:
        counts[1 - y, b] += 1
    p, q = counts + 1.0
    ratios = np.where(counts.sum(axis=0) >= toxicity.FEWEST, np.log(p / p.sum() / (q / q.sum())), 0)
    weights = np.divide(model.coefficients, ratios, out=np.zeros_like(ratios), where=ratios != 0)
    slope = toxicity.RIDGE * weights
    for b, y in learnt:
        slope[b] += (model.score(b) - y) * ratios[b] / len(learnt)
    start = np.zeros_like(slope)
    for b, y in learnt:
        start[b] += (np.mean([y for _, y in learnt]) - y) * ratios[b] / len(learnt)
    assert np.linalg.norm(slope) < 0.02 * np.linalg.norm(start)


def test_toxicity_edges(spark):
    data = toxic_texts(120, 5) + [(1000 + i, t, 0) for i, t in enumerate(rows.EDGES)]
    docs, labels = both(spark, data)
    extra = rows.table(spark, [(None, "vilewort", 0.1, "s"), (3, data[3][1], 0.1, "s"), (None, None, None, None)], docs.schema.simpleString()[7:-1].replace(":", " "))
    known = labels.union(rows.table(spark, [(None, 1), (4, None), (5, data[5][2]), (77_777, 1)], "doc_id bigint, toxic int"))
    got = toxicity.toxicity(docs.union(extra), known).collect()
    assert len(got) == len(data) + 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    empty = {r.score for r in got if r.doc_id in (1000, 1001, 1002)}
    assert len(empty) == 1


@pytest.mark.parametrize("toxic, wanted", [(None, 0.5), (0, 0.0), (1, 1.0)])
def test_toxicity_with_labels_of_one_class(spark, toxic, wanted):
    docs, labels = both(spark, [(i, f"word{i}", toxic) for i in range(30)])
    assert all(abs(r.score - wanted) < 1e-9 for r in toxicity.toxicity(docs, labels).collect())


def test_no_more_texts_than_the_bound_are_learnt_from(spark):
    texts = [(1, f"text {i % 40}", 1) for i in range(200)] + [(i, f"own {i}", 0) for i in range(2, 60)]
    docs = rows.table(spark, [(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = rows.table(spark, sorted({(i, y) for i, _, y in texts}), "doc_id bigint, toxic int")
    few = toxicity.labelled_texts(docs, labels, 20).collect()
    every = toxicity.labelled_texts(docs, labels, 10_000).collect()
    assert len(few) == 20
    # A text that a hot id repeats is learnt from once, and no held-out one at all.
    assert len(every) == (0 if held(1) else 40) + sum(not held(i) for i in range(2, 60))


def test_toxicity_of_an_empty_table(spark):
    docs, labels = both(spark, [])
    assert toxicity.toxicity(docs, labels).count() == 0


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    learnt = [(got[i].predicted, y) for i, y in labels.items() if i in got and not got[i].held_out]
    assert sum(p == y for p, y in learnt) >= 0.98 * len(learnt)
    unseen = [(got[i].predicted, y) for i, y in labels.items() if i in got and got[i].held_out]
    assert sum(p == y for p, y in unseen) >= 0.9 * len(unseen)


# Centroids


def plain_clusters(data, size, k=8, rounds=10):
    kept = [(i, v) for i, v in data if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    points = [(i, [math.floor(1024 * c) for c in v]) for i, v in kept]
    order = sorted(points, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in points:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres)))
        return out

    for _ in range(rounds):
        got = assign()
        for i in range(len(centres)):
            own = [v for (_, v), (_, j) in zip(points, got) if j == i]
            if own:
                centres[i] = [sum(column) // len(own) for column in zip(*own)]
    got = assign()
    total = sum(d for d, _ in got)
    return sorted(
        (str(vec), i, d, sum(e for e, j in got if j == i), total, hashlib.sha256(",".join(map(str, centres[i])).encode()).hexdigest())
        for (vec, _), (d, i) in zip(points, got)
    )


def listed(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_centroids_against_a_plain_version(spark):
    data = gaussian(3, 250, 5) + [(400 + i, v) for i, (_, v) in enumerate(gaussian(3, 30, 5))]
    assert listed(centroids.clusters(vectors(spark, data), dimensions=5)) == plain_clusters(data, 5)


def test_centroids_with_ties(spark):
    """Points on a coarse grid lie equally far from many centroids."""
    rng = random.Random(6)
    data = [(i, [rng.randrange(-2, 3) / 64 for _ in range(3)]) for i in range(200)]
    assert listed(centroids.clusters(vectors(spark, data), dimensions=3)) == plain_clusters(data, 3)


def test_centroids_edges(spark):
    odd = [(900, None), (901, [0.1, None, 0.1]), (902, [NAN] * 3), (903, [INF] * 3), (904, [0.1]), (905, []), (906, [0.1] * 4)]
    data = gaussian(2, 20, 3) + odd + [(None, [0.1] * 3), (7, [0.2] * 3), (7, [0.2] * 3), (7, [0.2] * 3)]
    assert listed(centroids.clusters(vectors(spark, data), dimensions=3)) == plain_clusters(data, 3)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_fewer_vectors_than_centroids(spark, n):
    data = gaussian(4, n, 3)
    assert listed(centroids.clusters(vectors(spark, data), dimensions=3)) == plain_clusters(data, 3)


def test_equal_starts_leave_later_centroids_empty(spark):
    data = [(i, [0.5, 0.25]) for i in range(30)]
    got = listed(centroids.clusters(vectors(spark, data), dimensions=2))
    assert got == plain_clusters(data, 2) and {r[1] for r in got} == {0}


def test_centroids_of_nothing(spark):
    for data in ([], [(1, None)], [(1, [0.5])]):
        assert centroids.clusters(vectors(spark, data)).count() == 0


def test_bounds_save_distances():
    """Assignments stay exact while most distances are never computed."""
    rng = np.random.default_rng(1)
    points = rng.integers(-1000, 1000, (16, 8))
    data = np.concatenate([p + rng.integers(-60, 60, (200, 8)) for p in points])
    n = len(data)
    cluster, second, upper, lower = np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n)
    moves, computed = np.zeros(16), []
    for _ in range(6):
        now = centroids.Centroids(points, moves)
        computed.append(now.assign(data, cluster, second, upper, lower))
        all_ = ((data[:, None] - points) ** 2).sum(axis=2)
        assert (cluster == all_.argmin(axis=1)).all()
        rest = np.where(np.arange(16) == cluster[:, None], np.iinfo(np.int64).max, all_).min(axis=1)
        assert (lower <= np.sqrt(rest) * (1 + 1e-9)).all() and (upper >= np.sqrt(all_.min(axis=1)) * (1 - 1e-9)).all()
        shifted = points + rng.integers(-3, 4, points.shape)
        moves, points = np.sqrt(((shifted - points) ** 2).sum(axis=1)), shifted
    assert max(computed[1:]) < 0.1 * 16 * n


def test_centroids_refuse_what_longs_cannot_hold(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(vectors(spark, [(1, [1e9])]), dimensions=1).collect()
