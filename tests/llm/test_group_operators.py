"""Operators that bring rows together: components, sharding, SimHash, vectors, repeated windows, weak labels."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import rows
from pyspark import RDD
from pyspark.sql import functions as F

from fanchart.llm import decontaminate, fm_index, itq, quality, queries, sharding, simhash, substring
from fanchart.llm.components import connected_components
from fanchart.llm.sampling import distinct_texts


def roots_of(nodes, links):
    """Smallest node reachable, by brute force."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(9, 9), (5, 4), (4, 5)]
    got = connected_components(rows.table(spark, links, "a bigint, b bigint")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.root for r in got} == roots_of(nodes, [x for x in links if x[0] != x[1]])
    assert len(got) == len(nodes)
    assert connected_components(rows.table(spark, [], "a bigint, b bigint")).count() == 0


def sharded(spark, data, shards):
    records = rows.table(spark, data, "doc_id bigint, text string").select(
        "doc_id", sharding.size_of("text").alias("size"), sharding.virtual_slot("doc_id").alias("virtual_slot"))
    usage = sharding.slot_bytes(records)
    slot_map = sharding.initial_map(usage, shards)
    return records, usage, slot_map


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(2)
    data = [(i, "é" * rng.randrange(400)) for i in range(3000)] + [(None, None), (None, ""), (5, "again"), (5, "again")]
    records, usage, slot_map = sharded(spark, data, 8)
    placed = sharding.place(records, slot_map, "doc_id").collect()
    assert len(placed) == len(data)
    sizes, places = [0] * 8, [[] for _ in range(8)]
    for r in placed:
        sizes[r.shard] += r["size"]
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(sizes) - min(sizes) <= max(r.bytes for r in usage.collect())
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)


def test_a_new_shard_only_takes(spark):
    _, usage, slot_map = sharded(spark, [(i, "x" * (i % 97)) for i in range(4000)], 8)
    before = {r.virtual_slot: (r.version, r.shard) for r in slot_map.collect()}
    after = {r.virtual_slot: (r.version, r.shard) for r in sharding.grown_map(slot_map, usage).collect()}
    assert before.keys() == after.keys()
    assert {v for v, _ in before.values()} == {1} and {v for v, _ in after.values()} == {2}
    assert all(new in (8, before[slot][1]) for slot, (_, new) in after.items())
    weight = {r.virtual_slot: r.bytes for r in usage.collect()}
    share = sum(weight[slot] for slot, (_, shard) in after.items() if shard == 8) / sum(weight.values())
    assert 0.09 < share <= 0.1112


def test_shards_are_even_under_repeated_ids_and_rows(spark):
    """One id with many texts, and one row that makes a third of the table."""
    data = [(i, "x" * 50) for i in range(1300)] + [(7777, f"{i} " + "y" * 60) for i in range(1400)] + [(8888, "z" * 90)] * 1300
    records = rows.table(spark, data, "doc_id bigint, text string").withColumns({"start": F.lit("a"), "shard": F.lit(3), "place": F.lit(1)})
    records = records.withColumns({"size": sharding.size_of("text"), "crc": F.crc32(F.col("text").cast("binary"))})
    records = sharding.told_apart(records, "doc_id", "crc", "size")
    records = records.withColumn("virtual_slot", sharding.virtual_slot("_record", "_repeat")).cache()
    usage = sharding.slot_bytes(records)
    placed = sharding.place(records, sharding.initial_map(usage, 8), "doc_id").collect()
    assert len(placed) == len(data) and {r.start for r in placed} == {"a"}
    sizes, places = [0] * 8, [[] for _ in range(8)]
    for r in placed:
        sizes[r.shard] += r["size"]
        places[r.shard].append(r.place)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_sharding_query_against_brute_force(spark, sf_dir):
    got = queries.op2_sharding(spark, sf_dir).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    crc = zlib.crc32
    wanted = sorted((i, len((t or "").encode()) + 1, crc((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
    load, places, slots, later = [0] * 8, [[] for _ in range(8)], {}, [0] * 9
    for r in got:
        load[r.shard] += r["size"]
        later[r.shard_version_2] += r["size"]
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and r.shard_version_2 in (8, r.shard)
        # A virtual slot lies in one shard of either version.
        assert slots.setdefault(r.virtual_slot, (r.shard, r.shard_version_2)) == (r.shard, r.shard_version_2)
    assert all(sorted(p) == list(range(len(p))) for p in places)
    heaviest = max(sum(r["size"] for r in got if r.virtual_slot == s) for s in slots)
    assert max(load) - min(load) <= heaviest and later[8] <= sum(load) / 9


def test_sharding_an_empty_table(spark):
    records, _, slot_map = sharded(spark, [], 8)
    assert sharding.place(records, slot_map, "doc_id").count() == 0


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    pieces = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [simhash.xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [*rows.EDGES, "one two three", "A b\vc\x0cd e", rows.prose(3, 300), "tie tie tie tie tie x"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hash_is_the_one_spark_has(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % 2**64 == simhash.xxhash.xxh64_intdigest(b"a b c d", 42)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = [m % 2**64 for m in simhash.covering_masks(4)], random.Random(1)
    for _ in range(20_000):
        differ = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(mask & differ == 0 for mask in masks)
    assert all(28 <= mask.bit_count() <= 36 for mask in masks)


@pytest.mark.parametrize("group", [4096, 5])
def test_links_connect_what_all_pairs_connect(spark, group):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            flips = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False))
            values.add(int(c) ^ flips)
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    links = simhash.fingerprint_links(rows.table(spark, [(v,) for v in signed], "fp bigint"), 4, group)
    wanted = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    found = [(r.a, r.b) for r in links.distinct().collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in found)
    assert roots_of(signed, found) == roots_of(signed, wanted)


def test_near_duplicates_of_edges(spark):
    texts = [*rows.EDGES, rows.prose(1, 400), rows.prose(1, 400) + " more", rows.prose(9, 400)]
    got = {r.doc_id: r for r in simhash.near_duplicates(rows.documents(spark, texts, 10)).collect()}
    marks = {i: plain_fingerprint(t) for i, t in enumerate(texts, 10)}
    links = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == roots_of(marks, links)
    twice = rows.table(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (None, "z")], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(twice).collect()) == [
        ("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert simhash.near_duplicates(rows.documents(spark, [])).count() == 0


def vectors(seed):
    """Clusters of near-duplicates around random directions, exact copies, scaled copies and unusable rows."""
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for _ in range(40):
        centre = rng.normal(size=64)
        for _ in range(rng.integers(1, 12)):
            v = centre + rng.normal(size=64) * rng.uniform(0, 0.22)
            out.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 2)), None))
            i += 1
    first = out[0][1]
    out += [(i + k, first, out[0][2], None) for k in range(5)] + [(i + 5, [2 * x for x in first], out[0][2], None)]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3]
    out += [(i + 6 + k, v, 0, None) for k, v in enumerate(bad)] + [(i + 20, first, None, None), (None, first, out[0][2], None)]
    return out


@pytest.mark.parametrize("group", [1024, 4])
def test_vectors_against_brute_force(spark, group, monkeypatch):
    data = vectors(group)
    monkeypatch.setattr(itq.nearest_links, "__defaults__", (itq.THRESHOLD, group))
    df = rows.table(spark, data, "vec_id bigint, embedding array<float>, label int, n_links int")
    got = itq.near_duplicate_vectors(df).collect()
    assert len(got) == len(data)
    good = [k for k, (_, v, label, _) in enumerate(data) if label is not None and v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(data[k][1]) / np.linalg.norm(data[k][1]) for k in good}
    links = {(a, b) for a in good for b in good if a != b and data[a][2] == data[b][2] and unit[a] @ unit[b] >= 0.98}
    wanted = {data[k][0]: sum(a == k for a, _ in links) for k in range(len(data))}
    assert all(r.n_links <= wanted[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(wanted.values())
    for r in got:
        if wanted[r.vec_id] == 0:
            assert r.component_id == r.vec_id and r.kept
    assert {r.component_id for r in got if r.vec_id is None} == {0}


def test_no_vectors(spark):
    empty = rows.table(spark, [], "vec_id bigint, embedding array<float>, label int")
    assert itq.near_duplicate_vectors(empty).count() == 0
    unusable = rows.table(spark, [(1, None, 1), (2, [1.0], None)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, itq.near_duplicate_vectors(unusable).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_wider_keys_take_more_tables():
    for n in (10, 10**6, 10**11):
        width = itq.key_bits(n)
        masks = itq.tables_for(width)
        same = (1 - math.acos(itq.THRESHOLD) / math.pi) ** width
        assert 1 - (1 - same) ** len(masks) >= itq.RECALL and {int(m).bit_count() for m in masks} == {width}


def test_the_number_of_tables_is_bounded():
    seen = set()
    for angle in (math.acos(itq.THRESHOLD), 0.4, 0.65, 1.2, math.pi / 2):
        for n, together in ((0, 0.0), (1, 1.0), (10**4, 500.0), (10**6, 10.0**6), (10**11, 10.0**10)):
            width = itq.width_for(n, together, angle)
            masks = itq.tables_for(width, angle=angle)
            assert len(masks) <= itq.TABLES and {int(m).bit_count() for m in masks} == {width}
            assert width == 0 or 1 - (1 - (1 - angle / math.pi) ** width) ** len(masks) >= itq.RECALL
            seen.add("label" if not width else "wide" if width == itq.key_bits(n) else "narrow")
    assert seen == {"label", "wide", "narrow"}


@pytest.mark.parametrize("offset, group", [(3.0, 1024), (3.0, 20), (5.7, 20)])
def test_recall_where_vectors_share_a_direction(spark, offset, group, monkeypatch):
    monkeypatch.setattr(itq.nearest_links, "__defaults__", (itq.THRESHOLD, group))
    rng = np.random.default_rng(11)
    base = rng.normal(size=(500, 64)) / 8 + offset * np.eye(64)[0]
    # Twins on either side of the threshold.
    twin = base + rng.normal(size=base.shape) * 0.025 * np.linalg.norm(base, axis=1, keepdims=True) * rng.uniform(0.7, 1.1, (500, 1))
    data = [(i, v.tolist(), i % 2) for i, v in enumerate(np.vstack([base, twin]))]
    got = itq.near_duplicate_vectors(rows.table(spark, data, "vec_id bigint, embedding array<double>, label int")).collect()
    unit = np.array([v for _, v, _ in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.arange(1000) % 2
    links = (unit @ unit.T >= itq.THRESHOLD) & (label[:, None] == label) & ~np.eye(1000, dtype=bool)
    for own in (0, 1):
        wanted = links[label == own].sum()
        assert 0 < 0.99 * wanted <= sum(r.n_links for r in got if r.vec_id % 2 == own) <= wanted


def test_codes_are_balanced():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(2000, 16)) @ rng.normal(size=(16, 16)) + 3
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    codes = itq.Rotation(sample).codes(sample)
    shares = [np.mean((codes >> np.uint64(i) & np.uint64(1)) == 1) for i in range(64)]
    assert all(0.25 < share < 0.75 for share in shares)


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 200)
    text[::23] = 0
    index = fm_index.FMIndex(text, np.arange(200) // 23, 64)
    for _ in range(200):
        pattern = rng.integers(1, 4, rng.integers(1, 6))
        low, high = np.array([0]), np.array([200])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        places = [i for i in range(200 - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
        assert high[0] - low[0] == len(places)
        if places:
            assert index.owners.least(low, high)[0] == min(i // 23 for i in places)


def plain_removal(docs, window):
    """doc_id to (words, removed, digest), for distinct ids."""
    first, out = {}, {}
    for i in sorted(docs):
        words = (docs[i] or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first.setdefault(tuple(words[p : p + window]), i) < i:
                gone[p : p + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("group, shard_words", [(4000, 400_000), (3, 300)])
def test_repeated_windows_against_brute_force(spark, group, shard_words, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard_words)
    passage, half = rows.prose(1, 120), rows.prose(2, 49)
    texts = [*rows.EDGES, passage, passage, half, half, "the " * 400, "the " * 90]
    texts += [rows.prose(10 + i, 60) + "\n" + passage + "\t" + rows.prose(30 + i, 40) for i in range(8)]
    texts += [" ".join(w if k % 67 else f"edit{i}" for k, w in enumerate(rows.prose(5, 300).split())) for i in range(8)]
    texts += [passage + " " + passage, rows.prose(6, 3) * 400]
    got = substring.remove_repeated_windows(rows.documents(spark, texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == plain_removal(dict(enumerate(texts)), 50)


def test_repeated_windows_of_rows_without_or_with_equal_ids(spark):
    passage = rows.prose(1, 80)
    data = [(3, passage), (3, passage), (3, passage + " x"), (None, passage), (4, passage), (4, passage)]
    got = substring.remove_repeated_windows(rows.table(spark, data, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("3", 0), ("3", 0), ("3", 0), ("4", 80), ("4", 80), ("None", 0)]
    assert substring.remove_repeated_windows(rows.documents(spark, [])).count() == 0


def test_many_rows_of_one_id(spark):
    """Texts and repeats of one id neither multiply nor remove one another."""
    passage = rows.prose(40, 70)
    data = [(1, passage)] + [(5, f"head{i} " + passage) for i in range(60)] + [(5, "again " + passage)] * 60 + [(6, passage + " x")]
    got = substring.remove_repeated_windows(rows.table(spark, data, "doc_id bigint, text string")).collect()
    assert len(got) == len(data)
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 70, 0)] + [(5, 71, 70)] * 120 + [(6, 71, 70)]


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(3)
    sound = rng.random(20_000) < 0.85
    share = {True: [0.01, 0.002, 0.03], False: [0.9, 0.6, 0.7]}
    votes = ["".join("r" if rng.random() < p else "k" for p in share[bool(s)]) for s in sound]
    counts = {v: votes.count(v) for v in set(votes)}
    keep, rates = quality.estimate(sorted(counts.items()))
    assert np.allclose(rates, np.array([share[False], share[True]]).T, atol=0.03)
    assert np.mean([(keep[v] >= 0.5) == s for v, s in zip(votes, sound)]) > 0.97


def plain_quality(docs, labels, steps=300, rate=0.05, decay=1e-4):
    """(score, votes) by id: buckets, vote counts and the scorer's fit by plain loops and dense matrices."""
    toxic = {}
    for i, label in labels:
        if i is not None and label is not None:
            toxic[i] = max(toxic.get(i, 0), int(label == 1))
    known = {}
    for i, text in docs:
        if i in toxic:
            known[text] = max(known.get(text, 0), toxic[i])
    listed, share = {}, sum(known.values()) / max(len(known), 1)
    counts = {}
    for text, bad in known.items():
        words = set(decontaminate.words_of(text))
        hashed = {zlib.crc32(w) % quality.BUCKETS for w in words}
        hashed |= {zlib.crc32(b"\0" + w[:6]) % quality.BUCKETS + quality.BUCKETS for w in words}
        for h in hashed:
            n, b = counts.get(h, (0, 0))
            counts[h] = n + 1, b + bad
    for h, (n, b) in counts.items():
        p, z = b / n, quality.DEVIATIONS
        low = (p + z**2 / n / 2 - z * math.sqrt(p * (1 - p) / n + (z / n / 2) ** 2)) / (1 + z**2 / n)
        if low > (1 + share) / 2:
            listed[h] = -math.log(1 - low)
    evidence = np.zeros(2 * quality.BUCKETS if 0 < share < 1 else 0)
    for h, e in listed.items():
        evidence[h] = e
    own = {}
    for text in {t for _, t in docs}:
        words = decontaminate.words_of(text)
        own[text] = quality.votes_of(text, words, quality.hashes_of(words), evidence)
    keep, _ = quality.posteriors(sorted(Counter(own[t] for _, t in docs).items()))
    different = list(own)
    columns = quality.FEATURES + 3 * len(quality.LABELLERS)
    index = {}
    rows_ = []
    for text in different:
        words = set(decontaminate.words_of(text))
        hashed = {zlib.crc32(w) % quality.FEATURES for w in words}
        hashed |= {zlib.crc32(b"\0" + w[:6]) % quality.FEATURES for w in words}
        cast = {quality.FEATURES + 3 * i + "kra".index(v) for i, v in enumerate(own[text])}
        rows_.append({c: 1 / math.sqrt(len(hashed)) for c in hashed} | dict.fromkeys(cast, 1.0))
        for c in rows_[-1]:
            index.setdefault(c, len(index))
    assert max(index) < columns
    x = np.zeros((len(different), len(index) + 1))
    for i, row in enumerate(rows_):
        x[i, -1] = 1
        for c, v in row.items():
            x[i, index[c]] = v
    goal = np.array([keep[own[t]] for t in different])
    shrink = np.array([decay if c < quality.FEATURES else 0.0 for c in index] + [0.0])
    w, mean, square = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - goal) / len(different) + shrink * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w = w - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    scores = 1 / (1 + np.exp(-(x @ w)))
    return {t: (float(s), own[t]) for t, s in zip(different, scores)}


def test_quality_query_against_a_plain_version(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    wanted, text = plain_quality(docs, labels), dict(docs)
    got = queries.queries()["op10_quality"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        score, votes = wanted[text[r.doc_id]]
        assert r.votes == votes and abs(r.score - score) < 1e-3 and (r.keep == (score >= 0.5) or abs(score - 0.5) < 1e-3)


def test_listed_words_have_no_shortest_length_and_count_texts_once(spark):
    marks, plain = ["zq", "yx", "\u4eba"], [f"w{i} of the day" for i in range(60)]
    texts = [(i, f"{marks[i % 3]} {marks[(i + 1) % 3]} w{i} day") for i in range(12)] + list(enumerate(plain, 100))
    # One toxic text a thousand times, by one id and by many: its own words are no evidence.
    texts += [(500 + i % 40, "copied stuff day") for i in range(1000)]
    labels = [(i, 0, int(i < 100 or i >= 500)) for i in {i for i, _ in texts}]
    docs = rows.table(spark, texts, "doc_id bigint, text string")
    listed = quality.listed_buckets(docs, rows.table(spark, labels, "doc_id bigint, quality int, toxic int"))
    assert all(listed[zlib.crc32(m.encode()) % quality.BUCKETS] for m in marks)
    assert not any(listed[zlib.crc32(w) % quality.BUCKETS] for w in [b"copied", b"stuff", b"day", b"of", b"w1"])
    vote = {t: quality.Classifier(listed).votes(t)[1][-2] for t in ["zq yx" + " ok" * 20, "zq" + " ok" * 20, "ok " * 20]}
    assert list(vote.values()) == ["r", "a", "k"]


def test_fitted_texts_are_bounded_whatever_the_ids(spark):
    texts = [(7, rows.prose(i, 30)) for i in range(300)] + [(i, "same text " * 5) for i in range(300)]
    docs = rows.table(spark, texts, "doc_id bigint, text string")
    chosen = [r.text for r in distinct_texts(docs, 40).collect()]
    assert len(chosen) == len(set(chosen)) == 40
    assert len(distinct_texts(docs, 40, total=600).collect()) <= 40
    assert len(distinct_texts(docs, 1000, total=600).collect()) == 301


def test_quality_on_held_out_labels(spark):
    """Fitted on word lists from half of the labels, judged on the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    classifier = quality.fit(docs.select("doc_id", "text"), labels.filter(half), fitted=4000)
    judged = docs.join(labels.filter(~half), "doc_id").select("text", "quality", "toxic")
    got = quality.score_documents(judged, classifier).collect()
    good = [r.keep for r in got if r.quality == 1 and r.toxic == 0]
    poor = [r.keep for r in got if r.quality == 0]
    toxic = [r.keep for r in got if r.toxic == 1]
    assert np.mean(good) > 0.95 and np.mean(poor) < 0.05 and np.mean(toxic) < 0.1


def test_quality_of_edges(spark):
    docs = rows.documents(spark, [*rows.EDGES, *(rows.prose(i, 200) for i in range(30)), "LOUD!! WORDS!! " * 40, "a | b | " * 50])
    none = rows.table(spark, [], "doc_id bigint, quality int, toxic int")
    classifier = quality.fit(docs.select("doc_id", "text"), none)
    got = quality.score_documents(docs, classifier).orderBy("doc_id").collect()
    assert not any(r.keep for r in got[:3]) and not got[-1].keep and not got[-2].keep
    assert all(r.keep for r in got[-32:-2])
    empty = docs.limit(0)
    assert quality.score_documents(empty, quality.fit(empty.select("doc_id", "text"), none)).count() == 0
    toxic = rows.table(spark, [(10, None, 1), (None, 1, None), (11, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score_documents(docs, quality.fit(docs.select("doc_id", "text"), toxic)).count() == docs.count()


def test_every_chosen_document_is_fitted_on_whatever_the_order(spark, monkeypatch):
    assert (quality.FITTED, quality.FEATURES) == (12_000, 1 << 18)
    docs = rows.documents(spark, [rows.prose(i, 60 + 20 * i) for i in range(40)]).select("doc_id", "text")
    none = rows.table(spark, [], "doc_id bigint, quality int, toxic int")
    fit, fitted = quality.fit_scorer, []

    def few_steps(sample):
        fitted.append(sample.count())
        return fit(sample, steps=3)

    # The bound that the sample used to stop at.
    monkeypatch.setattr(quality, "FITTED_FEATURES", 100, raising=False)
    monkeypatch.setattr(quality, "fit_scorer", few_steps)
    a, b = (quality.fit(d, none, fitted=30).weights for d in (docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1)))
    assert fitted == [30, 30] and np.allclose(a, b, atol=1e-5)


def test_the_fit_sends_the_driver_numbers_of_the_samples_features_only(spark, monkeypatch):
    votes = [quality.FEATURES + 3 * i for i in range(len(quality.LABELLERS))]
    sample = [(i % 5 / 8 + i % 3 / 7, np.array([*{7 * (i % 5), 250_000 + i % 3}, *votes], dtype=np.int32).tobytes()) for i in range(40)]
    different = len({f for _, b in sample for f in np.frombuffer(b, dtype=np.int32)})
    collect, sizes = RDD.collect, []

    def watched(self):
        got = collect(self)
        sizes.extend(len(x) for x in got if isinstance(x, np.ndarray))
        return got

    monkeypatch.setattr(RDD, "collect", watched)
    weights = quality.fit_scorer(rows.table(spark, sample, "goal double, features binary"), steps=20)
    assert sizes and max(sizes) <= different + 2
    # The same steps with a weight for every feature.
    goals = np.array([g for g, _ in sample])
    dense = np.zeros((len(sample), quality.FEATURES + 3 * len(quality.LABELLERS) + 1), dtype=np.float32)
    for own, (_, b) in zip(dense, sample):
        features = np.frombuffer(b, dtype=np.int32)
        own[features], own[-1] = quality.scales_of(features), 1
    plain, mean, square = np.zeros(dense.shape[1]), 0, 0
    for step in range(1, 21):
        slope = dense.T @ (1 / (1 + np.exp(-dense @ plain)) - goals) / len(goals)
        slope[: quality.FEATURES] += 1e-4 * plain[: quality.FEATURES]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        plain = plain - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    assert len(weights) == len(plain) and np.allclose(weights, plain, atol=1e-3)


def test_the_most_frequent_word_is_counted_in_the_whole_text():
    words = [w for i in range(25) for w in (b"a%d" % i, b"buy")]
    votes = quality.votes_of(b" ".join(words).decode(), words, frozenset(), frozenset())
    assert votes[quality.LABELLERS.index("top_word")] == quality.REJECT


def test_pairs_are_found_under_a_common_offset(spark):
    rng = np.random.default_rng(5)
    offset = 3 * np.eye(64)[0]
    base = rng.normal(size=(400, 64)) / 8 + offset
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base / (base**2).sum(axis=1, keepdims=True)
    twin = base + side * 0.18 * np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(side, axis=1, keepdims=True)
    data = [(i, v.tolist(), i % 400 % 2) for i, v in enumerate(np.vstack([base, twin]))]
    got = itq.near_duplicate_vectors(rows.table(spark, data, "vec_id bigint, embedding array<double>, label int")).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in data}
    matrix = np.stack([unit[i] for i in range(800)])
    same = np.equal.outer(*[np.array([label for _, _, label in data])] * 2)
    links = (matrix @ matrix.T >= 0.98) & same & ~np.eye(800, dtype=bool)
    for label in (0, 1):
        found = sum(r.n_links for r in got if r.vec_id % 400 % 2 == label)
        assert found >= 0.98 * links[[i for i, _, own in data if own == label]].sum() > 0
