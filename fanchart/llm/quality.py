"""Quality classifier from weak labels.

Heuristic labellers vote keep, reject or abstain on every document. Several look for the same fault. For each fault,
expectation-maximisation over the counts of all vote patterns estimates the accuracies of its labellers and gives every
pattern the probability that the fault is absent; a document's posterior is the product over the faults. Posteriors of a
bounded sample train a hashed linear scorer, which sees the words and the votes, and which decides on every document.

Counts of vote patterns cover all documents; there are at most 3^labellers of them, so they fit on the driver whatever
the input. The words of the last two labellers come from at most ``LABELLED`` distinct labelled texts; the scorer is
fitted on at most ``FITTED`` distinct texts, all features of each, by a Spark job a step. Both samples take the smallest
hashes of texts, so they do not depend on order, and copies or rows of one id, however many, count once.

A word is listed if the lower confidence bound of its share of toxic texts is far above theirs of all texts. Words are
listed by hash, one number a bucket, so that the list has a fixed size and every word that passes is in it. The product
of one minus the bounds, over a text's different listed words, must be at most ``DOUBT`` for a rejection, so that a word
listed on little evidence does not tell alone; beyond it the labeller abstains.

Null and empty texts have no words; only the labellers for emptiness reject them. Repeated rows count as often as they
occur, but in the samples. Without labels no word is listed and its labellers abstain. A label of 1 is toxic; an id with
several labels is toxic if one of them is. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from fanchart.llm.arrow import map_rows
from fanchart.llm.decontaminate import words_of
from fanchart.llm.sampling import distinct_texts, smallest_hashes
from fanchart.session import cut_lineage

KEEP, REJECT, ABSTAIN = "k", "r", "a"
# Bounds of the two samples, and the number of hashed features.
LABELLED, FITTED, FEATURES = 20_000, 12_000, 1 << 18
# Tasks of one step of the scorer's fit.
FIT_TASKS = 8
# Buckets of listed words; word beginnings have as many of their own.
BUCKETS = 1 << 20
# Standard deviations of the confidence bound, and the doubt that listed words may leave.
DEVIATIONS, DOUBT = 1.645, 0.2
# Shares of faulty and sound documents to start from; they stand where no labeller votes.
EXPECTED = np.array([0.05, 0.95])
# Bytes of a word's beginning, and the hash that beginnings start from, so that they differ from words.
PREFIX, MARKED = 6, zlib.crc32(b"\0")
# Labellers by the fault they look for. A document is bad if it has any fault, and faults come without one another.
ASPECTS = {
    "symbols": ["symbols", "symbol_runs", "bars"],
    "shouting": ["capitals", "exclamations"],
    "repetition": ["distinct_words", "echoes", "top_word"],
    "emptiness": ["few_words", "no_letters"],
    "toxicity": ["listed_words", "listed_prefixes"],
}
LABELLERS = [name for names in ASPECTS.values() for name in names]
_SYMBOLS, _CAPITALS = b"#$%&*|@^~<>\\{}=", bytes(range(65, 91))
_RUNS = [s * 3 for s in (b"#", b"$", b"%", b"&", b"*")]


def _vote(n: int, share: float, keep_up_to: float, reject_from: float) -> str:
    """By a share of something unwanted; texts of few words get no opinion unless the share is high."""
    if share >= reject_from:
        return REJECT
    return KEEP if share <= keep_up_to and n >= 20 else ABSTAIN


def hashes_of(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words, and of their different beginnings."""
    different = set(words)
    beginnings = {w[:PREFIX] for w in different}
    return (
        np.fromiter(map(zlib.crc32, different), np.int64, len(different)),
        np.fromiter((zlib.crc32(w, MARKED) for w in beginnings), np.int64, len(beginnings)),
    )


def listed_vote(n: int, found: float, known: bool) -> str:
    """By the evidence of listed words or beginnings."""
    if found >= -np.log(DOUBT):
        return REJECT
    return KEEP if known and not found and n >= 20 else ABSTAIN


def votes_of(text: str | None, words: list[bytes], hashes: tuple[np.ndarray, np.ndarray], listed: np.ndarray) -> str:
    """One letter per labeller; ``listed`` has the evidence per bucket of words, then of beginnings, or is empty."""
    data, n = (text or "").encode(), len(words)
    if not n:
        return "".join(REJECT if name in ASPECTS["emptiness"] else ABSTAIN for name in LABELLERS)
    size, tokens = len(data), data.count(b" ") + data.count(b"\n") + 1
    capitals = size - len(data.translate(None, _CAPITALS))
    different = set(words)
    # Words of a very long text recur by nature; the share of different ones is judged against the text's length.
    expected = min(1.0, 6 * n ** -0.4)
    known = len(listed) > 0
    found = [float(listed[own % BUCKETS + i * BUCKETS].sum()) if known else 0.0 for i, own in enumerate(hashes)]
    return "".join(
        [
            _vote(n, (size - len(data.translate(None, _SYMBOLS))) / size, 0.01, 0.08),
            _vote(n, sum(map(data.count, _RUNS)) / tokens, 0.02, 0.25),
            _vote(n, data.count(b"|") / tokens, 0.01, 0.2),
            _vote(n, capitals / size, 0.1, 0.45),
            _vote(n, data.count(b"!!") / tokens, 0.01, 0.3),
            _vote(n, 1 - len(different) / n / expected, 0.6, 0.8) if n >= 20 else ABSTAIN,
            _vote(n, sum(map(eq, words, words[1:])) / n, 0.05, 0.3) if n >= 8 else ABSTAIN,
            _vote(n, max(Counter(words).values()) / n, 0.15, 0.4) if n >= 20 else ABSTAIN,
            KEEP,
            KEEP if capitals or any(w.isalpha() or not w.isascii() for w in different) else REJECT,
            *(listed_vote(n, f, known) for f in found),
        ]
    )


def least_share(bad: Column, n: Column, deviations: float = DEVIATIONS) -> Column:
    """Lower end of Wilson's interval for the share ``bad`` / ``n``."""
    square = deviations**2
    spread = F.sqrt(bad * (n - bad) / n + square / 4)
    return (bad + square / 2 - deviations * spread) / (n + square)


def listed_buckets(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> np.ndarray:
    """Evidence, -log(1 - bound), of the buckets of words, then of beginnings, that mark toxic documents, 0 where they do
    not, from at most ``limit`` distinct labelled texts; empty if these are all toxic or all clean."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id")
    known = known.agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = smallest_hashes(known, "doc_id", known.count(), limit)
    # At most LABELLED narrow rows; one id may have any number of texts.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = cut_lineage(distinct_texts(rows, limit, F.max("toxic").alias("toxic")))
    total = texts.agg(F.count("*").alias("all"), F.sum("toxic").alias("bad")).first()
    if not total.bad or total.bad == total["all"]:
        return np.zeros(0, dtype=np.float32)

    def start():
        def buckets(text: str | None) -> tuple:
            words, beginnings = hashes_of(words_of(text))
            return (np.unique(np.concatenate([words % BUCKETS, beginnings % BUCKETS + BUCKETS])).tolist(),)

        return buckets

    held = map_rows(texts, ["text"], {"buckets": "array<int>"}, start).select("toxic", F.explode("buckets").alias("b"))
    counts = held.groupBy("b").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    # Halfway from the share of toxic texts to one, at least.
    share = total.bad / total["all"]
    low = counts.select("b", least_share(F.col("bad"), F.col("n")).alias("low")).filter(F.col("low") > (1 + share) / 2)
    found = low.toPandas()
    evidence = np.zeros(2 * BUCKETS, dtype=np.float32)
    evidence[found["b"].to_numpy(dtype=np.int64)] = -np.log1p(-found["low"].to_numpy(dtype=float))
    return evidence


def estimate(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """(probability of no fault by vote pattern, rates): EM for labellers that are independent given the truth.

    rates[labeller, truth] is the share of rejections among its votes, truth 0 = faulty, 1 = sound. Abstentions say
    nothing. Labellers are taken to be better than chance: a rejection of a sound document is rarer than one in 20, one
    of a faulty document more frequent than one in 4. It starts from "what anyone rejects is faulty".
    """
    votes = np.array([["kra".index(v) for v in p] for p, _ in patterns])
    counts = np.array([c for _, c in patterns], dtype=float)
    rejects, votes_cast = (votes == 1).astype(float), (votes != 2).astype(float)
    sound = np.where(rejects.any(axis=1), *EXPECTED)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - sound), counts * sound])
        prior = (weight.sum(axis=1) + 2 * EXPECTED) / (counts.sum() + 2)
        rates = (weight @ rejects + 0.1) / (weight @ votes_cast + 1)
        rates = np.stack([rates[0].clip(0.25, 0.999), rates[1].clip(1e-5, 0.05)])
        score = np.log(prior)[:, None] + np.log(rates) @ rejects.T + np.log(1 - rates) @ (votes_cast - rejects).T
        after = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(after - sound).max() < 1e-9:
            break
        sound = after
    return {p: float(k) for (p, _), k in zip(patterns, sound)}, rates.T


def posteriors(patterns: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """(probability to keep by vote pattern, rates by fault)."""
    keep, rates, at = {p: 1.0 for p, _ in patterns}, {}, 0
    for aspect, names in ASPECTS.items():
        own: dict[str, int] = {}
        for p, count in patterns:
            part = p[at : at + len(names)]
            own[part] = own.get(part, 0) + count
        sound, rates[aspect] = estimate(sorted(own.items()))
        for p in keep:
            keep[p] *= sound[p[at : at + len(names)]]
        at += len(names)
    return keep, rates


def features_of(hashes: tuple[np.ndarray, np.ndarray], votes: str) -> np.ndarray:
    """Hashed presence of words and word beginnings, ascending, then one feature per vote behind the hashed ones."""
    cast = [FEATURES + 3 * i + "kra".index(v) for i, v in enumerate(votes)]
    return np.concatenate([np.unique(np.concatenate(hashes) % FEATURES), np.array(cast, dtype=np.int64)])


def scales_of(features: np.ndarray) -> np.ndarray:
    """Words share a unit length; each vote counts whole."""
    words = len(features) - len(LABELLERS)
    return np.concatenate([np.full(words, 1 / np.sqrt(max(words, 1))), np.ones(len(LABELLERS))])


def packed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """All rows (goal, features) of a partition as one block: index, row, scale and goal."""
    goal, features = [], []
    for g, f in rows:
        goal.append(g)
        features.append(np.frombuffer(f, dtype=np.int32))
    if goal:
        row = np.repeat(np.arange(len(goal), dtype=np.int32), [len(f) for f in features])
        scale = np.concatenate([scales_of(f) for f in features]).astype(np.float32)
        yield np.concatenate(features), row, scale, np.array(goal)


def renumbered(block: tuple, used: np.ndarray) -> tuple:
    """The block with each feature by its place in ``used``, which has all of them in ascending order."""
    index, *rest = block
    return np.searchsorted(used, index).astype(np.int32), *rest


def slope_of(block: tuple, weights: np.ndarray) -> np.ndarray:
    """Sum of the slopes of a block's documents: by feature, then of the intercept, and the number of documents last."""
    index, row, scale, goal = block
    z = np.bincount(row, weights[index] * scale, minlength=len(goal)) + weights[-1]
    error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - goal
    return np.append(np.bincount(index, error[row] * scale, minlength=len(weights) - 1), [error.sum(), len(goal)])


def fit_scorer(sample: DataFrame, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the features, and the intercept last, of a logistic scorer for the soft labels of ``sample`` (goal,
    features): full-batch Adam. Tasks keep the documents and sum up their slopes; only slopes reach the driver.

    A feature that no document of the sample has keeps the weight 0, so the steps exchange numbers of the others only.
    """
    context = sample.sparkSession.sparkContext
    packs = sample.rdd.coalesce(FIT_TASKS).mapPartitions(packed).persist(StorageLevel.MEMORY_AND_DISK)
    # Each task's different features, once; there are at most FIT_TASKS tasks.
    used = np.unique(np.concatenate(packs.map(lambda block: np.unique(block[0])).collect()))
    places = context.broadcast(used)
    blocks = packs.map(lambda block: renumbered(block, places.value)).persist(StorageLevel.MEMORY_AND_DISK)
    weights = np.zeros(len(used) + 1)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    # Words explain what the votes leave open.
    shrink = np.append(np.where(used < FEATURES, decay, 0.0), 0.0)
    for step in range(1, steps + 1):
        shared = context.broadcast(weights)
        # One slope a task, at most FIT_TASKS of them.
        total = sum(blocks.map(lambda block, shared=shared: slope_of(block, shared.value)).collect())
        shared.destroy()
        slope = total[:-1] / total[-1] + shrink * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights = weights - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    blocks.unpersist()
    packs.unpersist()
    places.destroy()
    every = np.zeros(FEATURES + 3 * len(LABELLERS) + 1)
    every[used], every[-1] = weights[:-1], weights[-1]
    return every


class Classifier:
    """Listed buckets, posteriors and scorer; small and of fixed size, so it is sent to the tasks whole."""

    def __init__(self, listed: np.ndarray):
        self.listed = listed
        self.posterior: dict[str, float] = {}
        self.rates: dict[str, np.ndarray] = {}
        self.weights = np.zeros(FEATURES + 3 * len(LABELLERS) + 1, dtype=np.float32)

    def votes(self, text: str | None) -> tuple[tuple[np.ndarray, np.ndarray], str]:
        """Hashes of the words, and the votes."""
        words = words_of(text)
        hashes = hashes_of(words)
        return hashes, votes_of(text, words, hashes, self.listed)

    def score(self, text: str | None) -> tuple[float, str]:
        hashes, votes = self.votes(text)
        features = features_of(hashes, votes)
        z = float(self.weights[features] @ scales_of(features)) + float(self.weights[-1])
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500)))), votes


def fit(docs: DataFrame, labels: DataFrame, fitted: int = FITTED, labelled: int = LABELLED) -> Classifier:
    """Counts votes over all of ``docs`` and fits the scorer on at most ``fitted`` distinct texts of them."""
    context = docs.sparkSession.sparkContext
    classifier = Classifier(listed_buckets(docs, labels, labelled))
    shared = context.broadcast(classifier)

    def start_votes():
        votes = shared.value.votes
        return lambda text: (votes(text)[1],)

    voted = map_rows(docs.select("text"), ["text"], {"votes": "string"}, start_votes)
    patterns = [(r.votes, r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    if not patterns:
        return classifier
    classifier.posterior, classifier.rates = posteriors(patterns)

    posterior = context.broadcast(classifier.posterior)

    def start_features():
        votes = shared.value.votes

        def featured(text: str | None) -> tuple:
            hashes, own = votes(text)
            return posterior.value[own], features_of(hashes, own).astype(np.int32).tobytes()

        return featured

    total = sum(n for _, n in patterns)
    texts = distinct_texts(docs, fitted, total=total).repartition(FIT_TASKS, "digest")
    sample = map_rows(texts, ["text"], {"goal": "double", "features": "binary"}, start_features)
    # Read by every step's tasks until they hold it, so computed once.
    written = cut_lineage(sample.select("goal", "features"))
    classifier.weights = fit_scorer(written).astype(np.float32)
    return classifier


def score_documents(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with score (probability to keep), keep and votes in place of such columns."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def start():
        score = shared.value.score

        def scored(value: str | None) -> tuple:
            probability, votes = score(value)
            return probability, probability >= 0.5, votes

        return scored

    return map_rows(docs, [text], {"score": "double", "keep": "boolean", "votes": "string"}, start)
