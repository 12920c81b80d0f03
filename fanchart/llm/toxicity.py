"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

After Wang and Manning (2012): a text's features are the character n-grams it holds, each once, hashed into a fixed number
of buckets. A bucket's value is its log-count ratio, the logarithm of its share of the toxic documents' n-grams over its
share of the other ones'. Logistic regression with a ridge penalty is fitted on these values, so that a telling n-gram
starts with a large value and needs a small coefficient. The fit is L-BFGS; a step's loss and slope are one Spark job over the
fitted rows, and the driver holds vectors of one number per bucket. N-grams lie inside a word or touch its ends, which a space marks;
letters are lower-cased and white space is one space.

Labels are learnt only from rows that ``held_out`` does not name, and only from ``LABELLED`` distinct texts at most, those
with the smallest hashes. Language, source and id are no inputs of a score.

A null or empty text has no n-grams and gets the intercept's score. Very long texts are hashed in
pieces. Repeated rows are scored alike and learnt from once. A null id is never held out and has no label. A null label
is none; a label of 1 is toxic, any other not; an id with several labels is toxic if one
of them is. With labelled rows of one class only,
every score is near 0 or near 1; without any it is 0.5. Columns of the input named like an output are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fanchart.llm.arrow import map_rows
from fanchart.session import cut_lineage, drop_written

# Lengths of n-grams, and bits of a bucket's number.
SHORTEST, LONGEST, BITS = 4, 7, 18
# Distinct labelled texts that the classifier is fitted on, at most.
LABELLED = 12_000
# Added to every count; buckets in fewer documents than this have no coefficient.
SMOOTHING, FEWEST = 1.0, 10
# Ridge penalty; the fit ends after this many steps, or when a step gains less than the loss it is given here.
RIDGE, STEPS, GAIN = 1e-4, 40, 1e-6
# Partitions of the learnt texts, tasks of a step, and corrections that the steps remember.
PARTS, TASKS, MEMORY = 16, 8, 10
# One row in this many is held out.
FOLDS = 5
# Characters of a text hashed at a time.
PIECE = 1 << 16
SPACE = 32


class Ngrams:
    """The distinct buckets of a text's n-grams. Keeps one flag per bucket between calls."""

    def __init__(self, bits: int = BITS):
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.shift = np.uint64(64 - bits)

    def __call__(self, text: str | None) -> np.ndarray:
        words = " ".join((text or "").lower().split())
        if not words:
            return np.empty(0, dtype=np.int64)
        points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for at in range(0, len(points), PIECE):
            self._mark(points[at : at + PIECE + LONGEST - 1].astype(np.uint64))
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found

    def _mark(self, points: np.ndarray) -> None:
        inner = points != SPACE
        hashed, whole = points.copy(), np.ones(len(points), dtype=bool)
        for n in range(2, min(LONGEST, len(points)) + 1):
            # A multiplicative hash, mixed once per character; an n-gram has no space but at its ends.
            hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
            hashed ^= hashed >> np.uint64(29)
            whole = whole[:-1] & inner[n - 2 : -1] if n > 2 else whole[:-1]
            if n >= SHORTEST:
                mixed = (hashed[whole] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
                self.seen[(mixed >> self.shift).astype(np.int64)] = True


@dataclass
class Classifier:
    """Coefficient per bucket (ratio times fitted weight) and intercept."""

    coefficients: np.ndarray
    intercept: float

    def score(self, buckets: np.ndarray) -> float:
        logit = self.intercept + float(self.coefficients[buckets].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def held_out(doc_id: Column | str) -> Column:
    """Whether a row's label must not be learnt from."""
    id_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(id, text, toxic): at most ``limit`` distinct labelled texts of ``docs`` (doc_id, text) that may be learnt from.

    The ids come first, those with the smallest hashes, so that only their texts are read on; then the texts, because
    one id may have any number of them.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` narrow rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    texts = texts.select(F.xxhash64("doc_id", "text").alias("id"), "text", "toxic")
    last = texts.select("id").distinct().orderBy("id").limit(limit).agg(F.max("id")).first()[0]
    return texts.filter(F.col("id") <= last).repartition(PARTS, "id").dropDuplicates(["id"])


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of a batch's rows (toxic, buckets), all their buckets, and the row of each bucket."""
    packed = batch.column(1).to_pylist()
    buckets = np.frombuffer(b"".join(packed), dtype="<i4")
    return batch.column(0).to_numpy(), buckets, np.repeat(np.arange(len(packed)), [len(p) // 4 for p in packed])


def bucket_counts(rows: DataFrame, size: int) -> DataFrame:
    """(bucket, toxic, clean): how many rows of either label hold a bucket. A task counts its rows before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            toxic, buckets, row = unpacked(batch)
            for i in (0, 1):
                total[i] += np.bincount(buckets[(toxic == 1 - i)[row]], minlength=size)
        held = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (held, *total[:, held])], names=["bucket", "toxic", "clean"])

    parts = rows.mapInArrow(counted, "bucket bigint, toxic bigint, clean bigint")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_count_ratios(counts: DataFrame, size: int, smoothing: float = SMOOTHING, fewest: int = FEWEST) -> np.ndarray:
    """Per bucket of ``counts`` its ratio; 0 where fewer than ``fewest`` documents hold it.

    There are at most ``size`` buckets, whatever the number of documents.
    """
    total, table = np.zeros((2, size)), counts.toArrow()
    at = table.column("bucket").to_numpy()
    total[0, at], total[1, at] = table.column("toxic").to_numpy(), table.column("clean").to_numpy()
    p, q = total + smoothing
    ratios = np.log((p / p.sum()) / (q / q.sum()))
    ratios[total.sum(axis=0) < fewest] = 0
    return ratios


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Classifier:
    """A classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``limit`` distinct texts at most."""

    def start():
        ngrams = Ngrams()
        return lambda text: (ngrams(text).astype("<i4").tobytes(),)

    rows = map_rows(labelled_texts(docs, labels, limit), ["text"], {"buckets": "binary"}, start)
    rows = cut_lineage(rows, ["toxic", "buckets"])
    n, share = rows.agg(F.count("*"), F.avg((F.col("toxic") == 1).cast("double"))).first()
    size = 1 << BITS
    if share in (None, 0.0, 1.0):
        return Classifier(np.zeros(size, dtype=np.float32), {None: 0.0, 0.0: -500.0, 1.0: 500.0}[share])
    ratios = log_count_ratios(bucket_counts(rows, size), size)
    used = np.flatnonzero(ratios)
    rows = renumbered(rows, used, size)

    def loss_and_slope(weights: np.ndarray) -> tuple[float, np.ndarray]:
        total = slope_sums(rows, weights[:-1] * ratios[used], weights[-1])
        slope = np.append(total[:-2] * ratios[used] / n + RIDGE * weights[:-1], total[-2] / n)
        return total[-1] / n + RIDGE / 2 * float(weights[:-1] @ weights[:-1]), slope

    weights = lowest(loss_and_slope, np.append(np.zeros(len(used)), np.log(share / (1 - share))))
    drop_written(rows)
    coefficients = np.zeros(size, dtype=np.float32)
    coefficients[used] = weights[:-1] * ratios[used]
    return Classifier(coefficients, float(weights[-1]))


def renumbered(rows: DataFrame, used: np.ndarray, size: int) -> DataFrame:
    """``rows`` with the buckets ``used`` only, each by its place among them; replaces the table ``rows``."""
    place = np.full(size, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def start():
        def kept(buckets: bytes) -> tuple:
            own = shared.value[np.frombuffer(buckets, dtype="<i4")]
            return (own[own >= 0].astype("<i4").tobytes(),)

        return kept

    after = cut_lineage(map_rows(rows, ["buckets"], {"buckets": "binary"}, start))
    drop_written(rows)
    return after.coalesce(TASKS)


def slope_sums(rows: DataFrame, coefficients: np.ndarray, intercept: float) -> np.ndarray:
    """Over ``rows`` (toxic, buckets): the sums of the errors per bucket, of all errors, and of the losses.

    A task adds up its rows and sends the driver one number per bucket; there are at most ``TASKS`` tasks.
    """
    shared = rows.sparkSession.sparkContext.broadcast((coefficients, intercept))

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficients, intercept = shared.value
        total = np.zeros(len(coefficients) + 2)
        for batch in batches:
            toxic, buckets, row = unpacked(batch)
            z = intercept + np.bincount(row, coefficients[buckets], len(toxic))
            off = 0.5 * (1 + np.tanh(z / 2)) - (toxic == 1)
            total[:-2] += np.bincount(buckets, off[row], len(coefficients))
            total[-2:] += off.sum(), (np.logaddexp(0, z) - (toxic == 1) * z).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros(len(coefficients) + 2)
    for r in rows.mapInArrow(slopes, "sums binary").collect():
        total += np.frombuffer(r.sums)
    shared.destroy()
    return total


def lowest(function, start: np.ndarray, steps: int = STEPS, gain: float = GAIN) -> np.ndarray:
    """Where ``function``, which gives value and slope, is lowest: L-BFGS with halved steps."""
    x, moves, turns = start, [], []
    value, slope = function(x)
    for _ in range(steps):
        direction, factors = slope.copy(), []
        for s, y in zip(reversed(moves), reversed(turns)):
            factors.append((s @ direction) / (y @ s))
            direction -= factors[-1] * y
        if moves:
            direction *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        for (s, y), factor in zip(zip(moves, turns), reversed(factors)):
            direction += s * (factor - (y @ direction) / (y @ s))
        step = 1.0 if moves else 1 / max(float(np.linalg.norm(direction)), 1e-12)
        next_value, next_slope = function(x - step * direction)
        while next_value > value - 1e-4 * step * (slope @ direction) and step > 1e-9:
            step /= 2
            next_value, next_slope = function(x - step * direction)
        if next_value >= value:
            break
        move, turn = -step * direction, next_slope - slope
        x = x + move
        won, value, slope = value - next_value, next_value, next_slope
        if won < gain:
            break
        if move @ turn > 0:
            moves, turns = [*moves, move][-MEMORY:], [*turns, turn][-MEMORY:]
    return x


def score_documents(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, and ``predicted``, 1 from a score of 0.5 on."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def start():
        ngrams, model = Ngrams(), shared.value
        return lambda t: (model.score(ngrams(t)),)

    scored = map_rows(docs, [text], {"score": "double"}, start)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", "text")
    classifier = fit(texts, labels.select("doc_id", "toxic"), limit)
    return score_documents(texts, classifier).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
