"""Substring dedup: words covered by a window of ``window`` words that also starts in a document with a smaller id go.

Each shard holds a compressed FM-index. Documents stream through it, backward search gives their matching statistics
against smaller documents, and stretches of at least a window are reported. Content decides the shards, so that a
document meets only the shards where it can match: a window's anchor is the least hash of its short word runs, equal
windows have equal anchors, and neighbouring windows with one anchor form a segment. Segments whose anchor occurs in one
document only cannot match and are left out; the others go to the shard of their anchor.

Exact copies of a document are found by the digest of their words: all but the smallest id lose every word, and only
that one is indexed and searched. Equal segments are indexed and searched once per shard. An anchor with more than
``GROUP`` segments is split into chunks, and every pair of chunks is a shard of its own.

Windows are judged on the input. A null text has no words. A document without an id is neither smaller nor larger than
any other: it keeps its words and takes none. Repeated rows have equal ids, so they do not remove one another.
Documents shorter than a window keep all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fanchart.llm.arrow import SLICE_ROWS, bounds, map_groups, map_rows, ship_package
from fanchart.llm.decontaminate import merge_intervals
from fanchart.llm.fm_index import FMIndex, matched_stretches
from fanchart.llm.simhash import chunked
from fanchart.session import cut_lineage

WINDOW = 50
# Words of an anchor's run, words per shard, segments per shard of a hot anchor, and symbols that suffixes are sorted by.
RUN, SHARD_WORDS, GROUP, DEPTH = 8, 800_000, 4_000, 128


def words_of(text: str | None) -> list[bytes]:
    """Split at ASCII white space, unchanged."""
    return (text or "").encode().split()


def digest_of(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each segment. Segments stay shorter than the depth of the suffix order."""
    if len(words) < window:
        return (np.empty(0, dtype=np.int64),) * 3
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    run, runs = min(RUN, window), len(words) - min(RUN, window) + 1
    value = np.zeros(runs, dtype=np.uint64)
    for i in range(run):
        value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + runs]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    # The least value of the runs of each window, by ranges of powers of two.
    wide, covered = window - run + 1, 1
    while 2 * covered <= wide:
        value = np.minimum(value[:-covered], value[covered:])
        covered *= 2
    if covered < wide:
        value = np.minimum(value[: covered - wide], value[wide - covered :])
    cuts = bounds(value)
    longest = DEPTH - window - 1
    first = np.concatenate([np.arange(a, b, longest) for a, b in zip(cuts[:-1], cuts[1:])])
    last = np.append(first[1:], len(value)) - 1
    return value[first].view(np.int64), first, last


def with_anchors(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with n_words, words_sha256 and the arrays anchor, first, last."""

    def start():
        def row(value: str | None) -> tuple:
            words = words_of(value)
            return (len(words), digest_of(words), *(a.tolist() for a in anchors(words, window)))

        return row

    outputs = {"n_words": "bigint", "words_sha256": "string", "anchor": "array<bigint>", "first": "array<int>", "last": "array<int>"}
    return map_rows(docs, [text], outputs, start)


def _segments(matching: DataFrame, window: int) -> DataFrame:
    """(shard, doc_id, seq, first, words) for each segment of ``matching`` (doc_id, seq, text, shard, first, last arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                out: list[list] = [[], [], [], [], []]
                for doc_id, seq, text, segments in zip(*(c.to_pylist() for c in whole.slice(at, SLICE_ROWS).columns)):
                    words = words_of(text)
                    for s in segments:
                        row = (s["shard"], doc_id, seq, s["first"], b" ".join(words[s["first"] : s["last"] + window]))
                        for column, cell in zip(out, row):
                            column.append(cell)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], names=["shard", "doc_id", "seq", "first", "words"]
                )

    return matching.select("doc_id", "seq", "text", "segments").mapInArrow(
        run, "shard bigint, doc_id bigint, seq bigint, first int, words binary"
    )


def search_shard(doc_ids: np.ndarray, segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end): stretches of each segment that occur in a segment of a smaller document."""
    owners = np.unique(doc_ids, return_inverse=True)[1].astype(np.int32)
    # Equal segments once, with their smallest document: it comes first in a stable order.
    once: dict[bytes, int] = {}
    order = np.argsort(owners, kind="stable").tolist()
    for i in order:
        once.setdefault(segments[i], i)
    number: dict[bytes, int] = {}
    text: list[int] = []
    starts, ends, own = [], [], []
    for segment, i in once.items():
        starts.append(len(text))
        text += [number.setdefault(w, len(number) + 1) for w in segment.split()]
        ends.append(len(text))
        text.append(0)
        own.append(owners[i])
    start, end, owner = np.array(starts), np.array(ends), np.array(own, dtype=np.int32)
    symbols = np.array(text, dtype=np.int64)
    index = FMIndex(symbols, np.repeat(owner, end - start + 1), DEPTH)
    which, a, b = matched_stretches(index, symbols, start, end, owner, window)
    found: dict[int, list[tuple[int, int]]] = {}
    for s, x, y in zip(which.tolist(), (a - start[which]).tolist(), (b - start[which]).tolist()):
        found.setdefault(s, []).append((x, y))
    place = {segment: s for s, segment in enumerate(once)}
    out = []
    for i in range(len(segments)):
        s = place[segments[i]]
        if owners[i] > owner[s]:
            out.append((i, 0, int(end[s] - start[s])))
        else:
            out += [(i, x, y) for x, y in found.get(s, ())]
    return tuple(np.array(column, dtype=np.int64) for column in zip(*out)) if out else (np.empty(0, dtype=np.int64),) * 3


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = with_anchors(docs, window).drop("text").withColumn("seq", F.xxhash64("words_sha256"))
    every = cut_lineage(every)
    # Exact copies, by a map-side minimum per digest.
    copies = every.filter(F.col("n_words") >= window).groupBy("words_sha256").agg(
        F.min("doc_id").alias("original"), F.max("doc_id").alias("_last"))
    copies = copies.filter(F.col("original") < F.col("_last")).drop("_last")
    judged = every.join(copies, "words_sha256", "left")
    is_copy = F.coalesce(F.col("original") < F.col("doc_id"), F.lit(False))

    zipped = F.explode(F.arrays_zip("anchor", "first", "last")).alias("s")
    # Repeats of a document have the same runs.
    once = judged.filter(~is_copy & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "seq"])
    runs = once.select("doc_id", "seq", zipped)
    runs = runs.select(F.col("s.anchor").alias("shard"), "doc_id", "seq", F.col("s.first").alias("first"), F.col("s.last").alias("last"))
    shared = runs.groupBy("shard").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"))
    shared = shared.filter(F.col("_a") < F.col("_b")).select("shard")
    candidates = cut_lineage(runs.join(shared, "shard"))
    words = candidates.agg(F.sum(F.col("last") - F.col("first") + window)).first()[0] or 0
    shards = 1 + words // SHARD_WORDS
    split = chunked(candidates.withColumn("own", F.col("shard")), "shard", "doc_id", GROUP)
    dealt = F.when(F.col("shard") == F.col("own"), F.pmod(F.xxhash64("own"), F.lit(shards))).otherwise(F.col("shard"))
    per_document = split.groupBy("doc_id", "seq").agg(
        F.collect_list(F.struct(dealt.alias("shard"), "first", "last")).alias("segments"))

    # The text of documents that may match, once: rows of one id and text are one, others are told apart by their words.
    texts = docs.join(per_document.select("doc_id").distinct(), "doc_id", "left_semi")
    printed = map_rows(texts, ["text"], {"words_sha256": "string"}, lambda: lambda t: (digest_of(words_of(t)),))
    printed = printed.withColumn("seq", F.xxhash64("words_sha256")).dropDuplicates(["doc_id", "seq"])
    matching = printed.join(per_document, ["doc_id", "seq"])
    matching = cut_lineage(matching, ["doc_id", "seq", "text", "segments"])

    def start():
        def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, ids, seqs, firsts = (rows.column(c).to_numpy() for c in ("shard", "doc_id", "seq", "first"))
            cuts = bounds(keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                i, x, y = search_shard(ids[a:b], rows.column("words").slice(a, b - a).to_pylist(), window)
                i = i + a
                columns = [ids[i], seqs[i], (x + firsts[i]).astype(np.int32), (y + firsts[i]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "seq", "start", "end"])

        return search

    schema = "doc_id bigint, seq bigint, start int, end int"
    stretches = map_groups(_segments(matching, window), "shard", ["doc_id"], schema, start)
    stretches = stretches.groupBy("doc_id", "seq").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    hit = matching.select("doc_id", "seq", "text").join(stretches, ["doc_id", "seq"])

    def start_removal():
        def removed(text: str, starts: list[int], ends: list[int]) -> tuple:
            words, kept, at = words_of(text), [], 0
            flat = merge_intervals(zip(starts, ends))
            for a, b in zip(flat[::2], flat[1::2]):
                kept += words[at:a]
                at = b
            kept += words[at:]
            return len(words) - len(kept), digest_of(kept)

        return removed

    removed = map_rows(hit, ["text", "starts", "ends"], {"n_removed": "bigint", "kept_sha256": "string"}, start_removal)
    removed = removed.select("doc_id", "seq", "n_removed", "kept_sha256")
    return judged.join(removed, ["doc_id", "seq"], "left").select(
        "doc_id",
        "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_copy, F.lit(digest_of([]))).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
