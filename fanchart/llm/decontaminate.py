"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts become words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. A pattern is a window of
``window`` consecutive words of a benchmark item (an item with fewer words is one shorter pattern). Per pattern length
there is a shift table by blocks of two words: a block that ends no pattern says how far the search may skip. Where the
shift is 0 the block is a suffix; its bucket holds the patterns that end so, and comparing the words confirms.

Null texts have no words. Items without words match nothing. Items with equal windows are all found. An item without an
id marks words but is not listed. Repeated documents and rows are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from fanchart.llm.arrow import map_rows

WINDOW = 10
# Patterns are held and sent in parts of about this many bytes of benchmark text; documents are searched for each part.
PART_BYTES = 8 << 20

_SEPARATORS = bytes(
    ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes, since every byte of a non-ASCII character belongs to a word."""
    return (text or "").encode().translate(_SEPARATORS).split()


class Patterns:
    """Shift tables and suffix buckets for the patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shifts: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(set))

    def add(self, words: list[bytes], item) -> None:
        ends = range(self.block, self.length + 1)
        for end in ends:
            block = self._block(words, end)
            self.shifts[block] = min(self.shifts.get(block, self.skip), self.length - end)
        self.buckets[self._block(words, self.length)][tuple(words)].add(item)

    def _block(self, words: list[bytes], end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set]]:
        """(start, items) of every occurrence."""
        length, skip, shifts, buckets = self.length, self.skip, self.shifts, self.buckets
        last = len(words)
        at = length
        if self.block == 1:
            for i, word in enumerate(words):
                if word in shifts:
                    yield i, buckets[word][(word,)]
            return
        while at <= last:
            block = (words[at - 2], words[at - 1])
            shift = shifts.get(block, skip)
            if shift:
                at += shift
                continue
            found = buckets[block].get(tuple(words[at - length : at]))
            if found:
                yield at - length, found
            at += 1


def build_patterns(items: Iterable[tuple], window: int = WINDOW) -> list[Patterns]:
    """Pattern sets by length from (item id, text)."""
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        if length:
            patterns = by_length.setdefault(length, Patterns(length))
            for start in range(len(words) - length + 1):
                patterns.add(words[start : start + length], item)
    return list(by_length.values())


def find_hits(words: list[bytes], sets: list[Patterns]) -> tuple[list[int], set]:
    """Merged word intervals [start, end, start, end ...], end exclusive, and the items found."""
    found, items = [], set()
    for patterns in sets:
        for start, of in patterns.search(words):
            found.append((start, start + patterns.length))
            items |= of
    return merge_intervals(found), items


def merge_intervals(intervals: Iterable[tuple[int, int]]) -> list[int]:
    merged: list[int] = []
    for start, end in sorted(intervals):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def mark_benchmark_words(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """``docs`` with n_words, hits (merged word intervals as a flat array) and items (sorted ids, as text).

    The benchmark is a stated query set. Its patterns go to the tasks as broadcasts of bounded size: the number of parts
    follows from its measured bytes, and each part is searched in all documents. A document is never moved.
    """
    spark = docs.sparkSession
    stated = benchmark.select("item_id", F.col("text"))
    size = stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part_bytes
    marked = docs
    for part in range(parts):
        # Items with the same text would all be in one part; so the part is chosen by id and text.
        rows = stated.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        marked = _mark_part(marked, spark.sparkContext.broadcast([tuple(r) for r in rows]), window, text, first=part == 0)
    return marked


def _mark_part(docs: DataFrame, shared, window: int, text: str, first: bool) -> DataFrame:
    def start():
        sets = build_patterns(shared.value, window)

        def mark(value: str | None, hits=(), items=()) -> tuple:
            words = words_of(value)
            found, of = find_hits(words, sets)
            if hits:
                found = merge_intervals([*zip(found[::2], found[1::2]), *zip(hits[::2], hits[1::2])])
            listed = {str(i) for i in of if i is not None}
            return len(words), found, sorted(listed.union(items))

        return mark

    outputs = {"n_words": "bigint", "hits": "array<int>", "items": "array<string>"}
    # Later parts go on from what the earlier ones found.
    inputs = [text] if first else [text, "hits", "items"]
    return map_rows(docs, inputs, outputs, start)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated in place of columns of these names."""
    marked = mark_benchmark_words(docs, benchmark, window)
    # The ends minus the starts of the flat intervals.
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint"))
    hit = F.aggregate(signed, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return marked.withColumns(
        {
            "n_hit": hit,
            "n_items": F.size("items").cast("bigint"),
            "items_sha256": F.sha2(F.array_join("items", ","), 256),
            "contaminated": F.size("hits") > 0,
        }
    ).drop("hits", "items")
