"""Embedding near-duplicates by iterative quantisation.

A rotation is learnt on a bounded sample so that the signs of the rotated, centred vectors are balanced binary codes with
little quantisation error. Multi-index Hamming tables, each keyed by some bits of the code and the label, retrieve
candidates: codes that agree in a key and differ in few bits. Candidates are ranked by cosine of the original vectors in
double precision. A pair that several tables hold counts in the first of them only.

The width of a key follows the number of vectors, so that buckets stay small, and the number of tables follows the
width, so that a pair at the threshold is found with the stated probability at every size. Codes are taken from centred
vectors, which are shorter than the unit vectors if those share a direction, and then the angle of a pair is larger: the
number of tables and the code distance follow the angle at the centred length that only ``SHORT`` of the sample fall below.

There are at most ``TABLES`` tables. Where the angle asks for more, keys get narrower until that many tables keep the
wanted recall; buckets grow instead and are split into pairs of chunks. Where such narrow keys would send a vector to more
places than comparing all chunks of its label does, the key is the label alone, and the search is exact. Codes that differ
as much in pairs as in strangers tell nothing, and then candidates go to the cosine without a look at their distance.

Equal vectors of a label are one class, so exact copies never meet pairwise. Null and zero vectors, those with null or
non-finite components and rows without a label link with nothing. Vectors of different lengths never link. A null
vec_id keeps its row and never names a component. Repeated rows are vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fanchart.llm.arrow import bounds, map_groups, map_rows, ship_package
from fanchart.llm.components import connected_components
from fanchart.llm.sampling import smallest_hashes
from fanchart.llm.simhash import chunked
from fanchart.session import cut_lineage

THRESHOLD = 0.98
# Vectors the rotation is fitted on, at most, and bits of a code.
SAMPLE, BITS = 20_000, 64
# Wanted chance to retrieve a pair at the threshold, and the code distance beyond which a pair is no candidate.
RECALL, FAR = 0.995, 20
# Share of the sample with smaller centred vectors than the number of tables is made for.
SHORT = 0.01
# Most tables, whatever the angle of a pair.
TABLES = 32
# Buckets of more vectors are split into chunks of about this many, at most ``WIDER`` times that where labels are very large.
GROUP, WIDER = 1024, 4
# Vectors whose cosines with a group are taken at a time.
BLOCK = 512


class Rotation:
    """Mean and projection; zero-padded to the longest vector."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 0):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        size = sample.shape[1]
        values, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, np.argsort(-values, kind="stable")[: min(bits, size)]]
        rng = np.random.default_rng(seed)
        # More bits than dimensions: several rotations side by side.
        parts = []
        while sum(p.shape[1] for p in parts) < bits:
            turn = np.linalg.qr(rng.normal(size=(main.shape[1],) * 2))[0]
            projected = centred @ main
            for _ in range(rounds):
                signs = np.where(projected @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ projected)
                turn = (u @ v).T
            parts.append(main @ turn)
        self.projection = np.hstack(parts)[:, :bits]

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit - self.mean) @ self.projection >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def unit_vectors(vectors: list, size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    largest = np.abs(out).max(axis=1, keepdims=True)
    out /= largest
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def unit_rows(column: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, zero-padded to ``size``, and lengths of a column of lists without nulls."""
    lists = pa.concat_arrays(column.chunks)
    lengths = lists.value_lengths().to_numpy()
    if (lengths != size).any():
        return unit_vectors(lists.to_pylist(), size), lengths
    out = lists.flatten().to_numpy().astype(float).reshape(len(lists), size)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), lengths


def usable(embedding: str = "embedding", label: str = "label"):
    """Whether a row can link at all."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & finite & some, F.lit(False))


def key_bits(n: int) -> int:
    return min(BITS, max(8, math.ceil(math.log2(max(n, 2)))))


def centred_angle(lengths: np.ndarray, threshold: float) -> float:
    """Angle between two centred vectors of a pair at the threshold, at the short end of the sample's ``lengths``."""
    half = math.sqrt((1 - threshold) / 2) / max(float(np.quantile(lengths, SHORT)), 1e-9)
    # Bits of vectors next to the mean are as good as random; beyond a right angle no number of tables helps.
    return min(max(math.acos(threshold), 2 * math.asin(min(half, 1.0))), math.pi / 2)


def far_for(angle: float) -> int:
    """Code distance that a pair at ``angle`` exceeds about never: eight standard deviations above what is expected."""
    p = angle / math.pi
    return min(BITS, max(FAR, math.ceil(BITS * p + 8 * math.sqrt(BITS * p * (1 - p)))))


def tables_wanted(width: int, recall: float, angle: float) -> int:
    """Number of tables of ``width`` bits that find a pair at ``angle`` with probability ``recall``."""
    same = (1 - angle / math.pi) ** width
    return math.ceil(math.log(1 - recall) / math.log(1 - same)) if same < 1 else 1


def width_for(n: int, together: float, angle: float, recall: float = RECALL, group: int = GROUP) -> int:
    """Bits of a key for ``n`` vectors, of which a vector shares its label with ``together`` on average."""
    widest = key_bits(n)
    width = next(w for w in range(widest, -1, -1) if tables_wanted(w, recall, angle) <= TABLES)
    if width == widest:
        return width
    # Places that a vector is sent to: its chunk with every other one, in each table.
    narrow = tables_wanted(width, recall, angle) * max(1.0, together / 2**width / group)
    return width if narrow < together / group else 0


def tables_for(
    width: int, threshold: float = THRESHOLD, recall: float = RECALL, angle: float | None = None
) -> list[np.uint64]:
    """Masks of ``width`` bits each, as many as the wanted recall takes: at the threshold a bit of a pair differs with
    probability angle / pi. Tables take the bits in a shuffled order, one after the other, round and round."""
    count = tables_wanted(width, recall, math.acos(threshold) if angle is None else angle)
    rng = np.random.default_rng(1)
    order = np.concatenate([rng.permutation(BITS) for _ in range(math.ceil(count * width / BITS) + 1)])
    masks = []
    for i in range(count):
        bits, at = set(), i * width
        while len(bits) < width:
            bits.add(int(order[at % len(order)]))
            at += 1
        masks.append(np.uint64(sum(1 << b for b in bits)))
    return masks


def _signed(mask: np.uint64) -> int:
    return int(mask.astype(np.int64))


def nearest_links(vectors: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(links a, b that span all components; id and number of linked rows) for distinct ``vectors`` (id, n, label, embedding)."""
    spark = vectors.sparkSession
    ship_package(spark)
    per_label = vectors.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size"))
    square = F.sum(F.col("n").cast("double") * F.col("n"))
    extent = per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("size").alias("size"), square.alias("square")).first()
    size = extent["size"] or 1
    sample = smallest_hashes(vectors.select("id", "embedding"), "id", extent["n"], SAMPLE).collect()
    units = unit_vectors([r.embedding for r in sample], size)
    rotation = Rotation(units) if sample else None
    angle = centred_angle(np.linalg.norm(units - rotation.mean, axis=1), threshold) if sample else math.acos(threshold)
    far = far_for(angle)
    shared = spark.sparkContext.broadcast(rotation)
    # Vectors of an average vector's label.
    together = (extent["square"] or 0.0) / max(extent["n"], 1)
    group *= min(WIDER, max(1, int(together / (32 * group))))
    masks = tables_for(width_for(extent["n"], together, angle, group=group), threshold, angle=angle)

    def start_codes():
        def codes(embeddings: list) -> list[tuple]:
            return [(int(c),) for c in shared.value.codes(unit_vectors(embeddings, size)).view(np.int64)]

        return codes

    coded = cut_lineage(map_rows(vectors, ["embedding"], {"code": "bigint"}, start_codes, sliced=True))
    keys = [
        F.xxhash64(F.lit(i), "label", F.size("embedding"), F.col("code").bitwiseAND(F.lit(_signed(m))))
        for i, m in enumerate(masks)
    ]
    table = F.posexplode(F.array(*keys)).alias("table", "bucket")
    # First by codes alone: who has a candidate in which bucket.
    keyed = coded.select(table, "code", "id").select("bucket", "table", "code", "id")
    parted = chunked(keyed, "bucket", "id", group)

    def start_candidates():
        def candidates(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, codes = rows.column("bucket").to_numpy(), rows.column("code").to_numpy().view(np.uint64)
            near = np.zeros(len(keys), dtype=bool)
            cuts = bounds(keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                own = codes[a:b]
                for i in range(b - a - 1):
                    hit = np.bitwise_count(own[i + 1 :] ^ own[i]) <= far
                    if hit.any():
                        near[a + i] = True
                        near[a + i + 1 : b] |= hit
            yield from rows.filter(pa.array(near)).combine_chunks().to_batches()

        return candidates

    schema = "bucket bigint, table int, code bigint, id bigint, side int"
    # Beyond half of the bits the distance keeps nearly all strangers too.
    close = map_groups(parted, "bucket", ["id"], schema, start_candidates) if far < BITS // 2 else parted
    # Then with the vectors of those.
    full = close.join(coded.select("id", "n", "embedding", "label"), "id")
    lower = np.array(masks, dtype=np.uint64)

    def start_links():
        def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, tables = rows.column("bucket").to_numpy(), rows.column("table").to_numpy()
            ids, counts, side = (rows.column(c).to_numpy() for c in ("id", "n", "side"))
            codes, labels = rows.column("code").to_numpy().view(np.uint64), rows.column("label").to_pylist()
            cuts, embeddings = bounds(keys), rows.column("embedding")
            out_a, out_b, out_n = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                unit, lengths = unit_rows(embeddings.slice(a, b - a), size)
                code, own_side = codes[a:b], side[a:b]
                numbers = np.unique(np.array(labels[a:b]), return_inverse=True)[1]
                close = np.zeros((b - a, b - a), dtype=bool)
                degree = np.zeros(b - a, dtype=np.int64)
                for at in range(0, b - a, BLOCK):
                    block = slice(at, at + BLOCK)
                    row, other = np.nonzero(unit[block] @ unit.T >= threshold)
                    row += at
                    # A pair counts in the first table that holds it, and in one group of it.
                    differ = code[row] ^ code[other]
                    good = (row != other) & (lengths[row] == lengths[other]) & (numbers[row] == numbers[other])
                    good &= (differ & lower[tables[a]]) == 0
                    for mask in lower[: tables[a]]:
                        good &= (differ & mask) != 0
                    good &= (own_side[row] != own_side[other]) | (own_side[row] == -1)
                    row, other = row[good], other[good]
                    close[row, other] = True
                    degree += np.bincount(row, counts[a:b][other], b - a).astype(np.int64)
                left, right = _forest(close)
                out_a += [ids[a + left], ids[a:b][degree > 0]]
                out_b += [ids[a + right], ids[a:b][degree > 0]]
                out_n += [np.zeros(len(left), dtype=np.int64), degree[degree > 0]]
            empty = np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([empty, *x])) for x in (out_a, out_b, out_n)], names=["a", "b", "n"]
            )

        return links

    found = map_groups(full, "bucket", ["id"], "a bigint, b bigint, n bigint", start_links)
    found = cut_lineage(found)
    return found.filter("a <> b").select("a", "b"), found.filter("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_near"))


def _forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a symmetric matrix."""
    left, right = [], []
    open_ = np.ones(len(close), dtype=bool)
    for root in range(len(close)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(close[at] & open_)
            open_[new] = False
            left += [at] * len(new)
            right += new.tolist()
            queue += new.tolist()
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def near_duplicate_vectors(
    df: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links to rows of the same label with a cosine of at least
    ``threshold``, the smallest vec_id reachable over links, and whether the row names its component."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    classes = rows.filter(usable()).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    # Numbered as written, so that the numbers stay.
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))
    links, near = nearest_links(classes.select("id", "n", "label", "embedding"), threshold)
    roots = connected_components(links).withColumnRenamed("node", "id")
    rooted = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(near, "id", "left")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    n_links = F.col("n") - 1 + F.coalesce("n_near", F.lit(0))
    known = rooted.join(names, "root").select("label", "embedding", n_links.alias("n_links"), "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
