"""Quantiles over groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine for a SKU's panel rows (never more than
the calendar has dates) and wrong for a whole table or a raw sales feed where one SKU may hold a third of the rows. The
two functions here do all their row-sized work in map-side aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fanchart.session import small_side

ACCURACY = 10_000
# Brackets of a group are as wide as the largest of these sizes that the group has.
GROUP_SIZES = (10, 100, 1_000, 10_000)
# The first growing part is this much smaller than the bracket.
SMALLEST_STEP = 2.0**64
# A task sorts at most about this many rows of one group; wider brackets are cut into so many parts and narrowed first.
MOST_ROWS, PARTS = 500_000, 1024
# Steps per doubling of a value, and a number above all their logarithms; a group's values that the driver ranks, at most.
STEPS, OFFSET, MOST_VALUES = 32, 40_000, 10_000


def exact_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = ACCURACY,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Linearly interpolated percentiles per ``keys``, one output column per entry of ``probs``.

    A sketch brackets the wanted ranks: its rank error is at most n/accuracy, and the bracket is wider than that by two
    ranks at least and twenty at most. One aggregate on the map side counts the rows between the brackets and groups
    the distinct values inside them, and only those are shuffled and sorted: some forty rows of a small group, a share
    of ``10 / accuracy`` of a large one before equal values are merged. Where that share of one group is more than
    ``most`` rows, its brackets are narrowed first, a pass over the rows at a time, each to about a ``PARTS``-th. The
    sketch, one row per group, is computed right away, so that the rows need no shuffle to meet it.
    """
    keys, names = list(keys), list(probs)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slacks = [3 / accuracy + 2 / size for size in GROUP_SIZES]
    bounds = [b for p in probs.values() for s in slacks for b in (max(p - s, 0.0), min(p + s, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", F.array(*map(F.lit, bounds)), accuracy).alias("_q"),
    )
    # Two ranks are 2/n; the next smaller size of the list stands for n.
    level = sum((F.col("_n") >= size).cast("int") for size in GROUP_SIZES) - 1
    open_ = F.col("_n") < GROUP_SIZES[0]
    lows, highs = [], []
    for i, p in enumerate(probs.values()):
        at = 2 * (i * len(slacks) + level)
        lowest = open_ | (F.get(F.array(*[F.lit(p <= s) for s in slacks]), level))
        highest = open_ | (F.get(F.array(*[F.lit(p >= 1 - s) for s in slacks]), level))
        lows.append(F.when(lowest, F.col("_min")).otherwise(F.get("_q", at)))
        highs.append(F.when(highest, F.col("_max")).otherwise(F.get("_q", at + 1)))
    sketch = sketch.select(*keys, F.col("_n").alias("n"), F.array(*lows).alias("_lows"), F.array(*highs).alias("_highs"))

    # Broadcast if there are few groups.
    sketch = small_side(sketch)
    widest = (sketch.agg(F.max("n")).first()[0] or 0) * 2 * (slacks[-1] + 1 / accuracy)
    growing, brackets = False, len(names)
    if widest > most:
        # From here on a bracket holds one rank, the one at or below the wanted place or the next.
        doubled = {c: F.flatten(F.transform(c, lambda x: F.array(x, x))) for c in ("_lows", "_highs")}
        sketch, brackets = sketch.withColumns(doubled), 2 * len(names)
    while widest > most:
        sketch = small_side(_narrowed(_met(rows, sketch, keys), keys, list(probs.values()), growing))
        widest, growing = sketch.agg(F.max("_inside")).first()[0], not growing
        sketch = sketch.drop("_inside")
    joined = _met(rows, sketch, keys)
    each = range(brackets)
    inside = reduce(or_, [F.col("_v").between(F.get("_lows", F.lit(i)), F.get("_highs", F.lit(i))) for i in each])
    # A row outside all brackets counts in the gap it lies in.
    gap = sum((F.col("_v") > F.get("_highs", F.lit(i))).cast("int") for i in each)
    counts = joined.groupBy(*keys, "n", gap.alias("gap"), F.when(inside, F.col("_v")).alias("v")).agg(
        F.count("*").alias("c"), F.min("_v").alias("least")
    )
    order = Window.partitionBy(*keys).orderBy("least")
    ranked = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when((F.col("upto") > rank) & F.col("v").isNotNull(), F.col("v")))

    out = []
    for name, p in probs.items():
        place = F.lit(p) * (F.col("n") - 1)
        out += [at_rank(F.floor(place)).alias(f"_a_{name}"), at_rank(F.ceil(place)).alias(f"_b_{name}")]
    picked = ranked.groupBy(*keys, "n").agg(*out)

    def between(name: str, p: float) -> Column:
        place, a, b = F.lit(p) * (F.col("n") - 1), F.col(f"_a_{name}"), F.col(f"_b_{name}")
        return (a + (b - a) * (place - F.floor(place))).alias(name)

    return picked.select(*keys, *[between(name, p) for name, p in probs.items()])


def _met(rows: DataFrame, sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the brackets of their group; without keys the one row of brackets is a scalar subquery."""
    if keys:
        return rows.join(sketch, keys)
    brackets = sketch.select(F.struct("n", "_lows", "_highs").alias("s")).scalar()
    return rows.withColumn("s", brackets).select("_v", "s.n", "s._lows", "s._highs")


def _part(v: Column, low: Column, high: Column, parts: int, growing: bool) -> Column:
    """Which part of a bracket a value of it lies in: equal parts, or parts that grow by a constant factor from ``low``.

    A pair of passes so takes either many bits or many orders of magnitude off a bracket, and the width of a double
    bounds their number. Halved first, so that the widest bracket does not overflow; the narrowest then has no width.
    """
    along = F.coalesce(F.try_divide(v / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))
    if growing:
        along = F.log1p(along * SMALLEST_STEP) / F.log1p(F.lit(SMALLEST_STEP))
    return F.when(v == high, F.lit(parts - 1)).otherwise(F.least(F.floor(along * parts), F.lit(parts - 1))).cast("bigint")


def _narrowed(joined: DataFrame, keys: list[str], probs: list[float], growing: bool) -> DataFrame:
    """Narrower brackets (keys, n, _lows, _highs, _inside): of each the part that holds its rank.

    Rows below a bracket are one part of it, those above none. At most ``PARTS`` + 1 sums per group and bracket are
    ranked. A bracket of different values always has rows in its first and its last part, so it gets narrower.
    """
    v = F.col("_v")
    placed = []
    for i in range(2 * len(probs)):
        low, high = F.get("_lows", F.lit(i)), F.get("_highs", F.lit(i))
        part = F.when(v < low, F.lit(-1)).when(v <= high, _part(v, low, high, PARTS, growing))
        placed.append(F.struct(F.lit(i).alias("i"), part.alias("part")))
    parts = joined.select(*keys, "n", "_v", F.explode(F.array(*placed)).alias("at")).filter("at.part is not null")
    parts = parts.groupBy(*keys, "n", "at.i", "at.part").agg(
        F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )
    order = Window.partitionBy(*keys, "i").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    place = F.get(F.array(*[F.lit(p) for p in probs for _ in range(2)]), F.col("i")) * (F.col("n") - 1)
    rank = F.when(F.col("i") % 2 == 0, F.floor(place)).otherwise(F.ceil(place))
    ranked = parts.withColumn("upto", F.sum("c").over(order))
    holding = F.min(F.when(F.col("upto") > rank, F.struct("part", "least", "most", "c")))
    found = ranked.groupBy(*keys, "n", "i").agg(holding.alias("s")).select(*keys, "n", "i", "s.*")
    inside = F.when(F.col("least") == F.col("most"), F.lit(0)).otherwise(F.col("c"))
    listed = F.sort_array(F.collect_list(F.struct("i", F.col("least").alias("low"), F.col("most").alias("high"))))
    out = found.groupBy(*keys, "n").agg(listed.alias("s"), F.max(inside).alias("_inside"))
    return out.select(*keys, "n", F.col("s.low").alias("_lows"), F.col("s.high").alias("_highs"), "_inside")


def weighted_quantiles(
    df: DataFrame, key: str, value: str, weight: str, tau: float, most: int = MOST_VALUES, parts: int = PARTS
) -> dict[int, float]:
    """Per group the smallest value whose cumulative weight reaches ``tau`` of the group's; exact.

    For few groups of unbounded size, numbered from 0, such as the leaves of a tree. The first pass is a histogram with
    ``STEPS`` bins per doubling of a value, summed on the map side; it names one bin per group. The second sums the
    weights of the values in those bins. If a bin holds more than ``most`` rows, it is cut into ``parts`` first, as often
    as it takes. A pass sends the driver one row per bin, part or value of a group: some thousands per group at most, or
    ``most``, whatever the number of rows.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.col(weight).alias("w"))
    v = F.col("v")
    # Null for 0, which lies between the negative and the positive bins.
    octave = F.floor(F.log2(F.abs(v)) * STEPS) + OFFSET
    part, inside = F.coalesce(F.signum(v).cast("bigint") * octave, F.lit(0)), rows
    found, open_, goals, growing = {}, None, {}, False
    while open_ is None or open_:
        if open_:
            size = max(open_) + 1
            low, high = (F.get(number_array([open_[g][i] if g in open_ else None for g in range(size)]), F.col("k")) for i in (0, 1))
            inside = rows.filter(v.between(low, high))
            if max(n for _, _, n in open_.values()) <= most:
                part = v
            else:
                part, growing = _part(v, low, high, parts, growing), not growing
        sums = inside.groupBy("k", part.alias("part")).agg(
            F.sum("w").alias("w"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        table = sums.toArrow()
        columns = [table.column(c).to_numpy() for c in ("k", "part", "w", "n", "low", "high")]
        order = np.lexsort((columns[1], columns[0]))
        keys, _, weights, counts, lows, highs = (c[order] for c in columns)
        open_ = {}
        for group in np.unique(keys).tolist():
            first, last = np.searchsorted(keys, group), np.searchsorted(keys, group, side="right")
            upto = np.cumsum(weights[first:last].astype(float))
            goal, slack = goals.setdefault(group, (tau * upto[-1], 1e-12 * tau * upto[-1]))
            # Sums of weights may miss the total by a rounding error; the last part then counts as reached.
            at = min(int(np.searchsorted(upto, goal - slack)), len(upto) - 1)
            goals[group] = goal - (upto[at - 1] if at else 0.0), slack
            at += first
            found[group] = float(highs[at])
            if lows[at] < highs[at]:
                open_[group] = float(lows[at]), float(highs[at]), int(counts[at])
    return found


def percentiles(df: DataFrame, value: str, probs: dict[str, float], weight: str = "") -> dict[str, float]:
    """Percentiles of a whole column, 0 where it has no values.

    Without a weight column, interpolated; with one, the smallest value whose cumulative weight reaches the share. Rows
    without a positive weight do not count.
    """
    if not weight:
        row = exact_percentile(df, [], value, probs).first()
        return {name: float(row[name]) if row and row[name] is not None else 0.0 for name in probs}
    rows = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    rows = rows.select(F.lit(0).alias("k"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    return {name: weighted_quantiles(rows, "k", "v", "w", p).get(0, 0.0) for name, p in probs.items()}


def number_array(values: list) -> Column:
    """Numbers, None or nested lists of them as one SQL literal."""

    def text(x) -> str:
        if isinstance(x, list):
            return "array(" + ", ".join(map(text, x)) + ")"
        return "CAST(NULL AS DOUBLE)" if x is None else f"{float(x)!r}D"

    return F.expr(text(values))
