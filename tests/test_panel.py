from datetime import date

import pytest
import tables
from pyspark.sql import functions as F

from fanchart.functions.dates import DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS, parse_date, step_date
from fanchart.functions.quantiles import exact_percentile, weighted_quantiles
from fanchart.functions.rounding import clip_and_round, round_half_even
from fanchart.functions.text import normalise_sku
from fanchart.grain import DAILY, MONTHLY, grain
from fanchart.operators import panel as pn
from fanchart.schema import MissingColumnError


def one(spark, sql_value, f):
    return spark.sql(f"select {sql_value} as x").select(f(F.col("x"))).first()[0]


def test_feature_lists_have_fifty_names():
    assert len(MONTHLY.feature_columns()) == len(set(MONTHLY.feature_columns())) == 50
    assert len(DAILY.feature_columns()) == len(set(DAILY.feature_columns())) == 50
    assert "comp_promo_share_28d" in DAILY.feature_columns() and "grp_trend_excl_3m" in MONTHLY.feature_columns()
    with pytest.raises(ValueError):
        grain("weekly")


@pytest.mark.parametrize(
    "text, clean",
    [("'102025'", "102025"), ("'102025.0'", "102025"), ("' 102025 '", "102025"), ("'nan'", "NA"), ("'NaN'", "NA"),
     ("'None'", "NA"), ("null", "NA"), ("102025", "102025"), ("'1.05'", "1.05"), ("'a\\tb '", "a\tb")],
)
def test_normalise_sku(spark, text, clean):
    assert one(spark, text, normalise_sku) == clean


@pytest.mark.parametrize(
    "text, formats, parsed",
    [("2024-01-05", DAY_FIRST_FORMATS, date(2024, 1, 5)), ("1.6.2024", DAY_FIRST_FORMATS, date(2024, 6, 1)),
     ("1.6.2024", MONTH_FIRST_FORMATS, date(2024, 1, 6)), ("8.21.2025", DAY_FIRST_FORMATS, None),
     ("8.21.2025", MONTH_FIRST_FORMATS, date(2025, 8, 21)), ("garbage", DAY_FIRST_FORMATS, None),
     ("2024-02-30", DAY_FIRST_FORMATS, None)],
)
def test_parse_date(spark, text, formats, parsed):
    assert one(spark, f"'{text}'", lambda c: parse_date(c, formats)) == parsed


def test_step_date_keeps_month_ends(spark):
    assert one(spark, "date'2024-01-31'", lambda c: step_date(c, 1, MONTHLY)) == date(2024, 2, 29)
    assert one(spark, "date'2024-02-29'", lambda c: step_date(c, 1, MONTHLY)) == date(2024, 3, 31)
    assert one(spark, "date'2024-02-29'", lambda c: step_date(c, 1, DAILY)) == date(2024, 3, 1)


@pytest.mark.parametrize("x, r", [(0.125, 0.12), (0.375, 0.38), (2.5, 2.5), (-3.0, 0.0), (1e9 + 0.126, 1e9 + 0.13)])
def test_clip_and_round(spark, x, r):
    assert one(spark, f"{x!r}D", clip_and_round) == r


def test_round_keeps_missing(spark):
    assert one(spark, "cast(null as double)", clip_and_round) is None
    assert one(spark, "-0.125D", round_half_even) == -0.12


def test_defaults_and_required_columns(spark):
    raw = spark.createDataFrame([("2024-01-05", 1.0, "x.0")], "date string, qty double, SKU string")
    row = pn.normalise(raw, MONTHLY).first()
    assert (row.date, row.sku, row.category, row.promo_flag) == (date(2024, 1, 31), "x", "ALL", 0)
    assert (row.oos_flag, row.comp_price_index, row.comp_qty_index, row.comp_promo_flag) == (0, 1.0, 1.0, 0)
    assert pn.normalise(raw.drop("SKU"), DAILY).first().sku == "ALL"
    with pytest.raises(MissingColumnError, match="qty"):
        pn.normalise(raw.drop("qty"), MONTHLY)


def test_nan_becomes_null(spark):
    raw = spark.createDataFrame([("2024-01-05", float("nan"))], "date string, qty double")
    assert pn.normalise(raw, MONTHLY).first().qty is None


def test_repeated_key_is_reported(spark):
    d = date(2024, 1, 31)
    good = tables.panel(spark, [(d, "a", "c", 1.0), (d, "b", "c", 1.0)])
    assert pn.require_unique_key(good) is good
    with pytest.raises(pn.DuplicateKeyError, match="a 2024-01-31"):
        pn.require_unique_key(tables.panel(spark, [(d, "a", "c", 1.0), (d, "a", "c", 2.0)]))


def test_lookback_daily_counts_thirty_days(spark):
    rows = [(date(2024, 1, 1), "a", "c", 1.0), (date(2024, 1, 31), "a", "c", 1.0), (date(2024, 3, 1), "a", "c", 1.0)]
    kept = pn.keep_lookback(tables.panel(spark, rows), 2, DAILY)
    assert kept.count() == 3
    assert pn.keep_lookback(tables.panel(spark, rows), 1, DAILY).count() == 2


def test_winsorise_caps_only_the_upper_side(spark):
    rows = [(date(2024, 1, i + 1), "a", "c", float(q)) for i, q in enumerate([-50, 1, 2, 3, 100])]
    rows.append((date(2024, 1, 9), "a", "c", None))
    capped = tables.column(pn.winsorise(tables.panel(spark, rows), 0.75), "qty")
    assert capped == [-50.0, 1.0, 2.0, 3.0, 3.0, None]


def test_rollup(spark):
    rows = [(date(2024, 2, 1), "a", "c", 2.0, 1), (date(2024, 2, 29), "a", "c", -1.0, 1), (date(2024, 3, 1), "a", "c", 0.0)]
    feb, mar = pn.monthly_rollup(tables.panel(spark, rows), 1.0).orderBy("date").collect()
    assert (feb.date, feb.qty, feb.sale_days, feb.promo_flag) == (date(2024, 2, 29), 1.0, 1, 1)
    assert feb.promo_share == 2 / 29 and (mar.sale_days, mar.promo_share, mar.promo_flag) == (0, 0.0, 0)


def test_exact_percentile_equals_percentile_on_large_and_skewed_groups(spark):
    # accuracy 50 makes every group larger than 500 rows take the bracket; one group holds most rows.
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 40_000, 0).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.rand(3) < 0.3, F.lit(5.0)).otherwise(F.randn(4) * 100).alias("v"),
    ).cache()
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    plain = F.percentile("v", F.array(*[F.lit(p) for p in probs.values()]))
    # A task that may sort five rows only has brackets narrowed again and again.
    for keys, most in ((["k"], 500_000), ([], 500_000), (["k"], 5), ([], 5)):
        ours = exact_percentile(rows, keys, "v", probs, accuracy=50, most=most)
        ours = {tuple(r[k] for k in keys): [r[n] for n in probs] for r in ours.collect()}
        wanted = {tuple(r[k] for k in keys): r.q for r in rows.groupBy(*keys).agg(plain.alias("q")).collect()}
        assert ours.keys() == wanted.keys()
        for k in ours:
            assert ours[k] == pytest.approx(wanted[k], rel=1e-12)


def test_exact_percentile_of_few_values_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("c", 7.0)], "k string, v double")
    found = {r.k: r.m for r in exact_percentile(rows, ["k"], "v", {"m": 0.5}).collect()}
    assert found == {"a": 1.5, "c": 7.0}


def test_weighted_quantiles_against_brute_force(spark):
    rows = spark.range(5_000).select(
        (F.col("id") % 3).cast("int").alias("leaf"), (F.randn(1) * 50).alias("v"), F.rand(2).alias("w")
    ).cache()
    for tau, most in ((0.1, 500_000), (0.5, 500_000), (0.9, 500_000), (0.1, 4), (0.9, 4)):
        found = weighted_quantiles(rows, "leaf", "v", "w", tau, most, parts=16)
        for leaf, group in rows.toPandas().groupby("leaf"):
            group = group.sort_values("v")
            reached = group.w.cumsum() >= tau * group.w.sum()
            assert found[leaf] == group.v[reached].iloc[0]


def test_weighted_quantiles_of_one_value(spark):
    rows = spark.createDataFrame([(0, 4.0, 1.0), (0, 4.0, 0.1), (2, 1.0, 1.0)], "leaf int, v double, w double")
    assert weighted_quantiles(rows, "leaf", "v", "w", 0.9) == {0: 4.0, 2: 1.0}


def test_weighted_quantiles_of_heavy_tails(spark):
    values = [2.0**i for i in range(201)]
    rows = spark.createDataFrame([(0, v, 1.0) for v in values] + [(1, -v, 1.0) for v in values], "leaf int, v double, w double")
    assert weighted_quantiles(rows, "leaf", "v", "w", 0.5) == {0: 2.0**100, 1: -(2.0**100)}
    assert weighted_quantiles(rows, "leaf", "v", "w", 0.5, most=1, parts=4) == {0: 2.0**100, 1: -(2.0**100)}
    wide = [-1.7e308, -1e-300, 0.0, 5e-324, 1e-300, 1.0, 1.7e308]
    rows = spark.createDataFrame([(0, v, 1.0) for v in wide], "leaf int, v double, w double")
    for i, v in enumerate(wide):
        assert weighted_quantiles(rows, "leaf", "v", "w", (i + 0.9) / len(wide)) == {0: v}


def test_percentiles_of_heavy_tails_with_narrow_tasks(spark):
    values = [s * 2.0**i for i in range(-300, 301) for s in (-1, 1)] + [0.0] * 50
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = exact_percentile(rows, [], "v", {"a": 0.25, "b": 0.5, "c": 0.9}, accuracy=20, most=1).first()
    wanted = rows.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert list(found) == pytest.approx(wanted, rel=1e-12)
