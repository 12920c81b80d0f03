"""The same results as the registered queries in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

from fanchart.grain import COMPETITOR_COLUMNS, DAILY, MONTHLY, Grain

# Settings of the registered queries, repeated here so that the SQL stands on its own.
HORIZON, FOLDS, HALFLIFE, ETA, LOOKBACK, LAST_K, PREVIEW = 12, 3, 18, 5.0, 24, 6, 200

LINES = """
lines as (
  select l.*, cast(l_shipdate as date) as day, concat(p_brand, '/', p_type) as sku, p_type as category, p_retailprice
  from lineitem l join part on l_partkey = p_partkey
)"""


def panel(grain: Grain) -> str:
    date = "cast(last_day(day) as date)" if grain is MONTHLY else "day"
    return f"""{LINES}, panel as (
  select sku, category, {date} as date, sum(l_quantity) as qty,
    case when 5 * sum(case when l_discount >= 0.085 then 1 else 0 end) >= count(*) then 1 else 0 end as promo_flag,
    case when 2 * sum(case when l_returnflag = 'R' then 1 else 0 end) > count(*) then 1 else 0 end as oos_flag,
    round(avg(l_extendedprice / l_quantity) / avg(p_retailprice), 6) as comp_price_index,
    round(sum(case when l_linestatus = 'O' then l_quantity else 0 end) / sum(l_quantity) + 0.5, 6) as comp_qty_index,
    case when 3 * sum(case when l_tax >= 0.06 then 1 else 0 end) >= count(*) then 1 else 0 end as comp_promo_flag
  from lines group by 1, 2, 3
)"""


def with_(*parts: str) -> str:
    return "with " + ", ".join(part.strip() for part in parts)


def lag(column: str, n: int) -> str:
    return f"lag({column}, {n}) over (partition by sku order by date)"


def mean(column: str, n: int, digits: int | None = 9) -> str:
    frame = f"over (partition by sku order by date rows between {n} preceding and 1 preceding)"
    value = f"avg({column}) {frame}"
    value = value if digits is None else f"round({value}, {digits})"
    return f"case when count({column}) {frame} = {n} then {value} end"


def target_columns(grain: Grain) -> list[str]:
    return [f"{lag('qty', n)} as y_lag{n}" for n in grain.lags]


def mean_columns(grain: Grain) -> list[str]:
    s = grain.suffix
    means = [f"{mean('qty', n)} as mean_{n}{s}" for n in grain.windows]
    return means + [f"{mean('promo_flag', n)} as promo_share_{n}{s}" for n in grain.promo_windows]


GROUPED = """
totals as (
  select category, date, coalesce(sum(qty), 0) as grp_qty, avg(promo_flag) as grp_promo_share from panel group by 1, 2
), grouped as (
  select panel.*, grp_qty, grp_promo_share, grp_qty - qty as grp_qty_excl
  from panel left join totals on panel.category = totals.category and panel.date = totals.date
)"""


def group_columns(grain: Grain) -> list[str]:
    s, x = grain.suffix, "grp_qty_excl"
    lags = [f"{lag(x, n)} as grp_qty_excl_lag{n}" for n in grain.lags]
    means = [f"{mean(x, n)} as grp_mean_excl_{n}{s}" for n in grain.windows]
    return lags + means + [f"{lag(x, 1)} - {lag(x, grain.trend_lag)} as {grain.trend_column}"]


def competitor_columns(grain: Grain) -> list[str]:
    lags = [f"{lag(c, n)} as {c}_lag{n}" for c in COMPETITOR_COLUMNS for n in grain.lags]
    means = [
        f"{mean(c, n)} as {grain.competitor_window_name(c, n)}"
        for c in COMPETITOR_COLUMNS
        for n in grain.competitor_windows
    ]
    return lags + means


def commas(columns: list[str]) -> str:
    return ",\n  ".join(columns)


def lag_features(grain: Grain) -> str:
    return f"{with_(panel(grain))} select sku, cast(date as varchar) as date, qty, {commas(target_columns(grain))} from panel"


def rolling_features(grain: Grain) -> str:
    return f"{with_(panel(grain))} select sku, cast(date as varchar) as date, {commas(mean_columns(grain))} from panel"


def group_features(grain: Grain) -> str:
    return f"""{with_(panel(grain), GROUPED)}
select sku, category, cast(date as varchar) as date, grp_qty, round(grp_promo_share, 9) as grp_promo_share,
  grp_qty_excl, {commas(group_columns(grain))} from grouped"""


def competitor_features(grain: Grain) -> str:
    return f"{with_(panel(grain))} select sku, cast(date as varchar) as date, {commas(competitor_columns(grain))} from panel"


# Rows with a full year of history, as training keeps them, and every fold's dates.
COMPLETE = """
numbered as (
  select *, row_number() over (partition by sku order by date) as rn,
    lag(qty, 12) over (partition by sku order by date) as lag12
  from panel
), complete as (select * from numbered where rn > 12)"""


def fold_table(source: str) -> str:
    """Anchors i * (n - h - 1) div (k - 1) over the sorted distinct dates."""
    return f"""
dates as (
  select date, row_number() over (order by date) - 1 as i, count(*) over () as n
  from (select distinct date from {source}) d
), folds as (
  select fold, anchor, n from (
    select fold, n, case when n - {HORIZON} - 1 < 0 then 0 else
      cast(floor(fold * (n - {HORIZON} - 1) / greatest(least({FOLDS}, n - {HORIZON}) - 1, 1)) as bigint) end as anchor
    from (select max(n) as n from dates) m, (select unnest(range({FOLDS})) as fold) f
    where fold < greatest(least({FOLDS}, n - {HORIZON}), 1)
  ) a
), bounds as (
  select fold, (select min(date) from dates) as train_start, a.date as train_end, b.date as test_start,
    c.date as test_end
  from folds join dates a on a.i = anchor join dates b on b.i = anchor + 1
  join dates c on c.i = case when folds.n - {HORIZON} - 1 < 0 then folds.n - 1 else anchor + {HORIZON} end
)"""


SCORES = """
    sum(abs(qty - p50)) / greatest(sum(abs(qty)), 1e-9) as wmape,
    avg(2 * abs(qty - p50) / greatest(abs(qty) + abs(p50), 1e-9)) as smape,
    avg(case when scale is not null then abs(qty - p50) end) / greatest(avg(scale), 1e-9) as mase,
    avg(greatest(0.1 * (qty - p10), -0.9 * (qty - p10))) as pin10,
    avg(greatest(0.5 * (qty - p50), -0.5 * (qty - p50))) as pin50,
    avg(greatest(0.9 * (qty - p90), -0.1 * (qty - p90))) as pin90"""

NAMED_SCORES = """round({f}(wmape), 6) as "wMAPE", round({f}(smape), 6) as "sMAPE", round({f}(mase), 6) as "MASE",
  round({f}(pin10), 6) as "Pinball_p10", round({f}(pin50), 6) as "Pinball_p50", round({f}(pin90), 6) as "Pinball_p90\""""

WALK_FORWARD = f"""
train as (select fold, c.* from complete c join bounds on date <= train_end),
test as (select fold, c.* from complete c join bounds on date > train_end and date <= test_end),
usable as (
  select fold from (select fold, count(*) as n from train group by 1) a
  where n >= 13 and exists (select 1 from test where test.fold = a.fold)
), residual as (
  select fold, sku, quantile_cont(qty - lag12, 0.1) as r10, quantile_cont(qty - lag12, 0.9) as r90,
    avg(abs(qty - lag12)) as scale
  from train group by 1, 2
), scored as (
  select test.fold, {SCORES} from (
    select test.fold, test.sku, qty, scale, lag12 as p50, lag12 + coalesce(r10, 0) as p10, lag12 + coalesce(r90, 0) as p90
    from test left join residual on test.fold = residual.fold and test.sku = residual.sku
    where test.fold in (select fold from usable)
  ) test group by 1
)"""


def half_even(x: str) -> str:
    """Clip at 0 and round to 2 digits, ties to even."""
    return f"round_even(greatest({x}, 0.0) * 100, 0) / 100"


def seasonal(grain: Grain, horizon: int, start: str = "(select max(date) from panel)") -> str:
    """The seasonal naive forecast: step h repeats row ((h - 1) mod season) + 1 of a SKU's last season rows."""
    season = grain.season
    step = "cast(last_day(k.start + to_months(cast(h as int))) as date)" if grain is MONTHLY else "k.start + cast(h as int)"
    return f"""
ends as (
  select sku, qty, row_number() over (partition by sku order by date desc) as age,
    {start} as start
  from panel
), residual as (
  select sku, quantile_cont(qty - lagged, 0.1) as r10, quantile_cont(qty - lagged, 0.9) as r90
  from (select sku, qty, lag(qty, {season}) over (partition by sku order by date) as lagged from panel) r
  group by 1
), raw as (
  select k.sku, {step} as date, h, coalesce(ends.qty, 0) as p50,
    coalesce(ends.qty, 0) + coalesce(r10, 0) as p10, coalesce(ends.qty, 0) + coalesce(r90, 0) as p90
  from (select distinct sku, start, unnest(range(1, {horizon + 1})) as h from ends) k
  left join ends on ends.sku = k.sku and ends.age = {season} - ((h - 1) % {season})
  left join residual on residual.sku = k.sku
), forecast as (
  select sku, date, h, 0 as promo_flag, {half_even('least(p10, p50, p90)')} as p10,
    {half_even('p10 + p50 + p90 - least(p10, p50, p90) - greatest(p10, p50, p90)')} as p50,
    {half_even('greatest(p10, p50, p90)')} as p90
  from raw
)"""


FORECAST = "select cast(date as varchar) as date, sku, promo_flag, p10, p50, p90 from forecast"
OWN_START = "max(date) over (partition by sku)"

PLAN = """
plan as (
  select cast(last_day(date + interval 12 month) as date) as date, sku, promo_flag from panel
  union all
  select distinct cast(last_day(date + interval 12 month) as date), 'ALL', 1 from panel where month(date) = 12
)"""


def planned(date: str, sku: str) -> str:
    return f"""coalesce((select max(promo_flag) from plan where plan.date = {date} and plan.sku = {sku}),
    (select max(promo_flag) from plan where plan.date = {date} and plan.sku = 'ALL'), 0)"""


WEIGHTS = f"""pow(0.5, (date_diff('month', date, (select max(date) from panel))) / {float(HALFLIFE)})
  * (1 - 0.9 * oos_flag)"""

EXPERTS = """
residual as (
  select sku, quantile_cont(qty - lag12, 0.1) as r10, quantile_cont(qty - lag12, 0.9) as r90 from complete group by 1
), constant as (
  select quantile_cont(qty, 0.1) as c10, quantile_cont(qty, 0.5) as c50, quantile_cont(qty, 0.9) as c90 from complete
), last as (select sku, arg_max(qty, date) as last_y from complete group by 1)"""

LOSSES = """
constant as (select fold, quantile_cont(qty, 0.5) as c50 from train group by 1),
last as (select fold, sku, arg_max(qty, date) as last_y from train group by 1, 2),
forecasts as (
  select test.fold, qty, 'snaive' as expert, lag12 as p50 from test
  union all
  select test.fold, qty, 'constant', c50 from test join constant on test.fold = constant.fold
  union all
  select test.fold, qty, 'last', coalesce(last_y, 0)
  from test left join last on test.fold = last.fold and test.sku = last.sku
), losses as (
  select expert, avg(loss) as loss from (
    select expert, fold, sum(abs(qty - p50)) / greatest(sum(abs(qty)), 1e-9) as loss
    from forecasts where fold in (select fold from usable) group by 1, 2
  ) l group by 1
)"""


def oracle_sql() -> dict[str, str]:
    month, day = panel(MONTHLY), panel(DAILY)
    sql: dict[str, str] = {}

    every = "sku, category, cast(date as varchar) as date, qty, promo_flag, oos_flag, comp_price_index, comp_qty_index, comp_promo_flag"
    sql["panel_monthly"] = f"{with_(month)} select {every} from panel"
    reread = every.replace("comp_promo_flag", "case when year(date) % 2 = 1 then 0 else comp_promo_flag end as comp_promo_flag")
    sql["csv_round_trip"] = f"{with_(month)} select {reread} from panel"
    sql["panel_daily"] = f"{with_(day)} select {every} from panel"
    sql["panel_extent"] = (
        f"{with_(month)} select count(distinct date) as months, count(distinct sku) as skus from panel"
    )
    sql["sku_normalise"] = r"""
with messy as (
  select p_partkey, case when p_size < 10 then concat(p_partkey, '.0') when p_size < 20 then concat('  ', p_partkey, ' ')
    when p_size < 30 then concat(p_brand, '.0 ') when p_size < 35 then 'nan' when p_size < 40 then ' None '
    when p_size < 45 then p_name end as sku
  from part
), clean as (
  select p_partkey, regexp_replace(regexp_replace(sku, '^\s+|\s+$', '', 'g'), '\.0$', '') as sku from messy
)
select p_partkey, case when sku is null or sku in ('', 'nan', 'NaN', 'None') then 'NA' else sku end as sku from clean"""
    sql["parse_dates"] = """
with texts as (
  select l_linenumber, case l_linenumber when 1 then strftime(l_shipdate, '%Y-%m-%d')
    when 2 then strftime(l_shipdate, '%-d.%-m.%Y') when 3 then strftime(l_shipdate, '%-d/%-m/%Y')
    when 4 then strftime(l_shipdate, '%-d-%-m-%Y') when 5 then strftime(l_shipdate, '%b %Y') end as text
  from lineitem
), parsed as (
  select l_linenumber,
    cast(try_strptime(text, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%d-%m-%Y']) as date) as date
  from texts
)
select l_linenumber, cast(date as varchar) as date, cast(cast(last_day(date) as date) as varchar) as month,
  count(*) as n from parsed group by 1, 2, 3"""
    sql["lookback_filter"] = f"""{with_(month)}
select sku, cast(date as varchar) as date, qty from panel
where date >= (select max(date) from panel) - interval {LOOKBACK} month"""
    sql["drop_incomplete"] = f"""{with_(month)}
select * from (
  select sku, cast(date as varchar) as date, qty, {lag('qty', 12)} as y_lag12, {mean('qty', 12)} as mean_12m from panel
) f where y_lag12 is not null and mean_12m is not null"""
    sql["winsorise"] = f"""{with_(LINES)}, caps as (
  select sku, quantile_cont(l_extendedprice, 0.99) as cap from lines group by 1
)
select l_orderkey, l_linenumber, lines.sku, round(least(l_extendedprice, cap), 6) as qty
from lines join caps on lines.sku = caps.sku"""
    sql["monthly_rollup"] = f"""{with_(LINES)}, caps as (
  select sku, quantile_cont(l_quantity, 0.99) as cap from lines group by 1
), capped as (
  select lines.sku, category, cast(last_day(day) as date) as date, least(l_quantity, cap) as qty,
    case when l_discount >= 0.085 then 1 else 0 end as promo_flag
  from lines join caps on lines.sku = caps.sku
)
select cast(date as varchar) as date, sku, max(category) as category, round(sum(qty), 6) as qty,
  round(least(greatest(sum(promo_flag) / day(date), 0), 1), 9) as promo_share,
  count(case when qty > 0 then 1 end) as sale_days, case when sum(promo_flag) > 0 then 1 else 0 end as promo_flag
from capped group by capped.date, sku"""

    wave = "round({f}(2 * pi() * {x} / {n}.0), 6) + 0.0 as {name}"
    waves = commas(
        [
            wave.format(f="sin", x="month(date)", n=12, name="month_sin"),
            wave.format(f="cos", x="month(date)", n=12, name="month_cos"),
            wave.format(f="sin", x="(isodow(date) - 1)", n=7, name="dow_sin"),
            wave.format(f="cos", x="(isodow(date) - 1)", n=7, name="dow_cos"),
        ]
    )
    sql["calendar_features"] = f"""
with dates as (select distinct cast(l_shipdate as date) as date from lineitem)
select cast(date as varchar) as date, month(date) as month, quarter(date) as quarter, isodow(date) - 1 as dow,
  day(date) as dom, weekofyear(date) as week, {waves} from dates"""

    for grain in (MONTHLY, DAILY):
        sql[f"lag_features_{grain.name}"] = lag_features(grain)
        sql[f"rolling_features_{grain.name}"] = rolling_features(grain)
        sql[f"group_features_{grain.name}"] = group_features(grain)
        sql[f"competitor_features_{grain.name}"] = competitor_features(grain)
    history = target_columns(MONTHLY) + mean_columns(MONTHLY) + group_columns(MONTHLY) + competitor_columns(MONTHLY)
    sql["all_features_monthly"] = f"""{with_(month, GROUPED)}
select sku, cast(date as varchar) as date, month(date) as month, quarter(date) as quarter, {commas(history)}
from grouped"""
    sql["forward_fill"] = f"""{with_(month)}, hidden as (
  select sku, date, case when oos_flag = 0 then qty end as masked from panel
)
select sku, cast(date as varchar) as date, masked,
  last_value(masked ignore nulls) over (partition by sku order by date rows unbounded preceding) as filled
from hidden"""
    sql["last_k_rows"] = f"""{with_(month)}
select sku, cast(date as varchar) as date, qty from (
  select *, row_number() over (partition by sku order by date desc) as age from panel
) p where age <= {LAST_K}"""
    sql["training_weights"] = f"""{with_(month)}
select sku, cast(date as varchar) as date, round({WEIGHTS}, 9) as weight from panel"""

    scored = f"""{with_(month)}, rows_ as (
  select * from (select *, {lag('qty', 12)} as lag12 from panel) l where lag12 is not null
), residual as (
  select sku, quantile_cont(qty - lag12, 0.1) as r10, quantile_cont(qty - lag12, 0.9) as r90,
    avg(abs(qty - lag12)) as scale
  from rows_ group by 1
), scored as (
  select rows_.*, scale, r10, lag12 as p50, lag12 + r10 as p10, lag12 + r90 as p90
  from rows_ join residual on rows_.sku = residual.sku
)"""
    sql["metrics_wape_smape_pinball"] = f"""{scored}
select category, round(wmape, 6) as "wMAPE", round(smape, 6) as "sMAPE", round(pin10, 6) as "Pinball_p10",
  round(pin50, 6) as "Pinball_p50", round(pin90, 6) as "Pinball_p90"
from (select category, {SCORES} from scored group by 1) s"""
    sql["metrics_mase"] = f"""{scored}
select category, round(avg(abs(qty - (p50 + r10))) / greatest(avg(scale), 1e-9), 6) as "MASE" from scored group by 1"""
    sql["constant_quantiles"] = """
select round(quantile_cont(l_extendedprice, 0.1), 6) as p10, round(quantile_cont(l_extendedprice, 0.5), 6) as p50,
  round(quantile_cont(l_extendedprice, 0.9), 6) as p90 from lineitem"""

    sql["constant_quantiles_weighted"] = """
with lines as (
  select l_returnflag as flag, l_extendedprice as v, l_quantity as w from lineitem
  union all select 'ALL', l_extendedprice, l_quantity from lineitem
), upto as (
  select flag, v, sum(w) over (partition by flag order by v) as reached, sum(w) over (partition by flag) as total
  from lines where w > 0 and v is not null
)
select flag, min(case when reached >= 0.1 * total then v end) as p10, min(case when reached >= 0.5 * total then v end) as p50,
  min(case when reached >= 0.9 * total then v end) as p90 from upto group by 1"""

    sql["rolling_folds"] = f"""{with_(month, fold_table('panel'))}
select fold, cast(train_start as varchar) as train_start, cast(train_end as varchar) as train_end,
  cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end from bounds"""
    sql["fold_assignment"] = f"""{with_(month, fold_table('panel'))}
select fold, case when date <= train_end then 'train' else 'test' end as part, count(*) as n,
  cast(min(date) as varchar) as first_date, cast(max(date) as varchar) as last_date, sum(qty) as qty
from panel join bounds on date <= test_end group by 1, 2"""
    walk = with_(month, COMPLETE, fold_table("complete"), WALK_FORWARD)
    sql["walk_forward_folds"] = f"{walk} select fold, {NAMED_SCORES.format(f='')} from scored"
    sql["walk_forward_naive"] = f"{walk} select {NAMED_SCORES.format(f='avg')}, count(*) as n_folds from scored"

    sql["quantile_gbt_summary"] = f"""{with_(month, COMPLETE)}
select encoding, (select count(*) from complete) as n_rows, true as p10_better, true as p50_better, true as p90_better
from (values ('onehot'), ('target')) t(encoding)"""
    sql["seasonal_naive_forecast"] = f"{with_(month, seasonal(MONTHLY, HORIZON))} {FORECAST}"
    sql["seasonal_naive_daily"] = f"{with_(day, seasonal(DAILY, 14))} {FORECAST}"
    sql["recursive_forecast_naive"] = sql["seasonal_naive_forecast"]
    sql["recursive_forecast_alone"] = f"{with_(month, seasonal(MONTHLY, HORIZON, OWN_START))} {FORECAST}"
    sql["naive_calibrated"] = f"""{with_(month, seasonal(MONTHLY, HORIZON))}, ratios as (
  select sku, case when count(*) >= 2 then
    least(greatest(median(qty / greatest(coalesce(lag12, 0), 1e-6)), 0.6), 1.4) else 1 end as ratio
  from (
    select sku, qty, {lag('qty', 12)} as lag12, row_number() over (partition by sku order by date desc) as age
    from panel
  ) t where age <= {LAST_K} group by 1
)
select cast(date as varchar) as date, raw.sku, 0 as promo_flag, {half_even('p10 * ratio')} as p10,
  {half_even('p50 * ratio')} as p50, {half_even('p90 * ratio')} as p90
from raw join ratios on raw.sku = ratios.sku"""
    sql["promo_plan_join"] = f"""{with_(month, PLAN)}, stubs as (
  select sku, arg_min(category, date) as category,
    cast(last_day((select max(date) from panel) + interval 1 month) as date) as date
  from panel group by 1
)
select sku, category, cast(date as varchar) as date, qty, promo_flag from panel
union all
select sku, category, cast(date as varchar), null, {planned('stubs.date', 'stubs.sku')} from stubs"""
    sql["promo_plan_lookup"] = f"""{with_(month, PLAN)}
select sku, cast(date as varchar) as date, {planned('panel.date', 'panel.sku')} as planned_flag from panel"""
    sql["promo_scenarios"] = f"""{with_(month, seasonal(MONTHLY, HORIZON), PLAN)}
select 'repeat' as scenario, cast(date as varchar) as date, sku,
  {planned('forecast.date', 'forecast.sku')} as promo_flag, p10, p50, p90 from forecast
union all
select 'general', cast(date as varchar), sku, {planned('forecast.date', "'ALL'")}, p10, p50, p90 from forecast"""
    sql["feed_back_p50"] = f"""{with_(month, seasonal(MONTHLY, HORIZON))}
select sku, cast(date as varchar) as date, qty from panel
union all
select sku, cast(date as varchar), p50 from forecast"""

    sql["ensemble_mean"] = f"""{with_(month, COMPLETE, EXPERTS)}
select complete.sku, cast(date as varchar) as date,
  round((lag12 + r10 + c10 + last_y) / 3, 6) as p10, round((lag12 + c50 + last_y) / 3, 6) as p50,
  round((lag12 + r90 + c90 + last_y) / 3, 6) as p90
from complete join residual on complete.sku = residual.sku join last on complete.sku = last.sku, constant"""
    sql["ensemble_exp_weights"] = f"""{walk}, {LOSSES}
select expert, round(loss, 6) as loss,
  round(exp(-{ETA} * loss) / (select sum(exp(-{ETA} * loss)) from losses), 6) as weight from losses"""
    sql["ensemble_report"] = f"""{with_(month, COMPLETE)}
select 'monthly' as freq, 5.0 as eta, {HALFLIFE} as halflife, count(*) as rows,
  {len(MONTHLY.feature_columns()) + 2} as features_total, 'qty' as y_col, cast(min(date) as varchar) as date_min,
  cast(max(date) as varchar) as date_max, {FOLDS} as cv_folds, {HORIZON} as horizon, 3 as n_experts from complete"""

    both = with_(month, seasonal(MONTHLY, HORIZON))
    sql["sku_series"] = f"""{both}
select sku, cast(date as varchar) as date, 'qty' as series, qty as value from panel
union all select sku, cast(date as varchar), 'p10', p10 from forecast
union all select sku, cast(date as varchar), 'p50', p50 from forecast
union all select sku, cast(date as varchar), 'p90', p90 from forecast"""
    category = "(select sku, arg_max(category, date) as category from panel group by 1) c"
    labelled = f"forecast f join {category} on f.sku = c.sku"
    sql["category_series"] = f"""{both}
select category, cast(date as varchar) as date, 'qty' as series, round(sum(qty), 6) as value from panel group by 1, 2
union all select category, cast(date as varchar), 'sum_p10', round(sum(p10), 6) from {labelled} group by 1, 2
union all select category, cast(date as varchar), 'sum_p50', round(sum(p50), 6) from {labelled} group by 1, 2
union all select category, cast(date as varchar), 'sum_p90', round(sum(p90), 6) from {labelled} group by 1, 2"""
    sql["promo_intervals"] = f"""{with_(month)}
select distinct sku, cast(cast(date_trunc('month', date) as date) as varchar) as start,
  cast(date + 1 as varchar) as "end" from panel where promo_flag = 1"""
    sql["promo_intervals_daily"] = f"""{with_(day)}
select distinct category, cast(date as varchar) as start, cast(date + 1 as varchar) as "end"
from panel where promo_flag = 1"""
    sql["any_promo"] = f"""{with_(month)}
select sku, case when max(promo_flag) > 0 then 1 else 0 end as any_promo from panel group by 1"""
    export = f"select cast(f.date as varchar) as date, f.sku, c.category, promo_flag, p10, p50, p90 from {labelled}"
    sql["forecast_export"] = f"{both} {export}"
    sql["forecast_preview"] = f"{both} {export} order by f.date, f.sku limit {PREVIEW}"
    sql["selector_values"] = f"""{with_(month)}
select distinct 'sku' as selector, sku as value from panel
union all select distinct 'category', category from panel"""
    sql["sku_category"] = f"""{with_(month)}
select sku, arg_min(category, date) as first_category, arg_max(category, date) as latest_category
from panel group by 1"""
    sql["synthetic_panel"] = """
with months as (
  select i, cast(last_day(date '2019-01-31' + to_months(cast(i as int))) as date) as date from range(72) r(i)
), flagged as (
  select cast(p_partkey as varchar) as sku, p_retailprice as base, p_size, i, date,
    case when p_size > 25 and month(date) in (3, 9) or p_size <= 25 and month(date) in (11, 12) then 1 else 0 end
      as promo_flag
  from part, months
), hashed as (
  select *, md5(sku || ':' || i || ':7') as digest from flagged
), even as (
  select *, (cast('0x' || substr(digest, 1, 12) as bigint) + 0.5::double) / 16.0::double ** 12 as u,
    (cast('0x' || substr(digest, 13, 12) as bigint) + 0.5::double) / 16.0::double ** 12 as v from hashed
)
select cast(date as varchar) as date, sku, promo_flag,
  round(greatest(base + (i - p_size) * (p_size / 100.0) + 12 * sin(2 * pi() * month(date) / 12)
    + 6 * cos(2 * pi() * month(date) / 6) + 10 * promo_flag + 5 * sqrt(-2 * ln(u)) * cos(2 * pi() * v), 0), 2) as qty
from even"""
    return sql
