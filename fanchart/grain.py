"""The two calendars a panel can have, and the feature columns each one carries.

Monthly and daily features differ only in lags, window lengths and calendar columns, so every feature
function takes a :class:`Grain` instead of existing twice.
"""

from __future__ import annotations

from dataclasses import dataclass

COMPETITOR_COLUMNS = ("comp_price_index", "comp_qty_index", "comp_promo_flag")
CATEGORICAL_COLUMNS = ("sku", "category")
TARGET = "qty"


@dataclass(frozen=True)
class Grain:
    """Lags, window lengths and season of one calendar."""

    name: str
    suffix: str
    calendar: tuple[str, ...]
    lags: tuple[int, ...]
    windows: tuple[int, ...]
    promo_windows: tuple[int, ...]
    competitor_windows: tuple[int, ...]
    trend_lag: int
    season: int

    @property
    def max_lag(self) -> int:
        """Rows of history one feature row looks back on."""
        return max(self.lags + self.windows)

    @property
    def season_column(self) -> str:
        return f"y_lag{self.season}"

    @property
    def trend_column(self) -> str:
        return f"grp_trend_excl_{self.trend_lag}{self.suffix}"

    def target_columns(self) -> list[str]:
        return [f"y_lag{n}" for n in self.lags] + [f"mean_{n}{self.suffix}" for n in self.windows]

    def promo_columns(self) -> list[str]:
        return [f"promo_share_{n}{self.suffix}" for n in self.promo_windows]

    def group_columns(self) -> list[str]:
        lags = [f"grp_qty_excl_lag{n}" for n in self.lags]
        means = [f"grp_mean_excl_{n}{self.suffix}" for n in self.windows]
        return lags + means + [self.trend_column]

    def competitor_window_name(self, column: str, n: int) -> str:
        if column == "comp_promo_flag":
            return f"comp_promo_share_{n}{self.suffix}"
        return f"{column}_mean_{n}{self.suffix}"

    def competitor_columns(self) -> list[str]:
        lags = [f"{c}_lag{n}" for c in COMPETITOR_COLUMNS for n in self.lags]
        means = [self.competitor_window_name(c, n) for c in COMPETITOR_COLUMNS for n in self.competitor_windows]
        return lags + means

    def history_columns(self) -> list[str]:
        """Columns computed from earlier rows of the panel."""
        return self.target_columns() + self.promo_columns() + self.group_columns() + self.competitor_columns()

    def feature_columns(self) -> list[str]:
        """Every model input, categorical columns first."""
        current = ["promo_flag", "oos_flag", *COMPETITOR_COLUMNS]
        return [*CATEGORICAL_COLUMNS, *self.calendar, *current, *self.history_columns()]


MONTHLY = Grain(
    name="monthly",
    suffix="m",
    calendar=("month", "month_sin", "month_cos", "quarter"),
    lags=(1, 3, 6, 12),
    windows=(3, 6, 12),
    promo_windows=(3, 6, 12),
    competitor_windows=(3, 6, 12),
    trend_lag=3,
    season=12,
)

DAILY = Grain(
    name="daily",
    suffix="d",
    calendar=("dow", "dom", "week", "month", "month_sin", "month_cos", "dow_sin", "dow_cos"),
    lags=(1, 7, 14, 28),
    windows=(7, 14, 28),
    promo_windows=(7, 28),
    competitor_windows=(7, 28),
    trend_lag=7,
    season=7,
)


def grain(name: str) -> Grain:
    """Look a grain up by name."""
    known = {g.name: g for g in (MONTHLY, DAILY)}
    if name not in known:
        raise ValueError(f"freq must be one of {sorted(known)}, not {name!r}")
    return known[name]
