"""Relations of the library and checks at operator entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The study's time zone: wall times are in it, instants are converted to it.
ZONE = "Asia/Ho_Chi_Minh"
# fixed values: class, status and column names
CLASSES = ("DOWN", "FLAT", "UP")
SENTIMENTS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
STATUSES = ("same_session", "next_session", "stale", "unmapped", "invalid", "no_calendar")
MAPPED = ("same_session", "next_session")
PRICES = "ticker string, time timestamp_ntz, open double, high double, low double, close double, volume double"
NEWS = "ticker string, url string, published_at string, prob_negative double, prob_neutral double, prob_positive double"
PRICE_FEATURES = ("ret_1d", "log_ret_1d", "roll_vol_5", "ma_ratio_5", "vol_change_1d")
SENTIMENT_FEATURES = (
    "news_count",
    "has_news",
    "sent_prob_negative_mean",
    "sent_prob_neutral_mean",
    "sent_prob_positive_mean",
    "sent_pos_ratio",
    "sent_neg_ratio",
    "sent_pos_minus_neg",
    "sent_dispersion",
)
ROLLING_FEATURES = ("sent_pos_minus_neg_roll", "sent_pos_minus_neg_ewm", "news_count_roll_sum", "has_news_roll_mean")
PANEL = ("ticker", "observation_date", "target_date", "as_of", "close", *PRICE_FEATURES, *SENTIMENT_FEATURES, *ROLLING_FEATURES, "target_return", "target_label", "split")


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns {missing}")


def finite(column: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def refuse(bad: DataFrame, what: str) -> None:
    """Raises if ``bad`` has a row; looks at one row only."""
    if found := bad.limit(1).collect():
        raise ValueError(f"{what}: {found[0].asDict()}")
