"""Queries over the panel: features, alignment, sentiment, targets, splits and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation, panel, sessions, splits
from tidemark.operators.quality import coverage
from tidemark.plans.catalog import Catalog, sql_round
from tidemark.schemas import PANEL, PRICE_FEATURES, SENTIMENT_FEATURES
from tidemark.sources.derived import BARS, NEWS, bars, inputs, news
from tidemark.sources.staging import once

CATALOG = Catalog()
query = CATALOG.query

ALIGNED = """aligned AS (
    SELECT ticker, url, published, prob_negative, prob_neutral, prob_positive, mapping_status,
           CASE WHEN mapping_status IN ('same_session', 'next_session') THEN session_date END AS observation_date
    FROM (SELECT e.*, s.session_date,
                 CASE WHEN s.session_date IS NULL THEN 'unmapped' WHEN s.session_date - e.effective > 12 THEN 'stale'
                      WHEN s.session_date = CAST(e.published AS DATE) THEN 'same_session' ELSE 'next_session' END AS mapping_status
          FROM (SELECT *, CAST(published AS DATE) + CASE WHEN hour(published) * 60 + minute(published) > 900 THEN 1 ELSE 0 END AS effective FROM news) e
          ASOF LEFT JOIN bars s ON e.ticker = s.ticker AND e.effective <= s.session_date))"""
DAILY = """daily AS (
    SELECT ticker, observation_date, count(*) AS news_count, CAST(1 AS BIGINT) AS has_news,
           avg(prob_negative) AS sent_prob_negative_mean, avg(prob_neutral) AS sent_prob_neutral_mean, avg(prob_positive) AS sent_prob_positive_mean,
           avg(CASE WHEN prob_positive > prob_negative AND prob_positive > prob_neutral THEN 1.0 ELSE 0.0 END) AS sent_pos_ratio,
           avg(CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 1.0 ELSE 0.0 END) AS sent_neg_ratio,
           avg(prob_positive - prob_negative) AS sent_pos_minus_neg, stddev_pop(prob_positive - prob_negative) AS sent_dispersion
    FROM aligned
    WHERE observation_date IS NOT NULL AND prob_negative BETWEEN 0 AND 1 AND prob_neutral BETWEEN 0 AND 1 AND prob_positive BETWEEN 0 AND 1
          AND abs(prob_negative + prob_neutral + prob_positive - 1) <= 1.01e-3
    GROUP BY 1, 2)"""
FEATURES = """returns AS (
    SELECT ticker, session_date AS observation_date, close, volume, close / lag(close) OVER w - 1 AS ret_1d, ln(close / lag(close) OVER w) AS log_ret_1d,
           volume / lag(volume) OVER w - 1 AS vol_change_1d, lead(session_date) OVER w AS target_date, lead(close) OVER w / close - 1 AS target_return,
           lead(session_date, 5) OVER w AS target_date_5, lead(close, 5) OVER w / close - 1 AS target_return_5
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY session_date)),
features AS (
    SELECT *, CASE WHEN count(ret_1d) OVER w = 5 THEN stddev_samp(ret_1d) OVER w END AS roll_vol_5, CASE WHEN count(close) OVER w = 5 THEN close / avg(close) OVER w END AS ma_ratio_5
    FROM returns WINDOW w AS (PARTITION BY ticker ORDER BY observation_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
FILLED = """filled AS (
    SELECT f.*, coalesce(d.news_count, 0) AS news_count, coalesce(d.has_news, 0) AS has_news, coalesce(sent_prob_negative_mean, 0) AS sent_prob_negative_mean,
           coalesce(sent_prob_neutral_mean, 1) AS sent_prob_neutral_mean, coalesce(sent_prob_positive_mean, 0) AS sent_prob_positive_mean,
           coalesce(sent_pos_ratio, 0) AS sent_pos_ratio, coalesce(sent_neg_ratio, 0) AS sent_neg_ratio, coalesce(sent_pos_minus_neg, 0) AS sent_pos_minus_neg,
           coalesce(sent_dispersion, 0) AS sent_dispersion
    FROM features f LEFT JOIN daily d USING (ticker, observation_date)),
panel AS (
    SELECT *, CAST(observation_date AS TIMESTAMP) + INTERVAL 15 HOUR AS as_of, avg(sent_pos_minus_neg) OVER w AS sent_pos_minus_neg_roll,
           list_reduce(list(CAST(sent_pos_minus_neg AS DOUBLE)) OVER e, lambda y, x: y * (1 - 2.0::DOUBLE / 6) + x * (2.0::DOUBLE / 6)) AS sent_pos_minus_neg_ewm,
           CAST(sum(news_count) OVER w AS DOUBLE) AS news_count_roll_sum, avg(has_news) OVER w AS has_news_roll_mean
    FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY observation_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         e AS (PARTITION BY ticker ORDER BY observation_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
TO_DAILY = (BARS, NEWS, ALIGNED, DAILY)
TO_PANEL = (*TO_DAILY, FEATURES, FILLED)
#: The last 60 target dates are the test period; thresholds are fitted on all dates before.
DATES = "dates AS (SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT target_date AS date FROM panel WHERE target_date IS NOT NULL))"
THRESHOLDS = "thresholds AS (SELECT quantile_cont(target_return, 1/3::DOUBLE) AS q_low, quantile_cont(target_return, 2/3::DOUBLE) AS q_high FROM panel JOIN dates ON target_date = date WHERE rank <= n - 60)"
LABELLED = """labelled AS (
    SELECT panel.* , CASE WHEN target_return < q_low THEN 'DOWN' WHEN target_return > q_high THEN 'UP' WHEN target_return IS NOT NULL THEN 'FLAT' END AS target_label, q_low, q_high
    FROM panel, thresholds)"""
TO_LABELS = (*TO_PANEL, DATES, THRESHOLDS, LABELLED)
NUMBERS = "ret_1d log_ret_1d roll_vol_5 ma_ratio_5 vol_change_1d"
SENTIMENTS = " ".join(SENTIMENT_FEATURES[2:])
SCALED = ["ret_1d", "roll_vol_5", "sent_pos_minus_neg"]


WORLD = ("orders", "customer", "lineitem")


def full_panel(spark, d):
    """The panel: as many rows as there are bars, made once for the tables it comes from."""
    return once(spark, "panel", inputs(d, *WORLD), lambda: panel.build_panel(bars(spark, d), daily(spark, d)))


def aligned(spark, d):
    return sessions.align_forward(news(spark, d), bars(spark, d))


def daily(spark, d):
    """Sentiment by ticker and session: as few rows as bars, made once, as the panel reads them several times."""
    return once(spark, "daily", inputs(d, *WORLD), lambda: panel.daily_sentiment(aligned(spark, d)))


def train_part(whole):
    return splits.assign(whole, splits.final_split(whole, 60)).where("split = 'train'").drop("split")


def fitted(spark, d):
    """Thresholds of the training dates: returns and dates come from the bars alone."""
    return panel.fit_thresholds(train_part(targets(spark, d, 1)))


def labelled(spark, d):
    return panel.label_panel(full_panel(spark, d), fitted(spark, d))


@query(
    """SELECT ticker, coalesce(target_label, 'NONE') AS target_label, count(*) AS n_rows, CAST(sum(news_count) AS BIGINT) AS n_news, avg(sent_pos_minus_neg) AS mean_polarity, avg(sent_pos_minus_neg_ewm) AS mean_ewm,
              avg(target_return) AS mean_return FROM labelled GROUP BY ALL""",
    TO_LABELS,
    "mean_polarity mean_ewm mean_return",
)
def flagship(spark, d):
    """Labels, news and sentiment of the whole point-in-time panel, by ticker and outcome."""
    return labelled(spark, d).groupBy("ticker", F.coalesce("target_label", F.lit("NONE")).alias("target_label")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("news_count").alias("n_news"),
        F.avg("sent_pos_minus_neg").alias("mean_polarity"),
        F.avg("sent_pos_minus_neg_ewm").alias("mean_ewm"),
        F.avg("target_return").alias("mean_return"),
    )


@query("SELECT * FROM bars", (BARS,), "open high low close")
def derived_bars(spark, d):
    return bars(spark, d)


@query("SELECT ticker, observation_date, close, ret_1d, log_ret_1d, roll_vol_5, ma_ratio_5, vol_change_1d FROM features", (BARS, FEATURES), "close " + NUMBERS)
def price_features(spark, d):
    return panel.price_features(bars(spark, d)).select("ticker", "observation_date", "close", *PRICE_FEATURES)


@query("SELECT ticker, url, mapping_status, observation_date FROM aligned", (BARS, NEWS, ALIGNED))
def asof_align(spark, d):
    return aligned(spark, d).select("ticker", "url", "mapping_status", "observation_date")


@query(
    """SELECT count(*) AS n_rows, count(observation_date) AS n_mapped, count(*) - count(observation_date) AS n_dropped, count_if(mapping_status = 'same_session') AS same_session,
       count_if(mapping_status = 'next_session') AS next_session, count_if(mapping_status = 'stale') AS stale, count_if(mapping_status = 'unmapped') AS unmapped,
       count_if(mapping_status = 'invalid') AS invalid, count_if(mapping_status = 'no_calendar') AS no_calendar FROM aligned""",
    (BARS, NEWS, ALIGNED),
)
def alignment_report(spark, d):
    return sessions.alignment_report(aligned(spark, d))


@query("SELECT * FROM daily", TO_DAILY, SENTIMENTS)
def daily_sentiment(spark, d):
    return daily(spark, d)


@query(
    f"SELECT {', '.join(c for c in PANEL if c not in ('target_label', 'split'))} FROM panel",
    TO_PANEL,
    f"close {NUMBERS} {SENTIMENTS} sent_pos_minus_neg_roll sent_pos_minus_neg_ewm news_count_roll_sum has_news_roll_mean target_return",
)
def point_in_time_panel(spark, d):
    return full_panel(spark, d).drop("target_label", "split")


@query("SELECT ticker, observation_date, sent_pos_minus_neg_roll, sent_pos_minus_neg_ewm, news_count_roll_sum, has_news_roll_mean FROM panel", TO_PANEL, "sent_pos_minus_neg_roll sent_pos_minus_neg_ewm news_count_roll_sum has_news_roll_mean")
def ewm_sentiment(spark, d):
    return full_panel(spark, d).select("ticker", "observation_date", "sent_pos_minus_neg_roll", "sent_pos_minus_neg_ewm", "news_count_roll_sum", "has_news_roll_mean")


def targets(spark, d, horizon):
    return panel.with_target(bars(spark, d).withColumnRenamed("session_date", "observation_date"), horizon).select("ticker", "observation_date", "target_date", "target_return")


@query("SELECT ticker, observation_date, target_date, target_return FROM features", (BARS, FEATURES), "target_return")
def targets_h1(spark, d):
    return targets(spark, d, 1)


@query("SELECT ticker, observation_date, target_date_5 AS target_date, target_return_5 AS target_return FROM features", (BARS, FEATURES), "target_return")
def targets_h5(spark, d):
    return targets(spark, d, 5)


@query(
    """SELECT ticker, observation_date, target_date, CASE WHEN count(target_return) OVER w > 1 THEN target_return - avg(target_return) OVER w END AS target_return
       FROM features WINDOW w AS (PARTITION BY target_date)""",
    (BARS, FEATURES),
    "target_return",
)
def excess_return(spark, d):
    return panel.cross_sectional_excess(targets(spark, d, 1))


@query(
    """SELECT ticker, observation_date, sent_prob_neutral_mean, sent_dispersion, news_count FROM
       (SELECT f.ticker, f.observation_date, 1.0 AS sent_prob_neutral_mean, 0.0 AS sent_dispersion, coalesce(d.news_count, 0) AS news_count FROM features f LEFT JOIN
        (SELECT ticker, observation_date, count(*) AS news_count FROM aligned WHERE observation_date IS NOT NULL GROUP BY 1, 2) d USING (ticker, observation_date))""",
    (BARS, NEWS, ALIGNED, FEATURES),
    "sent_prob_neutral_mean sent_dispersion",
)
def neutral_control(spark, d):
    return panel.assemble(bars(spark, d), panel.neutral_control(news(spark, d))).select("ticker", "observation_date", "sent_prob_neutral_mean", "sent_dispersion", "news_count")


@query("SELECT count(*) AS n_rows FROM news WHERE published >= TIMESTAMP '1997-03-01' AND published < TIMESTAMP '1998-04-01'", (NEWS,))
def publication_window(spark, d):
    start, end = F.lit("1997-03-01").cast("timestamp_ntz"), F.lit("1998-03-31").cast("timestamp_ntz")
    return news(spark, d).where((F.col("published") >= start) & (F.col("published") < end + F.expr("INTERVAL 1 DAY"))).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT ticker, observation_date, target_date FROM panel WHERE target_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", TO_PANEL)
def outcome_window(spark, d):
    return full_panel(spark, d).where(F.col("target_date").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))).select("ticker", "observation_date", "target_date")


@query("SELECT q_low, q_high FROM thresholds", TO_LABELS, "q_low q_high")
def thresholds(spark, d):
    return fitted(spark, d)


@query("SELECT ticker, observation_date, target_label FROM labelled", TO_LABELS)
def trend_labels(spark, d):
    return labelled(spark, d).select("ticker", "observation_date", "target_label")


FIT = f"""fit AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) <= 1e-12 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}' for c in SCALED)}
    FROM panel JOIN dates ON target_date = date WHERE rank <= n - 60 AND {' AND '.join(f'{c} IS NOT NULL' for c in SCALED)})"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, m_{c} AS mean, s_{c} AS scale FROM fit" for c in SCALED), (*TO_LABELS, FIT), "mean scale")
def scaler_params(spark, d):
    return panel.fit_scaler(train_part(full_panel(spark, d)), SCALED)


@query(f"SELECT ticker, observation_date, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in SCALED)} FROM panel, fit", (*TO_LABELS, FIT), " ".join(SCALED), places=6)
def scaled_features(spark, d):
    whole = full_panel(spark, d)
    return panel.scaled(whole, panel.fit_scaler(train_part(whole), SCALED), SCALED).select("ticker", "observation_date", *SCALED)


def dated(spark, d):
    return targets(spark, d, 1)


BAR_DATES = "dates AS (SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT target_date AS date FROM features WHERE target_date IS NOT NULL))"


@query(
    """SELECT date, CASE WHEN rank > n - t THEN 'test' WHEN rank > n - t - v THEN 'val' ELSE 'train' END AS split
       FROM (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS t, greatest(1, round_even(n * 0.15, 0)) AS v FROM dates)""",
    (BARS, FEATURES, BAR_DATES),
)
def chronological_split(spark, d):
    return splits.chronological_split(dated(spark, d))


@query("SELECT date, CASE WHEN rank > n - 60 THEN 'val' ELSE 'train' END AS split FROM dates", (BARS, FEATURES, BAR_DATES))
def final_split(spark, d):
    return splits.final_split(dated(spark, d), 60)


def walk_sql(expanding: bool) -> str:
    start = "0" if expanding else "e - len"
    return f"""SELECT CAST(w AS INTEGER) AS window, date, CASE WHEN a < e THEN 'train' WHEN a < e + 20 THEN 'val' ELSE 'test' END AS split
       FROM (SELECT date, rank - 1 AS a, n - 80 AS len, n - 80 + w * 20 AS e, w FROM dates, (SELECT unnest(range(3)) AS w)) WHERE a >= {start} AND a < e + 40"""


@query(walk_sql(True), (BARS, FEATURES, BAR_DATES))
def walk_forward(spark, d):
    return splits.walk_forward(dated(spark, d), 3, 20, 20)


@query(walk_sql(False), (BARS, FEATURES, BAR_DATES))
def walk_forward_rolling(spark, d):
    return splits.walk_forward(dated(spark, d), 3, 20, 20, expanding=False)


@query(
    """SELECT ticker, observation_date, target_label, sequence FROM (
           SELECT ticker, observation_date, target_label,
                  list([round(ret_1d, 8) + 0.0, round(roll_vol_5, 8) + 0.0, round(sent_pos_minus_neg, 8) + 0.0]) OVER (PARTITION BY ticker ORDER BY observation_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sequence,
                  count(ret_1d + roll_vol_5 + sent_pos_minus_neg) OVER (PARTITION BY ticker ORDER BY observation_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS k
           FROM labelled) WHERE k = 5 AND target_label IS NOT NULL""",
    TO_LABELS,
)
def sequences(spark, d):
    found = panel.sequences(labelled(spark, d), SCALED)
    return found.select("ticker", "observation_date", "target_label", F.transform("sequence", lambda s: F.transform(s, lambda x: sql_round(x) + F.lit(0.0))).alias("sequence"))


@query("SELECT ticker, max(observation_date) AS observation_date, CAST(5 AS INTEGER) AS length FROM features GROUP BY ticker", (BARS, FEATURES))
def latest_sequences(spark, d):
    return panel.latest_sequences(labelled(spark, d), SCALED).select("ticker", "observation_date", F.size("sequence").alias("length"))


@query("SELECT count(*) AS n_rows, CAST(sum(has_news) AS BIGINT) AS n_with_news, round(sum(has_news) / count(*), 6) AS coverage FROM panel", TO_PANEL)
def news_coverage(spark, d):
    return coverage(full_panel(spark, d))


@query("SELECT ticker, max_by(close, session_date) AS last_close, max(session_date) AS last_session_date, DATE '1998-02-01' AS observation_date FROM bars WHERE session_date <= DATE '1998-02-01' GROUP BY ticker", (BARS,), "last_close")
def last_close_asof(spark, d):
    own = bars(spark, d)
    at = own.select("ticker").distinct().withColumn("observation_date", F.lit("1998-02-01").cast("date"))
    return sessions.last_known(own, at, "close")
