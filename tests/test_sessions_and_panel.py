import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel, sessions, splits
from tidemark.plans.catalog import sql_round
from tidemark.sources.derived import bars, news


def calendar(spark, n, ticker="AAA", start=dt.date(2021, 1, 4)):
    days, day = [], start
    while len(days) < n:
        if day.weekday() < 5:
            days.append((ticker, day))
        day += dt.timedelta(1)
    return spark.createDataFrame(days, "ticker string, session_date date")


@pytest.mark.parametrize(
    "published, ticker, n, status, session",
    [
        ("2021-01-05 14:00:00", "AAA", 10, "same_session", dt.date(2021, 1, 5)),
        ("2021-01-05 15:00:00", "AAA", 10, "same_session", dt.date(2021, 1, 5)),
        ("2021-01-05 15:00:00.9", "AAA", 10, "same_session", dt.date(2021, 1, 5)),
        ("2021-01-05 15:00:01", "AAA", 10, "next_session", dt.date(2021, 1, 6)),
        ("2021-01-05 16:00:00", "AAA", 10, "next_session", dt.date(2021, 1, 6)),
        ("2021-01-09 10:00:00", "AAA", 10, "next_session", dt.date(2021, 1, 11)),
        ("2019-01-01 09:00:00", "AAA", 5, "stale", None),
        ("2021-06-01 09:00:00", "AAA", 5, "unmapped", None),
        (None, "AAA", 5, "invalid", None),
        (None, "ZZZ", 5, "invalid", None),
        ("2021-01-05 09:00:00", "ZZZ", 5, "no_calendar", None),
    ],
)
def test_alignment(spark, published, ticker, n, status, session):
    rows = spark.createDataFrame([(ticker, published)], "ticker string, p string").select("ticker", F.col("p").cast("timestamp_ntz").alias("published"))
    found = sessions.align_forward(rows, calendar(spark, n)).first()
    assert (found.mapping_status, found.observation_date) == (status, session)
    assert found.as_of == (dt.datetime.combine(session, dt.time(15)) if session else None)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_news_are_read_once_and_mapped_as_day_by_day(spark, monkeypatch, limit):
    monkeypatch.setattr(sessions.few, "__defaults__", (limit,))
    days = {"AAA": [4, 5, 5, 11, 27], None: [6]}
    own = [(t, dt.date(2021, 1, d)) for t, ds in days.items() for d in ds] + [("NUL", None)]
    rows = [(t, dt.datetime(2021, 1, 1) + dt.timedelta(hours=8 * k)) for t in ("AAA", None, "NUL", "ZZZ") for k in range(90)]
    news_rows = spark.createDataFrame(rows, "ticker string, published timestamp_ntz")
    aligned = sessions.align_forward(news_rows, spark.createDataFrame(own, "ticker string, session_date date"), max_roll_days=3)
    expected = set()
    for t, p in rows:
        effective = p.date() + dt.timedelta(p.hour > 15)
        onward = [dt.date(2021, 1, d) for d in days.get(t, []) if dt.date(2021, 1, d) >= effective]
        status = "no_calendar" if t not in days else "unmapped" if not onward else "stale" if (min(onward) - effective).days > 3 else "same_session" if min(onward) == p.date() else "next_session"
        expected.add((t, p, status, min(onward) if status in ("same_session", "next_session") else None))
    assert {(r.ticker, r.published, r.mapping_status, r.observation_date) for r in aligned.collect()} == expected and aligned.count() == len(rows)
    plan = aligned._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("published" in line and ("LogicalRDD" in line or "LocalRelation" in line) for line in plan) == 1
    none = sessions.align_forward(news_rows, spark.createDataFrame(own, "ticker string, session_date date"), max_roll_days=-1)
    assert none.where("observation_date is not null").count() == 0


def test_alignment_report_counts_every_status(spark):
    rows = spark.createDataFrame([("AAA", "2021-01-05 09:00:00"), ("AAA", None), ("ZZZ", "2021-01-05 09:00:00")], "ticker string, p string")
    aligned = sessions.align_forward(rows.select("ticker", F.col("p").cast("timestamp_ntz").alias("published")), calendar(spark, 5))
    assert sessions.alignment_report(aligned).first().asDict() == {"n_rows": 3, "n_mapped": 1, "n_dropped": 2, "same_session": 1, "next_session": 0, "stale": 0, "unmapped": 0, "invalid": 1, "no_calendar": 1}


def test_repeated_sessions_and_missing_columns_raise(spark):
    twice = spark.createDataFrame([("AAA", "2021-01-04"), ("AAA", "2021-01-04")], "ticker string, time string")
    with pytest.raises(ValueError):
        sessions.trading_sessions(twice)
    with pytest.raises(ValueError):
        sessions.align_forward(twice, calendar(spark, 3))
    with pytest.raises(ValueError):
        sessions.seconds("25:00")


def test_the_future_does_not_change_the_past(spark, tiny):
    own = bars(spark, tiny)
    cut = dt.date(1999, 1, 1)
    after = F.col("session_date") > F.lit(cut)
    tampered = own.withColumns({"close": F.when(after, F.col("close") * 7).otherwise(F.col("close")), "volume": F.when(after, F.col("volume") * 3).otherwise(F.col("volume"))})
    flow = news(spark, tiny)
    columns = ["ticker", "observation_date", "ret_1d", "roll_vol_5", "ma_ratio_5", "sent_pos_minus_neg_ewm", "news_count_roll_sum"]
    past = [panel.assemble(b, flow).where(F.col("observation_date") <= F.lit(cut)).select(*columns) for b in (own, tampered)]
    assert past[0].exceptAll(past[1]).count() == 0 and past[0].count() > 0


def test_targets_and_excess(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, d), c) for d, c in ((2, 100.0), (3, 110.0), (4, 99.0))] + [("B", dt.date(2024, 1, d), c) for d, c in ((2, 100.0), (3, 90.0), (4, 99.0))], "ticker string, observation_date date, close double")
    made = {(r.ticker, r.observation_date.day): r.target_return for r in panel.with_target(rows).collect()}
    assert made["A", 2] == pytest.approx(0.1) and made["A", 3] == pytest.approx(-0.1) and made["A", 4] is None
    excess = {(r.ticker, r.observation_date.day): r.target_return for r in panel.cross_sectional_excess(panel.with_target(rows)).collect()}
    assert excess["A", 2] == pytest.approx(0.1) and excess["B", 3] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        panel.with_target(rows, 0)


def test_ewm_equals_the_recursion(spark):
    values = [math.sin(k) for k in range(30)]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(k), v) for k, v in enumerate(values)], "ticker string, observation_date date, x double")
    found = [r.y for r in panel.ewm(rows, "x", 5, "y").orderBy("observation_date").collect()]
    y = values[0]
    for got, x in zip(found, values):
        y = x if x is values[0] else (1 - 2 / 6) * y + 2 / 6 * x
        assert got == pytest.approx(y)


def test_thresholds_labels_and_scaler(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(10)] + [(None,), (float("nan"),)], "target_return double")
    bounds = panel.fit_thresholds(rows).first()
    assert (bounds.q_low, bounds.q_high) == (pytest.approx(3.0), pytest.approx(6.0))
    labels = [r.target_label for r in panel.label_panel(rows, panel.fit_thresholds(rows)).orderBy("target_return").collect()]
    assert labels.count("DOWN") == 3 and labels.count("UP") == 3 and labels.count("FLAT") == 4 and labels.count(None) == 2
    with pytest.raises(ValueError):
        panel.fit_thresholds(rows, 0.7, 0.3)
    flat = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 9.0)], "a double, b double")
    fit = {r.feature: (r.mean, r.scale) for r in panel.fit_scaler(flat, ["a", "b"]).collect()}
    assert fit == {"a": (2.0, 1.0), "b": (2.0, 1.0)}


def test_usable_rows(spark):
    cases = [(0.2, 0.3, 0.5, True), (0.2, 0.3, 0.501, True), (0.2, 0.3, 0.502, False), (-0.1, 0.6, 0.5, False), (float("nan"), 0.5, 0.5, False), (None, 0.5, 0.5, False)]
    rows = spark.createDataFrame([(*c[:3], "same_session", dt.date(2024, 1, 2), k) for k, c in enumerate(cases)], "prob_negative double, prob_neutral double, prob_positive double, mapping_status string, observation_date date, k int")
    assert {r.k for r in rows.where(panel.usable()).collect()} == {k for k, c in enumerate(cases) if c[3]}


def test_windows_are_ordered_disjoint_and_raise_when_short(spark):
    dates = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(k),) for k in range(50)], "target_date date")
    found = {}
    for r in splits.walk_forward(dates, 3, 5, 4).collect():
        found.setdefault((r.window, r.split), []).append(r.date)
    tests = [set(found[w, "test"]) for w in range(3)]
    for w in range(3):
        assert max(found[w, "train"]) < min(found[w, "val"]) and max(found[w, "val"]) < min(found[w, "test"]) and len(tests[w]) == 5
    assert not (tests[0] & tests[1] or tests[1] & tests[2])
    with pytest.raises(ValueError):
        splits.walk_forward(dates, 12, 5, 4, min_train=10)
    parts = {s: [r.date for r in splits.chronological_split(dates).where(F.col("split") == s).collect()] for s in ("train", "val", "test")}
    assert (len(parts["val"]), len(parts["test"])) == (8, 8) and max(parts["train"]) < min(parts["val"])


def test_a_days_mean_does_not_depend_on_how_news_are_dealt(spark):
    taxes, discounts = [k * 7 % 9 / 100 for k in range(128)], [k * 5 % 11 / 100 for k in range(128)]
    rows = [(t * 5, 1 - t * 5 - d * 5, d * 5, "same_session", "A", dt.date(2024, 1, 2)) for t, d in zip(taxes, discounts)]
    schema = "prob_negative double, prob_neutral double, prob_positive double, mapping_status string, ticker string, observation_date date"
    means = {"sent_prob_negative_mean": [r[0] for r in rows], "sent_prob_neutral_mean": [r[1] for r in rows], "sent_prob_positive_mean": [r[2] for r in rows], "sent_pos_minus_neg": [r[2] - r[0] for r in rows]}
    for given, parts in ((rows, 1), (rows[::-1], 3), (sorted(rows), 7)):
        found = panel.daily_sentiment(spark.createDataFrame(given, schema).repartition(parts)).first()
        assert found.news_count == 128 and {name: found[name] for name in means} == {name: math.fsum(x) / 128 for name, x in means.items()}


def test_doubles_are_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    near = [(2 * k + 1) / (2 * 10**8) for k in range(3_000_000, 3_000_500)]
    values = [0.048046874999999996, 0.037890625, -0.037890625, 1e305, float("inf"), None, *near, *[-math.nextafter(x, 0) for x in near], *[math.nextafter(x, 1) for x in near]]
    expected = duckdb.sql("select list(round(x, 8) + 0.0) from (select unnest($1::double[]) as x)", params=[values]).fetchall()[0][0]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double")
    found = [r.y for r in frame.select("k", (sql_round(F.col("x")) + F.lit(0.0)).alias("y")).orderBy("k").collect()]
    assert found == expected
