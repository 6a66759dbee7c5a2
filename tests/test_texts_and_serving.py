import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import curation, eventlog, quality, serving
from tidemark.streaming import live


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_markup(spark):
    page = "<p>A &amp; B<!-- no --><script>var x = '<b>';</script> &eacute;\n <b>C</b></p>"
    assert one(spark, page, T.clean_html) == "A & B é C"
    assert one(spark, "<p> </p>", T.clean_html) is None and one(spark, None, T.clean_html) is None


def test_article(spark):
    page = '<head><title>t</title><meta property="og:title" content="Head line"></head><div id="vst_detail" itemprop="articleBody">One <br>two<script>no</script> <div>three</div></div><span itemprop="datePublished">2024-01-02T10:00</span><div>after</div>'
    found = spark.createDataFrame([(page,), (None,)], "h string").select(T.parse_article("h").alias("a")).select("a.*").collect()
    assert tuple(found[0]) == ("Head line", "One two three", "2024-01-02T10:00") and tuple(found[1]) == (None, None, None)


def test_links_and_times(spark):
    assert one(spark, "//h/a-12.htm", T.https) == "https://h/a-12.htm" and one(spark, "//h/a-12.htm", T.article_id) == "12"
    assert len(one(spark, "https://h/x", T.article_id)) == 16
    assert [one(spark, u, lambda c: T.allowed(c, ("a.b",))) for u in ("https://a.b/x", "http://a.b/x", "https://a.b.c/x", None)] == [True, False, False, False]
    assert one(spark, "02/01/2024", T.published_at) is None
    assert one(spark, "02/01/2024 10:30", T.published_at) == dt.datetime(2024, 1, 2, 10, 30)
    assert one(spark, "2024-01-02T10:30:00+07:00", T.published_at) == dt.datetime(2024, 1, 2, 10, 30)
    assert one(spark, "2024-01-02T10:30:00Z", T.published_at) == dt.datetime(2024, 1, 2, 17, 30)
    assert one(spark, "02-01-2024 10:30:00+09:00", T.published_at) == dt.datetime(2024, 1, 2, 8, 30)
    assert one(spark, "2024-01-02", T.stored_time) == dt.datetime(2024, 1, 2)
    assert one(spark, "no date at all", T.published_at) is None


def test_cues_are_distinct_and_longest_first(spark):
    assert one(spark, "Thua lỗ, thua lỗ và nợ xấu", lambda c: T.cue_count(c, T.NEGATIVE_CUES)) == 2
    assert one(spark, None, lambda c: T.cue_count(c, T.NEGATIVE_CUES)) == 0


def test_labels_and_truncation(spark):
    assert [one(spark, x, T.label_id) for x in (" negative", "2", "1.0", "1.5", "x", None)] == [0, 2, 1, None, None, None]
    tokens = spark.createDataFrame([(list("abcde"),)], "t array<string>")
    cut = tokens.select(*[T.truncated(F.col("t"), 3, h).alias(h) for h in ("head", "tail", "head_tail")]).first()
    assert ("".join(cut["head"]), "".join(cut["tail"]), "".join(cut["head_tail"])) == ("abc", "cde", "abe")


def test_client_keys(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("2001:db8::1",), ("x",)], "a string").select(T.client_key("a").alias("k")).collect()
    assert [r.k for r in rows] == ["1.2.3.4", "2001:db8::/64", None]


def test_link_join_keeps_each_pair_once(spark):
    links = spark.createDataFrame([("FPT", "u1"), ("FPT", "u1"), ("VNM", "u1"), ("VNM", "u9")], "ticker string, url string")
    contents = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2)], "url string, title string, seq int")
    assert sorted(map(tuple, curation.link_join(links, contents, "seq").select("ticker", "url", "title").collect())) == [("FPT", "u1", "new"), ("VNM", "u1", "new")]


def test_capped_draw_caps_and_refills(spark):
    rows = spark.createDataFrame([("A", f"a{k}") for k in range(50)] + [("B", "b0"), ("C", "c0")], "ticker string, url string")
    drawn = curation.capped_weighted_draw(rows, F.lit(1.0), 9, 1).collect()
    assert len(drawn) == 9 and sum(r.ticker == "A" for r in drawn) == 7
    wide = spark.createDataFrame([(t, f"{t}{k}") for t in "ABCDEF" for k in range(50)], "ticker string, url string")
    counts = curation.capped_weighted_draw(wide, F.lit(1.0), 30, 1).groupBy("ticker").count().collect()
    assert max(r["count"] for r in counts) <= 6


def test_strata_are_disjoint(spark):
    rows = [(f"u{k}", "ABC"[k % 3], int(k % 3 == 0), int(k % 3 == 1), 0.2, 0.3, 0.5) for k in range(60)]
    pool = spark.createDataFrame(rows, "url string, ticker string, negative_cues int, positive_cues int, prob_negative double, prob_neutral double, prob_positive double")
    found = curation.draw_strata(pool, {"eval_random": 10, "train_negative": 5, "train_positive": 5, "train_active": 5}).collect()
    assert len(found) == len({r.url for r in found}) == 25
    with pytest.raises(ValueError):
        curation.draw_strata(pool, {})


def test_bad_prices_raise(spark):
    good = pd.DataFrame({"Time": ["2021-01-04"], "Open": [1.0], "High": [1.0], "Low": [1.0], "Close": [1.0], "Volume": [5]})
    assert quality.normalize_prices(spark.createDataFrame(good), "AAA").first().close == 1.0
    for change in ({"Close": [0.0]}, {"Volume": [0]}, {"Close": [float("nan")]}, {"Time": ["never"]}):
        with pytest.raises(ValueError):
            quality.normalize_prices(spark.createDataFrame(good.assign(**change)), "AAA")
    with pytest.raises(ValueError):
        quality.normalize_prices(spark.createDataFrame(pd.concat([good, good])), "AAA")


def test_issue_once(spark, tmp_path):
    rows = spark.createDataFrame([("A", "UP", "now")], "ticker string, y_pred string, issued_at string")
    path = str(tmp_path / "issued")
    assert serving.issue(rows, path) == "written" and serving.issue(rows.withColumn("issued_at", F.lit("later")), path) == "unchanged"
    with pytest.raises(ValueError):
        serving.issue(rows.withColumn("y_pred", F.lit("DOWN")), path)


def test_resolution_uses_the_issued_thresholds(spark):
    day, target = dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    issued = [("A", day, "FLAT", -0.5, 0.5, dt.datetime(2024, 1, 3, 8, 59)), ("B", day, "UP", None, None, dt.datetime(2024, 1, 3, 9, 0)), ("C", day, "UP", None, None, None)]
    rows = spark.createDataFrame(issued, "ticker string, observation_date date, y_pred string, threshold_low double, threshold_high double, issued_at timestamp_ntz")
    panel = spark.createDataFrame([("A", day, target, 0.2), ("B", day, target, 0.2)], "ticker string, observation_date date, target_date date, target_return double")
    found = {r.ticker: r for r in serving.resolve(rows, panel, spark.createDataFrame([(-0.1, 0.1)], "q_low double, q_high double")).collect()}
    assert (found["A"].y_true, found["A"].correct, found["A"].prospective) == ("FLAT", True, True)
    assert (found["B"].y_true, found["B"].prospective, found["B"].issued_same_session) == ("UP", False, False)
    assert (found["C"].y_true, found["C"].correct, found["C"].prospective) == (None, None, False)


def test_event_lines(spark):
    lines = ['{"id": 1, "ts": "t", "type": "job.status", "key": "a", "data": {"x": 1}}', "not json", '{"id": 2, "type": "other", "key": "b"}', '{"id": 3, "type": "news.ingested"}']
    assert [r.id for r in eventlog.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == [1]


def test_replay(spark):
    log = spark.createDataFrame([(k, f"k{k}") for k in range(5, 9)], "id long, key string")
    kinds = lambda x: [(r.kind, r.id) for r in eventlog.replay(log, x).orderBy("id").collect()]
    assert kinds("6") == [("event", 7), ("event", 8)] and kinds("8") == [] and kinds(None) == [] and len(kinds("4")) == 4
    assert kinds("9") == kinds("3") == kinds("9" * 30) == [("reset:stale_last_event_id", 8)] and kinds("x") == [("reset:invalid_last_event_id", 8)]


def test_the_log_stream_appends_once(spark, tmp_path):
    incoming, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.range(6).select(F.lit(dt.datetime(2024, 1, 1)).alias("ts"), F.lit("job.status").alias("type"), F.concat(F.lit("k"), F.col("id") % 4).alias("key"), F.lit("{}").alias("data"), F.col("id").alias("seq"))
    rows.write.parquet(incoming)
    for checkpoint in ("a", "a", "b"):
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        live.append_stream(stream, log, str(tmp_path / checkpoint), ["seq"]).awaitTermination()
    assert sorted((r.id, r.key) for r in live.stored_log(spark, log).collect()) == [(1, "k0"), (2, "k1"), (3, "k2"), (4, "k3")]


def test_the_limiter_stream_equals_the_batch_fold(spark, tiny, tmp_path):
    requests = spark.read.parquet(f"{tiny}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    requests.write.parquet(str(tmp_path / "in"))
    out = live.limited(spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in")), 2, 7200.0)
    query = out.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {r.event_id: round(r.retry_after, 3) for r in spark.table("limited").collect()}
    folded = {r.event_id: round(r.retry_after, 3) for r in eventlog.token_bucket(requests, 2, 7200.0).collect()}
    assert streamed == folded and any(folded.values())


def test_news_that_are_shown_are_chosen_before_joins(spark, tiny):
    from tidemark.plans.panel import aligned, bars
    from tidemark.plans.runs import titles
    from tidemark.plans.serving import shown_news

    day, own, every = F.lit("1998-02-01").cast("date"), bars(spark, tiny), aligned(spark, tiny)
    few = shown_news(spark, tiny, day)
    rows = lambda found: sorted(map(str, found.collect()))
    last = serving.last_sessions(own, day).select("ticker", F.col("session_date").alias("observation_date"))
    wanted = [x.join(last, ["ticker", "observation_date"], "left_semi") for x in (every, few)]
    assert rows(wanted[0]) == rows(wanted[1]) != []
    assert few.count() * 4 < every.count()
    # titles are looked up for what is shown
    latest = own.groupBy("ticker").agg(F.max("session_date").alias("observation_date")).select("*", F.lit("UP").alias("y_pred"), *[F.lit(p).alias(n) for p, n in zip((0.2, 0.3, 0.5), serving.PROBABILITIES, strict=True)], *[F.lit(None).cast("double").alias(n) for n in ("threshold_low", "threshold_high")])
    bounds, named = spark.createDataFrame([(-0.1, 0.1)], "q_low double, q_high double"), titles(spark, tiny)
    before = serving.today(latest, own, every.join(named, "url", "left"), own, bounds)
    after = serving.today(latest, own, every, own, bounds, named)
    assert rows(before) == rows(after)
    assert any(n["title"] for r in after.collect() for n in r["news"] or [])
