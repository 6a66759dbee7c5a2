"""Queries over experiment records, the serving cycle, label files and stored times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.draws import key_hash, sql_hash
from tidemark.functions.text import published_at, reader_label
from tidemark.operators import arms, curation, evaluation, eventlog, runs, serving, sessions, splits
from tidemark.plans.catalog import Catalog
from tidemark.plans.evaluation import DELTAS, DRAWS, METRICS, SCORES, TO_PREDICTIONS, cells, drawn_sql, metric_sql, predictions, sql_weights
from tidemark.plans.panel import ALIGNED, fitted, full_panel
from tidemark.plans.serving import TO_ISSUED, issued, shown_news
from tidemark.plans.texts import ARTICLES, LABELLED, POOL, articles, labelled, pool
from tidemark.sources.derived import BARS, NEWS, bars, inputs, news, read
from tidemark.sources.files import synthetic_prices as made_prices
from tidemark.sources.staging import once

CATALOG = Catalog()
query = CATALOG.query
METRIC = METRICS.split()

# --- times in the study's zone ------------------------------------------------

STAMPS = """stamps AS (
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+07:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M')
                     WHEN 3 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d-%m-%Y %H:%M:%S+02:00') END AS stamp FROM events)"""


def stamps(spark, d):
    ts, k = F.col("ts"), F.col("event_id") % 5
    form = lambda f: F.date_format(ts, f)
    stamp = (
        F.when(k == 0, form("yyyy-MM-dd'T'HH:mm:ss'+07:00'")).when(k == 1, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, form("dd/MM/yyyy HH:mm")).when(k == 3, form("yyyy-MM-dd")).otherwise(form("dd-MM-yyyy HH:mm:ss'+02:00'"))
    )
    return read(spark, d, "events").select("event_id", stamp.alias("stamp"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strptime(stamp[1:19], '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strptime(stamp[1:19], '%Y-%m-%dT%H:%M:%S') + INTERVAL 7 HOUR WHEN 2 THEN strptime(stamp, '%d/%m/%Y %H:%M')
                     WHEN 4 THEN strptime(stamp[1:19], '%d-%m-%Y %H:%M:%S') + INTERVAL 5 HOUR END AS published FROM stamps""",
    (STAMPS,),
)
def published_times(spark, d):
    """Stored texts with offsets, without and without a time, as wall time in the study's zone."""
    return stamps(spark, d).select("event_id", published_at(F.col("stamp")).alias("published"))


GOLDEN = [
    ("FPT", "2021-01-05T14:00:00+07:00"),
    ("FPT", "2021-01-05T16:00:00+07:00"),
    ("FPT", "2021-01-05T08:00:00Z"),
    ("FPT", "2021-01-05T08:00:01Z"),
    ("FPT", "2021-01-09T10:00:00+07:00"),
    ("FPT", "2019-01-01T09:00:00+07:00"),
    ("FPT", "2021-02-01T09:00:00+07:00"),
    ("FPT", "not a time"),
    ("ZZZ", "2021-01-05T14:00:00+07:00"),
]


@query(
    f"""SELECT ticker, stamp, CASE WHEN moment IS NULL THEN 'invalid' WHEN ticker <> 'FPT' THEN 'no_calendar' WHEN session IS NULL THEN 'unmapped' WHEN session - effective > 12 THEN 'stale' WHEN session = CAST(moment AS DATE) THEN 'same_session' ELSE 'next_session' END AS mapping_status,
               CASE WHEN moment IS NOT NULL AND ticker = 'FPT' AND session - effective <= 12 THEN session END AS observation_date FROM (
            SELECT *, (SELECT min(DATE '2021-01-04' + k + 2 * (k // 5)) FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS k) WHERE DATE '2021-01-04' + k + 2 * (k // 5) >= effective) AS session FROM (
                SELECT *, CAST(moment AS DATE) + CASE WHEN hour(moment) * 3600 + minute(moment) * 60 + floor(second(moment)) > 54000 THEN 1 ELSE 0 END AS effective FROM (
                    SELECT ticker, stamp, CASE WHEN stamp LIKE '%Z' THEN try_strptime(stamp[1:19], '%Y-%m-%dT%H:%M:%S') + INTERVAL 7 HOUR ELSE try_strptime(stamp[1:19], '%Y-%m-%dT%H:%M:%S') END AS moment FROM (VALUES {', '.join(map(str, GOLDEN))}) AS v(ticker, stamp))))""",
)
def golden_alignment(spark, d):
    """Texts with offsets against ten weekdays from a Monday on: every status but one side of the cutoff more."""
    k = F.col("id").cast("int")
    days = spark.range(10).select(F.lit("FPT").alias("ticker"), F.date_add(F.lit("2021-01-04").cast("date"), (k + 2 * F.floor(k / 5)).cast("int")).alias("session_date"))
    rows = spark.createDataFrame(GOLDEN, "ticker string, stamp string").withColumn("published", published_at(F.col("stamp")))
    return sessions.align_forward(rows, days).select("ticker", "stamp", "mapping_status", "observation_date")


# --- records of runs ----------------------------------------------------------

STRATA = f"""strata AS (SELECT window, arm, seed, stratum, c00 + c01 + c02 + c10 + c11 + c12 + c20 + c21 + c22 AS n, {metric_sql()['macro_f1']} AS macro_f1 FROM (
    SELECT window, arm, seed, stratum, {cells()} FROM (SELECT *, CASE WHEN has_news = 1 THEN 'has_news' ELSE 'no_news' END AS stratum FROM predictions) GROUP BY ALL))"""


def scores(spark, d):
    return evaluation.scores(predictions(spark, d), "window", "arm", "seed")


@query(
    """SELECT arm, window, CAST(coalesce(sum(CASE WHEN stratum = 'has_news' THEN n END), 0) AS BIGINT) AS n_news, CAST(coalesce(sum(CASE WHEN stratum = 'no_news' THEN n END), 0) AS BIGINT) AS n_no_news, avg(CASE WHEN stratum = 'has_news' THEN macro_f1 END) AS mean_news,
              avg(CASE WHEN stratum = 'no_news' THEN macro_f1 END) AS mean_no_news, avg(CASE WHEN stratum = 'has_news' THEN macro_f1 END) - avg(CASE WHEN stratum = 'no_news' THEN macro_f1 END) AS delta FROM strata GROUP BY ALL""",
    (*TO_PREDICTIONS, STRATA),
    "mean_news mean_no_news delta",
)
def client_windows(spark, d):
    return runs.client_windows(evaluation.stratified_scores(predictions(spark, d), "window", "arm", "seed"))


@query(f"SELECT {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std' for m in METRIC)}, count(*) AS folds FROM scores WHERE arm = 'price'", (*TO_PREDICTIONS, SCORES), " ".join(f"{m}_mean {m}_std" for m in METRIC))
def fold_summary(spark, d):
    return runs.fold_summary(scores(spark, d).where("arm = 'price'"), *METRIC)


@query(
    f"SELECT concat('W', window + 1) AS window, {', '.join(f'max(CASE WHEN arm = {chr(39)}price_sentiment{chr(39)} THEN {m} END) - max(CASE WHEN arm = {chr(39)}neutral{chr(39)} THEN {m} END) AS {m}' for m in METRIC)} FROM (SELECT window, arm, {', '.join(f'avg({m}) AS {m}' for m in METRIC)} FROM scores GROUP BY ALL) GROUP BY window",
    (*TO_PREDICTIONS, SCORES),
    METRICS,
)
def gain_lines(spark, d):
    gains = evaluation.information_gain(scores(spark, d), "price", "neutral", "price_sentiment")
    arrays = gains.groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "gain"))), lambda x: x["gain"]).alias("per_window"))
    return runs.window_lines(arrays)


@query(
    """SELECT arm, avg(macro_f1) AS mean, stddev_pop(macro_f1) AS std, count(*) AS n_runs, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM scores GROUP BY arm
       UNION ALL SELECT 'DELTA price_sentiment__minus__price', (SELECT avg(delta) FROM deltas), (SELECT stddev_pop(delta) FROM deltas), (SELECT count(*) FROM deltas), quantile_cont(value, 0.025), quantile_cont(value, 0.975)
       FROM (SELECT draw, sum(delta * weight) / sum(weight) AS value FROM weights JOIN deltas USING (window) GROUP BY draw)""",
    (*TO_PREDICTIONS, SCORES, DELTAS, sql_weights("deltas", "window", 7)),
    "mean std low high",
)
def ladder_table(spark, d):
    return runs.ladder_table(scores(spark, d), [("price_sentiment", "price")], DRAWS, 7)


EFFECTS = {"information_gain": ("price_sentiment", "neutral"), "architecture": ("neutral", "price"), "naive": ("price_sentiment", "price")}


@query(
    " UNION ALL ".join(
        f"""SELECT metric, '{name}' AS effect, mean, low, high, p_le_zero FROM (WITH {drawn_sql(*pair)} SELECT metric, quantile_cont(CASE WHEN draw >= 0 THEN value END, 0.025) AS low, quantile_cont(CASE WHEN draw >= 0 THEN value END, 0.975) AS high,
            avg(CASE WHEN draw >= 0 THEN CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END END) AS p_le_zero, max(CASE WHEN draw = -1 THEN value END) AS mean FROM long GROUP BY metric)"""
        for name, pair in EFFECTS.items()
    ),
    TO_PREDICTIONS,
    "mean low high p_le_zero",
)
def compare_runs(spark, d):
    """The run with news against its control: the same price arm, the treated arm on neutral news."""
    every = predictions(spark, d)
    real = every.where("arm in ('price', 'price_sentiment')")
    control = every.where("arm in ('price', 'neutral')").withColumn("arm", F.when(F.col("arm") == "neutral", "price_sentiment").otherwise(F.col("arm")))
    return runs.compare_runs(real, control, "price", "price_sentiment", DRAWS, 7)


@query()
def gain_report(spark, d):
    """What news are worth by window and over all, with intervals from drawn windows and from drawn dates."""
    every = predictions(spark, d)
    real = every.where("arm in ('price', 'price_sentiment')")
    control = every.where("arm in ('price', 'neutral')").withColumn("arm", F.when(F.col("arm") == "neutral", "price_sentiment").otherwise(F.col("arm")))
    return runs.gain_report(real, control, "price", "price_sentiment", DRAWS, 7)


CASES = [(c, f, s, e) for c in ("2024-05-01", "2024-07-01", None) for f in ("2024-06-01", None) for s in ("x", None) for e in ("x", "y", None)]
CASE_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in c) + ")" for c in CASES)


@query(
    f"""SELECT cutoff, first_date, sha, expected, coalesce(sha = expected AND cutoff <= first_date, false) AS point_in_time,
               CASE WHEN sha IS NULL THEN 'manifest_missing' WHEN expected IS NULL THEN 'hash_missing' WHEN sha <> expected THEN 'hash_mismatch' WHEN cutoff IS NULL THEN 'no_label_cutoff' WHEN first_date IS NULL THEN 'no_test_window'
                    WHEN cutoff > first_date THEN 'cutoff_after_test_start' ELSE 'verified' END AS reason FROM (VALUES {CASE_SQL}) AS v(cutoff, first_date, sha, expected)"""
)
def point_in_time_verdict(spark, d):
    rows = spark.createDataFrame(CASES, "cutoff string, first_date string, sha string, expected string")
    return rows.select("*", *runs.verdict(F.to_date("cutoff"), F.to_date("first_date"), F.col("sha"), F.col("expected")))


@query(
    "SELECT sha256(string_agg(h, '' ORDER BY ticker, session_date)) AS digest, count(*) AS n_rows FROM (SELECT ticker, session_date, sha256(concat_ws(chr(31), ticker, CAST(session_date AS VARCHAR), CAST(volume AS VARCHAR))) AS h FROM bars)",
    (BARS,),
)
def ordered_digest(spark, d):
    return runs.ordered_digest(bars(spark, d), ["ticker", "session_date"], ["ticker", "session_date", "volume"])


# --- serving ------------------------------------------------------------------

TITLED = "titles AS (SELECT concat('n-', l_orderkey, '-', l_linenumber) AS url, concat('item ', min(l_partkey)) AS title FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)"


def titles(spark, d):
    """Stored titles: every other line item has one."""
    items = read(spark, d, "lineitem").where("l_linenumber % 2 = 1").groupBy(F.concat_ws("-", F.lit("n"), "l_orderkey", "l_linenumber").alias("url"))
    return items.agg(F.concat(F.lit("item "), F.min("l_partkey")).alias("title"))


@query("SELECT ticker, url, title, CASE WHEN prob_positive >= prob_negative AND prob_positive >= prob_neutral THEN 'POSITIVE' WHEN prob_negative >= prob_neutral THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM news LEFT JOIN titles USING (url)", (NEWS, TITLED))
def titled_news(spark, d):
    """Scored news with their titles, if stored, and the class that a reader is shown."""
    return news(spark, d).join(titles(spark, d), "url", "left").select("ticker", "url", "title", reader_label().alias("label"))


LATEST = "latest AS (SELECT * FROM issued QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY observation_date DESC) = 1)"


@query(
    """SELECT i.ticker, i.observation_date, y_pred, greatest(prob_down, prob_flat, prob_up) AS confidence, close AS last_close, round_even(close * (1 + q_low), 2) AS band_low, round_even(close * (1 + q_high), 2) AS band_high,
              i.observation_date < (SELECT max(observation_date) FROM latest) AS stale, CAST(coalesce(n_news, 0) AS INTEGER) AS n_news, shown
       FROM latest i JOIN (SELECT ticker AS t, session_date, close FROM bars) b ON i.ticker = t AND i.observation_date = session_date LEFT JOIN (
           SELECT ticker, count(*) AS n_news, string_agg(concat_ws('|', url, title, CASE WHEN prob_positive >= prob_negative AND prob_positive >= prob_neutral THEN 'POSITIVE' WHEN prob_negative >= prob_neutral THEN 'NEGATIVE' ELSE 'NEUTRAL' END), ';' ORDER BY place) AS shown FROM (
               SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY greatest(prob_negative, prob_positive) DESC, url) AS place FROM aligned LEFT JOIN titles USING (url)
               WHERE (ticker, observation_date) IN (SELECT (ticker, session_date) FROM (SELECT ticker, session_date, row_number() OVER (PARTITION BY ticker ORDER BY session_date DESC) AS r FROM bars WHERE session_date <= (SELECT max(observation_date) FROM latest)) WHERE r <= 5)) WHERE place <= 5 GROUP BY ticker) n USING (ticker)""",
    (*TO_ISSUED, LATEST, TITLED),
    "confidence last_close band_low band_high",
    places=6,
)
def today(spark, d):
    """The reader's view of the latest forecasts: closes, bands, titles and labels in one answer."""
    latest = curation.keep_first(issued(spark, d), ["ticker"], F.desc("observation_date"))
    own = bars(spark, d)
    newest = latest.agg(F.max("observation_date")).first()[0]
    shown = serving.today(latest, own, shown_news(spark, d, F.lit(newest)), own, fitted(spark, d), titles(spark, d))
    line = F.transform("news", lambda n: F.concat_ws("|", n["url"], n["title"], n["label"]))
    return shown.withColumn("shown", F.array_join(line, ";")).drop("news")


@query()
def refit_and_predict(spark, d):
    """An arm fitted on all dates but the last, frozen, read back, and its forecast of the latest sessions."""
    from tidemark.sources.staging import shared_dir

    path = f"{shared_dir(spark)}/arm-{spark.sparkContext.applicationId}"
    arms.refit(full_panel(spark, d), ["ret_1d", "roll_vol_5", "ma_ratio_5"], 60, path)
    return arms.predict_latest(full_panel(spark, d), path).select("arm", "ticker", "observation_date", "y_pred", *serving.PROBABILITIES)


@query(
    """SELECT id, key, type FROM (SELECT *, (SELECT coalesce(max(id), 0) FROM logged) + row_number() OVER (ORDER BY stage, moment, arm, key) AS id FROM (
           SELECT concat('s', event_id) AS key, 'signal.issued' AS type, 0 AS stage, CAST(CAST(ts AS DATE) AS VARCHAR) AS moment, event_type AS arm FROM events WHERE event_id % 3 = 0
           UNION ALL SELECT concat('b', event_id), 'news.ingested', 1, CAST(CAST(ts AS DATE) AS VARCHAR), NULL FROM events WHERE event_id % 3 = 1
           UNION ALL SELECT concat('j', event_id), 'job.status', 2, CAST(CAST(ts AS DATE) AS VARCHAR), NULL FROM events WHERE event_id % 3 = 2) WHERE key NOT IN (SELECT key FROM logged))""",
    ("logged AS (SELECT event_id + 1 AS id, concat(['s', 'b', 'j'][1 + event_id % 3], event_id) AS key FROM events WHERE event_id % 7 < 5)",),
)
def reconcile(spark, d):
    """Artifacts of three kinds against a log that lacks two sevenths of them."""
    events = read(spark, d, "events").withColumn("at", F.to_date("ts"))
    kind = F.element_at(F.array(*map(F.lit, "sbj")), (F.col("event_id") % 3 + 1).cast("int"))
    keyed = events.withColumn("key", F.concat(kind, "event_id"))
    log = keyed.where("event_id % 7 < 5").select((F.col("event_id") + 1).alias("id"), "key")
    of = lambda k: keyed.where(F.col("event_id") % 3 == k)
    return eventlog.reconcile(log, of(0).select("key", F.col("at").alias("observation_date"), F.col("event_type").alias("arm")), of(1), of(2))


# --- label files --------------------------------------------------------------

STRATED = f"strated AS (SELECT doc_id, label, CASE {sql_hash(repr('stratum'), 'doc_id')} % 4 WHEN 0 THEN 'train_negative' WHEN 1 THEN NULL ELSE 'eval_random' END AS stratum FROM labelled)"


def strated(spark, d):
    k = key_hash("stratum", F.col("doc_id")) % 4
    return labelled(spark, d).withColumn("stratum", F.when(k == 0, "train_negative").when(k > 1, "eval_random"))


FOLDED = f"folded AS (SELECT *, CASE WHEN stratum IS NULL OR stratum = 'eval_random' THEN (row_number() OVER (PARTITION BY label, stratum IS NULL OR stratum = 'eval_random' ORDER BY {sql_hash(repr('42'), 'doc_id')}, doc_id) - 1) % 3 END AS fold FROM strated)"


@query("SELECT doc_id, label, fold FROM folded", (LABELLED, STRATED, FOLDED))
def stratum_folds(spark, d):
    return splits.stratum_folds(strated(spark, d), 3, "label", "doc_id", ("eval_random",)).select("doc_id", "label", F.col("fold").cast("long").alias("fold"))


@query(
    f"""SELECT doc_id, CASE WHEN fold = 0 THEN 'test' WHEN pool AND r < round_even(count(*) OVER (PARTITION BY pool, label) * (want / pooled), 0) THEN 'val' ELSE 'train' END AS split FROM (
        SELECT *, row_number() OVER (PARTITION BY pool, label ORDER BY {sql_hash(repr('inner'), repr('42'), 'doc_id')}, doc_id) - 1 AS r FROM (
            SELECT *, coalesce(fold <> 0, false) AS pool, (SELECT ceil(count(*) * 0.1::DOUBLE) FROM folded WHERE fold IS DISTINCT FROM 0) AS want, (SELECT count(*) FROM folded WHERE fold <> 0) AS pooled FROM folded))""",
    (LABELLED, STRATED, FOLDED),
)
def inner_validation(spark, d):
    folded = splits.stratum_folds(strated(spark, d), 3, "label", "doc_id", ("eval_random",))
    return splits.inner_validation(folded, 0, "label", "doc_id").select("doc_id", "split")


@query(
    """SELECT doc_id, CASE WHEN r > n - greatest(1, round_even(n * 0.1, 0)) THEN 'test' WHEN r > n - greatest(1, round_even(n * 0.1, 0)) - greatest(1, round_even(n * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM (
           SELECT doc_id, dense_rank() OVER (ORDER BY day) AS r, n FROM (SELECT doc_id, CAST(TIMESTAMP '2024-01-01 20:00:00' + to_days(CAST(doc_id % 90 AS INTEGER)) + INTERVAL 7 HOUR AS DATE) AS day FROM documents), (SELECT least(90, count(DISTINCT doc_id % 90)) AS n FROM documents))"""
)
def text_split(spark, d):
    """Texts split by the local day of stored instants, which is a day later than their UTC day."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd'T20:00:00Z'")
    return splits.text_split(read(spark, d, "documents").select("doc_id", day.alias("published_at"))).select("doc_id", "split")


@query(
    """SELECT doc_id FROM (SELECT doc_id, nullif(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(trim(body, ' '), '')), '') AS x FROM articles) WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id) = 1""",
    (ARTICLES,),
)
def dedup_by_input(spark, d):
    return curation.dedup_by_input(articles(spark, d), "title_context", "doc_id").select("doc_id")


@query(
    """SELECT sha256(concat_ws('|', ticker, url)) AS sample_id, ticker, title, substr(trim(coalesce(body, ''), ' '), 1, 500) AS body_preview, url, '' AS label FROM pool0""",
    (ARTICLES, POOL),
)
def label_template(spark, d):
    return curation.label_template(pool(spark, d)).select("sample_id", "ticker", "title", "body_preview", "url", "label")


@query(
    f"""SELECT 'eval_random' AS stratum, 'eval' AS usage, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, CAST(42 AS INTEGER) AS seed, sha256(string_agg(url, chr(10) ORDER BY url)) AS links_sha256
        FROM (SELECT * FROM pool0 ORDER BY {sql_hash(repr('uniform'), repr('42'), 'url')}, url LIMIT 50)""",
    (ARTICLES, POOL),
)
def sampling_manifest(spark, d):
    return curation.sampling_manifest(curation.draw_strata(pool(spark, d), {"eval_random": 50}), 42)


FINAL = "final AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE label END AS label, CASE WHEN doc_id % 4 = 0 THEN 'NEUTRAL' ELSE label END AS prelabel FROM labelled)"


def preliminary(spark, d):
    k = F.col("doc_id")
    return labelled(spark, d).select("doc_id", F.when(k % 5 == 0, "?").otherwise(F.col("label")).alias("label"), F.when(k % 4 == 0, "NEUTRAL").otherwise(F.col("label")).alias("prelabel"))


@query(
    """SELECT count(*) AS n_rows, count_if(label <> '?') AS finalized, count_if(label = '?') AS left_preliminary, count_if(label <> '?' AND prelabel <> label) AS changed_from_prelabel,
              count_if(label = 'NEGATIVE') AS n_negative, count_if(label = 'NEUTRAL') AS n_neutral, count_if(label = 'POSITIVE') AS n_positive FROM final""",
    (LABELLED, FINAL),
)
def finalize_report(spark, d):
    return curation.finalize_report(preliminary(spark, d))


@query("SELECT doc_id, CASE WHEN label = '?' THEN 'PRELIMINARY_REVIEW_REQUIRED' ELSE 'REVIEWED' END AS annotation_status, CASE WHEN label = '?' THEN 'assistant_prelabel' ELSE 'human_reviewed' END AS annotation_source FROM final", (LABELLED, FINAL))
def finalize_labels(spark, d):
    rows = preliminary(spark, d).withColumns({c: F.lit(v) for c, v in curation.PRELIMINARY.items()})
    return curation.finalize_labels(rows).select("doc_id", "annotation_status", "annotation_source")


@query("SELECT trim(text, ' ') AS text, min(CASE quality WHEN 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END) AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1")
def seed_texts(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").where("quality is not null")
    return curation.seed_texts(rows.select("text", F.col("quality").alias("code")), {0: "NEGATIVE", 1: "POSITIVE"})


@query("SELECT count(*) AS n_rows, count_if(doc_id % 3 <> 0) AS with_time, count_if(length(trim(coalesce(body, ''), ' ')) > 0) AS with_body, count_if(doc_id % 5 = 0) AS failed FROM articles", (ARTICLES,))
def article_coverage(spark, d):
    k = F.col("doc_id")
    return runs.article_coverage(articles(spark, d).withColumns({"published_at": F.when(k % 3 != 0, "2024"), "parse_failed": k % 5 == 0}))


@query(
    "SELECT 'SYN' AS ticker, DATE '2020-01-01' + CAST(k + 2 * ((k + 2) // 5) AS INTEGER) AS session_date, 99.5 + k * 0.05 + 5 * sin(k / 7.0) AS open, 101 + k * 0.05 + 5 * sin(k / 7.0) AS high, 99 + k * 0.05 + 5 * sin(k / 7.0) AS low, 100 + k * 0.05 + 5 * sin(k / 7.0) AS close, CAST(1000 + k % 17 * 10 AS DOUBLE) AS volume FROM (SELECT unnest(range(260)) AS k)",
    (),
    "open high low close volume",
)
def synthetic_prices(spark, d):
    return made_prices(spark, 260)
