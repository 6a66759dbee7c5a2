"""Queries over texts: markup, links, dedup, labels and drawing for annotation.

Articles are documents: the first line is the title, the rest the body; tickers go by the id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.draws import draw, sql_hash, sql_uniform, uniform
from tidemark.operators import curation, evaluation, quality, splits, textcv
from tidemark.operators.eventlog import fetch_queue as fetch_queue_of
from tidemark.plans.catalog import Catalog
from tidemark.plans.panel import NEWS
from tidemark.sources.derived import BARS, bars, news, read
from tidemark.sources.staging import staged

CATALOG = Catalog()
query = CATALOG.query

#: Cues of the four languages of the documents: the mechanics are those of the news cues.
NEGATIVE = ("the", "der", "las", "pour", "idiot", "stupid")
POSITIVE = ("and", "und", "que", "une", "with")
TICKERS = ("AAA", "BBB", "CCC", "DDD")
#: Two documents in a row of six share each link, so links repeat at every size of the table.
HOSTS = ("//www.vietstock.vn/a-", "http://finance.vietstock.vn/a-", "//host.example/a-")
ARTICLES = """articles AS (
    SELECT doc_id, ['AAA', 'BBB', 'CCC', 'DDD'][1 + doc_id % 4] AS ticker, concat(CASE doc_id % 3 WHEN 0 THEN '//www.vietstock.vn/a-' WHEN 1 THEN 'http://finance.vietstock.vn/a-' ELSE '//host.example/a-' END, doc_id // 6, '.htm') AS url, split_part(text, chr(10), 1) AS title,
           nullif(trim(substr(text, length(split_part(text, chr(10), 1)) + 2), ' '), '') AS body
    FROM documents)"""
CUES = f"""cues AS (
    SELECT *, len(list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '{T.cue_pattern(NEGATIVE)}'))) AS negative_cues,
           len(list_distinct(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(body, ''))), '{T.cue_pattern(POSITIVE)}'))) AS positive_cues FROM pool0)"""
POOL = f"""pool_url AS (SELECT *, lower(trim(coalesce(title, ''), ' ')) AS tk, substr(lower(trim(coalesce(body, ''), ' ')), 1, 400) AS bk FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY ticker, doc_id) = 1),
pool_title AS (SELECT * FROM pool_url WHERE tk <> '' QUALIFY row_number() OVER (PARTITION BY tk ORDER BY url) = 1),
pool0 AS (SELECT doc_id, ticker, url, title, body FROM pool_title WHERE bk <> '' QUALIFY row_number() OVER (PARTITION BY bk ORDER BY url) = 1),
{CUES}"""
LABELLED = """labelled AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'NEGATIVE' ELSE CASE quality WHEN 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END END AS label FROM labels)"""


def articles(spark, d):
    title = F.substring_index("text", "\n", 1)
    return read(spark, d, "documents").select(
        "doc_id",
        F.element_at(F.array(*map(F.lit, TICKERS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("ticker"),
        F.concat(F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("doc_id") % 3 + 1).cast("int")), F.expr("doc_id div 6"), F.lit(".htm")).alias("url"),
        title.alias("title"),
        T.blank_to_null(F.trim(F.substring(F.col("text"), F.length(title) + 2, F.length("text")))).alias("body"),
    )


def pool(spark, d):
    rows = curation.keep_first(articles(spark, d), ["url"], "ticker", "doc_id")
    found = curation.candidate_pool(rows)
    shown = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return found.withColumns({"negative_cues": T.cue_count(shown, NEGATIVE), "positive_cues": T.cue_count(shown, POSITIVE)}).select("doc_id", "ticker", "url", "title", "body", "negative_cues", "positive_cues")


def labelled(spark, d):
    label = F.when(F.col("toxic") == 1, "NEGATIVE").when(F.col("quality") == 1, "POSITIVE").otherwise("NEUTRAL")
    return read(spark, d, "labels").select("doc_id", label.alias("label"))


@query(
    r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '') AS text FROM pages"""
)
def clean_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.clean_html(F.col("html"), all_entities=False).alias("text"))


@query()
def parse_article(spark, d):
    return read(spark, d, "pages").withColumn("a", T.parse_article("html")).select("page_id", "a.title", "a.body", "a.published")


@query()
def listing_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.inline_outer(T.listing_links("html")))


@query("SELECT doc_id, regexp_replace(url, '^(http:)?//', 'https://') AS url, coalesce(nullif(regexp_extract(url, '-(\\d+)\\.htm', 1), ''), substr(sha256(url), 1, 16)) AS article_id, regexp_matches(url, '^(http:)?//(www.|finance.)?vietstock.vn/') AS allowed FROM articles", (ARTICLES,))
def link_normalization(spark, d):
    own = articles(spark, d)
    return own.select("doc_id", T.https(F.col("url")).alias("url"), T.article_id(F.col("url")).alias("article_id"), T.allowed(T.https(F.col("url"))).alias("allowed"))


@query(
    """SELECT doc_id, coalesce(nullif(trim(title, ' '), ''), nullif(trim(body, ' '), '')) AS as_title, coalesce(nullif(trim(substr(nullif(trim(body, ' '), ''), 1, 50), ' '), ''), nullif(trim(title, ' '), '')) AS as_context,
              nullif(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(trim(body, ' '), '')), '') AS as_both, length(trim(coalesce(body, ''), ' ')) > 0 AS has_body FROM articles""",
    (ARTICLES,),
)
def input_text(spark, d):
    own = articles(spark, d)
    return own.select("doc_id", T.input_text("title").alias("as_title"), T.input_text("context", context_chars=50).alias("as_context"), T.input_text("title_context").alias("as_both"), T.has_body(F.col("body")).alias("has_body"))


@query("SELECT doc_id, CAST(CASE WHEN quality IN (0, 1) THEN quality END AS INTEGER) AS label_id, CAST(CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS named_id FROM labels")
def normalize_labels(spark, d):
    rows = read(spark, d, "labels").join(labelled(spark, d), "doc_id")
    return rows.select("doc_id", T.label_id(F.col("quality")).alias("label_id"), T.label_id(F.lower(F.concat(F.lit(" "), "label"))).alias("named_id"))


@query("SELECT doc_id, negative_cues, positive_cues FROM cues", (ARTICLES, POOL))
def cue_counts(spark, d):
    return pool(spark, d).select("doc_id", "negative_cues", "positive_cues")


LEXICON = f"""lexicon AS (SELECT doc_id, lower(concat_ws(' ', title, list_extract({[*T.NEGATIVE_CUES]!r}, 1 + doc_id % {len(T.NEGATIVE_CUES)}), list_extract({[*T.NEGATIVE_CUES]!r}, 1 + doc_id * 7 % {len(T.NEGATIVE_CUES)}), list_extract({[*T.POSITIVE_CUES]!r}, 1 + doc_id % {len(T.POSITIVE_CUES)}))) AS shown FROM articles)"""


@query(
    f"""SELECT doc_id, len(list_distinct(regexp_extract_all(shown, '{T.cue_pattern(T.NEGATIVE_CUES)}'))) AS negative_cues, len(list_distinct(regexp_extract_all(shown, '{T.cue_pattern(T.POSITIVE_CUES)}'))) AS positive_cues FROM lexicon""",
    (ARTICLES, LEXICON),
)
def lexicon_cues(spark, d):
    """The news lexicon on titles that had cues of it put in."""
    k, pick = F.col("doc_id"), lambda cues, at: F.element_at(F.array(*map(F.lit, cues)), (at % len(cues) + 1).cast("int"))
    shown = F.concat_ws(" ", "title", pick(T.NEGATIVE_CUES, k), pick(T.NEGATIVE_CUES, k * 7), pick(T.POSITIVE_CUES, k))
    return articles(spark, d).select("doc_id", T.cue_count(shown, T.NEGATIVE_CUES).alias("negative_cues"), T.cue_count(shown, T.POSITIVE_CUES).alias("positive_cues"))


@query("SELECT doc_id, ticker, url, title FROM pool0", (ARTICLES, POOL))
def candidate_pool(spark, d):
    return pool(spark, d).select("doc_id", "ticker", "url", "title")


@query(f"SELECT doc_id FROM pool0 ORDER BY {sql_hash(repr('uniform'), repr('42'), 'url')}, url LIMIT 100", (ARTICLES, POOL))
def uniform_draw(spark, d):
    return curation.uniform_draw(pool(spark, d), 100, 42).select("doc_id")


WEIGHTED = f"""keyed AS (
    SELECT *, -ln({sql_uniform("'weighted'", "'42'", "url")}) / greatest((negative_cues + 1.0) / (1.0 + positive_cues), 1e-9) AS k FROM {{rows}} WHERE negative_cues > 0),
drawn AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k, url) AS r, greatest(1, ceil(60 * 0.2::DOUBLE), ceil(60 / (SELECT count(DISTINCT ticker) FROM keyed))) AS cap FROM keyed) ORDER BY r > cap, k, url LIMIT 60)"""


def stratum_sql(name, rows, eligible, weight, quota):
    return f"""keyed_{name} AS (SELECT *, -ln({sql_uniform("'weighted'", "'42'", "url")}) / greatest({weight}, 1e-9) AS k FROM {rows} WHERE {eligible}),
drawn_{name} AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k, url) AS r, greatest(1, ceil({quota} * 0.2::DOUBLE), ceil({quota} / (SELECT count(DISTINCT ticker) FROM keyed_{name}))) AS cap FROM keyed_{name}) ORDER BY r > cap, k, url LIMIT {quota})"""


PRIORS = ("prior-a", "prior-b", "prior-c")
PRIOR_SQL = [f"({sql_uniform(repr(p), 'url')} / ({' + '.join(sql_uniform(repr(x), 'url') for x in PRIORS)}))" for p in PRIORS]


def prior_columns():
    own = [uniform(p, F.col("url")) for p in PRIORS]
    total = own[0] + own[1] + own[2]
    return [u / total for u in own]


@query("SELECT doc_id, ticker FROM drawn", (ARTICLES, POOL, WEIGHTED.format(rows="cues")))
def capped_weighted_draw(spark, d):
    rows = pool(spark, d).where("negative_cues > 0")
    return curation.capped_weighted_draw(rows, (F.col("negative_cues") + 1.0) / (1.0 + F.col("positive_cues")), 60, 42).select("doc_id", "ticker")


@query(
    "SELECT doc_id, 'eval_random' AS stratum, 'eval' AS usage, round((SELECT count(*) FROM evals) / (SELECT count(*) FROM cues), 6) AS inclusion_probability FROM evals"
    + "".join(f" UNION ALL SELECT doc_id, 'train_{s}', 'train', round((SELECT count(*) FROM drawn_{s}) / (SELECT count(*) FROM keyed_{s}), 6) FROM drawn_{s}" for s in ("negative", "positive", "active")),
    (
        ARTICLES,
        POOL,
        f"evals AS (SELECT * FROM cues ORDER BY {sql_hash(repr('uniform'), repr('42'), 'url')}, url LIMIT 50)",
        "rest1 AS (SELECT * FROM cues WHERE url NOT IN (SELECT url FROM evals))",
        stratum_sql("negative", "rest1", "negative_cues > 0", "(negative_cues + 1.0) / (1.0 + positive_cues)", 60),
        "rest2 AS (SELECT * FROM rest1 WHERE url NOT IN (SELECT url FROM drawn_negative))",
        stratum_sql("positive", "rest2", "positive_cues > 0", "(positive_cues + 1.0) / (1.0 + negative_cues)", 40),
        "rest3 AS (SELECT * FROM rest2 WHERE url NOT IN (SELECT url FROM drawn_positive))",
        stratum_sql("active", "rest3", f"{sql_hash(repr('scored'), 'url')} % 3 > 0", f"1 - greatest({PRIOR_SQL[0]}, {PRIOR_SQL[1]}, {PRIOR_SQL[2]})", 30),
    ),
)
def strata_draw(spark, d):
    """All four strata; two thirds of the pool have scores, which are drawn by key."""
    priors = [F.when(draw(3, "scored", F.col("url")) > 0, p).alias(c) for c, p in zip(curation.PROBABILITIES, prior_columns(), strict=True)]
    # every stratum is drawn from the pool: it is written once, without the texts
    rows = staged(pool(spark, d).select("doc_id", "ticker", "url", "negative_cues", "positive_cues", *priors), "pool")
    return curation.draw_strata(rows, {"eval_random": 50, "train_negative": 60, "train_positive": 40, "train_active": 30}).select("doc_id", "stratum", "usage", "inclusion_probability")


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY ticker, doc_id % 5 ORDER BY {sql_hash(repr('proportional'), repr('42'), 'url')}, url) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY ticker, doc_id % 5) * 0.1, 0)) AS w FROM pool0) WHERE r <= w""",
    (ARTICLES, POOL),
)
def proportional_draw(spark, d):
    return curation.proportional_draw(pool(spark, d).withColumn("year", F.col("doc_id") % 5 + 2020), ["ticker", "year"], 0.1, 42).select("doc_id")


@query(f"SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(repr('matched'), repr('42'), 'doc_id')}, doc_id) AS r FROM labelled) WHERE r <= CASE label WHEN 'NEGATIVE' THEN 5 WHEN 'NEUTRAL' THEN 20 ELSE 10 END", (LABELLED,))
def class_matched_draw(spark, d):
    return curation.class_matched_draw(labelled(spark, d), {"NEGATIVE": 5, "NEUTRAL": 20, "POSITIVE": 10}, "label", 42, "doc_id").select("doc_id", "label")


@query(f"SELECT doc_id, label, (row_number() OVER (PARTITION BY label ORDER BY {sql_hash(repr('42'), 'doc_id')}, doc_id) - 1) % 5 AS fold FROM labelled", (LABELLED,))
def stratified_folds(spark, d):
    return splits.stratified_folds(labelled(spark, d), 5, "label", "doc_id").select("doc_id", "label", F.col("fold").cast("long").alias("fold"))


@query(
    f"""SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM (
        SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(repr('42'), 'doc_id')}, doc_id) AS r, greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.1, 0)) AS t,
               greatest(1, round_even(count(*) OVER (PARTITION BY label) * 0.2, 0)) AS v FROM labelled)""",
    (LABELLED,),
)
def stratified_split(spark, d):
    return splits.stratified_split(labelled(spark, d), "label", "doc_id", 0.2, 0.1).select("doc_id", "split")


@query("SELECT label, count(*) AS n_rows, (SELECT count(*) FROM labelled) / (3 * count(*)) AS weight FROM labelled GROUP BY label", (LABELLED,), "weight")
def label_weights(spark, d):
    return evaluation.class_weights(labelled(spark, d), "label", ("NEGATIVE", "NEUTRAL", "POSITIVE"))


LABEL_FILE = "file AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'MAYBE' ELSE label END AS label, CASE WHEN doc_id % 3 = 0 THEN 'eval_random' ELSE 'train_negative' END AS stratum, concat('u', doc_id // 3) AS url, concat('t', doc_id // 4) AS title FROM labelled)"


def label_file(spark, d):
    rows = labelled(spark, d)
    k = F.col("doc_id")
    return rows.select(
        "doc_id",
        F.when(k % 7 == 0, "").when(k % 11 == 0, "MAYBE").otherwise(F.col("label")).alias("label"),
        F.when(k % 3 == 0, "eval_random").otherwise("train_negative").alias("stratum"),
        F.concat(F.lit("u"), F.expr("doc_id div 3")).alias("url"),
        F.concat(F.lit("t"), F.expr("doc_id div 4")).alias("title"),
    )


@query(
    """SELECT 'pending' AS "check", '' AS subject, count_if(label = '') AS n FROM file UNION ALL SELECT 'labelled', '', count_if(label IN ('NEGATIVE', 'NEUTRAL', 'POSITIVE')) FROM file
       UNION ALL SELECT 'invalid', '', count_if(label = 'MAYBE') FROM file
       UNION ALL SELECT 'class', concat_ws('/', stratum, label), count(*) FROM file WHERE label IN ('NEGATIVE', 'NEUTRAL', 'POSITIVE') GROUP BY stratum, label
       UNION ALL SELECT 'repeated_url', '', count(*) - count(DISTINCT url) FROM file UNION ALL SELECT 'repeated_title', '', count(*) - count(DISTINCT title) FROM file""",
    (LABELLED, LABEL_FILE),
)
def label_audit(spark, d):
    return curation.label_audit(label_file(spark, d))


@query(
    """SELECT url, label, sample_id, stratum, 'train' AS usage FROM (
           SELECT 0 AS b, url, label, concat('one-', doc_id) AS sample_id, stratum FROM file WHERE doc_id % 2 = 0 UNION ALL SELECT 1, url, label, concat('two-', doc_id), 'legacy' FROM file WHERE doc_id % 2 = 1)
       WHERE label IN ('NEGATIVE', 'NEUTRAL', 'POSITIVE') QUALIFY row_number() OVER (PARTITION BY url ORDER BY b, sample_id) = 1""",
    (LABELLED, LABEL_FILE),
)
def merge_labels(spark, d):
    rows = label_file(spark, d).withColumn("sample_id", F.col("doc_id"))
    merged = curation.merge_labels([("one", rows.where("doc_id % 2 = 0")), ("two", rows.where("doc_id % 2 = 1").drop("stratum"))])
    return merged.select("url", "label", "sample_id", "stratum", "usage")


@query(
    """SELECT label, round(h, 4) AS half_width, round(greatest(0, 0.7 - h), 4) AS ci_low, round(least(1, 0.7 + h), 4) AS ci_high FROM (SELECT label, 1.96 * sqrt(0.7 * 0.3 / count(*)) AS h FROM labelled GROUP BY label)""",
    (LABELLED,),
    "half_width ci_low ci_high",
)
def minority_power(spark, d):
    return labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", *curation.minority_power(F.col("n"), 0.7))


@query("SELECT ticker, a.url, title FROM (SELECT DISTINCT ticker, url FROM articles) l JOIN (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) = 1) a ON l.url = a.url".replace("SELECT ticker,", "SELECT l.ticker,"), (ARTICLES,))
def link_join(spark, d):
    own = articles(spark, d)
    return curation.link_join(own, own.drop("ticker"), "doc_id").select("ticker", "url", "title")


@query("SELECT url, doc_id FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) = 1", (ARTICLES,))
def dedup_keep_last(spark, d):
    return curation.keep_last(articles(spark, d), ["url"], "doc_id").select("url", "doc_id")


@query("SELECT doc_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM articles s WHERE s.doc_id % 3 = 0 AND s.ticker = a.ticker AND s.url = a.url)", (ARTICLES,))
def antijoin_incremental(spark, d):
    own = articles(spark, d)
    return curation.unseen(own, own.where("doc_id % 3 = 0"), ["ticker", "url"]).select("doc_id")


@query("SELECT ticker, session_date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session_date ORDER BY s DESC) AS r FROM (SELECT ticker, session_date, close, 0 AS s FROM bars UNION ALL SELECT ticker, session_date, close + 1, 1 FROM bars WHERE day(session_date) < 10)) WHERE r = 1", (BARS,), "close")
def merge_on_write(spark, d):
    own = bars(spark, d).select("ticker", "session_date", "close")
    return curation.merge_on_write(own, own.where(F.day("session_date") < 10).withColumn("close", F.col("close") + 1), ["ticker", "session_date"])


@query(
    """SELECT ticker, url, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker, url ORDER BY s DESC) AS r FROM (
           SELECT ticker, url, doc_id, 0 AS s FROM dedup WHERE doc_id % 10 < 6 AND ticker <> 'AAA' UNION ALL SELECT ticker, url, doc_id, 1 FROM dedup WHERE doc_id % 10 >= 4)) WHERE r = 1""",
    (ARTICLES, "dedup AS (SELECT * FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)"),
)
def slice_replace(spark, d):
    own = curation.keep_first(articles(spark, d), ["url"], "doc_id").select("ticker", "url", "doc_id")
    complete = own.select("ticker").distinct().where("ticker = 'AAA'")
    return curation.replace_slices(own.where("doc_id % 10 < 6"), own.where("doc_id % 10 >= 4"), complete, ["ticker"], ["ticker", "url"])


@query("SELECT doc_id FROM (SELECT doc_id, try_strptime(CASE WHEN doc_id % 5 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%d/%m/%Y') END, '%d/%m/%Y') AS day FROM documents) WHERE day IS NULL OR day BETWEEN DATE '2024-03-01' AND DATE '2024-06-30'")
def listing_window(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "dd/MM/yyyy")
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(day).alias("list_date"))
    return curation.within_window(rows, "2024-03-01", "2024-06-30").select("doc_id")


@query("SELECT url, CASE WHEN doc IS NULL THEN 'new' WHEN doc % 2 = 0 THEN 'no_body' ELSE 'no_time' END AS reason FROM (SELECT DISTINCT a.url, s.doc_id AS doc FROM articles a LEFT JOIN store s ON a.url = s.url) WHERE doc IS NULL OR doc % 2 = 0 OR (doc % 3 = 0 AND doc % 5 <> 0)", (ARTICLES, "store AS (SELECT * FROM articles WHERE doc_id % 10 < 6 QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1)"))
def fetch_queue(spark, d):
    own, k = articles(spark, d), F.col("doc_id")
    store = curation.keep_first(own.where("doc_id % 10 < 6"), ["url"], "doc_id").select("url", F.when(k % 2 == 1, "body").alias("body"), F.when(k % 3 != 0, "2024").alias("published_at"), (k % 5 == 0).alias("parse_failed"))
    return fetch_queue_of(own, store)


@query(
    """SELECT sha256(array_to_string(list_sort(list(sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), coalesce(title, ''), coalesce(body, ''))))), '')) AS fingerprint, count(*) AS n_rows FROM articles""",
    (ARTICLES,),
)
def frame_fingerprint(spark, d):
    return curation.fingerprint(articles(spark, d), ["doc_id", "title", "body"])


@query(
    """SELECT (SELECT sha256(array_to_string(list_sort(list(DISTINCT concat_ws(chr(9), ticker, url))), chr(10))) FROM articles) AS batch_key, (SELECT count(*) FROM articles) AS n_rows,
              (SELECT string_agg(concat_ws('=', ticker, CAST(n AS VARCHAR)), ',' ORDER BY ticker) FROM (SELECT ticker, count(*) AS n FROM articles GROUP BY ticker)) AS by_ticker""",
    (ARTICLES,),
)
def batch_digest(spark, d):
    return curation.batch_digest(articles(spark, d))


@query(
    """SELECT ticker AS subject, unnest(['finite_prices', 'positive_close', 'positive_volume', 'unique_session', 'close_in_range']) AS "check", unnest([count_if(close IS NULL), count_if(close <= 0), count_if(volume <= 0), count(*) - count(DISTINCT session_date), count_if(close < low OR close > high)]) AS violations
       FROM rounded GROUP BY ticker""",
    (BARS, "rounded AS (SELECT ticker, session_date, round(low, 6) AS low, round(high, 6) AS high, round(close, 6) AS close, volume FROM bars)"),
)
def data_quality(spark, d):
    return quality.price_checks(bars(spark, d).withColumns({c: F.round(c, 6) for c in ("open", "high", "low", "close")}))


@query(
    """SELECT unnest(['in_range', 'sum_is_one', 'unique_link']) AS "check", unnest([count_if(NOT (prob_negative BETWEEN -1e-12 AND 1 + 1e-12 AND prob_neutral BETWEEN -1e-12 AND 1 + 1e-12 AND prob_positive BETWEEN -1e-12 AND 1 + 1e-12)),
              count_if(abs(prob_negative + prob_neutral + prob_positive - 1) > 1e-6), count(*) - count(DISTINCT (ticker, url))]) AS violations FROM news""",
    (NEWS,),
)
def probability_checks(spark, d):
    return quality.probability_checks(news(spark, d))


@query("SELECT doc_id, string_split(title, ' ')[1:8] AS head, CASE WHEN len(string_split(title, ' ')) <= 8 THEN string_split(title, ' ') ELSE list_concat(string_split(title, ' ')[1:4], string_split(title, ' ')[-4:]) END AS head_tail FROM articles", (ARTICLES,))
def truncation(spark, d):
    tokens = F.split("title", " ")
    return articles(spark, d).select("doc_id", T.truncated(tokens, 8, "head").alias("head"), T.truncated(tokens, 8, "head_tail").alias("head_tail"))


@query("SELECT CASE n % 3 WHEN 0 THEN 'NEGATIVE' WHEN 1 THEN 'NEUTRAL' ELSE 'POSITIVE' END AS label, n AS sample_id FROM (SELECT unnest(range(60)) AS n)")
def synthetic_labels(spark, d):
    return spark.range(60).select(F.element_at(F.array(F.lit("NEGATIVE"), F.lit("NEUTRAL"), F.lit("POSITIVE")), (F.col("id") % 3 + 1).cast("int")).alias("label"), F.col("id").alias("sample_id"))


# --- the text classifier ----------------------------------------------------


def labelled_articles(spark, d):
    return articles(spark, d).join(labelled(spark, d), "doc_id")


@query()
def text_cross_validation(spark, d):
    """Title and context, cross-validated over five folds with balanced classes."""
    return textcv.cross_validated(labelled_articles(spark, d), "title_context", "head_tail")


@query()
def text_ablation(spark, d):
    """Three inputs by three truncations, each cross-validated."""
    return textcv.ablation(labelled_articles(spark, d), size=64, parallel=8)
