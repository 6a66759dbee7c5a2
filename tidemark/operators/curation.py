"""Links, merges, dedup and drawing of texts for annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import digests
from tidemark.functions.draws import key_hash, uniform
from tidemark.functions.stats import numbered_within
from tidemark.functions.text import NEGATIVE_CUES, POSITIVE_CUES, cue_count, input_text, label_id
from tidemark.schemas import refuse, require_columns

MAX_TICKER_SHARE = 0.2
PROBABILITIES = ("prob_negative", "prob_neutral", "prob_positive")
# fixed values: marks of labels that an automatic pass made and that a person has reviewed
PRELIMINARY = {"annotation_status": "PRELIMINARY_REVIEW_REQUIRED", "annotation_source": "assistant_prelabel"}
REVIEWED = {"annotation_status": "REVIEWED", "annotation_source": "human_reviewed"}
USAGE = {"eval_random": "eval", "train_negative": "train", "train_positive": "train", "train_active": "train"}


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the one with the greatest ``order``: the last to come."""
    return keep(rows, keys, F.desc(order))


def keep_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return keep(rows, keys, *order)


def keep(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


def merge_on_write(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the fresh ones; a fresh row replaces the stored one of its keys."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)))
    return keep_last(both, keys, "_seq").drop("_seq")


def replace_slices(stored: DataFrame, fresh: DataFrame, complete: DataFrame, slices: list[str], keys: list[str]) -> DataFrame:
    """Slices that were walked completely replace what is stored; incomplete ones are merged in."""
    rest = stored.join(complete.select(*slices).distinct(), slices, "left_anti")
    return merge_on_write(rest, fresh, keys)


def link_join(links: DataFrame, contents: DataFrame, order: str) -> DataFrame:
    """Every distinct (ticker, url) with its content; of contents with one url the last counts."""
    require_columns(links, "ticker", "url")
    return links.select("ticker", "url").distinct().join(keep_last(contents, ["url"], order).drop(order), "url")


def unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys haven't been worked on."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def within_window(listings: DataFrame, start: str, end: str) -> DataFrame:
    """Listings dated in the window, and those whose date can't be read."""
    day = F.try_to_date("list_date", "dd/MM/yyyy")
    return listings.where(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def candidate_pool(articles: DataFrame, labelled: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Articles not labelled yet, one for each link, then for each title, then for each beginning of a body."""
    require_columns(articles, "ticker", "url", "title", "body")
    pool = unseen(articles, labelled, ["url"]) if labelled is not None else articles
    pool = pool.withColumns({"_title": F.lower(F.trim(F.coalesce("title", F.lit("")))), "_body": F.substring(F.lower(F.trim(F.coalesce("body", F.lit("")))), 1, 400)})
    pool = keep_first(pool, ["url"], "ticker")
    pool = keep_first(pool.where("_title <> ''"), ["_title"], "url")
    pool = keep_first(pool.where("_body <> ''"), ["_body"], "url")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    pool = pool.withColumns({"negative_cues": cue_count(text, NEGATIVE_CUES), "positive_cues": cue_count(text, POSITIVE_CUES)}).drop("_title", "_body")
    if scored is not None:
        return pool.join(keep_first(scored, ["url"], *PROBABILITIES).select("url", *PROBABILITIES), "url", "left")
    return pool.withColumns({c: F.lit(None).cast("double") for c in PROBABILITIES})


def uniform_draw(rows: DataFrame, quota: int, seed: int, key: str = "url") -> DataFrame:
    """``quota`` rows, each equally likely; the order of a hash of the key decides."""
    return rows.orderBy(key_hash("uniform", seed, F.col(key)), key).limit(quota)


def weighted_key(weight: Column, seed: int, key: str) -> Column:
    """Exponential key of a weighted draw without replacement: the smallest keys are drawn."""
    return -F.ln(uniform("weighted", seed, F.col(key))) / F.greatest(weight, F.lit(1e-9))


def capped_weighted_draw(rows: DataFrame, weight: Column, quota: int, seed: int, share: float = MAX_TICKER_SHARE, key: str = "url") -> DataFrame:
    """A weighted draw with at most a cap of each ticker, filled up beyond the cap only where it falls short.

    The cap is never below an equal split. Ranks within a ticker are cut to the quota before the final
    order, so no task sorts more than that of each ticker.
    """
    if quota < 1:
        return rows.limit(0)
    keyed = rows.withColumn("_k", weighted_key(weight, seed, key))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy("_k", key))).where(F.col("_r") <= quota)
    names = rows.agg(F.greatest(F.countDistinct("ticker"), F.lit(1)).alias("_names"))
    cap = F.greatest(F.lit(1), F.ceil(F.lit(quota * share)), F.ceil(F.lit(quota) / F.col("_names")))
    over = ranked.join(F.broadcast(names), F.lit(True)).withColumn("_over", F.col("_r") > cap)
    return over.orderBy("_over", "_k", key).limit(quota).drop("_k", "_r", "_names", "_over")


def draw_strata(pool: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Disjoint strata in a fixed order, each from what is left: a uniform one, then enriched ones.

    Returns the drawn rows with stratum, usage and the share of the eligible rows that was drawn.
    """
    left, drawn = pool, []

    def take(stratum: str, eligible: DataFrame, chosen: DataFrame) -> None:
        nonlocal left
        n = eligible.agg(F.count(F.lit(1)).alias("_n"))
        own = chosen.withColumns({"stratum": F.lit(stratum), "usage": F.lit(USAGE[stratum])})
        size = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
        drawn.append(own.join(F.broadcast(n), F.lit(True)).withColumn("inclusion_probability", F.round(size / F.col("_n"), 6)).drop("_n"))
        left = left.join(chosen.select("url"), "url", "left_anti")

    if (quota := quotas.get("eval_random", 0)) > 0:
        take("eval_random", left, uniform_draw(left, quota, seed))
    for stratum, cue, other in (("train_negative", "negative_cues", "positive_cues"), ("train_positive", "positive_cues", "negative_cues")):
        if (quota := quotas.get(stratum, 0)) > 0:
            eligible = left.where(F.col(cue) > 0)
            take(stratum, eligible, capped_weighted_draw(eligible, (F.col(cue) + 1.0) / (1.0 + F.col(other)), quota, seed))
    if (quota := quotas.get("train_active", 0)) > 0:
        eligible = left.where(" and ".join(f"{c} is not null" for c in PROBABILITIES))
        take("train_active", eligible, capped_weighted_draw(eligible, 1 - F.greatest(*PROBABILITIES), quota, seed))
    if not drawn:
        raise ValueError("no stratum has a quota")
    out = drawn[0]
    for more in drawn[1:]:
        out = out.unionByName(more)
    return out


def proportional_draw(rows: DataFrame, groups: list[str], fraction: float, seed: int, key: str = "url") -> DataFrame:
    """max(1, round(n * fraction)) rows of each group."""
    own = Window.partitionBy(*groups)
    wanted = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)).over(own) * fraction, 0).cast("int"))
    order = own.orderBy(key_hash("proportional", seed, F.col(key)), key)
    return rows.withColumns({"_w": wanted, "_r": F.row_number().over(order)}).where("_r <= _w").drop("_w", "_r")


def class_matched_draw(rows: DataFrame, wanted: dict, label: str, seed: int, key: str) -> DataFrame:
    """Exactly so many rows of each class; a class with too few raises."""
    have = {r[label]: r["count"] for r in rows.where(F.col(label).isin(*wanted)).groupBy(label).count().collect()}
    if short := {name: have.get(name, 0) for name, n in wanted.items() if have.get(name, 0) < n}:
        raise ValueError(f"too few rows: have {short}, want {wanted}")
    sizes = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    placed = numbered_within(rows.where(F.col(label).isin(*wanted)), [key_hash("matched", seed, F.col(key)), F.col(key)], "_r", F.col(label))
    return placed.where(F.col("_r") <= sizes[F.col(label)]).drop("_r")


def merge_labels(batches: list[tuple[str, DataFrame]], valid: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> DataFrame:
    """Label files in order: ids get the batch's name, invalid labels go, of one url the first batch counts."""
    merged = None
    for k, (name, rows) in enumerate(batches):
        own = rows.withColumns({"label": F.upper(F.trim("label")), "sample_id": F.concat(F.lit(f"{name}-"), F.col("sample_id").cast("string")), "_batch": F.lit(k)})
        merged = own if merged is None else merged.unionByName(own, allowMissingColumns=True)
    merged = merged.where(F.col("label").isin(*valid))
    for column, default in (("stratum", "legacy"), ("usage", "train")):
        merged = merged.withColumn(column, F.coalesce(column, F.lit(default)) if column in merged.columns else F.lit(default))
    return keep_first(merged, ["url"], "_batch", "sample_id").drop("_batch")


def label_audit(labels: DataFrame, valid: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> DataFrame:
    """(check, subject, n): pending, labelled, invalid, repeated links and titles, and classes by stratum."""
    shown = F.upper(F.trim(F.coalesce("label", F.lit(""))))
    base = labels.withColumn("_l", shown)
    parts = [
        base.agg(F.count_if(F.col("_l") == "").alias("n")).select(F.lit("pending").alias("check"), F.lit("").alias("subject"), "n"),
        base.agg(F.count_if(F.col("_l").isin(*valid)).alias("n")).select(F.lit("labelled").alias("check"), F.lit("").alias("subject"), "n"),
        base.agg(F.count_if((F.col("_l") != "") & ~F.col("_l").isin(*valid)).alias("n")).select(F.lit("invalid").alias("check"), F.lit("").alias("subject"), "n"),
        base.where(F.col("_l").isin(*valid)).groupBy("stratum", "_l").agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("check"), F.concat_ws("/", "stratum", "_l").alias("subject"), "n"),
    ]
    for column in ("url", "title"):
        extra = base.groupBy(column).agg((F.count(F.lit(1)) - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n"))
        parts.append(extra.select(F.lit(f"repeated_{column}").alias("check"), F.lit("").alias("subject"), "n"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def minority_power(n: Column, recall: float = 0.5) -> list[Column]:
    """Half width and clipped ends of the 95 % Wald interval of a recall over n rows; no rows raise."""
    rows = F.when(n >= 1, n).otherwise(F.raise_error("a recall needs at least one row").cast("long"))
    half = 1.96 * F.sqrt(F.lit(recall * (1 - recall)) / rows)
    ends = F.greatest(F.lit(0.0), recall - half), F.least(F.lit(1.0), recall + half)
    return [F.round(x, 4).alias(name) for x, name in zip((half, *ends), ("half_width", "ci_low", "ci_high"), strict=True)]


def refuse_preliminary(labels: DataFrame, allowed: bool = False) -> DataFrame:
    """Raises on rows that an automatic pass labelled and nobody has reviewed, by status or by source."""
    for column, flag in PRELIMINARY.items():
        if not allowed and column in labels.columns:
            refuse(labels.where(F.col(column) == flag).select(column), "preliminary labels")
    return labels


def finalize_labels(labels: DataFrame, valid: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> DataFrame:
    """Rows with a valid label become reviewed, in status and source alike; others keep what they have."""
    require_columns(labels, "label")
    sure = F.coalesce(F.trim("label").isin(*valid), F.lit(False))
    have = lambda c: F.col(c).cast("string") if c in labels.columns else F.lit(None).cast("string")
    return labels.withColumns({c: F.when(sure, F.lit(v)).otherwise(have(c)) for c, v in REVIEWED.items()})


def finalize_report(labels: DataFrame, valid: tuple[str, ...] = ("NEGATIVE", "NEUTRAL", "POSITIVE")) -> DataFrame:
    """One row: rows, finalized, left preliminary, labels that differ from the stored ones, and each class."""
    label = F.trim("label")
    sure = F.coalesce(label.isin(*valid), F.lit(False))
    stored = F.trim("prelabel") if "prelabel" in labels.columns else F.lit(None).cast("string")
    changed = F.count_if(sure & stored.isNotNull() & (stored != label)) if "prelabel" in labels.columns else F.lit(None).cast("long")
    classes = [F.count_if(label == c).alias(f"n_{c.lower()}") for c in valid]
    return labels.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(sure).alias("finalized"), F.count_if(~sure).alias("left_preliminary"), changed.alias("changed_from_prelabel"), *classes)


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Rows with ``label_id``; an invalid label or an id that disagrees with its label raises."""
    ids = labels.withColumn("_id", label_id(F.col("label" if "label" in labels.columns else "label_id")))
    refuse(ids.where(F.col("_id").isNull()), "invalid label")
    if {"label", "label_id"} <= set(labels.columns):
        refuse(ids.where(~F.col("label_id").try_cast("int").eqNullSafe(F.col("_id"))), "label and label_id disagree")
    return ids.withColumn("label_id", F.col("_id")).drop("_id")


def with_input(rows: DataFrame, variant: str, **options) -> DataFrame:
    """Rows with the model's input text; rows without any go, and none left raises."""
    made = rows.withColumn("input_text", input_text(variant, **options)).where("input_text is not null")
    if not made.limit(1).count():
        raise ValueError(f"no row has a text for {variant!r}")
    return made


def dedup_by_input(rows: DataFrame, variant: str, order: str, **options) -> DataFrame:
    """Rows with the model's input text, one for each text; rows without any go, and none left raises.

    The text is built first: what is one text for one variant may be two for another.
    """
    return keep_first(with_input(rows, variant, **options), ["input_text"], order)


def label_template(pool: DataFrame, preview: int = 500) -> DataFrame:
    """Rows to annotate: fixed columns, a preview of the body and an empty label."""
    known = lambda c, kind="string": F.col(c) if c in pool.columns else F.lit(None).cast(kind)
    shown = F.substring(F.trim(F.coalesce("body", F.lit(""))), 1, preview)
    return pool.select(F.sha2(F.concat_ws("|", "ticker", "url"), 256).alias("sample_id"), "ticker", known("published_at").alias("published_at"), "title", shown.alias("body_preview"), "url", F.lit("").alias("label"), known("stratum").alias("stratum"), known("usage").alias("usage"))


def sampling_manifest(drawn: DataFrame, seed: int) -> DataFrame:
    """(stratum, usage, n_rows, n_tickers, seed, digest of the links): what was drawn, reproducibly."""
    links = F.sha2(F.array_join(F.array_sort(F.collect_set("url")), "\n"), 256)
    return drawn.groupBy("stratum", "usage").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.lit(seed).alias("seed"), links.alias("links_sha256"))


def seed_texts(rows: DataFrame, codes: dict[int, str]) -> DataFrame:
    """Public seed texts: codes become class names (an unknown one raises), empty and repeated texts go."""
    names = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    made = rows.select(F.trim("text").alias("text"), F.try_element_at(names, F.col("code").cast("int")).alias("label"), "code").where("text is not null and text <> ''")
    refuse(made.where(F.col("label").isNull()), "unknown code")
    return made.groupBy("text").agg(F.min("label").alias("label"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of all rows, whatever their order: of their sorted digests in a row; nulls count as empty."""
    if not rows.limit(1).count():
        raise ValueError("an empty frame has no fingerprint")
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return digests.in_a_row(rows.select(row.alias("h")), "h").withColumnRenamed("digest", "fingerprint")


def batch_digest(rows: DataFrame) -> DataFrame:
    """The key of a batch of news: a digest of its sorted (ticker, url) lines, with counts by ticker."""
    line = F.concat_ws("\t", "ticker", "url")
    lines = digests.in_a_row(rows.select(line.alias("line")).distinct(), "line", "\n").select(F.col("digest").alias("batch_key"))
    digest = lines.join(rows.agg(F.count(F.lit(1)).alias("n_rows")), F.lit(True))
    counts = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    by = counts.agg(F.array_sort(F.collect_list(F.concat_ws("=", "ticker", "n"))).alias("by_ticker"))
    return digest.join(by, F.lit(True)).withColumn("by_ticker", F.array_join("by_ticker", ","))
