"""Filter interaction audit (operator 13): what each filter removes in every order, by inclusion-exclusion.

Every document gets one failure flag for each filter. For each of the 32 sets of filters one product of
flags is summed by part (and again with the weights of good and toxic documents): the joint failures.
Everything else is arithmetic on those 32 numbers of a part. The Moebius transform over subsets gives the
survivors of every set of filters, and so what each step of each order keeps, removes, finds removed
already or loses; over supersets it gives what fails exactly one filter. The game whose worth is what a
set of filters removes has the Harsanyi dividends (-1)^(|T|+1) x joint failures of T, so that the sum of a
filter's removals over all orders is the sum of 120 / |T| dividends over the sets T that hold it.

Scale: one pass over the texts, whose digest and flags go on alone. Documents meet their labels by id.
Copies are counted by digest, part, flags and labels before a digest's rows meet, so a text that makes up a
third of all rows sends one row for each task and combination. The 96 sums are one aggregate by part. The
orders come from a generator over one row for each part.

Defined results: a null text is the empty text; a null source is the part ''; a row whose id is null never
fails the copy filter and makes no other row fail it; rows that repeat an id and a text don't fail through
each other; a document has label 1 if any of its rows in ``labels`` has it, null labels count as 0.
An empty table has no parts. Other columns are pruned.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

FILTERS = "ABCDE"
#: The filter that compares texts; all others look at one text.
COPIES = FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SETS = range(1 << len(FILTERS))
SALTS = 64


def own_failures(text: Column) -> list[Column]:
    """The failure conditions of A, B, C and D, which look at one text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def flagged(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, own): own has bit k if the document fails the k-th of the filters that look at one text."""
    plain, (t, i, p) = common.numbered(docs, text, doc_id, part)
    plain = plain.select(F.coalesce(F.col(t), F.lit("")).alias("text"), F.col(i).alias("doc_id"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("part"))
    own = sum((F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(own_failures(F.col("text")))), F.lit(0))
    return plain.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("own"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic`` (0 or 1) of the labels; ids that are null have no labels and are salted."""
    of = labels.groupBy(labels["doc_id"].alias("_id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("_good"), F.max((labels["toxic"] == 1).cast("int")).alias("_toxic")
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS))).otherwise(F.lit(0))
    found = flags.withColumn("salt", salt).join(of.withColumn("_salt", F.lit(0)), F.expr("doc_id = _id AND salt = _salt"), "left")
    return found.select(*flags.columns, "salt", F.coalesce("_good", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"))


def failure_counts(rows: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents of a part by the set of filters that they fail and their labels."""
    kind = ["digest", "part", "own", "good", "toxic"]
    # rows of one id are together after the join with the labels
    ids = rows.groupBy("doc_id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"), F.min(known).alias("least"))
    whole = kinds.select("*", F.expr("min(least.doc_id) OVER (PARTITION BY digest)").alias("first"))
    kept = F.col("without_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = F.array(F.struct(F.col("own").alias("fails"), kept.alias("n")), F.struct((F.col("own") + (1 << COPIES)).alias("fails"), (F.col("n") - kept).alias("n")))
    return whole.select("part", "good", "toxic", F.inline(sides)).where("n > 0").select("part", "fails", "good", "toxic", "n")


def joint_failures(counts: DataFrame) -> DataFrame:
    """One row for each part; ``every``, ``good`` and ``toxic`` hold for each set (as bits) those that fail all of its filters."""
    def product(s: int) -> Column:
        flags = F.lit(1)
        for k in range(len(FILTERS)):
            if s >> k & 1:
                flags = flags * F.getbit("fails", F.lit(k))
        return flags.cast("long")

    weights = {"every": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    sums = [F.sum(product(s) * w).alias(f"{name}_{s}") for name, w in weights.items() for s in SETS]
    found = counts.groupBy("part").agg(*sums)
    return found.select("part", *[F.array(*[F.col(f"{name}_{s}") for s in SETS]).alias(name) for name in weights])


def moebius(joint: Column, chosen: Column, below: bool) -> Column:
    """The signed sum of joint failures over the subsets of ``chosen`` (what fails none of it), or over its supersets (what fails exactly it)."""
    sets = F.sequence(F.lit(0), F.lit(len(SETS) - 1))

    def term(total: Column, t: Column) -> Column:
        counted = t.bitwiseAND(chosen) == (t if below else chosen)
        odd = (F.bit_count(t) if below else F.bit_count(t.bitwiseXOR(chosen))) % 2 == 1
        value = F.element_at(joint, (t + 1).cast("int"))
        return total + F.when(~counted, F.lit(0)).when(odd, -value).otherwise(value)

    return F.aggregate(sets, F.lit(0).cast("long"), term)


def audited(joint: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the joint failures of the parts."""
    n, every = len(FILTERS), range(len(FILTERS))
    sets = F.sequence(F.lit(0), F.lit(len(SETS) - 1))

    def survivors(name: str) -> Column:
        return F.transform(sets, lambda s: moebius(F.col(name), s, True))

    tables = {f"{name}_left": survivors(name) for name in ("every", "good", "toxic")}
    tables["alone"] = F.array(*[moebius(F.col("every"), F.lit(1 << k), False) for k in every])
    orders = len(ORDERS)
    shares = [sum(((-1) ** (s.bit_count() + 1) * (orders // s.bit_count()) * F.element_at("every", s + 1) for s in SETS if s >> k & 1), F.lit(0).cast("long")) for k in every]
    tables["shares"] = F.array(*shares)
    found = joint.select("part", "every", *[c.alias(k) for k, c in tables.items()])
    found = found.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    found = found.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def at(step: Column) -> Column:
        """The place among the filters of the one that an order has at a step."""
        return F.instr(F.lit(FILTERS), F.col("filter_order").substr(step, F.lit(1))).cast("int") - 1

    def member(step: Column) -> Column:
        return F.element_at(F.array(*[F.lit(1 << k) for k in every]), at(step) + 1)

    def among(last: Column) -> Column:
        """The set of the order's first ``last`` filters."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, j: s + F.when(j <= last, member(j)).otherwise(0))

    found = found.select("*", at(F.col("step")).alias("k"), among(F.col("step") - 1).alias("before"), among(F.col("step")).alias("after"))

    def left(name: str, chosen: str) -> Column:
        return F.element_at(f"{name}_left", F.col(chosen) + 1)

    removed = left("every", "before") - left("every", "after")
    failing = F.element_at("every", member(F.col("step")) + 1)
    return found.select(
        "part",
        "filter_order",
        "step",
        left("every", "after").alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        F.element_at("alone", F.col("k") + 1).alias("unique_fails"),
        (left("good", "before") - left("good", "after")).alias("good_lost"),
        (left("toxic", "before") - left("toxic", "after")).alias("toxic_lost"),
        F.element_at("shares", F.col("k") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What the filters do to ``docs``: one row for each part, order and step."""
    return audited(joint_failures(failure_counts(labelled(flagged(docs, **columns), labels))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir, "source"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE_SQL = {
    "op13_filter_audit": r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
    lab AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
    flags AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
               (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
            || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
            || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
            || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
            || (CASE WHEN coalesce(d.doc_id > firsts.first, false) THEN 'E' ELSE '' END) AS fails
        FROM d LEFT JOIN lab USING (doc_id) JOIN firsts USING (t)),
    kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
    perms(filter_order) AS (
        SELECT '' UNION ALL SELECT filter_order || f FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
    orders AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
               FROM perms, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
    steps AS (
        SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS alone,
               len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone
        FROM kinds, orders),
    sums AS (
        SELECT part, filter_order, step, f,
               sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END) AS toxic_lost
        FROM steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM sums
    """
}
