"""License scans (operator 5): canonical digest lookup.

A text is brought to a canonical form: letters become lower case, punctuation and white space (so line
breaks and comment signs as well) become single spaces, a title in front of the text and copyright
statements go, and equivalent spellings become one (licence and license, -ise and -ize, -our and -or,
sub-license and sublicense, whilst and while, ...). The digest of the whole canonical text is then joined
to the digests of known licences, made from their texts by the same expressions or listed as digests.
DataFrame functions only, one pass over the rows. The known digests are broadcast if they are few
(checked against a counted bound); with more Spark shuffles the narrow digests, not the texts.

Nothing depends on where lines end but blank lines, which part paragraphs. A title is a first paragraph,
or what stands before a first copyright statement, of up to 20 words with the word licence among the
first 8. A copyright statement begins with the word and a (c) mark or a year, or a mark and a year, and
ends with its paragraph or where a licence's own wording begins (``OPENINGS``), within 40 words; what
says copyright otherwise (notice, holder, owner) is wording. A licence inside a longer text isn't looked
for: the digest is that of the entire text.

The spelling rules work on word ends and fold more than dictionaries would; both sides are folded
alike, and texts that differ otherwise keep different digests.

Defined results: null, empty and blank texts have the canonical form of the empty text and no licence;
of several known licences with one canonical text the first name in alphabetical order is given, and
repeated texts count once; repeated rows get one result each; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.licence_texts import DIGESTS, LICENCES

#: Wording that ends a copyright statement: how licence texts begin or go on after one.
OPENINGS = "all rights reserved|permission (?:is|to)|redistribution and|everyone is|licensed under|released under|this (?:software|program|library|work|file|license|package)|preamble|version"
YEAR = "(?:(?:19|20)[0-9][0-9]|yyyy|year)"
PARAGRAPH = " "
#: The step after which words are single and stand between spaces.
WORDS_FROM = 2
#: Steps of the canonical form, in order: pattern and replacement. Java's and RE2's syntax agree on them.
STEPS: list[tuple[str, str]] = [
    # lines without letters, digits and anything beyond ASCII part paragraphs
    (r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n)+", f" {PARAGRAPH} "),
    ("©", " c "),
    # ASCII punctuation and white space, and the quotes, dashes, bullets and blanks beyond ASCII
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F «®·»‐-―‘-‟•…　]+", " "),
    (rf"^ (?:[^ {PARAGRAPH}]+ ){{0,7}}licen[cs]e (?:[^ {PARAGRAPH}]+ ){{0,12}}?({PARAGRAPH}|copyright c|copyright {YEAR}|c {YEAR}) ", " {1} "),
    (rf" (?:copyright c|copyright {YEAR}|c {YEAR}) (?:[^ {PARAGRAPH}]+ ){{0,40}}?({PARAGRAPH}|{OPENINGS}|$)", " {1}"),
    (rf"(?:all rights reserved|{PARAGRAPH}) ", ""),
    (r"(licen|practi|defen|offen)c(e|es|ed|ing|ee|or|ees|ors) ", "{1}s{2} "),
    (r"is(e|es|ed|ing|ation|ations) ", "iz{1} "),
    (r"our(s|ed|ing|able|ably|ite|ites)? ", "or{1} "),
    (r"ll(ed|ing|er|ers|ment) ", "l{1} "),
    (r"(fulfil|enrol|instal|wil|skil)l?(s|ful|ment)? ", "{1}l{2} "),
    (r"(acknowled|jud)ge(ment|ments) ", "{1}g{2} "),
    (r"(cent|calib|met|lit)re(s)? ", "{1}er{2} "),
    (r"(sub|non|re|co) (licens|commercial|distribut|owner)", "{1}{2}"),
    (r"whilst ", "while "),
    (r"per cent ", "percent "),
    (r"(copyright|patent) owner(s)? ", "{1} holder{2} "),
]


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for k, (pattern, into) in enumerate(STEPS):
        out = F.regexp_replace(out, pattern, into.replace("{", "$").replace("}", ""))
        if k == WORDS_FROM:
            out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    return F.trim(out)


def known_digests(spark: SparkSession, licences: Iterable[tuple[str, str]] | DataFrame = LICENCES, digests: Iterable[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, license_id) of each known licence, from texts and from listed digests."""
    known = licences if isinstance(licences, DataFrame) else spark.createDataFrame(list(licences), "license_id string, text string")
    made = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''").select("license_id", F.sha2("form", 256).alias("canonical_sha256"))
    listed = spark.createDataFrame(list(digests), "license_id string, canonical_sha256 string")
    return made.unionByName(listed).groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))


def with_licences(docs: DataFrame, licences: Iterable[tuple[str, str]] | DataFrame = LICENCES, text: str = "text") -> DataFrame:
    """Appends canonical_sha256, license_id (null: none) and is_license."""
    known = known_digests(docs.sparkSession, licences)
    kept = [c for c in docs.columns if c.lower() not in ("canonical_sha256", "license_id", "is_license")]
    digested = docs.select(*kept, F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    found = digested.join(common.lookup_side(known, known.count()), "canonical_sha256", "left")
    return found.select(*kept, "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_licences(common.documents(spark, sf_dir)).drop("text")


def sql_canonical(column: str) -> str:
    out = f"lower(coalesce({column}, ''))"
    for k, (pattern, into) in enumerate(STEPS):
        shown = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{shown}', '{into.replace('{', chr(92)).replace('}', '')}', 'g')"
        if k == WORDS_FROM:
            out = f"concat(' ', trim({out}, ' '), ' ')"
    return f"trim({out}, ' ')"


def sql() -> str:
    known = ", ".join("('" + name.replace("'", "''") + "', '" + text.replace("'", "''") + "')" for name, text in LICENCES)
    listed = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS)
    return f"""
    WITH k AS (
        SELECT canonical_sha256, min(n) AS license_id
        FROM (SELECT n, sha256({sql_canonical("t")}) AS canonical_sha256 FROM (VALUES {known}) AS v(n, t) UNION ALL SELECT * FROM (VALUES {listed}) AS w(n, d)) GROUP BY 1),
    d AS (SELECT doc_id, sha256({sql_canonical("text")}) AS canonical_sha256 FROM documents)
    SELECT doc_id, d.canonical_sha256, license_id, license_id IS NOT NULL AS is_license
    FROM d LEFT JOIN k ON d.canonical_sha256 = k.canonical_sha256
    """


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL = {"op5_license_scan": sql()}
