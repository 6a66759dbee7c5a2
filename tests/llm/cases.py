"""Documents that every operator must handle, and helpers of the tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string"
#: Nulls, empties, blanks, ties, repeated rows, non-ASCII text, a word without end and a long text.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "one two three four"),
    (6, "The quick brown fox jumps over the lazy dog"),
    (6, "The quick brown fox jumps over the lazy dog"),
    (7, "Ünïcödé ΑΣ İstanbul 中文字 😀 ½ ١٢"),
    (8, "x" * 30_000),
    (9, "lorem ipsum dolor " * 20_000),
    (10, "!!! ... ---"),
    (None, "a text without an id"),
    (11, "<|endoftext|> inside <|startoftext|> a text"),
]


def edge(spark, extra: bool = False):
    docs = spark.createDataFrame(EDGE, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "predicted", "n_tokens", "kept", "digest", "node", "component_id", "n_words", "contaminated", "lang_pred", "license_id", "ids", "Text_sha256", "_digest"):
            docs = docs.withColumn(name, F.lit("own"))
    return docs


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def family(seed: int = 3, bases: int = 12, most: int = 9, vocabulary: int = 400) -> list[tuple[int, str]]:
    """Random texts with near copies of various distances, passages that many share and exact copies."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(30)]
    out: list[str] = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))
