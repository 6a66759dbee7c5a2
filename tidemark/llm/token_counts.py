"""Token counts (operator 1): byte-pair merging over a heap and a linked list, counting only.

Each piece of text starts as one symbol a byte. The adjacent pair of lowest rank is popped again and
again; every merge lowers the count by one, so the count is initial symbols minus merges and no
identifiers are made. Counts of pieces are remembered by each task, within a bound of bytes.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are each counted; the
vocabulary's special strings inside a text count as one token each, as the tokenizers library does by
default; a very long piece without a boundary costs n log n. Rows keep their order in a partition, no
row is shuffled and memory is bounded by an Arrow batch and the memory of pieces.
"""

from __future__ import annotations

import heapq

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe_vocab, common

VOCABULARY = "byte_bpe_50k.json"
CONTEXT = 1024


def merge_count(symbols: list[int], pairs: dict[int, int]) -> int:
    """How many symbols are left when no adjacent pair can be merged."""
    n = len(symbols)
    if n < 2:
        return n
    width, id_mask, get = bpe_vocab.WIDTH, bpe_vocab.ID_MASK, pairs.get
    heap = []
    for at in range(n - 1):
        if (found := get(symbols[at] << width | symbols[at + 1])) is not None:
            heap.append(found << 32 | at)
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        entry = pop(heap)
        at, found = entry & 0xFFFFFFFF, entry >> 32
        here, follows = symbols[at], after[at]
        if here < 0 or follows >= n or get(here << width | symbols[follows]) != found:
            continue
        left -= 1
        symbols[at] = merged = found & id_mask
        symbols[follows] = -1
        after[at] = beyond = after[follows]
        if beyond < n:
            before[beyond] = at
            if (found := get(merged << width | symbols[beyond])) is not None:
                push(heap, found << 32 | at)
        if (back := before[at]) >= 0 and (found := get(symbols[back] << width | merged)) is not None:
            push(heap, found << 32 | back)
    return left


class Counter:
    """Counts texts; the counts of pieces are remembered within a bound."""

    def __init__(self, vocabulary: bpe_vocab.Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        strings = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.known = common.Memory(self.count_piece)

    def count_piece(self, piece: str) -> int:
        first = self.vocabulary.first
        return merge_count([first[b] for b in piece.encode()], self.vocabulary.pairs)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(part) for part in parts)
        return sum(map(self.known.__getitem__, self.pieces(text)))


def with_token_counts(docs: DataFrame, path: str | None = None, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Appends the token count of ``text``; ``path`` is a byte-level vocabulary file read by the driver."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe_vocab.read(path or public_tokenizers.path(VOCABULARY)))

    def make():
        count = Counter(bpe_vocab.parse(sent.value)).count
        return lambda texts: [[count(t) for t in texts]]

    return common.map_text(docs, make, [common.field(name, T.LongType())], text)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return with_token_counts(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > CONTEXT).alias("over_limit"),
    )


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
