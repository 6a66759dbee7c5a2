"""Language identification (operator 3): a byte convolutional network in numpy.

A text, with A-Z lower-cased, is cut into fixed-length windows of bytes. Bytes are embedded, filters of several widths slide
over a window, max pooling keeps each filter's strongest response and a softmax gives the language. A
document's distribution is the mean over all its windows, weighted by their bytes, so whole texts
count. The network is trained in one task on all windows of a bounded sample of labelled rows
(``SAMPLE``, a parameter), which weights rare languages up, in the order of a hash of the id; scoring
is one pass over all rows in batches of windows, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
row every text is; with one language only, that one has score 1; of languages that tie the first in
alphabetical order is predicted; repeated rows are predicted alike; rows without a language aren't
learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

UNKNOWN = "und"
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4), 16, 8
SAMPLE = 2000
#: Windows that are convolved at a time: few enough for the caches.
BATCH = 32


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def unfolded(embedding: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Each place of each window with the embedded bytes of the widest filter, (n, places, width * embedded)."""
    widest = max(WIDTHS)
    padded = np.zeros((len(windows), windows.shape[1] + widest - 1, EMBEDDED), np.float32)
    padded[:, : windows.shape[1]] = embedding[windows]
    return np.concatenate([padded[:, k : k + windows.shape[1]] for k in range(widest)], axis=2)


def filter_mask() -> np.ndarray:
    """Which weights exist: narrower filters leave the later bytes out."""
    widest = max(WIDTHS)
    mask = np.zeros((widest * EMBEDDED, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDED, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def forward(net: Network, windows: np.ndarray) -> np.ndarray:
    pooled = np.empty((len(windows), net.filters.shape[1]), np.float32)
    for at in range(0, len(windows), BATCH):
        flat = unfolded(net.embedding, windows[at : at + BATCH])
        n, places, depth = flat.shape
        pooled[at : at + BATCH] = (flat.reshape(n * places, depth) @ net.filters).reshape(n, places, -1).max(1)
    return softmax(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)


def train(windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, languages: list[str], epochs: int = 3, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    mask, k = filter_mask(), len(languages)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, draw(256, EMBEDDED, scale=0.5), draw(*mask.shape, scale=0.25) * mask, np.zeros(mask.shape[1], np.float32), draw(mask.shape[1], k, scale=0.2), np.zeros(k, np.float32))
    net.embedding[0] = 0
    parts = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    moments, step = [(np.zeros_like(p), np.zeros_like(p)) for p in parts], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 64):
            batch = windows[order[at : at + 64]]
            n, places = batch.shape
            flat = unfolded(net.embedding, batch)
            response = (flat.reshape(n * places, -1) @ net.filters).reshape(n, places, -1)
            where = response.argmax(1)
            pooled = np.take_along_axis(response, where[:, None], 1)[:, 0] + net.bias
            active = np.maximum(pooled, 0)
            error = softmax(active @ net.out + net.out_bias)
            error[np.arange(n), labels[order[at : at + 64]]] -= 1
            error *= (weights[order[at : at + 64]] / n)[:, None]
            back = (error @ net.out.T) * (pooled > 0)
            picked = flat[np.arange(n)[:, None], where]
            g_filters = np.einsum("nf,nfd->df", back, picked) * mask
            g_flat = back[:, :, None] * net.filters.T[None]
            g_embedding = np.zeros_like(net.embedding)
            for w in range(max(WIDTHS)):
                place = where + w
                byte = np.where(place < places, np.take_along_axis(batch, np.minimum(place, places - 1), 1), 0)
                np.add.at(g_embedding, byte, g_flat[:, :, w * EMBEDDED : (w + 1) * EMBEDDED])
            g_embedding[0] = 0
            step += 1
            for p, g, (m, s) in zip(parts, (g_embedding, g_filters, back.sum(0), active.T @ error, error.sum(0)), moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return net


def cut(raw: bytes) -> np.ndarray:
    """All windows of a text; the last is filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def training_windows(texts: list[str], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each whole text and a short one; with the text's number and weights that add up alike for each text."""
    windows, owner, weight = [], [], []
    for k, text in enumerate(texts):
        raw = text.encode().lower()
        own = cut(raw)
        start = int(rng.integers(0, max(1, len(raw) - 8)))
        short = raw[start : start + int(rng.integers(8, 97))]
        windows += [own, np.frombuffer(short.ljust(WINDOW, b"\0"), np.uint8)[None]]
        owner += [k] * (len(own) + 1)
        # half for the short window: short texts are to be told as well
        weight += [0.5 / len(own)] * len(own) + [0.5]
    weights = np.array(weight, np.float32)
    return np.concatenate(windows), np.array(owner), weights / weights.mean()


def learn(docs: DataFrame, held_out: int | None = 2, folds: int = 4, sample: int = SAMPLE) -> Network | None:
    """Fits on at most ``sample`` labelled documents outside the held-out fold; None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held_out is not None:
        known = known.where(common.fold(known, "doc_id", folds) != held_out)
    share = known.groupBy("lang").count()
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") * F.col("count")
    chosen = known.select("doc_id", "lang").join(share, "lang").orderBy(place, "doc_id").limit(sample).select("doc_id")
    # the sample is bounded by a parameter, so this side is as well
    return common.fitted(known.select("doc_id", "lang", "text").join(F.broadcast(chosen.distinct()), "doc_id"), fit)


def fit(rows: list[tuple]) -> Network | None:
    """The network of (doc_id, lang, text) rows."""
    rows = sorted(set(rows), key=str)
    if not rows:
        return None
    languages = sorted({lang for _, lang, _ in rows})
    windows, owner, weights = training_windows([t for _, _, t in rows], np.random.default_rng(5))
    return train(windows, np.array([languages.index(lang) for _, lang, _ in rows])[owner], weights, languages)


def predictor(net: Network | None):
    letter = regex.compile(r"\p{L}").search

    def run(texts: list) -> list[list]:
        found = [(UNKNOWN, 0.0)] * len(texts)
        held, owner, size, count = [], [], [], 0

        def flush() -> None:
            if not held:
                return
            weighted = forward(net, np.concatenate(held)) * np.concatenate(size)[:, None]
            at = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            mean = np.add.reduceat(weighted, at) / np.add.reduceat(np.concatenate(size), at)[:, None]
            for k, p in zip(owner, mean, strict=True):
                best = int(p.argmax())
                found[k] = net.languages[best], float(min(1.0, max(0.0, p[best])))
            held.clear(), owner.clear(), size.clear()

        for k, text in enumerate(texts):
            if net is None or not text or not letter(text):
                continue
            raw = text.encode().lower()
            windows = cut(raw)
            held.append(windows)
            owner.append(k)
            size.append(np.minimum(WINDOW, len(raw) - WINDOW * np.arange(len(windows))).astype(np.float64))
            count += len(windows)
            if count >= 4096:
                flush()
                count = 0
        flush()
        return list(map(list, zip(*found, strict=True))) or [[], []]

    return run


def with_language(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """Appends lang_pred and score."""
    return common.map_text(docs, lambda: predictor(net), [common.field("lang_pred", T.StringType()), common.field("score", T.DoubleType())], text)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = learn(common.documents(spark, sf_dir, "lang"))
    found = with_language(common.documents(spark, sf_dir), net)
    return found.select("doc_id", (common.fold(found, "doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
