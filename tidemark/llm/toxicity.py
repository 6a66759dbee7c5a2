"""Toxicity (operator 4): a factorization machine over hashed terms.

A document is its set of distinct terms, hashed to slots. The score is the logistic function of
``b + sum w_i + sum_{i<j} <v_i, v_j>``: the pairwise part learns combinations, such as an insult
together with a group mention, that additive weights miss. Slots get weights and factors if there is
evidence for them in the sample's distinct texts: their presence depends on the label, or their presence
together with another slot's depends on it beyond what both tell alone. The log-likelihood ratio that is
asked for is what so many tests give by chance and some more (``MARGINS``), and for single slots no more
than a share of what a perfect one would have, so that small samples have models too. Every pair of slots
that occur together is tested, however rare or common: pairs are counted text by text from an inverted
index over a bounded sample of the texts (``PAIR_SAMPLE``, a parameter), and only slots too rare for any pair
of theirs to have the evidence stay out. Weights and factors are fitted together by Adam with decay. Training takes a bounded sample of
labelled rows (``SAMPLE``, a parameter) in the order of a hash of the id, so the same tables give the
same model; scoring reads every whole text of all rows in one pass without a shuffle.

Defined results: null or empty texts and texts without terms score by the bias alone; with no labelled
rows, or only one class, every score is the share of toxic rows (0 without rows); of repeated label
rows the greatest label counts; repeated documents score alike; null labels aren't learnt from.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

SLOT_BITS, FACTORS, SAMPLE = 20, 4, 20_000
THRESHOLD = 0.7
#: Evidence (G2) that is asked for: of slots at most, and beyond what chance gives, for slots and for pairs; the share of a
#: perfect slot's that is enough; decay.
EVIDENCE, MARGINS, PERFECT, DECAY = 20.0, (4.0, 8.0), 0.25, 1e-4
#: Labelled texts that pairs are counted in, half of them of the rarer label if there are as many.
PAIR_SAMPLE = 1500
#: Pairs of slots in texts that are counted, and pairs that are judged, at a time: the tables of a judged pair take
#: some 400 bytes, and the fit is one task beside others in an executor's memory.
GATHER, JUDGED = 1 << 18, 1 << 14
#: Passes over the sample, and steps at least if it is small.
EPOCHS, STEPS = 30, 1800
#: Words end at ASCII characters other than letters and digits.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slot(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << SLOT_BITS) - 1)


def slots(text: str | None) -> np.ndarray:
    terms = set(text.encode().translate(FOLD).split()) if text else ()
    return np.unique(np.fromiter(map(slot, terms), np.int32, len(terms)))


@dataclass
class Machine:
    bias: float
    #: Slots that have weights, ascending, with their weights and factors.
    active: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self):
        """A function from texts to scores, which remembers which terms matter."""
        row_of = {int(s): k for k, s in enumerate(self.active)}
        rows = common.Memory(lambda term: row_of.get(slot(term), -1), 16 << 20)

        def score(text: str | None) -> float:
            logit = self.bias
            if text:
                found = set(map(rows.__getitem__, set(text.encode().translate(FOLD).split())))
                found.discard(-1)
                if found:
                    at = sorted(found)
                    v = self.factors[at]
                    logit += float(self.weights[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum())
            return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

        return score


def constant(share: float) -> Machine:
    share = min(max(share, 1e-12), 1 - 1e-12)
    return Machine(float(np.log(share / (1 - share))), np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    active = informative(rows, y)
    row_of = np.full(1 << SLOT_BITS, -1, np.int64)
    row_of[active] = np.arange(len(active))
    kept = [k[k >= 0] for k in (row_of[r] for r in rows)]
    bias, w, v = float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(active)), rng.normal(0, 0.01, (len(active), FACTORS))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, v)]
    step = 0
    batches = max(1, len(kept) // 250)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        order = rng.permutation(len(kept))
        for batch in np.array_split(order, batches):
            step += 1
            sizes = np.array([len(kept[k]) for k in batch])
            flat = np.concatenate([kept[k] for k in batch])
            doc = np.repeat(np.arange(len(batch)), sizes)
            sums = np.zeros((len(batch), FACTORS))
            squares = np.zeros(len(batch))
            np.add.at(sums, doc, v[flat])
            np.add.at(squares, doc, (v[flat] ** 2).sum(1))
            logit = bias + np.bincount(doc, w[flat], len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[batch]) / len(batch)
            gw = np.bincount(flat, error[doc], len(active)) + DECAY * w
            gv = np.zeros_like(v)
            np.add.at(gv, flat, error[doc, None] * (sums[doc] - v[flat]))
            gv += DECAY * v
            bias -= 0.5 * float(error.sum())
            for x, g, (m, s), rate in ((w, gw, state[0], 0.05), (v, gv, state[1], 0.01)):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return Machine(bias, active, w, v)


def informative(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Slots with evidence of their own or together with another slot, from the distinct texts."""
    seen: set[tuple[bytes, float]] = set()
    first = [k for k, r in enumerate(rows) if (own := (hashlib.blake2b(r.tobytes(), digest_size=16).digest(), y[k])) not in seen and not seen.add(own)]
    rows, y = [rows[k] for k in first], y[first]
    flat = [np.concatenate([np.empty(0, np.int32), *(r for r, t in zip(rows, y, strict=True) if t == k)]) for k in (0, 1)]
    occurring = np.unique(np.concatenate(flat))
    have = np.array([np.bincount(np.searchsorted(occurring, f), minlength=len(occurring)) for f in flat])
    del flat
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)
    if not total.all():
        return np.empty(0, np.int64)
    alone = likelihood_ratio(have[:, None], total)
    perfect = likelihood_ratio(np.array([[[0.0]], [[total[1]]]]), total)[0]
    single = min(EVIDENCE, 2 * np.log(len(occurring)) + MARGINS[0], PERFECT * perfect)
    rows, y = paired_sample(rows, y)
    have = np.zeros_like(have)
    for r, t in zip(rows, y, strict=True):
        have[int(t), np.searchsorted(occurring, r)] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()], float)
    found = pairs_with_evidence(rows, y, occurring, have, total, likelihood_ratio(have[:, None], total))
    return np.union1d(occurring[alone >= single], occurring[found.ravel()]).astype(np.int64)


def paired_sample(rows: list[np.ndarray], y: np.ndarray, most: int = PAIR_SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """At most so many texts: of the rarer label up to half of them, the rest of the other."""
    rarer = float(y.sum() * 2 <= len(y))
    own = np.flatnonzero(y == rarer)[: most // 2]
    at = np.sort(np.concatenate([own, np.flatnonzero(y != rarer)[: most - len(own)]]))
    return [rows[k] for k in at], y[at]


def likelihood_ratio(have: np.ndarray, total: np.ndarray) -> np.ndarray:
    """G2 of label against state, where ``have`` (label, state, ...) counts all states but the last, the rest."""
    cells = np.concatenate([have, total.reshape(2, 1, *[1] * (have.ndim - 2)) - have.sum(1, keepdims=True)], axis=1)
    expected = cells.sum(0) * (total / total.sum()).reshape(2, 1, *[1] * (have.ndim - 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(cells > 0, cells * np.log(cells / expected), 0).sum((0, 1))


def pair_bound(tests: float) -> float:
    return 2 * np.log(max(tests, 1)) + MARGINS[1]


def pairs_with_evidence(rows: list[np.ndarray], y: np.ndarray, tested: np.ndarray, have: np.ndarray, total: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of places in ``tested`` that occur together and tell about the label what they don't tell alone.

    The log-likelihood that a slot of n texts can add to another's is n (ln N + 1) at most, with N texts.
    """
    n = have.sum(0)
    sizes = np.array([len(r) for r in rows], float)
    bound = pair_bound(min((sizes * sizes).sum(), float(len(tested)) ** 2) / 2)
    able = np.flatnonzero(2 * n * (np.log(total.sum()) + 1) >= bound)
    if len(able) < 2:
        return np.empty((0, 2), np.int64)
    place = np.full(1 << SLOT_BITS, -1, np.int32)
    place[tested[able]] = np.arange(len(able))
    kept = [k[k >= 0] for k in (place[r] for r in rows)]
    ends = np.cumsum([len(k) for k in kept])
    flat = np.concatenate(kept)
    owner = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    # the occurrences of each slot, and how many slots follow in their texts, whose places ascend
    order = np.argsort(flat, kind="stable")
    after = ends[owner[order]] - order - 1
    first = np.searchsorted(flat[order], np.arange(len(able) + 1))
    counts, tell, toxic = have[:, able].astype(float), alone[able], (y > 0).astype(np.int64)
    spread, rarer = np.log(total.sum()) + 1, total.min()

    def following(start: int, stop: int) -> np.ndarray:
        """Of the slots from ``start`` to ``stop``: twice the place of (slot, slot that follows in a text), and the text's label."""
        at, more = slice(first[start], first[stop]), after[first[start] : first[stop]]
        follow = np.repeat(order[at] + 1 - np.concatenate([[0], np.cumsum(more)[:-1]]), more) + np.arange(more.sum())
        row = (flat[order[at]].astype(np.int64) - start) * len(able)
        return 2 * (np.repeat(row, more) + flat[follow]) + np.repeat(toxic[owner[order[at]]], more)

    held, out = [], []

    def judge(i: np.ndarray, j: np.ndarray, together: np.ndarray) -> None:
        # what so many common texts can tell at most, and what can be told by there being few of them
        can = 4 * (together[0] + together[1]) * spread + 4 * counts[:, i].sum(0) * counts[:, j].sum(0) / rarer >= bound
        i, j, both = i[can], j[can], together[:, can].astype(float)
        states = np.stack([both, counts[:, i] - both, counts[:, j] - both], axis=1)
        strong = likelihood_ratio(states, total) - tell[i] - tell[j] >= bound
        out.append(np.stack([able[i[strong]], able[j[strong]]], 1))

    work = np.concatenate([[0], np.cumsum(after)])[first]
    start = size = 0
    while start < len(able):
        # many slots with few that follow, or one with very many
        stop = max(start + 1, int(np.searchsorted(work, work[start] + GATHER, "right")) - 1)
        places = following(start, stop)
        if stop == start + 1 and 4 * len(places) > len(able):
            n_of = np.bincount(places, minlength=2 * len(able)).reshape(-1, 2)
            met = np.flatnonzero(n_of[:, 0] + n_of[:, 1])
            n_of = n_of[met].T
        else:
            places.sort()
            met, begin = np.unique(places >> 1, return_index=True)
            ones = np.add.reduceat(places & 1, begin) if len(met) else np.empty(0, np.int64)
            n_of = np.stack([np.diff(np.append(begin, len(places))) - ones, ones])
        held.append(np.stack([met // len(able) + start, met % len(able), *n_of]))
        size += len(met)
        start = stop
        if size > GATHER or start == len(able):
            found = np.concatenate(held, 1)
            held, size = [], 0
            for a in range(0, found.shape[1], JUDGED):
                judge(*found[:2, a : a + JUDGED], found[2:, a : a + JUDGED])
    return np.concatenate([np.empty((0, 2), np.int64), *out])


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", held_out: int | None = 1, folds: int = 3, sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y"))
    if held_out is not None:
        known = known.where(common.fold(known, "doc_id", folds) != held_out)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded by a parameter, so this side is as well
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    marked = common.map_text(joined, lambda: lambda texts: [[slots(t).tobytes() for t in texts]], [common.field("_slots", T.BinaryType())])
    return common.fitted(marked.select(F.col("doc_id").cast("long"), F.col("_y").cast("int"), "_slots"), fit)


def fit(rows: list[tuple]) -> Machine:
    """The machine of (doc_id, label, packed slots) rows."""
    found = sorted(rows)
    return train([np.frombuffer(s, np.int32) for _, _, s in found], np.array([y for _, y, _ in found]))


def with_scores(docs: DataFrame, model: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Appends score and predicted."""

    def make():
        score = model.scorer()

        def run(texts: list) -> list[list]:
            found = [score(t) for t in texts]
            return [found, [int(s >= threshold) for s in found]]

        return run

    return common.map_text(docs, make, [common.field("score", T.DoubleType()), common.field("predicted", T.IntegerType())], text)


def without_toxic(docs: DataFrame, model: Machine, text: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of ``docs``."""
    plain, (own,) = common.numbered(docs, text)
    return with_scores(plain, model, own).where("predicted = 0").select(plain.columns).toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = with_scores(docs, learn(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold(scored, "doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
