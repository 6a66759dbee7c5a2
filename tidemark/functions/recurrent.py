"""A small recurrent classifier in numpy: one LSTM for each branch of features, their last states side by side, one linear layer.

Trained by Adam on mini-batches with back-propagation through time; the epoch with the best macro F1 on
validation rows is the one that is kept. All of it runs inside a task on the rows of one model.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
BETAS, TINY = (0.9, 0.999), 1e-8


def initial(branches: list[int], hidden: int, classes: int, rng: np.random.Generator) -> Weights:
    """Uniform weights; ``branches`` are the numbers of features."""
    wide = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
    out = {}
    for k, n in enumerate(branches):
        out |= {f"x{k}": wide(hidden, n, 4 * hidden), f"h{k}": wide(hidden, hidden, 4 * hidden), f"b{k}": wide(hidden, 4 * hidden)}
    last = hidden * len(branches)
    return out | {"head": wide(last, last, classes), "bias": wide(last, classes)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(w: Weights, parts: list[np.ndarray]) -> tuple[np.ndarray, list]:
    """Class probabilities of sequences (rows, steps, features), one array for each branch, and what the way back needs."""
    states, tapes = [], []
    for k, x in enumerate(parts):
        hidden = w[f"h{k}"].shape[0]
        h = c = np.zeros((len(x), hidden))
        tape = []
        for step in range(x.shape[1]):
            gates = x[:, step] @ w[f"x{k}"] + h @ w[f"h{k}"] + w[f"b{k}"]
            i, f, o = (sigmoid(gates[:, a * hidden : (a + 1) * hidden]) for a in (0, 1, 3))
            g = np.tanh(gates[:, 2 * hidden : 3 * hidden])
            before, c = c, f * c + i * g
            wide = np.tanh(c)
            tape.append((h, before, i, f, g, o, wide))
            h = o * wide
        states.append(h)
        tapes.append(tape)
    joined = np.concatenate(states, 1)
    logits = joined @ w["head"] + w["bias"]
    odds = np.exp(logits - logits.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True), [joined, tapes]


def gradients(w: Weights, parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, Weights]:
    """Weighted mean cross entropy and its gradient."""
    proba, (joined, tapes) = forward(w, parts)
    share = np.ones(len(y)) if weight is None else weight[y]
    share = share / share.sum()
    rows = np.arange(len(y))
    loss = -float(share @ np.log(np.maximum(proba[rows, y], 1e-300)))
    back = proba * share[:, None]
    back[rows, y] -= share
    out = {"head": joined.T @ back, "bias": back.sum(0)}
    into = back @ w["head"].T
    start = 0
    for k, (x, tape) in enumerate(zip(parts, tapes, strict=True)):
        hidden = w[f"h{k}"].shape[0]
        dh, dc = into[:, start : start + hidden], 0.0
        start += hidden
        dx, dw, db = (np.zeros_like(w[f"{n}{k}"]) for n in "xhb")
        for step in range(x.shape[1] - 1, -1, -1):
            h, before, i, f, g, o, wide = tape[step]
            dc = dc + dh * o * (1 - wide * wide)
            gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * wide * o * (1 - o)], 1)
            dx += x[:, step].T @ gates
            dw += h.T @ gates
            db += gates.sum(0)
            dh, dc = gates @ w[f"h{k}"].T, dc * f
        out |= {f"x{k}": dx, f"h{k}": dw, f"b{k}": db}
    return loss, out


def macro_f1(y: np.ndarray, predicted: np.ndarray, classes: int) -> float:
    """Mean F1 over all classes; one that neither occurs nor is predicted counts 0."""
    counts = np.bincount(y * classes + predicted, minlength=classes * classes).reshape(classes, classes).astype(float)
    both = counts.sum(0) + counts.sum(1)
    return float(np.mean(np.divide(2 * np.diag(counts), both, out=np.zeros(classes), where=both > 0)))


def probabilities(w: Weights, parts: list[np.ndarray], rows: int = 4096) -> np.ndarray:
    """In slices, so that memory doesn't grow with the rows."""
    n = len(parts[0])
    return np.concatenate([forward(w, [x[a : a + rows] for x in parts])[0] for a in range(0, n, rows)] or [np.zeros((0, len(w["bias"])))])


def fit(parts: list[np.ndarray], y: np.ndarray, val_parts: list[np.ndarray], val_y: np.ndarray, classes: int = 3, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 1e-3, patience: int = 6, seed: int = 42, weight: np.ndarray | None = None) -> tuple[Weights, dict]:
    """Trained weights and the history: losses and validation scores by epoch, the best epoch (from 1) and its score.

    Training ends after ``patience`` epochs without a better validation score and gives the weights of the
    best epoch; without validation rows those of the last one. Validation rows are scored only.
    """
    if min(epochs, batch, patience) < 1:
        raise ValueError("epochs, batch and patience must be at least 1")
    if not len(y):
        raise ValueError("no rows to train on")
    rng = np.random.default_rng(seed)
    w = initial([x.shape[2] for x in parts], hidden, classes, rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    losses, scores, steps, best, kept = [], [], 0, 0, w
    for epoch in range(1, epochs + 1):
        order, total = rng.permutation(len(y)), 0.0
        for a in range(0, len(y), batch):
            at = order[a : a + batch]
            loss, grad = gradients(w, [x[at] for x in parts], y[at], weight)
            total += loss * len(at)
            steps += 1
            for k, g in grad.items():
                first[k] += (1 - BETAS[0]) * (g - first[k])
                second[k] += (1 - BETAS[1]) * (g * g - second[k])
                w[k] = w[k] - rate * (first[k] / (1 - BETAS[0] ** steps)) / (np.sqrt(second[k] / (1 - BETAS[1] ** steps)) + TINY)
        losses.append(total / len(y))
        if not len(val_y):
            best, kept = epoch, w
            continue
        scores.append(macro_f1(val_y, probabilities(w, val_parts).argmax(1), classes))
        if not best or scores[-1] > scores[best - 1]:
            best, kept = epoch, dict(w)
        elif epoch - best >= patience:
            break
    return kept, {"losses": losses, "val_scores": scores, "best_epoch": best, "best_val_macro_f1": scores[best - 1] if scores else None}
