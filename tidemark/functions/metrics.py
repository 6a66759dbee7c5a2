"""Classification metrics as expressions over nine confusion counts c00..c22 (true, predicted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = [f"c{t}{p}" for t in range(3) for p in range(3)]


def confusion_counts(true: str = "y_true", predicted: str = "y_pred", classes: tuple[str, ...] = ("DOWN", "FLAT", "UP"), weight: Column | None = None) -> list[Column]:
    out = []
    for t, x in enumerate(classes):
        for p, y in enumerate(classes):
            hit = (F.col(true) == x) & (F.col(predicted) == y)
            out.append((F.count_if(hit) if weight is None else F.sum(F.when(hit, weight).otherwise(0))).alias(f"c{t}{p}"))
    return out


def zero_divide(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def from_confusion(prefix: str = "c") -> dict[str, Column]:
    """macro_f1 over all three classes, balanced accuracy over those that occur, and accuracy."""
    cell = lambda t, p: F.col(f"{prefix}{t}{p}").cast("double")
    add = lambda xs: sum(xs[1:], xs[0])
    true = [add([cell(k, p) for p in range(3)]) for k in range(3)]
    guessed = [add([cell(t, k) for t in range(3)]) for k in range(3)]
    total = add(true)
    recall = [zero_divide(cell(k, k), true[k]) for k in range(3)]
    f1 = [zero_divide(2 * cell(k, k), true[k] + guessed[k]) for k in range(3)]
    present = add([(t > 0).cast("int") for t in true])
    return {
        "macro_f1": add(f1) / 3,
        "balanced_accuracy": zero_divide(add(recall), present.cast("double")),
        "accuracy": zero_divide(add([cell(k, k) for k in range(3)]), total),
    }


def per_class(confusion: DataFrame, classes: tuple[str, ...] = ("DOWN", "FLAT", "UP")) -> DataFrame:
    """A row for each class: precision, recall, F1 and support."""
    cell = lambda t, p: F.col(f"c{t}{p}").cast("double")
    add = lambda xs: sum(xs[1:], xs[0])
    rows = []
    for k, name in enumerate(classes):
        true, guessed = add([cell(k, p) for p in range(3)]), add([cell(t, k) for t in range(3)])
        rows.append(
            F.struct(
                F.lit(name).alias("label"),
                zero_divide(cell(k, k), guessed).alias("precision"),
                zero_divide(cell(k, k), true).alias("recall"),
                zero_divide(2 * cell(k, k), true + guessed).alias("f1"),
                true.cast("long").alias("support"),
            )
        )
    keys = [c for c in confusion.columns if c not in CELLS]
    return confusion.select(*keys, F.inline(F.array(*rows)))
