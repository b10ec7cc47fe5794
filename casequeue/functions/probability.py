"""Class probabilities held as one array per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Max-shifted softmax of an array of doubles at a temperature."""
    heat = F.greatest(
        temperature if isinstance(temperature, Column) else F.lit(float(temperature)),
        F.lit(1e-6),
    )
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp((x - top) / heat))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)


def argmax_class(probabilities: Column, classes: Sequence[str]) -> Column:
    """Class of the first largest probability."""
    names = F.array(*[F.lit(str(name)) for name in classes])
    best = F.array_position(probabilities, F.array_max(probabilities))
    return F.element_at(names, best.cast("int"))


def class_index(label: Column, classes: Sequence[str]) -> Column:
    """One-based position of a label in the classes; 0 when unseen."""
    names = F.array(*[F.lit(str(name)) for name in classes])
    return F.array_position(names, label.cast("string"))
