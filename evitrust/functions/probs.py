"""Class-probability columns: alignment, normalization, temperature, arg-max, mixing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def align_probabilities(df: DataFrame, labels: Sequence[str], prefix: str = "prob_") -> DataFrame:
    """One column per label in the given order; a class the model never saw gets 0."""
    rest = [c for c in df.columns if not c.startswith(prefix)]
    probs = [
        (F.coalesce(F.col(prefix + x), F.lit(0.0)) if prefix + x in df.columns else F.lit(0.0)).alias(prefix + x)
        for x in labels
    ]
    return df.select(*rest, *probs)


def normalized(probs: Sequence[Column]) -> list[Column]:
    """Rows scaled to sum 1; an all-zero row becomes uniform."""
    total = _sum(list(probs))
    k = float(len(probs))
    return [F.when(total > 0, p / F.when(total > 0, total)).otherwise(1.0 / k) for p in probs]


def tempered(probs: Sequence[Column], temperature: Column | float) -> list[Column]:
    """``p^(1/T)`` renormalized; T = 1 leaves the row untouched."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    powered = normalized([F.pow(p, 1.0 / t) for p in probs])
    return [F.when(t == 1.0, p).otherwise(q) for p, q in zip(probs, powered)]


def arg_max(probs: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the largest probability; the first one wins a tie."""
    best = F.greatest(*probs) if len(probs) > 1 else probs[0]
    out = F.when(probs[0] == best, F.lit(labels[0]))
    for p, label in list(zip(probs, labels))[1:]:
        out = out.when(p == best, F.lit(label))
    return out


def mixed(first: Sequence[Column], second: Sequence[Column], alpha: Column | float) -> list[Column]:
    """``(1-alpha)*first + alpha*second``, renormalized."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return normalized([(1 - a) * p + a * q for p, q in zip(first, second)])


def probability_of(label: Column, probs: Sequence[Column], labels: Sequence[str]) -> Column:
    """Probability of the class named in ``label``; null for an unknown class."""
    out = F.when(label == labels[0], probs[0])
    for p, x in list(zip(probs, labels))[1:]:
        out = out.when(label == x, p)
    return out


def right_closed_bin(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """``[e0,e1],(e1,e2],...`` labels; null outside the edges."""
    out = F.when((x >= edges[0]) & (x <= edges[1]), F.lit(names[0]))
    for lo, hi, name in list(zip(edges, edges[1:], names))[1:]:
        out = out.when((x > lo) & (x <= hi), F.lit(name))
    return out


MISSINGNESS_EDGES = [0.0, 0.25, 0.5, 0.75, 1.0]
MISSINGNESS_NAMES = ["<=0.25", "0.25-0.5", "0.5-0.75", ">0.75"]
