"""Scores as aggregate columns, and over sets and grids; all of them native."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def ratio(part: Column, whole: Column) -> Column:
    """0.0 over an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def accuracy(truth: Column, said: Column) -> Column:
    known = truth.isNotNull() & said.isNotNull()
    return F.count_if(known & (truth == said)) / F.nullif(F.count_if(known), F.lit(0))


def finite_mean(c: Column) -> Column:
    """Null, NaN and infinite values are left out."""
    return F.avg(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c))


def error_norms(pred: Column, truth: Column) -> dict[str, Column]:
    d = pred - truth
    return {"mae": F.avg(F.abs(d)), "max_error": F.max(F.abs(d)), "rmse": F.sqrt(F.avg(d * d)), "rel_l2": F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(truth * truth))}


def set_scores(pred: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two arrays as sets; 1.0 if both are empty."""
    both, p, t = F.size(F.array_intersect(pred, truth)), F.size(F.array_distinct(pred)), F.size(F.array_distinct(truth))
    none = (p == 0) & (t == 0)
    one = lambda c: F.when(none, F.lit(1.0)).otherwise(c)
    return {"set_precision": one(ratio(both, p)), "set_recall": one(ratio(both, t)), "set_f1": one(ratio(2 * both, p + t))}


def grid(a: Column, b: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: a + (b - a) * k / (n - 1))


def trapezoid(values: Column, step: Column) -> Column:
    inner = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return step * (inner - (F.element_at(values, 1) + F.element_at(values, -1)) / 2)
