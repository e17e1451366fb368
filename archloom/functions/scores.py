"""Scores of edges and paths. Rounding is half away from zero on the scaled number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Confidence of an edge without evidence, by derivation kind.
BASE = {"hard": 0.50, "linked": 0.40, "inferred": 0.30}
BASE_OTHER = 0.15


def base_confidence(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, value in BASE.items():
        out = out.when(kind == name, F.lit(value))
    return out.otherwise(F.lit(BASE_OTHER))


def round_at(x: Column, digits: int) -> Column:
    return F.round(x * float(10**digits)) / float(10**digits)


def impact_score(product: Column, depth: Column) -> Column:
    return round_at(F.lit(100.0) * product * F.pow(F.lit(0.95), depth - 1), 2)


def path_cost(confidences: Column) -> Column:
    sure = F.transform(confidences, lambda c: F.when(c <= 0, F.lit(1.0)).otherwise(c))
    return round_at(F.aggregate(sure, F.lit(0.0), lambda a, c: a - F.ln(c)) + F.lit(0.05) * F.size(confidences), 4)


def path_score(confidences: Column) -> Column:
    sure = F.transform(confidences, lambda c: F.when(c <= 0, F.lit(1.0)).otherwise(c))
    n = F.size(confidences)
    return round_at(F.aggregate(sure, F.lit(1.0), lambda a, c: a * c) * F.when(n > 1, F.pow(F.lit(0.95), n - 1)).otherwise(F.lit(1.0)), 4)
