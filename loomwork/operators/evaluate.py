"""Calibration and accuracy measures as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ten equal bins of [0, 1]; the edges are those of a linear grid in binary floating point, so values at 0.3, 0.6 and 0.7
#: fall where a grid puts them. The last bin is closed.
EDGES = [i * 0.1 for i in range(10)] + [1.0]


def curve(rows: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """(bin, n, conf, acc) for bins with rows; rows with a null value are left out."""
    at = sum((F.when(F.col(conf) >= e, 1).otherwise(0) for e in EDGES[1:-1]), F.lit(1))
    return rows.where(F.col(conf).isNotNull() & F.col(correct).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("conf"), F.avg(correct).alias("acc"))


def errors(rows: DataFrame, conf: str = "conf", correct: str = "correct") -> DataFrame:
    """One row: expected calibration error and Brier score."""
    ece = curve(rows, conf, correct).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))
    brier = rows.agg(F.avg(F.pow(F.col(conf) - F.col(correct), F.lit(2.0))).alias("brier"))
    return ece.crossJoin(brier)  # one row each


def summary(rows: DataFrame, by: str, means: dict[str, str] = {}, ratios: dict[str, tuple[str, str]] = {}, counts: dict[str, Column] = {}) -> DataFrame:
    """(by, n, ...): means of columns, sums of one column over sums of another, and counts of rows, for each variant."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.col(c).cast("double")), 4).alias(k) for k, c in means.items()],
        *[F.round(F.try_divide(total(a), total(b)), 6).alias(k) for k, (a, b) in ratios.items()],
        *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()],
    )


def set_scores(rows: DataFrame, key: str, found: str, truth: str) -> DataFrame:
    """(key, precision, recall, f1) of two arrays as sets; 0 where a measure has no base."""
    a, b = F.array_distinct(found), F.array_distinct(truth)
    hit, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return rows.select(key, share(hit, n).alias("precision"), share(hit, m).alias("recall"), share(2 * hit, n + m).alias("f1"))
