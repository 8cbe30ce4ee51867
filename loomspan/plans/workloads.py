"""Workloads of mapped functions, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_means(df: DataFrame, position: str, value: str, window: int, stride: int, n: int) -> DataFrame:
    """Mean and count of ``value`` over windows of positions 0..n-1 that end before n; each row goes to the slices that hold it.

    An equi-grouping over exploded slice numbers: the work grows with window / stride, not with n.
    """
    last = (n - window - 1) // stride
    i = F.col(position)
    low = F.greatest(F.lit(0), F.floor((i - window) / stride) + 1)
    high = F.least(F.lit(last), F.floor(i / stride))
    slices = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
    rows = df.select(F.explode(slices).alias("slice"), F.col(value).alias("v"))
    return rows.groupBy("slice").agg(F.avg("v").alias("mean_value"), F.count("*").alias("n_values"))


def grid(df: DataFrame, parameters: dict[str, Column]) -> DataFrame:
    """A row for each row of ``df`` and each named column expression: parameter, result."""
    pairs = [x for k, v in parameters.items() for x in (F.lit(k), v.cast("double"))]
    return df.select("*", F.stack(F.lit(len(parameters)), *pairs).alias("parameter", "result"))


def shared_by_size(n_bytes: Column, is_object: Column, limit: int) -> Column:
    """Whether an argument is worth sharing once instead of sending with each task."""
    return ~is_object & (n_bytes > limit)
