"""Batch sizes: fixed, look-ahead and automatic, as plain functions and as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds that a batch should take at least and at most; a remote cluster's upper bound is lower.
SHORTEST, LONGEST, LONGEST_REMOTE = 0.2, 2.0, 1.0
OLD_SHARE = 0.8


def batch_number(position: Column, size: int) -> Column:
    """Number of the batch that holds a 1-based position."""
    return F.floor((position - 1) / size).cast("long")


def look_ahead(n_pulled: int, n_jobs: int, at_end: bool) -> int:
    """Size of the pieces that a look-ahead slice is cut into; smaller ones at the end of the input."""
    return max(1, n_pulled // (10 * n_jobs if at_end else n_jobs))


def look_ahead_col(n_pulled: Column, n_jobs: int, at_end: bool) -> Column:
    return F.greatest(F.lit(1), F.floor(n_pulled / (10 * n_jobs if at_end else n_jobs))).cast("long")


@dataclass
class BatchTuner:
    """Follows the durations of completed batches; a smoothed duration of 0 means no sample yet."""

    shortest: float = SHORTEST
    longest: float = LONGEST
    size: int = 1
    smoothed: float = 0.0

    def completed(self, size: int, duration: float) -> None:
        if size == self.size:  # a sample of an old size says nothing of the present one
            self.smoothed = duration if not self.smoothed else OLD_SHARE * self.smoothed + (1 - OLD_SHARE) * duration

    def next_size(self) -> int:
        old, d, new = self.size, self.smoothed, self.size
        if 0 < d < self.shortest:
            new = max(1, min(2 * old, 2 * int(old * self.shortest / d)))
        elif d > self.longest and old >= 2:
            new = max(1, 2 * int(old * self.shortest / d))
        if new != old:
            self.size, self.smoothed = new, 0.0
        return self.size

    def reset(self) -> None:
        self.size, self.smoothed = 1, 0.0


def smoothed(durations: Column) -> Column:
    """Smoothed duration after an array of samples."""
    return F.aggregate(durations, F.lit(0.0), lambda a, d: F.when(a == 0, d).otherwise(OLD_SHARE * a + (1 - OLD_SHARE) * d))


def tuned_size(durations: Column, shortest: float = SHORTEST, longest: float = LONGEST) -> Column:
    """Batch size after an array of samples, each taken at the size in force then."""
    pair = lambda size, s: F.struct(size.cast("long").alias("size"), s.cast("double").alias("s"))

    def step(a: Column, d: Column) -> Column:
        s = F.when(a["s"] == 0, d).otherwise(OLD_SHARE * a["s"] + (1 - OLD_SHARE) * d)
        fit = 2 * F.floor(a["size"] * shortest / s)
        new = F.when((s > 0) & (s < shortest), F.greatest(F.lit(1), F.least(2 * a["size"], fit))).when((s > longest) & (a["size"] >= 2), F.greatest(F.lit(1), fit)).otherwise(a["size"])
        return pair(new, F.when(new != a["size"], 0.0).otherwise(s))

    return F.aggregate(durations, pair(F.lit(1), F.lit(0.0)), step, lambda a: a["size"])
