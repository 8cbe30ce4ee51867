"""Streaming forms of batch statistics and of expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomspan.operators.batching import OLD_SHARE


def running_smoothed(samples: DataFrame, key: str, duration: str) -> DataFrame:
    """The smoothed duration of every key after each micro-batch; one number of state a key.

    Samples of one micro-batch are taken in the order of ``duration``'s row order within a key.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (0.0,)
        for df in frames:
            for d in df[duration].tolist():
                now = d if now == 0 else OLD_SHARE * now + (1 - OLD_SHARE) * d
        state.update((now,))
        yield pd.DataFrame({key: [k[0]], "smoothed": [now]})

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, smoothed double", "now double", "update", GroupStateTimeout.NoTimeout)


def first_calls(calls: DataFrame, key: list[str], time: str, valid_for: str) -> DataFrame:
    """Calls whose result isn't held any more: the first of each key within ``valid_for``; state ends with the watermark."""
    timed = calls.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, valid_for)
    return timed.dropDuplicatesWithinWatermark(key)
