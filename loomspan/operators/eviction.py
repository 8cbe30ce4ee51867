"""Which stored items to delete so that size, number and age stay within limits."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.scalars import size_bytes
from loomspan.plans.numbering import numbered


def items_to_delete(items: DataFrame, now, bytes_limit: int | str | None = None, items_limit: int | None = None, age_limit: timedelta | None = None) -> DataFrame:
    """Rows of ``items`` (item, size_bytes, last_access) to delete, least recently used first.

    Running sums over the order of access say how much lies before each item. Ties go by item.
    """
    if age_limit is not None and age_limit < timedelta(0):
        raise ValueError("an age can't be negative")
    if bytes_limit is None and items_limit is None and age_limit is None:
        return items.where(F.lit(False))
    df = numbered(items, "last_access", "item", as_="__rank", sum_of="size_bytes", sum_as="__before")
    total, n = items.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)), F.count("*")).first()
    gone = F.lit(False)
    if bytes_limit is not None:
        limit = size_bytes(bytes_limit) if isinstance(bytes_limit, str) else bytes_limit
        gone = gone | (F.col("__before") < total - limit)
    if items_limit is not None:
        gone = gone | (F.col("__rank") < n - items_limit)
    if age_limit is not None:
        gone = gone | (F.col("last_access") <= F.lit(now - age_limit).cast(items.schema["last_access"].dataType))
    return df.where(gone).select(*items.columns)
