"""Row numbers and running sums over a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.scratch import written


def numbered(df: DataFrame, *order: Column | str, as_: str = "position", sum_of: str | None = None, sum_as: str = "before") -> DataFrame:
    """``df`` with each row's 0-based place in the order and, if asked, the sum of ``sum_of`` over all rows before it.

    Rows are range-partitioned and sorted once, and written, so that partitions stay what they are.
    Places within a partition are local; the partitions' totals, one row each, give the offsets.
    """
    placed = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    placed = written(placed, "ordered")
    here, so_far = Window.partitionBy("__part").orderBy("__row"), Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(sum_of) if sum_of else F.lit(0)
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.coalesce(F.sum(value), F.lit(0)).alias("__s"))
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(so_far), F.lit(0)).alias("__s0"))
    out = placed.join(parts, "__part").withColumn(as_, (F.col("__n0") + F.row_number().over(here) - 1).cast("long"))
    if sum_of:
        out = out.withColumn(sum_as, F.col("__s0") + F.coalesce(F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.select(*df.columns, as_, *([sum_as] if sum_of else []))
