"""Grouping and ordering that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import store

# monotonically_increasing_id() is (partition id << 33) + row number.
_ROW_BITS = 33


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the 1-based place of every row in a total order.

    Rows are range-sorted once and stored; only one count per task is combined
    (a table of as many rows as there are partitions), so no task sees all rows.
    """
    # Numbers are fixed in the stored rows; sorting again could place equal
    # rows differently.
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row").withColumn(
        "_id", F.monotonically_increasing_id()
    )
    rows = store(rows, "ordered").withColumn("_p", F.shiftright("_id", _ROW_BITS))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id") - F.shiftleft(F.col("_p"), _ROW_BITS)
    return rows.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_off") + local + 1).drop("_id", "_p", "_off")
