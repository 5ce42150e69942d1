"""Dense numbers for the rows of a large table, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import materialise


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 0 to n - 1 in the given order.

    Rows are range-partitioned and numbered within each part; the parts' sizes,
    one row each, give the offsets. Rows that are equal in ``order`` get different
    numbers, in no defined order among them.
    """
    # Written once, as a second evaluation might cut the ranges elsewhere.
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parts.withColumn("_within", within).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (F.col("_before") + F.col("_within") - 1).cast("bigint")).drop("_part", "_within", "_before")
