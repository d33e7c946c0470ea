"""Dense positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.config import ensure_checkpoint_dir


def dense_positions(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group 0, 1, ... by ``order``, which must be unique in the group.

    Only the keys are range-partitioned, so one group that holds most of the rows is spread over
    many ranges. A row's position is its place in its range plus the group's rows in earlier
    ranges. The ranges are written once, because a second sampling could draw other bounds; the
    rows themselves meet their position in one join on unique keys.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*group, *order]
    ranged = df.select(*keys).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*group, "__range").orderBy(*order)
    numbered = (
        ranged.withColumn("__at", F.row_number().over(within) - 1)
        .join(offsets, [*group, "__range"])
        .select(*keys, (F.col("__at") + F.col("__offset")).cast("bigint").alias(out))
    )
    return df.join(numbered, keys)
