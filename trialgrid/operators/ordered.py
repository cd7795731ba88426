"""Order within groups of any size: running totals by ranges of rows, the first few rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.storage import shared_path


def running_totals(df: DataFrame, group: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """df with `name`, the sum of the weights of the rows before each one in its group; rows must differ in group and order.

    Rows are dealt by ranges of group and order, so a group of any size is cut into ranges; a window runs within a range only, and what the ranges
    before hold of a group is added from one row for each group and range. The ranges are written, as a second look at them must find them alike."""
    spark, kept = df.sparkSession, df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "ranges")
    dealt = df.withColumn("_weight", weight.cast("bigint")).repartitionByRange(parts, *group, *order)
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_part").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that has the group
    starts = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    local = rows.withColumn("_own", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    return local.join(starts, same).select(*kept, (F.col("_start") + F.col("_own")).alias(name))


def first_rows(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; tasks send k rows of a group at most."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
