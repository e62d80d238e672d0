"""Numbers for rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import checkpoint_dir


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over tasks for all cores, by keys or evenly: a small file has few splits, however much work or memory its rows take afterwards."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of the keys: within ranges of it, behind the sum of the ranges before. Only one row a range meets in one task."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranged.withColumn("__within", within).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")
