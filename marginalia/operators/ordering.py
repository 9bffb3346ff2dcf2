"""A total order over many rows, numbered by range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def numbered(rows: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """The rows with their place from 1 in the order of the columns.

    Range partitions are numbered apart, and each starts after the rows of
    those before it, so no task orders more than its range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))  # a row a range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_before") + within).cast("int")).drop("_range", "_before")
