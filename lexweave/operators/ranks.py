"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder

_IN_PARTITION = (1 << 33) - 1


def global_rank(rows: DataFrame, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``order``, which should have no ties.

    Rows are dealt by ranges of the order and sorted there. What a range begins at follows from the sizes of the ranges before it, a table of
    one row for each partition. The sorted rows are written to the shared folder in between, so ranges can't move.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_folder(spark, "ranked")
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)).alias("__at"))
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__before")
