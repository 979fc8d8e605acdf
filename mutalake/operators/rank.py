"""Global places in a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutalake.functions.session import settled


def with_place(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with a column of 1-based places in the order, which should be total.

    Range partitions are numbered apart and settled, since their bounds come from samples; a running total of their sizes, a number each, is added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()  # the partition in the upper, the row in the lower 33 bits
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", number)
    local = settled(parts).withColumn("part_", F.shiftrightunsigned("at_", 33).cast("int")).withColumn("local_", F.col("at_").bitwiseAND((1 << 33) - 1) + 1).drop("at_")
    sizes = local.groupBy("part_").agg(F.max("local_").cast("long").alias("size_"))
    entries = F.array_sort(F.collect_list(F.struct("part_", "size_")))
    totals = sizes.agg(entries.alias("all_")).select(F.explode("all_").alias("x_"), "all_").select(
        F.col("x_.part_").alias("part_"), F.aggregate(F.filter("all_", lambda y: y["part_"] < F.col("x_.part_")), F.lit(0).cast("long"), lambda a, y: a + y["size_"]).alias("before_"))
    return local.join(F.broadcast(totals), "part_").withColumn(name, F.col("before_") + F.col("local_")).drop("part_", "local_", "before_")
