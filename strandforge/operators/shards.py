"""Shards of a database: runs of ordinals with about equal residues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import cut


def prefix_sums(df: DataFrame, order: str, value: str, to: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows that come before in `order`.

    Ranges of the order are summed first and their sums run up, so that no single task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"), F.min(order).alias("__first"))
    run = W.orderBy("__first").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__range", F.coalesce(F.sum("__sum").over(run), F.lit(0)).alias("__offset"))
    within = W.partitionBy("__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "__range").withColumn(to, F.col("__offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__range", "__offset")


def balanced(sequences: DataFrame, order: str, shards: int) -> DataFrame:
    """sequences (order, len) with a shard: a sequence belongs to the shard in which its middle residue falls."""
    total = sequences.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    middle = F.col("before") + F.floor(F.col("len") / 2)
    bounds = [total * (s + 1) // shards for s in range(shards - 1)]
    shard = sum(((middle >= b).cast("int") for b in bounds), F.lit(0))
    return prefix_sums(sequences, order, "len").withColumn("shard", shard)
