"""Taxonomy: paths to the root, and the lowest common ancestor of a query's hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import cut


def paths(nodes: DataFrame) -> DataFrame:
    """taxid, path: from each node to its root. nodes: taxid, parent. A root is its own parent or has an unknown one; a path that would meet a node
    twice ends before it. Each round appends the path of a path's last parent, so rounds grow with the logarithm of the depth."""
    rows = nodes.groupBy("taxid").agg(F.min("parent").alias("parent"))
    known = rows.select(F.col("taxid").alias("parent")).distinct()
    rows = rows.join(known.withColumn("known", F.lit(True)), "parent", "left")
    up = F.when(F.col("known") & (F.col("parent") != F.col("taxid")), F.col("parent"))
    now = cut(rows.select("taxid", F.array("taxid").alias("path"), up.alias("next")))
    while not now.filter("next IS NOT NULL").isEmpty():
        above = now.toDF("above", "more", "after")
        joined = now.join(above, F.col("next") == F.col("above"), "left")
        new = F.array_except("more", "path")
        loops = F.size(new) < F.size("more")
        now = cut(
            joined.select(
                "taxid",
                F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", new)).alias("path"),
                F.when(F.col("after").isNotNull() & ~loops & ~F.array_contains("path", F.col("after")), F.col("after")).alias("next"),
            )
        )
    return now.select("taxid", "path")


def kept(hits: DataFrame, q: str, fraction: float) -> DataFrame:
    """The hits (q, taxid, score) within a fraction of the query's best score; a fraction of 0 keeps all."""
    if fraction <= 0:
        return hits
    best = F.max("score").over(W.partitionBy(q))
    return hits.withColumn("best", best).filter(F.col("score") >= F.col("best") * (1 - fraction)).drop("best")


#: Hits that a task is dealt, and nodes on paths that are handed to all tasks.
DEALT, HANDED = 1 << 20, 1 << 23


def dealt(hits: DataFrame, q: str) -> DataFrame:
    """The hits by query, in as many tasks as they need, however many there are."""
    spark = hits.sparkSession
    return hits.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hits.count() // DEALT)), q)


def lca(hits: DataFrame, path: DataFrame, q: str, fraction: float = 0.0) -> DataFrame:
    """q, taxid, assigned: the deepest node above all known taxa of a query's hits, null if none is known; how many distinct taxa the hits have.
    fraction: of the hits that are kept() by it.

    In the order of their paths from the root, all nodes below one stand side by side. So the first and the last of a query's taxa have the ancestor of
    all of them, and no hit meets its path. Hits are dealt by query once. Nodes whose parents lead in a circle have no such order and are counted."""
    taxa = kept(dealt(hits, q), q, fraction).select(q, "taxid").distinct()
    nodes = path.agg(F.coalesce(F.sum(F.size("path")), F.lit(0))).first()[0]
    near = F.broadcast if nodes <= HANDED else lambda df: df
    ends = path.select(F.element_at("path", -1).alias("taxid")).distinct()
    if not path.join(ends, "taxid", "left_semi").filter(F.size("path") > 1).isEmpty():
        return _counted(taxa, near(path), q)
    placed = cut(path.orderBy(F.reverse("path")).withColumn("number", F.monotonically_increasing_id()))
    numbers = near(placed.select("taxid", "number"))
    span = taxa.join(numbers, "taxid", "left").groupBy(q).agg(F.count("taxid").alias("assigned"), F.min("number").alias("first"), F.max("number").alias("last"))
    one, other = near(placed.select(F.col("number").alias("first"), F.col("path").alias("up"))), near(placed.select(F.col("number").alias("last"), F.col("path").alias("above")))
    common = F.filter("up", lambda x: F.array_contains("above", x))
    return span.join(one, "first", "left").join(other, "last", "left").select(q, F.get(common, F.lit(0)).alias("taxid"), "assigned")


def _counted(taxa: DataFrame, path: DataFrame, q: str) -> DataFrame:
    """lca() of distinct taxa: a node is common if as many of them pass through it as the query has."""
    assigned = taxa.groupBy(q).agg(F.count("taxid").alias("assigned"))
    known = taxa.join(path, "taxid")
    through = known.select(q, "taxid", F.posexplode(F.reverse("path")).alias("depth", "node"))
    counts = through.groupBy(q, "node").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    total = known.groupBy(q).agg(F.count("*").alias("total"))
    common = counts.join(total, q).filter("n = total").groupBy(q).agg(F.max_by("node", "depth").alias("taxid"))
    return assigned.join(common, q, "left").select(q, "taxid", "assigned")
