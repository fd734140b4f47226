"""How good a ranked list of hits is: labels, cumulative counts, precision and recall, hits before the first false one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def labelled(hits: DataFrame) -> DataFrame:
    """hits (query, target, score, q_family, t_family, q_fold, t_fold) with a verdict: tp for one family, ignored for one fold only, else fp. A
    query's hit on itself is dropped."""
    same = F.col("q_family") == F.col("t_family")
    fold = F.col("q_fold") == F.col("t_fold")
    return hits.filter("query != target").withColumn("verdict", F.when(same, "tp").when(fold, "ignored").otherwise("fp"))


def running(hits: DataFrame) -> DataFrame:
    """score, tp, fp so far: true and false hits at each score or better. Counts by score come first, so the one ordered pass
    over all scores sees a row for each distinct score."""
    by_score = hits.filter("verdict != 'ignored'").groupBy("score").agg(F.sum((F.col("verdict") == "tp").cast("long")).alias("t"), F.sum((F.col("verdict") == "fp").cast("long")).alias("f"))
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return by_score.select("score", F.sum("t").over(down).alias("tp"), F.sum("f").over(down).alias("fp"))


def before_first_false(hits: DataFrame) -> DataFrame:
    """query, found, possible: a query's true hits that score above its best false one, and all its true hits."""
    best_false = F.max(F.when(F.col("verdict") == "fp", F.col("score"))).over(W.partitionBy("query"))
    above = (F.col("verdict") == "tp") & (F.col("best").isNull() | (F.col("score") > F.col("best")))
    return hits.withColumn("best", best_false).groupBy("query").agg(F.sum(above.cast("long")).alias("found"), F.sum((F.col("verdict") == "tp").cast("long")).alias("possible"))
