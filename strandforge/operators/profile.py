"""Profiles of multiple alignments: weights, frequencies, effective numbers, consensus and scores, as group-bys over msa(msa, row, pos, code).

A code of 0 to 19 is a residue, 20 an unknown one, null or a negative one a gap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET, BACKGROUND, conditional
from ..plans.session import cut

PCA, PCB = 1.0, 1.5


def background(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(BACKGROUND)], "code int, background double")


def weights(msa: DataFrame) -> DataFrame:
    """msa, row, weight: position-based weights, shared out so that each alignment's add up to 1."""
    residue = msa.filter(F.col("code").between(0, 19))
    cells = residue.groupBy("msa", "pos", "code").agg(F.count("*").alias("n"))
    length = msa.filter("code >= 0").groupBy("msa", "row").agg(F.count("*").alias("residues"))
    share = residue.join(with_kinds(cells), ["msa", "pos", "code"]).groupBy("msa", "row").agg(F.sum(1.0 / (F.col("n") * F.col("kinds"))).alias("share"))
    return weighed(msa.select("msa", "row").distinct().join(length, ["msa", "row"], "left").join(share, ["msa", "row"], "left"))


def with_kinds(cells: DataFrame) -> DataFrame:
    """Cells (msa, pos, code, n) with how many kinds of residues their places have."""
    return cells.withColumn("kinds", F.count("*").over(W.partitionBy("msa", "pos")))


def weighed(rows: DataFrame) -> DataFrame:
    """msa, row, weight, rows of rows with their residues and shares."""
    raw = rows.select("msa", "row", (1e-6 + F.coalesce("share", F.lit(0.0)) / (F.coalesce("residues", F.lit(0)) + 30.0)).alias("raw"))
    total = raw.groupBy("msa").agg(F.sum("raw").alias("total"), F.count("*").alias("rows"))
    return raw.join(total, "msa").select("msa", "row", (F.col("raw") / F.col("total")).alias("weight"), "rows")


def frequencies(msa: DataFrame, weighted: DataFrame) -> DataFrame:
    """msa, pos, code, freq for all twenty codes of each place; a place without residues has the background."""
    sums = msa.filter(F.col("code").between(0, 19)).join(weighted, ["msa", "row"]).groupBy("msa", "pos", "code").agg(F.sum("weight").alias("w"))
    return shared_out(msa.select("msa", "pos").distinct(), sums)


def shared_out(places: DataFrame, sums: DataFrame) -> DataFrame:
    """Frequencies of places (msa, pos) from the weights of their residues, sums (msa, pos, code, w)."""
    every = places.crossJoin(F.broadcast(background(places.sparkSession)))
    filled = every.join(sums, ["msa", "pos", "code"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = F.sum("w").over(W.partitionBy("msa", "pos"))
    return filled.select("msa", "pos", "code", "background", F.when(total > 0, F.col("w") / total).otherwise(F.col("background")).alias("freq"))


def effective(msa: DataFrame, weighted: DataFrame, freq: DataFrame) -> DataFrame:
    """msa, pos, neff: the effective number of sequences of each place."""
    held = msa.filter("code >= 0").join(weighted, ["msa", "row"]).groupBy("msa", "pos").agg(F.sum("weight").alias("held"))
    return numbers(held, weighted, freq)


def numbers(held: DataFrame, weighted: DataFrame, freq: DataFrame) -> DataFrame:
    """Effective numbers from the weight that each place holds (msa, pos, held)."""
    spread = freq.groupBy("msa", "pos").agg(F.sum(F.when(F.col("freq") > 1e-10, -F.col("freq") * F.log2("freq")).otherwise(0.0)).alias("h"))
    whole = spread.groupBy("msa").agg(F.avg(F.pow(F.lit(2.0), F.col("h"))).alias("mean"))
    rows = weighted.groupBy("msa").agg(F.max("rows").alias("rows"))
    limit = F.greatest(F.lit(10.0), F.col("mean") + 1)
    full = spread.join(whole, "msa").join(rows, "msa").join(held, ["msa", "pos"], "left").withColumn("limit", limit)
    w = F.coalesce("held", F.lit(0.0)) - 1.0 / F.col("rows")
    scale = F.log2((F.col("limit") - F.col("mean")) / (F.col("limit") - 1))
    neff = F.when(w < 0, 1.0).otherwise(F.col("limit") - (F.col("limit") - 1) * F.pow(F.lit(2.0), scale * w))
    return full.select("msa", "pos", neff.alias("neff"))


def consensus(freq: DataFrame) -> DataFrame:
    """msa, pos, consensus: the residue that exceeds its background most, the first of equals, X if none does."""
    over = F.col("freq") - F.col("background")
    best = freq.groupBy("msa", "pos").agg(F.max(F.struct(over.alias("over"), (-F.col("code")).alias("first"))).alias("b"))
    letter = F.substring(F.lit(ALPHABET), 1 - F.col("b.first"), F.lit(1))
    return best.select("msa", "pos", F.when(F.col("b.over") > 1e-8, letter).otherwise("X").alias("consensus"))


def pssm(freq: DataFrame, neff: DataFrame, pca: float = PCA, pcb: float = PCB, bias: float = 0.0, given=None) -> DataFrame:
    """msa, pos, code, score, prob: eight times the log-odds of frequencies mixed with pseudocounts, the fewer sequences the more.

    given: half-bit scores that the pseudocounts follow, the integer scores without their bias if none."""
    spark = freq.sparkSession
    r = conditional(given)
    mixing = spark.createDataFrame([(a, b, float(r[a, b])) for a in range(20) for b in range(20)], "code int, b int, r double")
    expected = freq.select("msa", "pos", F.col("code").alias("b"), "freq").join(F.broadcast(mixing), "b").groupBy("msa", "pos", "code").agg(F.sum(F.col("r") * F.col("freq")).alias("g"))
    tau = F.least(F.lit(1.0), pca / (1 + F.col("neff") / pcb)) if pca > 0 else F.lit(0.0)
    both = freq.join(expected, ["msa", "pos", "code"]).join(neff, ["msa", "pos"])
    prob = (1 - tau) * F.col("freq") + tau * F.col("g")
    value = F.round(8 * F.log2(F.col("prob") / F.col("background")) + 8 * bias)
    score = F.when(F.col("prob") > 0, F.greatest(F.lit(-128.0), F.least(F.lit(127.0), value))).otherwise(-128.0)
    return both.withColumn("prob", prob).select("msa", "pos", "code", score.cast("int").alias("score"), "prob")


def profile(msa: DataFrame, pca: float = PCA, pcb: float = PCB, bias: float = 0.0, given=None) -> DataFrame:
    w = weights(msa)
    f = frequencies(msa, w)
    return pssm(f, effective(msa, w, f), pca, pcb, bias, given)


def _wide(p: DataFrame, x: str) -> DataFrame:
    """A row for each place, with its twenty probabilities."""
    each = [F.coalesce(F.sum(F.when(F.col("code") == k, F.col("prob"))), F.lit(0.0)).alias(f"{x}{k}") for k in range(20)]
    return p.groupBy("msa", "pos").agg(*each)


def _pair_score() -> Column:
    """Eight times the log-odds of two places p and q giving the same residue, within -128 and 127."""
    total = sum((F.col(f"p{k}") * F.col(f"q{k}") / F.lit(max(p, 1e-6)) for k, p in enumerate(BACKGROUND)), F.lit(0.0))
    value = F.round(8 * F.log2(F.greatest(total, F.lit(1e-6))))
    return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), value)).cast("int")


def column_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """The score of each place of one profile against each of another. A pair of places is one row of a cross join, so this is for profiles, not
    for databases of them."""
    a = cut(_wide(left, "p").withColumnsRenamed({"msa": "left_msa", "pos": "left_pos"}).repartition("left_msa", "left_pos"))
    b = cut(_wide(right, "q").withColumnsRenamed({"msa": "right_msa", "pos": "right_pos"}))
    return a.crossJoin(b).select("left_msa", "left_pos", "right_msa", "right_pos", _pair_score().alias("score"))


def facing_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_msa, right_msa, pos, score: each place of the left profiles against the same place of each right one."""
    a, b = _wide(left, "p").withColumnRenamed("msa", "left_msa"), _wide(right, "q").withColumnRenamed("msa", "right_msa")
    return a.join(b, "pos").select("left_msa", "right_msa", "pos", _pair_score().alias("score"))


assert math.isclose(sum(BACKGROUND), 1.0, abs_tol=1e-3)
