"""Exact dedup by content sort, with DataFrame functions only.

Texts are normalised (white space deleted), dealt out by sampled splitters over (prefix, hash), and sorted;
equal texts then stand side by side, and the sort's neighbouring comparisons of whole normalised texts form the groups.
Splitters are samples of a bounded key, so the driver never gets whole texts. A text that holds more than
1/512 of all rows is dealt out under 256 salts; the heads of its runs are merged afterwards, by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, parts_for, read

#: A text with more than 1/HOT_SHARE of the rows is split; so at most HOT_SHARE rows are broadcast.
HOT_SHARE = 512
SALTS = 256
PREFIX = 32


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _sorted(docs: DataFrame, doc_id: str, text: str, carried: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows beside their equals: carried columns, doc_id, n_chars, norm, hot, rank within a run of equals, head of the run; and the rows with hot
    texts alone. Which rows are hot, and by what hash, changes nothing but who is dealt where."""
    spark = docs.sparkSession
    norm = normalised(F.coalesce(F.col(text), F.lit("")))
    keyed = docs.select(*carried, F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_chars"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    counts = keyed.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("norm")).alias("bytes"))
    counts = cut(counts.filter("n > 1").unionByName(counts.filter("n = 1").agg(F.lit(None).cast("long").alias("h"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))))
    total, size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    hot = counts.filter((F.col("n") > max(1, total // HOT_SHARE)) & F.col("h").isNotNull()).select("h", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(SALTS)).cast("int")).otherwise(0)
    placed = keyed.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("salt", salt).withColumn("prefix", F.substring("norm", 1, PREFIX))
    if carried:  # what is normalised is carried already, so it is made again rather than shuffled twice
        placed = placed.drop("norm")
    dealt = placed.repartitionByRange(parts_for(spark, size), "prefix", "h", "salt")
    if carried:
        dealt = dealt.withColumn("norm", normalised(F.coalesce(F.col("whole")[text], F.lit(""))))
    run = W.partitionBy("prefix", "h", "salt", "norm")
    first = run.orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id"))
    head = F.first(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"))).over(first)
    ranked = dealt.withColumn("head", head).withColumn("rank", F.row_number().over(first)).withColumn("run_size", F.count("*").over(run))
    return ranked, keyed.join(F.broadcast(hot), "h", "left_semi")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("norm").cast("binary"), 256))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Of equal texts the row with the most code points, then
    the smallest doc_id (of any type with an order), stays; a null doc_id comes after all others. Rows that repeat a doc_id are rows of their own: of
    rows that tie in all, one is kept. Other columns of docs are not read, so their names can't clash."""
    ranked, _ = _sorted(docs, doc_id, text, [])
    runs = cut(ranked.select("doc_id", _digest().alias("sha"), "n_chars", "hot", "head", "rank", "run_size"))
    merged = runs.filter("hot AND rank = 1").groupBy("sha").agg(F.min("head").alias("best"), F.sum("run_size").alias("all"))
    out = runs.join(F.broadcast(merged), "sha", "left")
    head = F.when(F.col("hot"), F.col("best")).otherwise(F.col("head"))
    return out.select(
        "doc_id",
        head["id"].alias("keep_id"),
        F.when(F.col("hot"), F.col("all")).otherwise(F.col("run_size")).cast("long").alias("group_size"),
        ((F.col("rank") == 1) & (~F.col("hot") | (F.col("head") == F.col("best")))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that groups() keeps, with all their columns. They travel with their texts through the sort, so ids may repeat or be null."""
    ranked, hot = _sorted(docs, doc_id, text, [F.struct("*").alias("whole")])
    head = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"))
    best = hot.groupBy(_digest().alias("sha")).agg(F.min(head).alias("best"))  # as few rows as there are hot texts
    first = ranked.filter("rank = 1").withColumn("sha", F.when(F.col("hot"), _digest()))
    return first.join(F.broadcast(best), "sha", "left").filter(~F.col("hot") | (F.col("head") == F.col("best"))).select("whole.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""
