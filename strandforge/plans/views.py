"""The given tables as sequences, alignments and a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import codes, residues_of
from .session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", residues_of(F.col("text")).alias("seq"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", residues_of(F.col("text")).alias("seq"))


def nucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("doc_id", F.translate("seq", UPPER, BASES).alias("nt"))


def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of msa() as sequences: msa, row, seq."""
    return table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("msa"), F.col("doc_id").alias("row"), residues_of(F.col("text")).alias("seq"))


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment for each language: all letters of all its documents, as many columns as its longest row has and one at least.

    The gaps after a shorter row's end add nothing to any profile, so they aren't made; a row without letters is one gap."""
    docs = stacked(spark, sf_dir)
    place = F.when(F.col("seq") == "", F.array(F.lit(-1))).otherwise(codes(F.col("seq")))
    return docs.select("msa", "row", F.posexplode(place).alias("pos", "code"))


def items_msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items, from their first letters on, as one alignment."""
    items = queries(spark, sf_dir).filter("seq != ''")
    return items.select(F.lit("benchmark").alias("msa"), F.col("item_id").alias("row"), F.posexplode(codes(F.col("seq"))).alias("pos", "code"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxid, parent, rank, name: a root, regions, nations and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    root = spark.range(1).select(F.lit(1).cast("long").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("root").alias("rank"), F.lit("root").alias("name"))
    region = t("region").select((F.col("r_regionkey") + 10).cast("long"), F.lit(1).cast("long"), F.lit("region"), "r_name")
    nation = t("nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 10).cast("long"), F.lit("nation"), "n_name")
    supplier = t("supplier").select((F.col("s_suppkey") + 10000).cast("long"), (F.col("s_nationkey") + 100).cast("long"), F.lit("supplier"), "s_name")
    return root.union(region).union(nation).union(supplier)


def taxon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's hits: the suppliers of its lines, scored by price."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 10000).alias("taxid"), F.col("l_extendedprice").alias("score"))
