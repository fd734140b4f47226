"""FASTA files, multiple alignments and taxonomy dumps as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET


def _records(spark: SparkSession, path: str) -> DataFrame:
    """file, place, header, body (lines after the header without comments) of each record. Spark splits files at record starts; gzip files go
    to one task each."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("v"))
    lines = F.filter(F.split(F.regexp_replace("v", "^(?:;[^\n]*\n|\\s*\n)*>?", ""), "\r?\n"), lambda x: ~x.startswith(";"))
    return raw.select("file", "place", lines.alias("l")).select("file", "place", F.trim(F.coalesce(F.get("l", F.lit(0)), F.lit(""))).alias("header"), F.array_join(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), "").alias("body")).filter("header != '' OR body != ''")


def numbered(df: DataFrame, place: str, to: str = "ordinal") -> DataFrame:
    """df with its rows counted from 0 in the order of a monotonically increasing id: the partitions' sizes run up, then each partition's own count."""
    split = df.withColumn("__part", F.shiftright(F.col(place), 33)).withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(place)) - 1)
    sizes = split.groupBy("__part").agg(F.count("*").alias("__n"))
    run = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    return split.join(F.broadcast(before), "__part").withColumn(to, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, id (the header's first word), header, seq of each record. Blanks, gaps and one last `*` go; letters are made capitals. A record
    without a header or residues, or with other characters, is an error."""
    bare = F.upper(F.regexp_replace("body", r"[\s.-]", ""))
    seq = F.regexp_replace(bare, r"\*$", "")
    wrong = F.when(F.col("header") == "", "a record has no header").when(seq == "", F.concat(F.lit("no residues: "), "header")).when(seq.rlike(r"[^A-Z*]"), F.concat(F.lit("not residues: "), "header"))
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat("file", F.lit(": "), wrong)).cast("string")).otherwise(seq)
    rows = numbered(_records(spark, path), "place")
    return rows.select("ordinal", F.split("header", r"\s+")[0].alias("id"), "header", checked.alias("seq"))


def msa(spark: SparkSession, path: str, name: str = "msa") -> DataFrame:
    """msa, row, pos, code of an alignment. With small letters these are insertions and go; without, the columns where the first row has a residue
    stay, and rows are padded or cut to the first."""
    rows = numbered(_records(spark, path), "place", "row").select("row", F.split(F.regexp_replace("body", r"\s", ""), "").alias("c"))
    small = rows.select(F.max(F.exists("c", lambda x: x.rlike("[a-z]"))).alias("small"))
    first = rows.filter("row = 0").select(F.filter(F.transform("c", lambda x, i: F.when(~x.isin("-", "."), i)), lambda i: i.isNotNull()).alias("at"))
    both = rows.crossJoin(F.broadcast(small)).crossJoin(F.broadcast(first))
    kept = F.when(F.col("small"), F.filter("c", lambda x: ~x.rlike("[a-z.]"))).otherwise(F.transform("at", lambda i: F.coalesce(F.get("c", i), F.lit("-"))))
    each = both.select("row", F.posexplode(kept).alias("pos", "letter"))
    code = F.when(F.col("letter").isin("-", "."), F.lit(-1)).otherwise(F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col("letter")), F.lit(0)), F.lit(21)) - 1)
    return each.select(F.lit(name).alias("msa"), "row", "pos", code.alias("code"))


def _fields(spark: SparkSession, path: str) -> Column:
    return F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """taxid, parent, rank; rows of fewer than three fields or without numbers are skipped."""
    f = _fields(spark, path)
    rows = spark.read.text(path).filter(F.size(f) >= 3)
    return rows.select(f[0].try_cast("long").alias("taxid"), f[1].try_cast("long").alias("parent"), f[2].alias("rank")).dropna(subset=["taxid", "parent"])


def names(spark: SparkSession, path: str) -> DataFrame:
    """taxid, name: the scientific names."""
    f = _fields(spark, path)
    return spark.read.text(path).filter((F.size(f) >= 4) & (f[3] == "scientific name")).select(f[0].try_cast("long").alias("taxid"), f[1].alias("name")).dropna(subset=["taxid"])


def sequence_taxa(spark: SparkSession, path: str) -> DataFrame:
    """id, taxid, split by tab or comma; of an id's rows the last counts."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).withColumn("f", F.split("value", "[\t,]"))
    known = rows.filter(F.size("f") >= 2).select("at", F.col("f")[0].alias("id"), F.col("f")[1].try_cast("long").alias("taxid")).dropna(subset=["taxid"])
    return known.groupBy("id").agg(F.max_by("taxid", "at").alias("taxid"))
