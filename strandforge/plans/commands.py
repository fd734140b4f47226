"""What a user asks for by name, beside search: translated search, aligned rows, taxonomy of hits, pairwise alignment, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET
from ..operators import alignment, taxonomy, translation
from ..operators.alignment import Scoring
from ..sources import database
from ..sources.writers import a3m_row, write_fasta
from .search import search, totals
from .session import cut, ship


def translatesearch(nucleotides: DataFrame, targets: DataFrame, key: str, t: str, nt: str = "nt", least: int = 20, **given) -> DataFrame:
    """The hits of the open reading frames, of `least` residues or more, of nucleotides (key, nt). A frame is named key_fframe_nt_start, in the
    column `orf`. No frame at all is an error."""
    found = translation.orfs(nucleotides, key, nt, least).filter("aa != ''")
    name = F.concat(F.col(key).cast("string"), F.lit("_f"), "frame", F.lit("_"), "nt_start")
    frames = cut(found.select(name.alias("orf"), F.col("aa").alias("seq")))
    if frames.isEmpty():
        raise ValueError("no open reading frames")
    return search(frames, targets, "orf", t, **given)


def result2msa(hits: DataFrame, queries: DataFrame, targets: DataFrame, q: str, t: str) -> DataFrame:
    """q, line, target (null for the query itself), row: each query, as line 0, and its hits laid against it in their order. Queries without hits stand alone."""
    asked = queries.select(q, F.upper("seq").alias("qseq"))
    held = targets.select(t, F.upper("seq").alias("tseq"))
    row = a3m_row(F.length("qseq"), F.col("tseq"), F.col("qstart"), F.col("tstart"), F.col("cigar"))
    laid = hits.join(asked, q).join(held, t).select(q, F.col("rank").alias("line"), F.col(t).alias("target"), row.alias("row"))
    return laid.unionByName(asked.select(q, F.lit(0).alias("line"), F.lit(None).cast(targets.schema[t].dataType).alias("target"), F.col("qseq").alias("row")))


def family(hits: DataFrame, queries: DataFrame, targets: DataFrame, q: str, t: str) -> DataFrame:
    """msa (the query), row (its line), pos, code of queries and the hits laid against them, as profiles are built from."""
    laid = result2msa(hits, queries, targets, q, t)
    letters = laid.select(F.col(q).alias("msa"), F.col("line").alias("row"), F.posexplode(F.split(F.regexp_replace("row", "[a-z]", ""), "")).alias("pos", "letter"))
    code = F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col("letter")), F.lit(0)), F.lit(21)) - 1
    return letters.filter("letter NOT IN ('-', '')").select("msa", "row", "pos", code.alias("code"))


def createdb(spark: SparkSession, source: str, path: str, nucleotide: bool = False) -> tuple[int, list[str]]:
    """Writes FASTA or a database as a database; how many entries it has, and warnings."""
    found, warnings = database.load(spark, source, nucleotide)
    return database.write(found, "ordinal", path, "header", nucleotide, source.rstrip("/").rsplit("/", 1)[-1]), warnings


def convert2fasta(spark: SparkSession, source: str, path: str, nucleotide: bool = False) -> list[str]:
    """Writes a database or FASTA as FASTA, a line a sequence with its whole header; warnings."""
    found, warnings = database.load(spark, source, nucleotide)
    write_fasta(found.orderBy("ordinal"), "ordinal", path, 0, "header")
    return warnings


def align(query: DataFrame, targets: DataFrame, q: str, t: str) -> DataFrame:
    """The best local alignment of one query, without composition bias, with each target that has one with a score above 0."""
    if query.count() != 1:
        raise ValueError("align takes one query")
    ship(query.sparkSession)
    scoring = Scoring(bias=False)
    asked = cut(alignment.spaced(query.select(q, F.upper("seq").alias("qseq")), scoring, *totals(targets), float("inf")))
    pairs = targets.select(t, F.col("seq").alias("tseq")).crossJoin(asked).filter("tseq != '' AND qseq != ''")
    return alignment.aligned(pairs, q, t, scoring, float("inf"), max_hits=0)


def classify(hits: DataFrame, queries: DataFrame, taxa: DataFrame, nodes: DataFrame, q: str, t: str, fraction: float = 0.0) -> DataFrame:
    """q, taxid, rank, name, assigned_hits of every query: the lowest common ancestor of its hits' taxa (taxa: t, taxid; nodes: taxid, parent, rank,
    name), of those within `fraction` of the best bits where that is above 0. Hits without a taxon don't count; a query without a known one is unclassified."""
    placed = cut(hits.join(taxa.select(t, "taxid"), t).select(q, "taxid", F.col("bits").alias("score")))  # they are counted, then dealt
    found = taxonomy.lca(taxonomy.kept(placed, q, fraction), taxonomy.paths(nodes), q).filter("taxid IS NOT NULL")
    named = found.join(nodes.select("taxid", "rank", "name"), "taxid", "left")
    return queries.select(q).join(named, q, "left").select(
        q, F.coalesce("taxid", F.lit(0)).alias("taxid"), F.coalesce("rank", F.lit("no rank")).alias("rank"),
        F.when(F.col("taxid").isNull(), "unclassified").otherwise(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("assigned", F.lit(0)).alias("assigned_hits"),
    )
