"""Operators on small inputs with known answers, and the registered queries against DuckDB on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from strandforge.functions import residues as rs
from strandforge.operators import clustering, masking, seeds, taxonomy, translation
from strandforge.plans import search
from strandforge.plans.queries import QUERIES, SQL
from strandforge.sources import writers

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_seed_codes(spark):
    df = spark.createDataFrame([(0, "ACDEFGHIK"), (1, "MKVLLACDE"), (2, "YYYYYYYYY"), (3, "ACXEFGHIK"), (4, "AC"), (5, "")], "id int, seq string")
    assert rows(seeds.windows(df, "id").select("id", "code")) == [(0, 178128), (1, 33416023), (2, 63999999)]


@pytest.mark.parametrize("mask", ["0110", "1", "", "12", "1" * 13])
def test_bad_seeds(mask):
    with pytest.raises(ValueError):
        seeds.Seed(mask)


def test_translation(spark):
    df = spark.createDataFrame([(0, "ATGAAATTTGGGTAA")], "id int, nt string")
    found = translation.orfs(df, "id", least=3)
    assert found.filter("frame = 1").select("nt_start", "aa").collect() == [(0, "MKFG")]
    back = spark.createDataFrame([(0, "TTACCCAAATTTCAT")], "id int, nt string")
    assert translation.orfs(back, "id", least=3).filter("frame = -1").select("nt_start", "aa").collect() == [(3, "MKFG")]
    codons = spark.createDataFrame([(c,) for c in ("ATG", "TTT", "ATA", "TGG", "TAA", "TGA", "GGG", "NNN")], "c string")
    assert [r[0] for r in codons.select(rs.codon_letter(F.col("c"))).collect()] == list("MFIW**GX")


def test_low_complexity(spark):
    df = spark.createDataFrame([(0, "MKVLLACDEFGHIK" + "Q" * 30 + "MKVLLACDEFGHIK"), (1, "ACD")], "id int, seq string")
    assert rows(masking.low_complexity(df, "id")) == [(0, 8, 51)]
    assert rows(masking.low_complexity(df, "id", 15, 2.3, 2.3)) == [(0, 8, 51)]


def test_lca(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 2), (7, 6)], "taxid long, parent long")
    path = taxonomy.paths(nodes)
    hits = spark.createDataFrame([("a", 4, 1.0), ("a", 5, 1.0), ("b", 4, 1.0), ("b", 7, 1.0), ("c", 7, 1.0), ("d", 4, 1.0), ("d", 999, 1.0), ("d", 5, 1.0), ("e", 999, 1.0)], "q string, taxid long, score double")
    assert {r["q"]: r["taxid"] for r in taxonomy.lca(hits, path, "q").collect()} == {"a": 3, "b": 2, "c": 7, "d": 3, "e": None}
    w = spark.createDataFrame([("a", 4, 100.0), ("a", 5, 95.0), ("a", 7, 50.0)], "q string, taxid long, score double")
    assert sorted(r["taxid"] for r in taxonomy.kept(w, "q", 0.1).collect()) == [4, 5]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "taxid long, parent long")
    assert {r["taxid"]: r["path"] for r in taxonomy.paths(loop).collect()}[3] == [3]


def test_clusters(spark):
    base = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQ"
    df = spark.createDataFrame([(0, base), (1, base[:20] + "A" + base[21:]), (2, base[1:]), (3, "WWWHHHPPPGGGCCCDDDEEEFFFIIILLLMMMNNNQQQ")], "id long, seq string")
    assert rows(clustering.clusters(df, "id")) == [(0, 0), (0, 1), (0, 2), (3, 3)]


def test_hash_order():
    import numpy as np

    known = {0: 16294208416658607535, 1: 10451216379200822465, 19: 13564971763896621636, 63999999: 14821874783991932340}
    assert clustering.hash64(np.array(list(known))).tolist() == list(known.values())


def test_search_options():
    for bad in ({"nope": 1}, {"evalue": 0}, {"min_qcov": 2}, {"sensitivity": 0.5}, {"spaced": "01"}, {"min_hits": 0}):
        with pytest.raises(ValueError):
            search.Options.of(**bad)


def test_search_keeps_its_answer(spark):
    """A mutated copy is found, and neither partitions nor the coverage filter's order change the result."""
    base = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQAEWIKDRFLTPYHGSMVNQC"
    t = spark.createDataFrame([(0, base + "GGGGPPPP"), (1, base[:30] + "AC" + base[30:]), (2, "PQRSTVWY" * 6), (3, "")], "t long, seq string")
    q = spark.createDataFrame([(7, base), (8, "")], "q long, seq string")
    one = rows(search.search(q, t, "q", "t"))
    assert one == rows(search.search(q.repartition(3), t.repartition(5), "q", "t"))
    assert [r[1] for r in sorted(one, key=lambda r: r[-1])] == [0, 1, 2]  # 2 shares eight residues, E 9e-5; no exact seed spans them
    assert rows(search.easysearch(q, t, "q", "t")) == one
    assert [r[1] for r in rows(search.search(q, t, "q", "t", max_hits=1, min_tcov=0.95))] == [1]


def test_fasta_lines(spark):
    df = spark.createDataFrame([(1, "A" * 60, "one first"), (2, "A" * 61, None), (3, "", "three")], "id long, seq string, header string")
    assert [r[0] for r in writers.fasta(df, "id", header="header").orderBy("id").select("fasta").collect()] == [">one first\n" + "A" * 60, ">2\n" + "A" * 60 + "\nA", ">three\n"]
    assert writers.fasta(df, "id", width=0).orderBy("id").first()["fasta"] == ">1\n" + "A" * 60


def test_text_formats(spark):
    df = spark.createDataFrame([(8.378e-55,), (0.292,), (6.3579e-06,)], "e double")
    assert [r[0] for r in df.select(writers.short_exponent(F.col("e"))).collect()] == ["8.38e-55", "2.92e-1", "6.36e-6"]
    a = spark.createDataFrame([(12, "XXACDEFGHIK", 2, 2, "3M2I2M1D2M")], "n int, t string, q int, s int, c string")
    assert a.select(writers.a3m_row(F.col("n"), F.col("t"), F.col("q"), F.col("s"), F.col("c"))).first()[0] == "--ACDefGH-IK--"[:14]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(sorted(names)).collect()), key=str) == sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in want.fetchall()), key=str)


def test_queries_without_sql(spark):
    hits = QUERIES["easysearch_hits"](spark, SMALL)
    assert hits.count() > 0 and writers.m8(hits, "item_id", "doc_id").columns == writers.M8
    assert QUERIES["gumbel_by_source"](spark, SMALL).count() > 0
