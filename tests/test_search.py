"""Whole searches: published hits, words near a window against brute force, masks, and the commands around a search."""

import itertools
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.functions import residues as rs
from strandforge.operators import masking, seeds
from strandforge.plans import commands, search
from strandforge.sources import readers, writers

GOLDEN = Path(__file__).parent / "golden"
BASE = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQAEWIKDRFLTPYHGSMVNQC"


def test_published_hits(spark):
    """24 sequences against themselves, seeds of two residues, X-drop evidence."""
    fa = readers.fasta(spark, str(GOLDEN / "sequences.fa"))
    q, t = fa.select(F.col("ordinal").alias("q"), "seq"), fa.select(F.col("ordinal").alias("t"), "seq")
    hits = search.search(q, t, "q", "t", spaced="11", evalue=10.0, mask=None, ungapped_xdrop=30, kmer_score=22, max_kmers=512, min_diag_score=33)
    hits = hits.orderBy("q", "evalue", F.desc("bits"), "t").withColumn("qn", F.concat(F.lit("seq"), "q")).withColumn("tn", F.concat(F.lit("seq"), "t"))
    got = ["\t".join(map(str, r)) for r in writers.m8(hits, "qn", "tn").collect()]
    assert ["\t".join(writers.M8), *got] == (GOLDEN / "hits.tsv").read_text().splitlines()


@pytest.mark.parametrize("word, threshold, most", [("ACD", 10, 40), ("WWW", 8, 512), ("KKE", 12, 7), ("PPP", 22, 5), ("GAV", -20, 9000)])
def test_nearest_words(word, threshold, most):
    rows = rs.score_matrix()[rs.encode(word), :20].astype(np.int64)
    rank = np.argsort(np.argsort(-rows, axis=1, kind="stable"), axis=1)
    every = [(-sum(rows[i, c] for i, c in enumerate(w)), [rank[i, c] for i, c in enumerate(w)], w) for w in itertools.product(range(20), repeat=3)]
    want = [(w[0] * 400 + w[1] * 20 + w[2], -s) for s, _, w in sorted(every) if -s >= threshold][:most]
    code, score = seeds.nearest(rows, threshold, most)
    assert list(zip(code.tolist(), score.tolist())) == want


def test_hidden_places_are_the_low_complexity_stretches(spark):
    texts = ["MKVLLACDEFGHIK" + "Q" * 30 + "MKVLLACDEFGHIK", "ACD", "", "QQQQQQQQQQQQQQQ", BASE, "PQPQPQPQPQPQPQ" + BASE + "G" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    want = {(r["id"], p) for r in masking.low_complexity(df, "id").collect() for p in range(r["start"], r["end"])}
    off = np.append(0, np.cumsum([len(x) for x in texts]))
    hidden = masking.hidden(np.frombuffer("".join(texts).encode(), np.uint8), off)
    assert {(i, p) for i, x in enumerate(texts) for p in range(len(x)) if hidden[off[i] + p]} == want
    soft = {r["id"]: r["seq"] for r in masking.softened(df, "id", 12, 2.2, 2.5).collect()}
    assert {(i, p) for i, s in soft.items() for p, c in enumerate(s) if c.islower()} == want
    assert [soft[i].upper() for i in range(len(texts))] == texts


def test_masked_residues_neither_seed_nor_score(spark):
    q = spark.createDataFrame([(0, "Q" * 80)], "q long, seq string")
    t = spark.createDataFrame([(0, "Q" * 80), (1, BASE)], "t long, seq string")
    assert search.search(q, t, "q", "t").count() == 0
    assert search.easysearch(q, t, "q", "t").count() == 0
    assert search.easysearch(q, t, "q", "t", mask_scoring=None, comp_bias_corr=False).count() == 1


def test_sensitivity_finds_more(spark):
    """A copy in which every fourth residue changed has no exact seed."""
    near = {"K": "R", "R": "K", "I": "V", "V": "I", "D": "E", "E": "D", "L": "M", "M": "L", "F": "Y", "Y": "F", "S": "T", "T": "S"}
    far = "".join(near.get(c, c) for c in BASE)
    q, t = spark.createDataFrame([(0, BASE)], "q long, seq string"), spark.createDataFrame([(0, far)], "t long, seq string")
    assert search.search(q, t, "q", "t", max_kmers=0, spaced="111111").count() == 0
    assert search.search(q, t, "q", "t", spaced="111111").count() == 1


def test_index_table(spark):
    t = spark.createDataFrame([(0, BASE + "GGHH"), (1, BASE[5:])], "t long, seq string")
    q = spark.createDataFrame([(0, BASE)], "q long, seq string")
    seeds.write_index(t, "t", "postings_of_t", mask=search.Options().mask, buckets=4)
    with_table = search.search(q, t, "q", "t", index=spark.table("postings_of_t"))
    assert sorted(map(tuple, with_table.collect())) == sorted(map(tuple, search.search(q, t, "q", "t").collect())) != []


def test_commands(spark):
    amino = {"M": "ATG", "K": "AAA", "V": "GTT", "L": "CTT", "A": "GCT", "C": "TGT", "D": "GAT", "E": "GAA", "F": "TTT", "G": "GGT", "H": "CAT", "I": "ATT", "N": "AAT", "P": "CCT", "Q": "CAA", "R": "CGT", "S": "TCT", "T": "ACT", "W": "TGG", "Y": "TAT"}
    t = spark.createDataFrame([(5, BASE), (6, "DDGGNNSS" * 5), (7, "")], "t long, seq string")
    nt = spark.createDataFrame([(1, "".join(amino[c] for c in BASE))], "n long, nt string")
    assert [(r["orf"], r["t"], r["identical"]) for r in commands.translatesearch(nt, t, "n", "t").collect()] == [("1_f1_0", 5, len(BASE))]
    with pytest.raises(ValueError, match="reading frames"):
        commands.translatesearch(nt.limit(0), t, "n", "t")

    q = spark.createDataFrame([(1, BASE[:40] + "A" + BASE[40:]), (2, "WWWWHHHHCCCC" * 3)], "q long, seq string")
    hits = search.search(q, t, "q", "t")
    laid = {(r["q"], r["line"]): (r["target"], r["row"]) for r in commands.result2msa(hits, q, t, "q", "t").collect()}
    assert laid.keys() == {(1, 0), (1, 1), (2, 0)} and laid[1, 0] == (None, BASE[:40] + "A" + BASE[40:])
    assert laid[1, 1][0] == 5 and laid[1, 1][1].replace("-", "") == BASE and len(laid[1, 1][1]) == len(BASE) + 1

    nodes = spark.createDataFrame([(1, 1, "root", "root"), (2, 1, "genus", "Foo")], "taxid long, parent long, rank string, name string")
    taxa = spark.createDataFrame([(5, 2)], "t long, taxid long")
    got = sorted(map(tuple, commands.classify(hits, q, taxa, nodes, "q", "t").collect()))
    assert got == [(1, 2, "genus", "Foo", 1), (2, 0, "no rank", "unclassified", 0)]

    one = q.filter("q = 1")
    text = [r["text"] for r in writers.pairwise(commands.align(one, t, "q", "t"), "q", "t").orderBy("t").collect()]
    assert text[0].startswith("1 vs 5: score=") and f"\n  Q[1-{len(BASE) + 1}] T[1-{len(BASE)}]" in text[0] and "cigar=40M1D" in text[0]
    with pytest.raises(ValueError, match="one query"):
        commands.align(q, t, "q", "t")
