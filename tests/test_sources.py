"""Readers on small files, malformed ones too, and the stream."""

import pytest

from strandforge.plans.search import easysearch
from strandforge.sources import readers
from strandforge.streaming.search import search_stream


def test_fasta(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_bytes(b";note\n>one first  record\r\nacde-f.g\r\n HIK*\r\n\n>two\nMK\n;inside\nVL*LX\n>one again\nAA\n")
    got = readers.fasta(spark, str(f)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["id"], r["seq"]) for r in got] == [(0, "one", "ACDEFGHIK"), (1, "two", "MKVL*LX"), (2, "one", "AA")]


@pytest.mark.parametrize("text", [">a\n\n>b\nMK\n", ">\nMK\n", ">a\nM1K\n"])
def test_bad_fasta(spark, tmp_path, text):
    f = tmp_path / "bad.fa"
    f.write_text(text)
    with pytest.raises(Exception, match="no residues|no header|not residues"):
        readers.fasta(spark, str(f)).collect()


def test_alignments(spark, tmp_path):
    f = tmp_path / "a.a3m"
    f.write_text(">q\nACD-E\n>r\nAccCD-E\n")
    rows = readers.msa(spark, str(f)).orderBy("row", "pos").collect()
    assert [r["code"] for r in rows] == [0, 1, 2, -1, 3] * 2
    f = tmp_path / "b.fa"
    f.write_text(">q\nA-CD\n>r\nAXCDEE\n>s\nA\n")
    rows = readers.msa(spark, str(f)).orderBy("row", "pos").collect()
    assert [r["code"] for r in rows] == [0, 1, 2, 0, 1, 2, 0, -1, -1]


def test_taxonomy_dumps(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\nbad\n")
    (tmp_path / "names.dmp").write_text("2\t|\tFoo\t|\t\t|\tscientific name\t|\n2\t|\tBar\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "map.tsv").write_text("a\t1\nb,2\na\t2\nx\n")
    assert sorted(map(tuple, readers.nodes(spark, str(tmp_path / "nodes.dmp")).collect())) == [(1, 1, "no rank"), (2, 1, "genus")]
    assert list(map(tuple, readers.names(spark, str(tmp_path / "names.dmp")).collect())) == [(2, "Foo")]
    assert sorted(map(tuple, readers.sequence_taxa(spark, str(tmp_path / "map.tsv")).collect())) == [("a", 2), ("b", 2)]


def test_stream(spark, tmp_path):
    base = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQAEWIKDRFLTPYHGSMVNQC"
    t = spark.createDataFrame([(0, base + "GGGG"), (1, "PQRSTVWY" * 6)], "t long, seq string")
    spark.createDataFrame([(7, base)], "q long, seq string").write.parquet(str(tmp_path / "in"))
    queries = spark.readStream.schema("q long, seq string").parquet(str(tmp_path / "in"))
    search_stream(queries, t, "q", "t", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    want = sorted((r["q"], r["t"]) for r in easysearch(spark.createDataFrame([(7, base)], "q long, seq string"), t, "q", "t").collect())
    assert sorted((r["q"], r["t"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and (7, 0) in want
