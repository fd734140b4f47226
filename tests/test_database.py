"""Databases of several files: round trips, their exact bytes, what is refused; and what kind of input a path is."""

import bz2
import gzip

import pytest
from strandforge.plans import commands
from strandforge.sources import database


def rows(spark):
    names = ["a first", "b", "", None, "e é ü", "f"]
    return spark.createDataFrame([(i * 10, n, "ACDEFGHIKL"[: i + 1] * (1 + i % 3)) for i, n in enumerate(names)], "n long, name string, seq string")


def test_bytes_of_a_database(spark, tmp_path):
    path = str(tmp_path / "db")
    assert database.write(rows(spark).repartition(4), "n", path, "name", source="x.fa") == 6
    texts = [r["seq"] for r in rows(spark).orderBy("n").collect()]
    heads = [(r["name"] or "") for r in rows(spark).orderBy("n").collect()]
    for suffix, held in (("", texts), ("_h", heads)):
        data, index, at = b"", "", 0
        for key, x in enumerate(held):
            entry = x.encode() + b"\n\0"
            data, index, at = data + entry, index + f"{key}\t{at}\t{len(entry)}\n", at + len(entry)
        assert (tmp_path / f"db{suffix}").read_bytes() == data
        assert (tmp_path / f"db{suffix}.index").read_text() == index
    assert (tmp_path / "db.lookup").read_text() == "".join(f"{k}\t{x.split(' ')[0]}\t0\n" for k, x in enumerate(heads))
    assert (tmp_path / "db.source").read_text() == "0\tx.fa\n"
    assert ((tmp_path / "db.dbtype").read_bytes(), (tmp_path / "db_h.dbtype").read_bytes()) == (b"\0\0\0\0", b"\x0c\0\0\0")
    assert not [x for x in tmp_path.iterdir() if x.name.endswith(".part")]


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "db")
    database.write(rows(spark), "n", path, "name")
    want = {(k, r["name"] or str(k), r["seq"]) for k, r in enumerate(rows(spark).orderBy("n").collect())}
    found = database.read(spark, path)
    assert {(r["key"], r["header"], r["seq"]) for r in found.collect()} == want
    assert {r["key"]: r["id"] for r in found.collect()} == {0: "a", 1: "b", 2: "2", 3: "3", 4: "e", 5: "f"}
    database.write(rows(spark).limit(0), "n", path, "name", nucleotide=True)
    assert database.read(spark, path, True).count() == 0
    with pytest.raises(ValueError, match="proteins"):
        database.read(spark, path, False)


def test_entries_in_any_order_with_headers_by_key(spark, tmp_path):
    (tmp_path / "d").write_bytes(b"acd*\n\0MK\nVL\n\0\0")
    (tmp_path / "d.index").write_text("7\t6\t7\n3\t0\t6\n")
    (tmp_path / "d.dbtype").write_bytes(b"\0\0\0\0")
    (tmp_path / "d_h").write_bytes(b"seven x\n\0")
    (tmp_path / "d_h.index").write_text("7\t0\t9\n")
    found = {r["key"]: (r["id"], r["seq"]) for r in database.read(spark, str(tmp_path / "d")).collect()}
    assert found == {7: ("seven", "MKVL"), 3: ("3", "ACD")}
    loaded, warnings = database.load(spark, str(tmp_path / "d"))
    assert loaded.count() == 2 and "1 entries have no header" in warnings[0]


def test_from_fasta_to_a_database_and_back(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a b\nMKVL\nLA\n>c\nWWHH\n")
    assert commands.createdb(spark, str(tmp_path / "x.fa"), str(tmp_path / "x")) == (2, [])
    assert commands.convert2fasta(spark, str(tmp_path / "x"), str(tmp_path / "out")) == []
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == ">a b\nMKVLLA\n>c\nWWHH\n"


@pytest.mark.parametrize("index, kind", [("0\t0\t4\n0\t0\t4\n", 0), ("0\t0\t400\n", 0), ("0\t0\n", 0), ("x\t0\t4\n", 0), ("0\t0\t3\n", 0), ("0\t0\t4\n", 2), ("0\t0\t4\n", 1 << 31), ("5000000000\t0\t4\n", 0), ("0\t4\t4\n", 0)])
def test_what_is_refused(spark, tmp_path, index, kind):
    (tmp_path / "d").write_bytes(b"AC\n\0A1\n\0")
    (tmp_path / "d.index").write_text(index)
    (tmp_path / "d.dbtype").write_bytes(kind.to_bytes(4, "little"))
    with pytest.raises(Exception):  # noqa: B017
        database.read(spark, str(tmp_path / "d")).collect()


def test_kinds_of_input(spark, tmp_path):
    at = lambda name, held: (tmp_path / name).write_bytes(held) and str(tmp_path / name)
    text = b">a b\nACGTACGT\n>c\nACGA\n"
    plain, packed = at("x.fa", text), at("x.fa.gz", gzip.compress(text))
    assert (database.detect(plain), database.detect(packed), database.detect(str(tmp_path))) == ("fasta", "gzip", "fasta")
    for path in (plain, packed):
        found, warnings = database.load(spark, path)
        assert [(r["id"], r["seq"]) for r in found.orderBy("ordinal").collect()] == [("a", "ACGTACGT"), ("c", "ACGA")] and "nucleotides" in warnings[0]
        assert database.load(spark, path, nucleotide=True)[1] == []
    at("lone.index", b"0\t0\t4\n")
    (tmp_path / "empty").touch()
    for path, error in ((at("x.bz2", bz2.compress(text)), "bzip2"), (str(tmp_path / "empty"), "empty"), (str(tmp_path / "none"), "no such"), (str(tmp_path / "lone"), "dbtype")):
        with pytest.raises((ValueError, FileNotFoundError), match=error):
            database.detect(path)
