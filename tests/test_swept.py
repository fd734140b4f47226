"""Scores and ends that are found in the JVM, against the numpy recursion; searches that need no other."""

import numpy as np
from pyspark.sql import functions as F

from strandforge.operators import alignment, swept
from strandforge.operators.alignment import score_rows
from strandforge.operators.kernels import sw_ends
from strandforge.plans import commands, search

BASE = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQAEWIKDRFLTPYHGSMVNQC"


def test_ends(spark):
    rng, rows, want = np.random.default_rng(3), [], []
    for m, gaps in ((1, (11, 1)), (7, (5, 2)), (64, (11, 1)), (150, (44, 4))):
        q = rng.integers(0, 21, m)
        r = score_rows(q)
        targets = [rng.integers(0, 21, n) for n in (*rng.integers(0, 90, 37), 0, 1, 400)] + [np.concatenate([q, q[::-1], q]), q]
        off = np.append(0, np.cumsum([len(x) for x in targets]))
        rows.append((m, *map(bytearray, (*swept.packed(r, *gaps), np.concatenate(targets).astype(np.int8).tobytes(), off.astype("<i4").tobytes())), *gaps))
        want.append(sw_ends([r] * len(targets), targets, *gaps).tolist())
    swept.opened(spark)
    df = spark.createDataFrame(rows, "m int, a binary, b binary, c binary, d binary, o int, e int").repartition(3)
    for (m, *_, o, e), ends in zip(rows, want):
        found = df.filter(F.col("m") == m).select(F.posexplode(swept.ends("a", "b", "c", "d", (o, e))).alias("i", "s"))
        assert [list(x)[1:] for x in found.select("i", *swept.parts(F.col("s"))).orderBy("i").collect()] == ends
    assert swept.packed(score_rows(np.zeros(8000, int), bias=False), 11, 1) is None


def test_searches_sweep(spark, monkeypatch):
    """No pair of a search goes through the numpy scores; a query's best hits are kept by score, then target."""
    q = spark.createDataFrame([(0, BASE), (1, BASE[::-1]), (2, ""), (3, None)], "q long, seq string")
    t = spark.createDataFrame([(i, "GGHH" * (i % 3) + BASE[i % 4 :]) for i in range(12)] + [(20, ""), (21, None), (22, "AC")], "t long, seq string")
    want = {(f, n): sorted(map(tuple, f(q, t, "q", "t", max_hits=n, min_tcov=1e-9).collect())) for f in (search.search, search.easysearch) for n in (0,)}

    def unused(*_):
        raise AssertionError("scored twice")

    monkeypatch.setattr(alignment, "_scored", unused)
    for f in (search.search, search.easysearch):
        assert len(want[f, 0]) == 12 and sorted(map(tuple, f(q, t, "q", "t", max_hits=0).collect())) == want[f, 0]
        assert [r["t"] for r in f(q, t, "q", "t", max_hits=5).orderBy("rank").collect()] == [0, 4, 8, 1, 5]


def test_hits_are_found_once_for_their_taxonomy(spark):
    made = spark.sparkContext.accumulator(0)

    def found(batches):
        for b in batches:
            made.add(len(b))
            yield b

    kinds = "q long, t long, bits double"
    hits = spark.createDataFrame([(1, 5, 9.0), (1, 6, 8.5), (2, 6, 3.0)], kinds).mapInPandas(found, kinds)
    q, taxa = spark.createDataFrame([(1,), (2,), (3,)], "q long"), spark.createDataFrame([(5, 3), (6, 4)], "t long, taxid long")
    nodes = spark.createDataFrame([(1, 1, "root", "root"), (2, 1, "genus", "A"), (3, 2, "species", "B"), (4, 2, "species", "C")], "taxid long, parent long, rank string, name string")
    got = {r["q"]: r["taxid"] for r in commands.classify(hits, q, taxa, nodes, "q", "t", 0.1).collect()}
    assert got == {1: 2, 2: 4, 3: 0} and made.value == 3
