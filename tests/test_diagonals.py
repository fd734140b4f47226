"""Diagonals found within tasks are those of the joined windows; sums within tasks are those of the rows."""

import pytest
from pyspark.sql import functions as F

from strandforge.operators import masking, prefilter, seeds, ungapped

Q = [(1, "MKVLLACDEFGHIKLMKVLLACDEF"), (2, "ACDEFGHIKLMNP"), (2, "WYWYWYWYWYWY"), (3, "")]
T = [(10, "AAMKVLLACDEFGHIKLMKVLLACDEFWYWYWYWYWYWYWY"), (11, "ACDEFGHIKLMNPXACDEFGHIKLMNP"), (12, None), (13, "MKVLL")]


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("twice", [False, True])
def test_diagonals(spark, monkeypatch, twice):
    q = spark.createDataFrame(Q, "q long, seq string")
    t = spark.createDataFrame(T + ([(10, "ACDEFGHIKLMNP")] if twice else []), "t long, seq string")
    words = seeds.windows(q, "q")
    whole = seeds.hits(words, seeds.windows(t, "t"), "q", "t")
    assert _rows(seeds.diagonals(words, t, "q", "t")) == _rows(whole)
    assert _rows(seeds.diagonals(words, t, "q", "t", most=2)) == _rows(seeds.top_diagonals(whole, "q", "t", 2))
    pairs = whole.groupBy("q", "t").agg(F.sum("hits"), F.min("qmin"), F.max("qmax"))
    assert _rows(seeds.diagonals(words, t, "q", "t", pairs=True)) == _rows(pairs)


def test_nothing_is_shuffled(spark):
    q, t = spark.createDataFrame(Q, "q long, seq string"), spark.createDataFrame(T, "t long, seq string")
    for found in (seeds.diagonals(seeds.windows(q, "q"), t, "q", "t", most=4), seeds.summary(t, "t")):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("twice", [False, True])
def test_summaries(spark, twice):
    t = spark.createDataFrame(T + ([(10, "ACDEFGHIKLMNP"), (None, "ACDEFGHIKLMNP"), (None, "ACDEFGHIKLMN")] if twice else []), "t long, seq string")
    plain = seeds.windows(t, "t").groupBy("t").agg(F.count("*"), F.countDistinct("code"), F.sum("code"))
    assert sorted(map(str, seeds.summary(t, "t").collect())) == sorted(map(str, plain.toDF("t", "windows", "codes", "total").collect()))
    d = F.col("delta").cast("long")
    by_place = masking.bias(t, "t").groupBy("t").agg(F.count("*").alias("places"), F.sum(d).alias("total"), F.min(d).alias("least"), F.max(d).alias("most"), F.sum(d * (F.col("pos") + 1)).alias("moment"))
    assert sorted(map(str, masking.bias_sums(t, "t").collect())) == sorted(map(str, by_place.collect()))


@pytest.mark.parametrize("twice", [False, True])
def test_chains(spark, twice):
    """Chains found within tasks are those of the joined segments, and nothing is shuffled."""
    q = spark.createDataFrame([*Q[:2], (4, "WYWYWYWYWYWY"), (5, ""), (6, None)], "q long, seq string")
    t = spark.createDataFrame(T + [(14, "MKVLLACDEFXXXGHIKLMKVLLWWACDEF" * 3)] + ([(10, "ACDEFGHIKLMNP")] if twice else []), "t long, seq string")
    found = prefilter.chains(seeds.windows(q, "q"), q, t, "q", "t", seeds.Seed(), 4)
    if twice:
        assert found is None
        return
    top = seeds.diagonals(seeds.windows(q, "q"), t, "q", "t", most=4).drop("rank")
    want = ungapped.chains(ungapped.segments(top, q, t, "q", "t", seeds.Seed().span), "q", "t").select("q", "t", "diag_x", "diag_y", "chain_score")
    assert _rows(found) == _rows(want) != []
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
