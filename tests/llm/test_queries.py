"""The registered queries against their SQL, and the pipeline against its stages by brute force, on the smallest tables."""

import os

import pytest

from strandforge.llm import queries as q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(q.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = q.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(sorted(names)).collect()), key=str) == sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in want.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline
    from .test_operators import brute_groups, words  # the brute-force forms

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert first.columns == corpus_pipeline.COLUMNS
    left = {r["doc_id"]: docs[r["doc_id"]] for r in first.collect()}
    best: dict = {}
    for i in sorted(left):
        k = "".join((left[i] or "").split(" ")).translate({c: None for c in range(9, 14)})
        if k not in best or len(left[i]) > len(left[best[k]]):
            best[k] = i
    left = {i: left[i] for i in best.values()}
    groups = brute_groups(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    items = [words(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {tuple(x[a : a + min(10, len(x))]) for x in items for a in range(len(x) - min(10, len(x)) + 1)}
    clean = set()
    for i, t in left.items():
        w = words(t)
        if not any(tuple(w[a : a + n]) in grams for n in {len(x) for x in grams} for a in range(len(w) - n + 1)):
            clean.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == clean
