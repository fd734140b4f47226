"""The lowest common ancestor from the first and last path, against a count over all nodes, and how its hits are dealt."""

import random

from strandforge.operators import taxonomy


def _want(parents, hits):
    def path(x):
        found = [x]
        while parents[found[-1]] in parents and parents[found[-1]] not in found:
            found.append(parents[found[-1]])
        return found

    out = {}
    for q in {h[0] for h in hits}:
        taxa = {h[1] for h in hits if h[0] == q}
        common = [n for n in parents if all(n in path(x) for x in taxa if x in parents)] if taxa & parents.keys() else []
        out[q] = (max(common, key=lambda n: len(path(n)), default=None), len(taxa - {None}))
    return out


def test_lca_of_random_forests(spark, monkeypatch):
    r = random.Random(3)
    parents = {n: r.choice([n, 999, *range(1, n)]) if n < 4 else r.randrange(max(1, n - 9), n) for n in range(1, 90)}
    hits = [(q, r.choice([*range(1, 90), 5000, None]) if q % 2 else r.randrange(40, 60)) for q in range(60) for _ in range(r.randint(1, 5))]
    df = spark.createDataFrame(hits, "q long, taxid long")
    path = taxonomy.paths(spark.createDataFrame(list(parents.items()), "taxid long, parent long"))
    for handed in (taxonomy.HANDED, 0):
        monkeypatch.setattr(taxonomy, "HANDED", handed)
        assert {x["q"]: (x["taxid"], x["assigned"]) for x in taxonomy.lca(df, path, "q").collect()} == _want(parents, hits)


def test_circles_are_counted(spark):
    path = taxonomy.paths(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 1)], "taxid long, parent long"))
    hits = spark.createDataFrame([("a", 4), ("a", 5), ("b", 4)], "q string, taxid long")
    assert {x["q"]: x["taxid"] for x in taxonomy.lca(hits, path, "q").collect()} == {"a": 1, "b": 4}


def test_hits_are_dealt_once_and_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(taxonomy, "DEALT", 100)
    path = taxonomy.paths(spark.createDataFrame([(1, 1), (2, 1)], "taxid long, parent long"))
    hits = spark.range(2000).selectExpr("id DIV 4 AS q", "id % 2 + 1 AS taxid", "double(id) AS score")
    found = taxonomy.lca(hits, path, "q", 0.3)
    assert found.rdd.getNumPartitions() == 20
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
