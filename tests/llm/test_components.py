"""Components of edges that many members share."""

from strandforge.llm.jaccard import HOOKS, components, hooked
from strandforge.llm.shared import Scratch


def test_hooked_edges_are_few_and_connect_the_same(spark):
    import random

    r = random.Random(7)
    names = [r.getrandbits(40) for _ in range(400)]
    stars, alone = names[:8], [(1, 2), (2, 3), (9, 8)]
    dense = [(min(s, v), max(s, v)) for v in names for s in stars if s != v]
    edges = spark.createDataFrame(dense + alone, "a long, b long")
    few = edges
    for _ in range(HOOKS):
        few = hooked(few)
    assert few.count() < 2 * len(names)
    scratch = Scratch(spark)
    found = dict(map(tuple, components(edges, scratch).collect()))
    scratch.drop()
    assert found == {**{v: min(names) for v in names}, 1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
