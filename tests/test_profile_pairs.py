"""Pairs of profiles that are handed to all tasks are those that move pair by pair."""

from strandforge.plans import profiles


def test_pairs_are_but_numbers(spark, monkeypatch):
    texts = {"a": ["MKVLLACDEFGHIKLMNPQRSTVWY", "MKVLIACDEFGHIKLMNPQRSTVWF"], "b": ["ACDEFGHIKLMNPQRS", "ACDEFGHIRLMNPQKS"], "c": ["WWWW"]}
    alphabet = "ACDEFGHIKLMNPQRSTVWY"
    rows = [(m, r, p, alphabet.index(c)) for m, held in texts.items() for r, text in enumerate(held) for p, c in enumerate(text)]
    msa = spark.createDataFrame(rows, "msa string, row int, pos int, code int")
    got = profiles.profileprofile(msa, msa)
    assert "right_p" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(profiles, "CELLS", 0)
    other = msa.filter("msa IS NOT NULL")
    assert sorted(map(str, got.collect())) == sorted(map(str, profiles.profileprofile(msa, other).collect())) != []
    monkeypatch.undo()
    empty = msa.limit(0)
    assert profiles.profileprofile(empty, empty).count() == 0
