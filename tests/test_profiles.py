"""Profile search against the exhaustive one and a plain recursion, its rounds, its statistics, and the alignment of profiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.functions import residues as rs
from strandforge.operators import profile
from strandforge.operators.kernels import table_path
from strandforge.plans import profiles
from strandforge.sources import writers

BASE = "MKVLLACDEFGHIKLMNPQRSTVWYMKWWHHEEDDKKAVGTRSPLMNCQAEWIKDRFLTPYHGSMVNQC"


def changed(text, every, shift=7):
    return "".join(rs.ALPHABET[(rs.ALPHABET.index(c) + shift) % 20] if i % every == every - 1 else c for i, c in enumerate(text))


def msa_of(spark, rows, name="m"):
    cells = [(name, r, i, rs.ALPHABET.index(c) if c in rs.ALPHABET else -1 if c == "-" else 20) for r, x in enumerate(rows) for i, c in enumerate(x)]
    return spark.createDataFrame(cells, "msa string, row int, pos int, code int")


@pytest.fixture(scope="module")
def targets(spark):
    rng = np.random.default_rng(5)
    noise = ["".join(rng.choice(list(rs.ALPHABET), int(n))) for n in rng.integers(40, 160, 30)]
    texts = [BASE, changed(BASE, 3), changed(BASE, 2), noise[0] + BASE[10:60] + noise[1], "", "XXXX", BASE, *noise]
    return spark.createDataFrame(list(enumerate(texts)), "t int, seq string").cache()


def plain(rows, target, gap_open, gap_extend):
    """The best local score by three matrices, cell by cell."""
    m, n = len(rows), len(target)
    h, e, f = (np.full((m + 1, n + 1), x, float) for x in (0, -math.inf, -math.inf))
    for a in range(1, m + 1):
        for b in range(1, n + 1):
            e[a, b] = max(e[a, b - 1] - gap_extend, h[a, b - 1] - gap_open)
            f[a, b] = max(f[a - 1, b] - gap_extend, h[a - 1, b] - gap_open)
            h[a, b] = max(0, h[a - 1, b - 1] + rows[a - 1][target[b - 1]], e[a, b], f[a, b])
    return h.max()


def test_packed_profiles_hold_scores_and_consensus(spark):
    msa = msa_of(spark, [BASE, changed(BASE, 5), BASE[:30] + "-" * 34])
    scores, consensus = profiles.built(msa)
    held = np.frombuffer(bytes(profiles.packed(scores, consensus).first()["profile"]), np.int8).reshape(-1, 22)
    want = np.zeros((len(BASE), 20), int)
    for r in scores.collect():
        want[r["pos"], r["code"]] = r["score"]
    assert (held[:, :20] == want).all() and (held[:, 20] == 0).all()
    assert "".join((rs.ALPHABET + "X")[c] for c in held[:, 21]) == "".join(r["consensus"] for r in consensus.orderBy("pos").collect())


def test_hits_by_brute_force(spark, targets):
    msa = msa_of(spark, [BASE, changed(BASE, 5)])
    given = dict(samples=200, evalue=10.0, max_hits=0)
    every = {r["t"]: r for r in profiles.profilesearch(msa, targets, "t", exhaustive=True, **given).collect()}
    held = bytes(profiles.packed(*profiles.built(msa)).first()["profile"])
    rows = profiles.SCORING.rows(held)
    texts = {r["t"]: r["seq"] for r in targets.collect()}
    k = profiles.calibrated(profiles.packed(*profiles.built(msa)), targets, *profiles.totals(targets), 200, 0x5EED).first()
    residues = sum(map(len, texts.values()))
    for t, text in texts.items():
        score = plain(rows, rs.encode(text), *profiles.GAPS) if text else 0
        evalue = k["k"] * len(rows) * residues * math.exp(-k["lam"] * score)
        assert (t in every) == (evalue <= 10 and score > 0), (t, score, evalue)
        if t in every:
            assert every[t]["raw"] == score and every[t]["evalue"] == pytest.approx(evalue)
    assert {0, 1, 3, 6} <= set(every) and not {4, 5} & set(every)
    assert every[0]["qlen"] == len(BASE) and every[0]["cigar"] == f"{len(BASE)}M"
    own = np.frombuffer(held, np.int8).reshape(-1, 22)[:, 21]
    assert every[0]["pident"] == pytest.approx(100 * (own == rs.encode(BASE)).mean())
    found = {r["t"]: r for r in profiles.profilesearch(msa, targets, "t", **given).collect()}
    assert {0, 1, 3, 6} <= set(found) and all(found[t]["raw"] == every[t]["raw"] for t in found)


def test_rounds_add_each_hit_once(spark, targets):
    msa = msa_of(spark, [BASE])
    once = profiles.profilesearch(msa, targets, "t", samples=200)
    assert once.filter("t = 0").first()["rank"] == 1
    rows = profiles.hit_rows(once, targets, "t")
    assert "".join(rs.ALPHABET[r["code"]] for r in rows.filter("row = 'hit 0'").orderBy("pos").collect()) == BASE
    again = {r["t"]: r["raw"] for r in profiles.profilesearch(msa, targets, "t", samples=200, rounds=3).collect()}
    assert {r["t"] for r in once.collect()} <= set(again)
    alone = {r["t"]: r["raw"] for r in profiles.profilesearch(msa, targets, "t", samples=200, rounds=3, inclusion=1e-300).collect()}
    assert alone == {r["t"]: r["raw"] for r in once.collect()}


def test_calibration_is_the_same_for_any_partitioning(spark, targets):
    msa = msa_of(spark, [BASE]).unionByName(msa_of(spark, [BASE[::-1]], "other"))
    p = profiles.packed(*profiles.built(msa)).cache()
    a, b = ({r["msa"]: (r["lam"], r["k"]) for r in profiles.calibrated(x, y, 3000, 37, 300, 1).collect()} for x, y in ((p, targets), (p.repartition(3), targets.repartition(5))))
    assert a == b and set(a) == {"m", "other"}
    assert all(0.02 < lam < 0.2 and k > 0 for lam, k in a.values())


def test_nothing_to_search(spark, targets):
    none = targets.limit(0)
    assert profiles.profilesearch(msa_of(spark, [BASE]), none, "t", samples=100).count() == 0
    assert profiles.profilesearch(msa_of(spark, ["AC"]), targets, "t", samples=100).count() == 0
    assert profiles.profilesearch(msa_of(spark, [BASE]).limit(0), targets, "t", samples=100, rounds=2).count() == 0
    for wrong in ({"exact_seeds": True}, {"comp_bias_corr": True}, {"rounds": 0}, {"max_kmers": 0}, {"unknown": 1}):
        with pytest.raises(ValueError):
            profiles.ProfileOptions.of(**wrong)
    assert [profiles.ProfileOptions.of(sensitivity=s).words[0] for s in (1, 5.7, 9)] == [68, 40, 20]


def test_paths_through_a_table():
    rng = np.random.default_rng(2)
    for _ in range(20):
        table = rng.integers(-30, 25, (int(rng.integers(1, 25)), int(rng.integers(1, 25))))
        want = plain(table, np.arange(table.shape[1]), 44, 4)
        got = table_path(table, table > 0, 44, 4)
        assert (got["score"] if got else 0) == want


def test_profiles_against_each_other(spark):
    left = msa_of(spark, [BASE], "a")
    right = msa_of(spark, [BASE[8:50]], "part").unionByName(msa_of(spark, [BASE[:20] + "W" + BASE[20:]], "longer"))
    found = {r["right"]: r for r in profiles.profileprofile(left, right).collect()}
    assert (found["part"]["qstart"], found["part"]["tstart"], found["part"]["cigar"], found["part"]["cons_id"]) == (8, 0, "42M", 100.0)
    p, q = (profile.profile(x) for x in (left, right.filter("msa = 'part'")))
    table = np.zeros((len(BASE), 42), int)
    for r in profile.column_scores(p, q).collect():
        table[r["left_pos"], r["right_pos"]] = r["score"]
    assert found["part"]["score"] == plain(table, np.arange(42), *profiles.GAPS) == 8 * found["part"]["bits"]
    line = writers.profile_pairs(profiles.profileprofile(left, right).filter("right = 'part'")).first()
    assert (line["q_start"], line["t_end"], line["cons_id%"]) == (9, 42, "100.0")
    assert profiles.profileprofile(left, right.limit(0)).count() == 0
