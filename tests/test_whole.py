"""Registered queries over inputs that a prefix or a cap would cut, against brute force."""

import math
from collections import Counter, defaultdict

import pytest

from strandforge.functions import residues as rs
from strandforge.plans.queries import QUERIES

TEXTS = [("en", "mkvl lacdefghik " * 9 + "wwy"), ("en", "ACDEFGHIKLMNPQRSTVWY" * 4), ("en", ""), ("en", None), ("de", "qrst" * 30 + "b"), ("de", "qrsv" * 16), ("fr", "--"), (None, "mkvl" * 30)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def alignment():
    """The codes of each row of each alignment, without gaps."""
    out = defaultdict(dict)
    for i, (lang, text) in enumerate(TEXTS):
        if lang:
            out[lang][i] = [rs.ALPHABET.index(c) if c in rs.ALPHABET else 20 for c in (text or "").upper() if "A" <= c <= "Z"]
    return out


def test_profiles_read_all_letters(spark, folder):
    weight, freq, width = {}, {}, {}
    for lang, held in alignment().items():
        width[lang] = max(1, *map(len, held.values()))
        column = [Counter(r[p] for r in held.values() if p < len(r) and r[p] < 20) for p in range(width[lang])]
        raw = {i: 1e-6 + sum(1 / (column[p][c] * len(column[p])) for p, c in enumerate(r) if c < 20) / (len(r) + 30) for i, r in held.items()}
        for i in held:
            weight[lang, i] = raw[i] / sum(raw.values())
        for p in range(width[lang]):
            w = Counter()
            for i, r in held.items():
                if p < len(r) and r[p] < 20:
                    w[r[p]] += weight[lang, i]
            for c in range(20):
                freq[lang, p, c] = w[c] / sum(w.values()) if w else rs.BACKGROUND[c]
    assert min(width["en"], width["de"]) > 60
    got = {(r["msa"], r["row"]): r["weight"] for r in QUERIES["henikoff_weights"](spark, folder).collect()}
    assert got.keys() == weight.keys() and all(math.isclose(got[k], weight[k], abs_tol=1e-9) for k in weight)
    got = {(r["msa"], r["pos"], r["code"]): r["freq"] for r in QUERIES["column_frequencies"](spark, folder).collect()}
    assert got.keys() == freq.keys() and all(math.isclose(got[k], freq[k], abs_tol=1e-7) for k in freq)
    places = {k[:2] for k in freq}
    for name in ("effective_sequences", "consensus_residues"):
        assert {(r["msa"], r["pos"]) for r in QUERIES[name](spark, folder).collect()} == places
    assert {(r["msa"], r["pos"], r["code"]) for r in QUERIES["pssm"](spark, folder).collect()} == freq.keys()


def test_profile_columns(spark, folder):
    from strandforge.operators import profile
    from strandforge.plans import views

    width = {lang: max(1, *map(len, held.values())) for lang, held in alignment().items()}
    prob = defaultdict(lambda: [0.0] * 20)
    made = profile.profile(views.msa(spark, folder))
    for r in made.collect():
        prob[r["msa"], r["pos"]][r["code"]] = r["prob"]
    exact = lambda a, b: 8 * math.log2(max(sum(x * y / max(g, 1e-6) for x, y, g in zip(prob[a], prob[b], rs.BACKGROUND)), 1e-6))
    right = lambda a, b, score: abs(max(-128, min(127, exact(a, b))) - score) <= 0.5 + 1e-6
    got = QUERIES["profile_columns"](spark, folder).collect()
    assert len(got) == sum(min(width[a], width[b]) for a in width for b in width if a < b)
    assert all(right((r["left_msa"], r["pos"]), (r["right_msa"], r["pos"]), r["score"]) for r in got)
    got = profile.column_scores(made.filter("msa = 'fr'"), made.filter("msa = 'de'")).collect()
    assert len(got) == width["fr"] * width["de"] and all(right((r["left_msa"], r["left_pos"]), (r["right_msa"], r["right_pos"]), r["score"]) for r in got)


def test_frequent_seeds_are_present(spark, tmp_path):
    """A seed at more than a hundred places is as present as any other."""
    spark.createDataFrame([(i, "MKVLLACDEFGH") for i in range(101)] + [(200, "WWYYWWYYWWYY")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "MKVLLACDEFGHWWYYWWYYW"), (2, "WWYYWWYYW"), (3, "QRSTQRSTQRST")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r["item_id"]: r["present"] for r in QUERIES["seed_presence"](spark, str(tmp_path)).collect()} == {1: 5, 2: 1}
