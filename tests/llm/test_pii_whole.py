"""Surrogates where a shape has no room, and mentions of one thing in several forms."""

import string
import time

import pytest
import regex

from strandforge.llm import pii
from strandforge.llm.shared import Scratch


def test_full_shapes_end(spark):
    """More entities than a shape has strings, and an address whose drawn part is punctuation only."""
    full = [("email", f"{a}@{b}.com") for a in string.ascii_lowercase for b in string.ascii_lowercase] + [("email", f"{a}@{b}.org") for a in string.digits for b in string.digits]
    many = full + [("email", "-@-.com"), ("email", "+@-.net"), ("phone", "+1"), *(("card", f"{d}") for d in range(10))]
    got = pii.surrogates(spark.createDataFrame(many, "kind string, entity string"), "k", Scratch(spark)).collect()
    assert len(got) == len(many) and len({(r["kind"], r["surrogate"]) for r in got}) == len(many)
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(many)
    assert all(r["surrogate"].split("@")[1][1:] == r["entity"].split("@")[1][1:] for r in got if r["kind"] == "email")


def test_mentions_of_one_thing(spark):
    said = [
        ["Mr. John Smith", "Mr John Smith", "Mr. Smith"], ["Jo@x.com", "jo@X.com"], ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
        ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["+1 (017) 555-7713", "+1 017 555 7713"], ["Frau Anna Berger", "Frau Berger"], ["Mr. Paul Jones", "Mr. Mark Jones", "Mr. Jones"],
    ]
    flat = [m for group in said for m in group]
    got = pii.pseudonymised(spark.createDataFrame([(0, "; ".join(flat)), (1, "x Mr Smith; jo@x.com")], "doc_id long, text string"), "k").collect()
    out = {r["doc_id"]: r["text"] for r in got}
    john, john2, smith, jo, jo2, c1, c2, c3, i1, i2, p1, p2, anna, berger, paul, mark, jones = new = out[0].split("; ")
    assert not set(new) & set(flat)
    plain = lambda x: "".join(c for c in x if c.isalnum())
    assert john.startswith("Mr. ") and john2 == john.replace("Mr.", "Mr") and smith == "Mr. " + john.split()[-1]
    assert jo.lower() == jo2.lower() and jo[0].isupper() and jo2[3].isupper() and out[1].split("; ")[1] == jo.lower()
    assert plain(c1) == plain(c2) == plain(c3) and c1[4] == " " and c3[4] == "-" and len(c2) == 16
    assert plain(i1) == plain(i2) and [len(x) for x in i1.split()] == [4, 4, 4, 4, 4, 2]
    assert plain(p1) == plain(p2) and p1[3] == "(" and p2[0] == "+"
    assert berger.split()[-1] == anna.split()[-1] and len({paul.split()[-1], mark.split()[-1], jones.split()[-1]}) == 3
    assert out[1].split("; ")[0] != "x " + john2.replace(john2.split()[1] + " ", "")


def test_searching_by_brute_force(spark):
    """Kinds and places against another library's search, and every text put together again from its pieces; distinct entities stay distinct."""
    any_of = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()))
    odd = [None, "", "Mr. Jean-Luc O’Neil +49 30 1234 5678; frau Müller, Herr Groß. Κυρία Άννα Δούκα, господин Иван Коваль", "x" * 70 + "@y a@b.c@d.e .@-.- 1.2.3.4.5 1.2.3.4", "Mr Al Mr Al", "x@y.zz"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-k, t) for k, t in enumerate(odd)] + [(None, "x@y.zz"), (-5, "x@y.zz")], "doc_id long, text string"))
    texts = [r["text"] for r in docs.collect()]
    got = pii.pseudonymised(docs, "k").collect()
    assert len(got) == len(texts)
    want = sorted(str([(m.lastgroup, m.start(), m.end()) for m in any_of.finditer(t or "")]) for t in texts)
    assert sorted(str([(e["kind"], e["start"], e["end"]) for e in r["entities"]]) for r in got) == want
    put = {}
    for r in got:
        gaps = [regex.escape(g) for g in any_of.split(next((t for t in texts if t and [m.group() for m in any_of.finditer(t)] == [e["value"] for e in r["entities"]]), ""))[:1]]
        assert not r["entities"] or regex.match(gaps[0], r["text"])
    for r in got:
        if len(r["entities"]) == 1:
            e = r["entities"][0]
            t = next(t for t in texts if t and t[e["start"] : e["end"]] == e["value"] and len(any_of.findall(t)) == 1 and r["text"].startswith(t[: e["start"]]) and r["text"].endswith(t[e["end"] :]))
            new = r["text"][e["start"] : len(r["text"]) - len(t) + e["end"]]
            assert new != e["value"] and put.setdefault(e["value"], new) == new
    assert len({v.lower() for v in put.values()}) == len({k.lower() for k in put})


def test_types_hold(spark):
    said = "DE89 3704 0044 0532 0130 00; GB82WEST12345698765432; DE00 3704 0044 0532 0130 00; +49 30 1234 5678; +1 (017) 555-7713; +358 40 123 4567"
    a, b, c, d, e, f = pii.pseudonymised(spark.createDataFrame([(0, said)], "doc_id long, text string"), "k").first()["text"].split("; ")

    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    assert a[:2] == "DE" and valid(a) and b[:2] == "GB" and valid(b) and c[:2] == "DE" and not valid(c)
    assert d.startswith("+49 ") and e.startswith("+1 (") and f.startswith("+358 ")
    assert {a, b, c, d, e, f}.isdisjoint(said.split("; "))
    with pytest.raises(ValueError):
        pii.pseudonymised(spark.createDataFrame([(0, said)], "doc_id long, text string"), "")


def test_long_runs(spark):
    """A run of a million characters, an address of twenty thousand parts, and thousands of entities in one text."""
    rows = [(0, "a" * 1_000_000), (1, "a@b" + ".c" * 20_000), (2, "Mr " + "A" * 200_000), (3, "jo@x.com " * 3000), (4, "1.2" * 100_000), (5, "A" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in pii.pseudonymised(df, "k").collect()}
    assert time.time() - began < 60
    assert [len(got[i]["entities"]) for i in range(6)] == [0, 1, 1, 3000, 0, 0] and len(set(got[3]["text"].split())) == 1
