import pytest
from pyspark.sql import functions as F
from test_requests_and_files import entities

from kinledger.operators import corpus, retrieve, scored
from kinledger.plans import search

CLAIM = "claim_id long, claimed_name string, cin string, website string, email string"


@pytest.mark.parametrize("scorer", [None, lambda f: F.col("trigram_core")])
def test_whole_search_of_a_source_cuts_nothing_before_it(spark, monkeypatch, scorer):
    """One bank among many registered companies of the same words, which take all places that are retrieved."""
    monkeypatch.setattr(search, "RETRIEVED", 2)
    monkeypatch.setattr(corpus, "CEILING_LEAST", 1)
    monkeypatch.setattr(retrieve, "NGRAM_BELOW", 0)
    claims = spark.createDataFrame([(1, "Zuri Gold Loans", None, None, None), (2, "Zuri", None, None, None)], CLAIM)
    assert search.served_search(claims, entities(spark), "bank", 3, scorer).collect() == []
    bank, every = (search.served_search(claims, entities(spark), s, 25, scorer, whole=True).collect() for s in ("bank", "all"))
    assert {(r.claim_id, r.entity_id, r["rank"]) for r in bank} == {(1, "bank:1", 1), (2, "bank:1", 1)}
    rows = lambda found: {(r.claim_id, r.entity_id, round(r.score, 6), r.probability) for r in found}
    assert rows(bank) == {r for r in rows(every) if r[1] == "bank:1"} and len(every) > 2


def test_accepted_matches_are_those_of_the_whole_ranking(spark):
    claims = spark.createDataFrame([(1, "Makano Gold Loans Ltd", None, None, None), (2, "Bank of Zuri", None, None, None), (3, "nothing alike", None, None, None)], "claim_id long, claimed_name string, cin string, website string, email string")
    whole = {tuple(r) for r in search.ranked_matches(claims, entities(spark)).where("accepted").collect()}
    assert whole and whole == {tuple(r) for r in search.ranked_matches(claims, entities(spark), accepted_only=True).collect()}


@pytest.mark.parametrize("block", [4, 1000])
def test_whole_ranking_equals_brute_force(spark, monkeypatch, block):
    """The pool by blocking score would be one entity of each claim."""
    monkeypatch.setattr(scored, "BLOCK_ENTITIES", block)
    monkeypatch.setattr(search, "POOLED", 1)
    monkeypatch.setattr(search, "MATCHES", 4)
    monkeypatch.setattr(corpus, "CEILING_LEAST", 1)
    monkeypatch.setattr(retrieve, "NGRAM_BELOW", 0)
    asked = {1: "Zuri Gold Leasing", 2: "Hoxod Agro", 3: "old temoki finance", 4: "qqq"}
    claims = spark.createDataFrame([(k, n, None, None, None) for k, n in asked.items()], CLAIM)
    e = entities(spark)
    words = lambda x: set(x.split())
    grams = lambda x: {f"  {x.lower()} "[i : i + 3] for i in range(len(x) + 1)}
    runs = lambda x: {x.replace(" ", "")[i : i + 3] for i in range(len(x.replace(" ", "")) - 2)}
    overlap = lambda a, b: len(a & b) / len(a | b)
    want = {}
    for r in search.claim_profiles(claims).collect():
        q, all_of = r.name_core, []
        for x in e.select("id", "pos", "name_core", "alternate_names").collect():
            if words(q) & words(" ".join([x.name_core, *x.alternate_names])) or runs(q) & runs(x.name_core):
                p = max(overlap(words(q), words(x.name_core)), overlap(grams(q), grams(x.name_core)))
                all_of.append((-int(round(p, 6) * 1000), x.pos, x.id, round(p, 6)))
        want |= {(r.claim_id, i + 1): (x[2], pytest.approx(x[3], abs=1e-6)) for i, x in enumerate(sorted(x for x in all_of if x[3] >= 0.05)[:4])}
    got = {(r.claim_id, r["rank"]): (r.entity_id, r.probability) for r in search.ranked_matches(claims, e, whole=True).collect()}
    assert got == want and {k for k, _ in got} == {1, 2, 3}
    assert got != {(r.claim_id, r["rank"]): (r.entity_id, r.probability) for r in search.ranked_matches(claims, e).collect()}


def test_whole_known_entities_are_not_lost_by_the_pool(spark, monkeypatch):
    """A longer name has all words asked for and takes the one place of the pool; the accepted one differs in a letter."""
    monkeypatch.setattr(search, "POOLED", 1)
    monkeypatch.setattr(retrieve, "NGRAM_BELOW", 0)
    names = ["MAKANO GOLDEN LOANS HOUSING TEMOKI HOXODO ZURI", "MAKANO GOLDEN LOANS HOUSING TEMOKIS"]
    rows = [(i, n, n + " LIMITED", n) for i, n in enumerate(names)]
    e = corpus.unite({"registered_nbfc": spark.createDataFrame(rows, "source_row_number int, name string, name_normalized string, name_core string")})
    claims = spark.createDataFrame([(1, "Makano Golden Loans Housing Temoki", None, None, None)], CLAIM)
    assert search.known_entities(claims, e).collect() == []
    assert [(r.entity_id, r.nth) for r in search.known_entities(claims, e, whole=True).collect()] == [("registered_nbfc:1", 1)]
