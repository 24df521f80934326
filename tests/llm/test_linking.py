import random

import pytest

from kinledger.llm import addresses, linkage, names, truncation
from kinledger.llm.strings import deletions, index_keys, osa, query_keys

TOWNS = [
    {"town_id": 1, "town": "Harinpur", "former_town": None, "state_code": "KL", "state_name": "Kelasthan", "pin_prefix": 314},
    {"town_id": 2, "town": "Tirakotta", "former_town": "Tricotah", "state_code": "VP", "state_name": "Varun Pradesh", "pin_prefix": 161},
]


def test_osa_and_deletions():
    assert osa("ab", "ba", 2) == 1 and osa("abc", "abc", 0) == 0 and osa("abcdef", "a", 2) == 3 and osa("", "ab", 2) == 2
    assert deletions("nexihe", 2) & deletions("nxeihe", 2) and "nxihe" in deletions("nexihe", 1)


@pytest.mark.parametrize("k", [1, 2])
@pytest.mark.parametrize("n", [1, 5, 22, 24, 25, 27, 60, 900])
def test_edit_keys_miss_nothing(n, k):
    rng = random.Random(n * 10 + k)
    for _ in range(60):
        meant = "".join(rng.choice("abcdefgh") for _ in range(n))
        typed = meant
        for _ in range(k):
            i = rng.randrange(len(typed) + 1)
            typed = rng.choice([typed[:i] + "x" + typed[i:], typed[:i] + typed[i + 1 :], typed[:i] + "y" + typed[i + 1 :], typed[: i - 1] + typed[i - 1 : i + 1][::-1] + typed[i + 1 :] if i else typed])
        # two swaps of the same letters are more than two edits
        assert osa(typed, meant, k) > k or query_keys(typed, k) & index_keys(meant, k)


def test_slips_trimmed_and_banded_as_in_full():
    def full(typed, meant):
        before, row = [], [1.1 * j for j in range(len(meant) + 1)]
        for i, a in enumerate(typed, 1):
            new = [1.1 * i]
            for j, b in enumerate(meant, 1):
                sub = 0.0 if a == b else 1.0 if names.adjacent(a, b) or {a, b} <= {"l", "i", "o"} else 1.9
                extra = 0.8 if i > 1 and a == typed[i - 2] or a == b else 1.1
                lost = 0.8 if j > 1 and b == meant[j - 2] else 1.0
                best = min(row[j - 1] + sub, row[j] + extra, new[j - 1] + lost)
                if i > 1 and j > 1 and a == meant[j - 2] and typed[i - 2] == b:
                    best = min(best, before[j - 2] + 0.9)
                new.append(best)
            before, row = row, new
        return row[-1]

    rng = random.Random(3)
    for _ in range(3000):
        meant = "".join(rng.choice("abio") for _ in range(rng.randrange(1, 9)))
        typed = list(meant)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(typed) + 1)
            typed[i : i + rng.randrange(2)] = rng.choice(["", "a", "o", "x"])
        typed = "".join(typed)
        want, got = full(typed, meant), names.slips(typed, meant, 2.7)
        assert abs(want - got) < 1e-9 or want > 2.7 and got > 2.7, (typed, meant, want, got)


def test_words_learnt_from_names_that_differ_in_one(spark):
    brands = [f"{a}{b}{c}" for a in ("makano", "temoki") for b in ("sa", "lu") for c in ("re", "vo", "ti")]
    listed = spark.createDataFrame([(f"{b} Small Business Credit".upper(),) for b in brands] + [(f"{b} Gold Loans",) for b in brands], "form string")
    typed = spark.createDataFrame([(f"{b.title()} Small Biz Credit Pvt Ltd",) for b in brands[:6]] + [(f"{b} small business credit",) for b in brands] + [(f"{brands[0]} Odd Loans",), (None,), ("",), ("x " * 9000,)], "name string")
    learnt = names.estimate_words(typed, listed, ["small", "business", "credit", "gold", "loans"])
    assert set(learnt) == {"biz"} and set(learnt["biz"]) == {"business"} and learnt["biz"]["business"] < 1
    assert names.estimate_words(typed.limit(0), listed.limit(0), ["small"]) == {}


def test_hot_brand_and_repeated_names(spark):
    forms = spark.createDataFrame(FORMS, "company int, form string")
    claims = spark.range(3000).selectExpr("id claim_id", "case id % 3 when 0 then 'Makano Agro Finance Ltd' when 1 then 'Makano Hsg Fin' else concat('Makano Agro Finance ', repeat('Ltd ', cast(id % 5 as int))) end claimed_name")
    got = names.attribute(claims, "claim_id", "claimed_name", forms, "company", "form")
    assert {(r.company, r["count"]) for r in got.groupBy("company").count().collect()} == {(1, 2000), (2, 1000)}


def test_same_premises(spark):
    rows = [
        (1, "12, Nexihe Road, 4th Floor, Gokarana Colony, Harinpur, KL, 314 043"),
        (2, "Gokarana Cly; Plot No. 12 Nexihe Rd; Near Old Mill; Harinpur"),
        (3, "12A Nexihe Road, Harinpur"),
        (4, "12/1 Nexihe Road, Harinpur"),
        (5, "12 Nexihe Lane, Harinpur"),
        (6, "12, Nexihe Road, Tricotah"),
        (7, "PIN 161078, #12 NEXIHE RD"),
        (8, None), (9, ""), (10, "x" * 20000), (11, "12, Nexihe Raod, Unit 4, Harinpur"),
    ]
    df = spark.createDataFrame([(a, b, "t") for a, b in rows], "row int, address string, town_id string")
    got = {(r.row_a, r.row_b) for r in addresses.same_premises(df, "row", "address", TOWNS).collect()}
    assert got == {(1, 2), (1, 11), (2, 11), (6, 7)}
    assert addresses.same_premises(df.limit(0), "row", "address", TOWNS).collect() == []


def test_type_words_are_learnt(spark):
    names = ["nexihe", "baruko", "mofeta", "hilova", "zudori", "kepasu"]
    rows = [(f"{i} {n} {kind}, {n} bhvn, Harinpur",) for i, n in enumerate(names) for kind in ("rd", "mrg")] + [(None,), ("",)]
    words = addresses.type_words(spark.createDataFrame(rows, "address string"), "address")
    assert {"rd", "mrg", "bhvn"} <= set(words) and "nexihe" not in words
    types = addresses.Types(words)
    assert types.street_type("rd") == "road" and types.street_type("mrg") == "marg" and types.street_type("raod") == "road" and types.street_type("plaza") is None
    assert types.is_type("bhvn", "building") and not types.is_type("bhvn", "locality") and types.is_type("chamber", "building")
    assert addresses.is_floor("flor") and addresses.is_floor("fl") and not addresses.is_floor("four")


def test_tied_towns_and_classes(spark):
    towns = [{"town_id": i, "town": f"Town{chr(97 + i)}{chr(97 + i)}pur", "former_town": None, "state_code": "VP", "state_name": "Varun Pradesh", "pin_prefix": 500} for i in range(12)]
    assert len(addresses.town_hypotheses({"named": [], "of_state": set(range(12)), "pin": None}, addresses.Towns(towns))) == 12
    assert len(addresses.town_hypotheses({"named": [], "of_state": set(), "pin": "500001"}, addresses.Towns(towns))) == 12
    rows = [(1, "Wupusi Plaza, 12 Nexihe Road, Harinpur"), (2, "Wupusi Plaza, Harinpur"), (3, "9 Baruko Lane, Harinpur"), (4, None)]
    df = spark.createDataFrame(rows, "row int, address string")
    got = {r.row: r.others for r in addresses.premises_sizes(df, "row", "address", TOWNS).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


FORMS = [(1, "MAKANO AGRO FINANCE"), (2, "MAKANO HOUSING FINANCE"), (3, "VETEFOFO GOLD LOANS"), (3, "RASAXOMO GOLD LOANS"), (4, "PULODAZI HIRE PURCHASE"), (5, "NEW KOZENUZO SECURITIES AND FINANCE"), (6, "WIBOZIWA FINANCE")]
FORMS += [(100 + 10 * i + j, f"{b} {t}") for i, t in enumerate(["AGRO FINANCE", "HOUSING FINANCE", "GOLD LOANS", "HIRE PURCHASE", "SECURITIES AND FINANCE", "FINANCE"]) for j, b in enumerate(["ZURIBALO", "TEMOKISA", "HALUVINE", "DOFIREKU"])]
CLAIMS = {
    "Makano Agro Finance Limited": 1, "MAKANO AGRO FINANC PVT LTD": 1, "Makano Hsg Fin (P) Ltd.": 2, "Vetefofo G.L. Ltd": 3, "Gold Loans, Rasaxomo": 3, "RasaxomoGold Loans": 3,
    "M/s Pulodazzi Hire Purchase": 4, "Phulodazi Hire Purchase Limited": 4, "Kozenuzo Securities Finance": 5, "Pulodazi Hire Limited": 4,
    "Makano Gold Loans": None, "Wiboziwa Agro Finance": None, "personal loan": None, "": None, "   ": None, "?": None, "finance ltd": None, "Qqqqqqqq Finance": None,
}


def test_names_attributed(spark):
    forms = spark.createDataFrame(FORMS, "company int, form string")
    rows = [(i, n, 1.0) for i, n in enumerate(CLAIMS)] + [(90, None, 1.0), (91, "Makano Agro Finance Limited", 1.0), (92, "z" * 30000, 0.0)]
    claims = spark.createDataFrame(rows, "claim_id long, claimed_name string, cost double")
    got = {r.claim_id: r.company for r in names.attribute(claims, "claim_id", "claimed_name", forms, "company", "form").collect()}
    want = {i: c for i, (n, c) in enumerate(CLAIMS.items()) if c} | {91: 1}
    assert got == want
    assert names.attribute(claims.limit(0), "claim_id", "claimed_name", forms, "company", "form").collect() == []


OFFICES = [{"regional_office": "Varunapur", "former_office": "Port Wellam"}, {"regional_office": "Sarvodur", "former_office": None}]


def test_records_linked(spark):
    forms = spark.createDataFrame([(c, f, "Varunapur" if c % 2 else "Sarvodur", "ICC" if c % 3 else "HFC") for c, f in FORMS], "company int, form string, office string, class string")
    typed = [(i, f.title() + " Limited", "Port Wellam" if c % 2 else " sarvodur RO", None if i % 2 else ("NBFC-ICC" if c % 3 else "HFC")) for i, (c, f) in enumerate(FORMS)]
    typed += [(200, "Makano Agro Finance Ltd", "Sarvodur", "ICC"), (201, None, "Varunapur", None), (202, "", None, None), (203, "Makano Agro Finance Ltd", None, None), (203, "Makano Agro Finance Ltd", None, None)]
    records = spark.createDataFrame(typed, "record_id long, name string, office string, class string")
    got = {r.record_id: r.company for r in linkage.link(records, "record_id", forms, "company", OFFICES).collect()}
    assert got == {i: c for i, (c, _) in enumerate(FORMS)} | {203: 1}
    assert linkage.link(records.limit(0), "record_id", forms, "company", OFFICES).collect() == []


def corpus(n):
    texts = []
    for i in range(n):
        body = " ".join(f"The office in town {(i * 7 + k) % 90} sent letter {(i + k) % 50} about the {['loan', 'fee', 'refund', 'notice'][(i + k) % 4]} and it was read." for k in range(3))
        texts.append(body + ["", "\nEncl: as above", "\n* * *", ""][i % 4])
    return texts


def test_truncation_on_held_out_cuts(spark):
    texts = corpus(1500)
    rows, truth = [], {}
    for i, t in enumerate(texts):
        cut = i % 10 == 3
        at = 40 + i % 70
        while cut and t[at - 1] in ". ":
            at += 1
        rows.append((i, t[:at] if cut else t, "web", "x"))
        truth[i] = cut
    rows += [(9001, None, "web", "x"), (9002, "", "web", "x"), (9003, "  \n", None, "x"), (9004, "word " * 40000 + "end.", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, limit string")
    p = {r.doc_id: r.p for r in truncation.score_all(df).collect()}
    assert len(p) == len(rows) and p[9001] is p[9002] is p[9003] is None and p[9004] is not None
    hits = {i for i in truth if p[i] >= truncation.THRESHOLD}
    real = {i for i, c in truth.items() if c}
    assert len(hits & real) / len(real) > 0.95 and len(hits & real) / max(len(hits), 1) > 0.95
    assert truncation.truncated(df.limit(0)).collect() == []


@pytest.mark.parametrize("text, mark", [("abc…", "…"), ("abc (contd", "(contd"), ("abc [rest lost]", "[rest lost]"), ("abc --- part missing ---", "--- part missing ---"), ("seen (twice) here", ""), ("abc.", ""), ("abc 👍", "emoji"), ("abc.\n-----", "")])
def test_closing(text, mark):
    assert truncation.closing(text)[1] == mark


def test_known_words_cover_all_texts(spark):
    rows = [(i, f"Letter {i} of Rareword Ltd came. It ends on Rareword" if i % 400 == 0 else f"Letter {i} was read by the desk.", "web") for i in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labelled = truncation.with_limits(df, "doc_id", "text", "source", truncation.field_limits(df, "text", "source"))
    known = truncation.known_words(labelled)
    assert "rareword" in {r.word for r in known.collect()}  # 6 of 2,400 texts, too few for a sample to know it
    small, large = (truncation.with_known(labelled, known, size) for size in (0, 1 << 40))
    assert sorted(small.collect()) == sorted(large.collect()) and small.where("is_known").count() == 2400


def test_further_passes_form_pairs_without_the_brand(spark):
    forms = spark.createDataFrame([(c, f, "Varunapur" if c % 2 else "Sarvodur", "ICC") for c, f in FORMS], "company int, form string, office string, class string")
    typed = [(i, f.title() + " Limited", "Port Wellam" if c % 2 else "Sarvodur", "ICC") for i, (c, f) in enumerate(FORMS)]
    # three letters off in one office; nothing like it; another office
    typed += [(300, "Pulxdqzw Hire Purchase Ltd", "Sarvodur", "ICC"), (301, "Qqeeqqee Hire Purchase Ltd", "Sarvodur", "ICC"), (302, "Pulxdqzw Hire Purchase Ltd", "Varunapur", "ICC")]
    typed += [(303, "Zurxbqlw Agro Finance Ltd", "Sarvodur", "ICC"), (304, "Temxkqsw Agro Finance Ltd", "Varunapur", "ICC"), (305, "Halxvqnw Gold Loans Ltd", "Sarvodur", "ICC")]
    records = spark.createDataFrame(typed, "record_id long, name string, office string, class string")
    pairs = {(r.record_id, r.company) for r in linkage.compare(records, "record_id", forms, "company", OFFICES).where("further").collect()}
    assert (300, 4) in pairs and (302, 4) not in pairs
    assert {(303, 100), (304, 101), (305, 122)} <= pairs


def test_truncation_model_depends_on_rows_alone(spark):
    rows = [(i, t, "web") for i, t in enumerate(corpus(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    models = []
    for shaped in (df.coalesce(1), df.orderBy(df.doc_id.desc()).repartition(8, "text")):
        limits = truncation.field_limits(shaped, "text", "source")
        labelled = truncation.with_limits(shaped, "doc_id", "text", "source", limits)
        models.append(truncation.train(labelled, "doc_id", truncation.known_words(labelled), 1000, limits))
    assert (models[0] == models[1]).all() and models[0].any()


def test_keys_of_brands_are_never_broadcast(spark):
    """A brand of 15 letters has some hundred keys: a side that looks small would be gathered on the driver as all of them."""
    brands = spark.createDataFrame([("kihadelazo",), ("kihadelaz",), ("mobutirega",)], "brand string").repartition(2, "brand")
    known = spark.createDataFrame([("kihadelazo",), ("mobtirega",)], "listed string").repartition(2, "listed")
    near = names.near_brands(brands, known)
    assert {tuple(r) for r in near.collect()} >= {("kihadelazo", "kihadelazo"), ("kihadelaz", "kihadelazo"), ("mobutirega", "mobtirega")}
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_keys_of_further_passes_are_never_broadcast(spark):
    typed = spark.createDataFrame([("t", "kihadelazo", ["gold"], "x")], "t_id string, brand string, line array<string>, office string")
    listed = spark.createDataFrame([("f", "kihazzzz", ["gold"], "x")], "f_id string, listed string, meant array<string>, of_office string")
    links = spark.createDataFrame([], "brand string, listed string")
    met = linkage.further_pairs(typed, listed, links, names.Words(["gold", "loans"]))
    assert [(r.t_id, r.f_id) for r in met.collect()] == [("t", "f")]
    assert "BroadcastHashJoin [k" not in met._jdf.queryExecution().executedPlan().toString()
