import random
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinledger.functions import html, labels, requests, text
from kinledger.operators import corpus, evaluate, ingest, limits, model, pairs, retrieve
from kinledger.plans import search, training
from kinledger.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "cell, shown, former",
    [
        ("121 Finance Private Limited (Formerly: Yerrow Finance and Investments Private Limited)", "121 Finance Private Limited", ["Yerrow Finance and Investments Private Limited"]),
        ("A C Steels (Name as per MCA - A.C. Fincom Private Limited)", "A C Steels", ["A.C. Fincom Private Limited"]),
        ("B (India) Ltd (formerly known as C Wealth Prime Limited and C Wealth Finance Limited)", "B (India) Ltd", ["C Wealth Prime Limited", "C Wealth Finance Limited"]),
        ("(Formerly: D Ltd) (formerly D LTD.)", "(Formerly: D Ltd) (formerly D LTD.)", ["D Ltd"]),
        (None, "", []),
        ("x" * 20000, "x" * 20000, []),
    ],
)
def test_former_names(spark, cell, shown, former):
    got = one(spark, text.parse_company_name, cell)
    assert (got.display_name, got.alternate_names) == (shown, former)


def test_core_strips_as_often_as_it_takes(spark):
    assert one(spark, text.name_core, "X" + " AND CO PRIVATE LIMITED LTD" * 6) == "X"
    assert one(spark, text.name_core, "PRIVATE LIMITED") == "PRIVATE LIMITED" and one(spark, text.name_core, "") == ""


@pytest.mark.parametrize("value, want", [("1,234", 1234), ("-5 x", -5), ("", None), (None, None), ("--", None), ("7-8", 7), ("9" * 40, None)])
def test_integers(spark, value, want):
    assert one(spark, text.parse_integer, value) == want


@pytest.mark.parametrize("address, public", [("8.8.8.8", True), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("100.64.0.1", False), ("169.254.1.1", False), ("224.0.0.1", False), ("256.1.1.1", False), ("1.2.3", False), ("::1", False), ("fe80::1", False), ("2001:db8::5", True), ("::ffff:10.0.0.1", False), ("::ffff:9.9.9.9", True), ("host.example", False), (None, False), ("", False)])
def test_public_addresses(spark, address, public):
    assert one(spark, requests.is_public_address, address) is public


@pytest.mark.parametrize("value, kind", [("U65999KA2019PTC123456", "cin"), ("a@b.example", "email"), ("www.b.example/x", "website"), ("A.C. Choksi & Co.", "company_name"), ("ftp://b.example", "company_name"), ("", None), (None, None)])
def test_free_text(spark, value, kind):
    assert one(spark, requests.kind_of_text, value) == kind


def test_requests(spark):
    rows = [(1, "x", None, None, None), (2, None, None, "b.example", "q@c.example"), (3, None, None, None, "q@c.example"), (4, None, None, None, None), (5, "a" * 301, None, None, None), (6, "a\u0000b", None, None, None), (7, None, None, None, "nobody"), (8, None, "x1", None, None), (9, None, None, "ht tp", None)]
    df = spark.createDataFrame(rows, "id int, name string, cin string, website string, email string")
    got = {r.id: r for r in requests.parse_requests(df, ["id"], None, "name", "cin", "website", "email").collect()}
    assert got[1].kind == "company_name" and got[2].hostname == "b.example" and got[2].kind == "website" and got[3].hostname == "c.example"
    assert got[4].error == requests.EMPTY and "too long" in got[5].error and "not allowed" in got[6].error and "e-mail" in got[7].error and "website" in got[9].error
    assert got[8].cin == "X1" and got[8].cin_looks_malformed and got[8].error is None


def test_labels(spark):
    assert one(spark, labels.bank_category, "List of Small Finance Banks (private sector)") == "small_finance_bank" and one(spark, labels.bank_category, None) is None
    assert one(spark, labels.slug, "THE A & B (BANK)") == "the_a_b_bank" and one(spark, lambda c: labels.shorten(c, 5), "abcdef") == "abcd…"
    assert one(spark, labels.url_key, "https://www.B.example/X/") == "b.example/x" and one(spark, labels.url_key, "ftp://b.example") is None
    assert one(spark, lambda c: labels.without_fillers(c, 9), " N/A ") is None
    assert one(spark, lambda c: labels.confidence_label(c, F.lit(0.95)), "cin") == "identified by CIN" and one(spark, lambda c: labels.confidence_label(c, F.lit(0.7)), None) == "possibly the same institution"


def test_pages(spark):
    page = "<title>A&#8377;&#12;B</title><meta property='og:x' content=\"it's\"><a href='/q'> </a><a href=\"/w#f\">W &amp; x</a><a href='#a'>n</a><a name=1>no</a><a href='https://other.example/'>o</a>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "x string")
    got = df.select(html.page_title(F.col("x")).alias("t"), html.page_meta(F.col("x"), "og:x").alias("m"), html.page_links(F.col("x"), F.lit("b.example")).alias("l")).collect()
    assert got[0].t == "A₹ B" and got[0].m == "it's" and [(r.url, r.label) for r in got[0].l] == [("https://b.example/q", "/q"), ("https://b.example/w", "W & x")]
    assert got[1].t is None and got[2].t is None and got[2].l == []
    names = one(spark, html.company_names, "our partner R.K. Finance&Leasing Pvt. Ltd. and Abc Private Limited; abc private limited, ABC Private Limited")
    assert names == ["R.K. Finance&Leasing Pvt. Ltd.", "Abc Private Limited"]
    assert one(spark, lambda c: html.fenced_json(c).cast("string"), "```json\n{\"a\":1}\n```") == '{"a":1}' and one(spark, lambda c: html.fenced_json(c).cast("string"), "{bad") is None


def test_anchored_window_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randrange(0, 4000)) for _ in range(400)] + [(None, 5), ("c", None)]
    df = spark.createDataFrame(rows, "client string, s long").select("client", F.timestamp_seconds("s").alias("ts"))
    want = {}
    for client in "ab":
        start, n, state = None, 0, [0, 0, 0]
        for t in sorted(s for c, s in rows if c == client):
            if start is None or t - start >= 60:
                start, n = t, 0
                state[2] += 1
            n += 1
            state[0], state[1] = state[0] + 1, state[1] + (n <= 3)
        want[client] = tuple(state)
    assert {r.client: (r.n_requests, r.n_allowed, r.n_windows) for r in limits.anchored_window(df, "client", "ts", 3, 60).collect()} == want
    assert limits.anchored_window(df.limit(0), "client", "ts", 3, 60).collect() == []


def grams(s):
    return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() for i in range(len(w) + 1)}


def test_fuzzy_names_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    cores = [f"{word()} {word()}".upper() for _ in range(60)]
    names = spark.createDataFrame([(i, c + " PRIVATE LIMITED", c) for i, c in enumerate(cores)], "id int, name_normalized string, name_core string")
    asked = [(i, c[:-1] + " LTD", c[:-1]) for i, c in enumerate(cores[:8])] + [(100, None, None), (101, "", "")]
    queries = spark.createDataFrame(asked, "q_id int, name_normalized string, name_core string")
    got = {}
    for r in retrieve.fuzzy_name_search(queries, "q_id", names, "id", limit=4).collect():
        got.setdefault(r.q_id, {})[r["rank"]] = round(r.similarity, 4)
    sim = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    for q, full, core in asked[:8]:
        best = sorted((max(sim(full, c + " PRIVATE LIMITED"), sim(core, c)) for c in cores), reverse=True)[:4]
        assert [got[q][i] for i in sorted(got[q])] == [round(x, 4) for x in best if x >= 0.3]
    assert 100 not in got and 101 not in got


def entities(spark):
    rows = [Row(source_row_number=i, name=f"{b} {t} Private Limited", name_normalized=f"{b} {t} PRIVATE LIMITED".upper(), name_core=f"{b} {t}".upper(), alternate_names=[f"OLD {b} {t}".upper()] if i % 3 == 0 else [], cin_normalized=f"C{i}", email_domains=[f"{b}.example"]) for i, (b, t) in enumerate((b, t) for b in ("makano", "temoki", "zuri", "hoxodo") for t in ("gold loans", "agro finance", "leasing"))]
    bank = [Row(source_row_number=1, name="Bank of Zuri", name_normalized="BANK OF ZURI", name_core="BANK OF ZURI", hostnames=["www.zuri.example"])]
    return corpus.unite({"registered_nbfc": spark.createDataFrame(rows), "bank": spark.createDataFrame(bank)}).cache()


def test_hosts_of_banks_identify(spark):
    e = entities(spark)
    claims = spark.createDataFrame([(1, "Zuri Bank", None, "https://net.zuri.example/x", None), (2, "qq", None, None, None)], "claim_id int, claimed_name string, cin string, website string, email string")
    ranked = {(r.claim_id, r["rank"]): r for r in search.ranked_matches(claims, e).collect()}
    assert ranked[1, 1].entity_id == "bank:1" and ranked[1, 1].identified_by == "official_website" and ranked[1, 1].accepted
    served = search.served_search(claims, e, "bank", 500).collect()
    assert {r.entity_id for r in served} == {"bank:1"}


def test_training_pairs(spark):
    e = entities(spark)
    made = training.labelled_pairs(e, 50).collect()
    split = {r.id: r.split for r in e.select("id", pairs.group_split(F.col("cluster_key")).alias("split")).collect()}
    assert made and all(split[r.entity_id] == r.split for r in made)
    assert len({(r.split, r.q_normalized, r.entity_id) for r in made}) == len(made)
    assert {r.variant_id for r in made} >= {"verbatim", "legal_form_dropped", "legal_form_swapped", "rbi_former_name"}
    verbatim = {(r.query_text, r.entity_id) for r in made if r.variant_id == "verbatim" and r.label == 1}
    assert verbatim == {(r.name, r.id) for r in e.select("id", "name").collect()}
    assert training.labelled_pairs(e.limit(0), 5).collect() == []
    full = training.featured(spark.createDataFrame(made), e)
    assert full.where("label = 1 and variant_id = 'verbatim' and exact_normalized_match <> 1").count() == 0


def test_quotas_redistribute(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 100 + i) for i in range(50)] + [("c", 200 + i) for i in range(20)], "s string, k int")
    got = {r.s: r["count"] for r in pairs.stratified_sample(df, "s", "k", 30).groupBy("s").count().collect()}
    assert got == {"a": 3, "b": 17, "c": 10}
    assert pairs.stratified_sample(df.limit(0), "s", "k", 30).collect() == []


def test_sheet_reading(spark):
    rows = [("w", "s1", 1, ["List as on March 31, 2026", None]), ("w", "s1", 2, ["Sl. No", "Name"]), ("w", "s1", 3, ["1", "A Ltd"]), ("w", "s1", 4, ["", " "]), ("w", "s1", 5, ["x", "x"]), ("w", "s2", 1, ["No date", None]), ("w", "s2", 2, ["a", "b"])]
    df = spark.createDataFrame(rows, "book string, sheet string, n int, cells array<string>")
    heads = {r.sheet: r for r in ingest.inherit_as_of(ingest.sheet_header(df, ["book", "sheet"], "n", "cells"), ["book"]).collect()}
    assert heads["s1"].as_of == heads["s2"].as_of == "2026-03-31" and heads["s1"].headers == ["Sl. No", "Name"]
    assert [r.n for r in ingest.data_rows(df.where("sheet = 's1'"), "n", "cells").collect()] == [3]
    wide = spark.createDataFrame([(1, ["x", "", "y"]), (2, None)], "n int, cells array<string>")
    assert [(r.source_column, r.field_group, r.value) for r in ingest.unpivot_cells(wide, "n", "cells", ["g"]).orderBy("source_column").collect()] == [(1, "g", "x"), (3, "column_3", "y")]
    arc = spark.createDataFrame([(1, ["4", "B ARC Ltd (Formerly: C Ltd)", "Town", "u 65", None, "a@b.example; -NA-"]), (2, ["5", " ", "", "", "", ""]), (3, ["6"])], "k int, cells array<string>")
    r = ingest.typed_rows(arc, "registered_arc", "cells", ["k"]).collect()
    assert len(r) == 1 and r[0].sl_no == 4 and r[0].alternate_names == ["C Ltd"] and r[0].cin_normalized == "U65" and not r[0].cin_is_valid and r[0].emails == ["a@b.example"]


def test_refused_snapshot(spark):
    df = spark.createDataFrame([(1, ["x"]), (2, [])], "i int, hosts array<string>")
    assert ingest.refuse_small(df, 2, "hosts", 1).count() == 2
    with pytest.raises(ValueError):
        ingest.refuse_small(df, 3, "hosts", 1)


def test_files(spark, tmp_path):
    schema = "q string, label int, token_jaccard double"
    df = spark.createDataFrame([('a "b", c', 1, 1 / 3), ("line\\x", 0, 0.0)], schema)
    files.write_pairs(df, f"{tmp_path}/p", ["token_jaccard"])
    assert sorted(map(tuple, files.read_pairs(spark, f"{tmp_path}/p", schema).collect())) == sorted([('a "b", c', 1, 0.333333), ("line\\x", 0, 0.0)])
    with pytest.raises(ValueError):
        files.read_pairs(spark, f"{tmp_path}/p", "q string, other int, token_jaccard double")
    e = entities(spark)
    files.write_index(e, f"{tmp_path}/i")
    assert files.load_index(spark, f"{tmp_path}/i").count() == e.count()
    with pytest.raises(ValueError):
        files.load_index(spark, f"{tmp_path}/i", 2)
    (tmp_path / "b.json").write_text('{"fetchedAt":"2026-03-01T05:00:00Z","banks":[{"id":"x","name":"Bank A Ltd","hostnames":["WWW.a.example"]}]}')
    row = files.read_snapshot(spark, f"{tmp_path}/b.json").first()
    assert (row.source_row_number, str(row.dataset_as_of), row.name_core, row.hostnames) == (1, "2026-03-01", "BANK A", ["a.example"])
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError):
        files.read_snapshot(spark, f"{tmp_path}/c.json")
    raw = spark.createDataFrame([(bytearray("₹".encode()),), (bytearray(b"caf\xe9"),)], "b binary").select(files.decode_page(F.col("b")).alias("t"))
    assert [r.t for r in raw.collect()] == ["₹", "café"]


def test_registry_and_selection(spark):
    empty = spark.createDataFrame([], "name string, version string, active boolean, body string")
    a = files.publish_model(empty, "m", "1", {"x": 1})
    b = files.publish_model(a, "m", "2", {"x": 2})
    assert {(r.version, r.active) for r in b.collect()} == {("1", False), ("2", True)}
    assert {(r.version, r.active) for r in files.publish_model(b, "m", "1", {"x": 3}).collect()} == {("1", True), ("2", False)}
    metrics = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.1, 0.9), ("c", 0.2, 1.0)], "model string, cost double, ap double")
    assert evaluate.select_model(metrics, "cost", "ap").first().model == "b"


def test_export_is_the_fitted_model(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.random()), float(rng.random()), 7.0) for i in range(200)]
    df = spark.createDataFrame([(*r, float(r[1] + rng.random() * 0.3 > 0.6)) for r in rows], "k int, a double, b double, c double, label double").coalesce(1)
    fitted = model.fit_logistic(df, ["a", "b", "c"], "label")
    weights, bias = model.export_logistic(fitted, ["a", "b", "c"])
    x, y = model.score_with(fitted, df).select("k", "p"), df.select("k", model.logistic_score(weights, bias).alias("p"))
    assert model.max_difference(x, y, "k", "p").first()[0] < 1e-9


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from kinledger import runtime

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session())
    assert uuid.uuid4()


def test_linked_cells(tmp_path):
    import zipfile

    from kinledger.sources import xlsx

    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "l.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}" xmlns:r="{r}"><sheetData><row r="1"><c r="A1"/><c r="B1" t="inlineStr"><is><t>text</t></is></c></row></sheetData><hyperlinks><hyperlink ref="A1" r:id="a"/><hyperlink ref="B1" r:id="b"/></hyperlinks></worksheet>')
        z.writestr("xl/worksheets/_rels/s.xml.rels", f'<R><x Id="a" Type="{r}/hyperlink" Target="mailto:a@b.example"/><x Id="b" Type="{r}/hyperlink" Target="https://b.example"/></R>')
    with zipfile.ZipFile(path) as book:
        assert list(xlsx.rows(book, "xl/worksheets/s.xml")) == [(1, ["a@b.example", "text"])]


def test_entry_functions(spark):
    from kinledger import api

    e = entities(spark)
    assert api.search(e, "Makano Gold Loans Ltd", "registered_nbfc", "3").first().entity_id == "registered_nbfc:0"
    for bad in (("x", "all", 5), ("y" * 301, "all", 5), ("makano", "nowhere", 5), ("makano", "all", "many")):
        with pytest.raises(api.InvalidInput):
            api.search(e, *bad)
    assert api.record(e, "bank:1").first().name == "Bank of Zuri" and api.record(e, "bank:1; --").count() == 0 and api.record(e, "other:1").count() == 0
    assert api.identify(e, query="https://net.zuri.example/x").first().identified_by == "official_website"
    with pytest.raises(api.InvalidInput):
        api.identify(e)
