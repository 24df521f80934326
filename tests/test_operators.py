import datetime as dt
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from kinledger.operators import corpus, evaluate, ingest, limits, model, pairs, retrieve
from kinledger.sources import html_directory, xlsx
from kinledger.streaming import windows

NAMES = [(1, "BAJAJ FINANCE LIMITED", "BAJAJ FINANCE", ["BAJAJ AUTO FINANCE LIMITED"], "C1", ["bajaj.example"]), (2, "YERROW HOUSING LIMITED", "YERROW HOUSING", [], None, ["mail.yerrow.example", "gmail.com"]), (3, "ZED LIMITED", "ZED", [], "C3", [])]


def entities(spark, rows=NAMES):
    df = spark.createDataFrame(rows, "r int, nn string, nc string, al array<string>, cin string, ed array<string>")
    return corpus.to_entity(df, "list", "registered", 0, {"row": "r", "name": "nn", "name_normalized": "nn", "name_core": "nc", "alternate_names": "al", "cin": "cin", "email_domains": "ed"})


def test_identify_and_parents(spark):
    keys = corpus.entity_keys(entities(spark))
    claims = spark.createDataFrame([(1, "C1", "ZED LIMITED", None, None), (2, None, None, "x.bajaj.example", "a.mail.yerrow.example"), (3, None, "BAJAJ AUTO FINANCE LIMITED", None, "gmail.com"), (4, None, None, "example", None)], "claim_id int, cin string, name_normalized string, host string, email_host string")
    got = {(r.claim_id, r.pos % 10): r.identified_by for r in retrieve.identify(claims, "claim_id", keys).collect()}
    assert got == {(1, 1): "cin", (1, 3): "exact_name", (2, 2): "contact_domain", (3, 1): "former_name"}


@pytest.mark.parametrize("hot", [1, 1_000_000])
def test_identify_with_shared_domains_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(retrieve, "HOT_PAIRS", hot)
    listed = [(i, f"N{i} LIMITED", f"N{i}", [], f"C{i}", ["post.example", f"own{i}.example"]) for i in range(6)]
    e = entities(spark, listed)
    asked = [(k, f"C{k}" if k % 2 else None, f"N{k % 3} LIMITED" if k > 3 else None, f"own{k}.example" if k == 4 else None, "mail.post.example") for k in range(8)]
    claims = spark.createDataFrame(asked, "claim_id int, cin string, name_normalized string, host string, email_host string")
    rows = retrieve.identify(claims, "claim_id", corpus.entity_keys(e), e.select("pos", "id")).collect()
    want = {}
    for k, cin, name, _, _ in asked:
        for i in range(6):
            routes = [r for r, hit in (("cin", cin == f"C{i}"), ("exact_name", name == f"N{i} LIMITED"), ("contact_domain", True)) if hit]
            want[k, f"list:{i}"] = (routes[0], sorted(routes))
    assert len(rows) == len(want) and {(r.claim_id, r.id): (r.identified_by, list(r.routes)) for r in rows} == want
    best = retrieve.identified_best(claims.withColumn("text", F.lit("N5")), "claim_id", corpus.entity_keys(e), e.select("pos", F.col("name_core").alias("text"), F.lit(0).alias("place")), 2)
    assert {(r.claim_id, f"list:{r.pos}"): r.identified_by for r in best.collect()} == {k: v[0] for k, v in want.items()}
    monkeypatch.setattr(retrieve, "FEW_ENTITIES", 1)
    near = retrieve.identified_best(claims.where("claim_id = 0").withColumn("text", F.lit("N5")), "claim_id", corpus.entity_keys(e), e.select("pos", F.col("name_core").alias("text"), F.lit(0).alias("place")), 2)
    assert {r.pos for r in near.collect()} == {0, 5}


def test_search_survives_a_typo_and_ties_follow_position(spark):
    claims = spark.createDataFrame([(1, "BAJAJJ FINANCE", "BAJAJJ FINANCE"), (2, "ZED LIMITED", "ZED"), (3, "X", "X"), (4, None, None)], "claim_id int, name_normalized string, name_core string")
    got = retrieve.search_candidates(claims, "claim_id", entities(spark), 5).collect()
    best = {r.claim_id: r for r in got if r["rank"] == 1}
    assert best[1].pos == 1 and best[2].pos == 3 and best[2].score > 2000 and set(best) == {1, 2}
    assert retrieve.search_candidates(claims.limit(0), "claim_id", entities(spark), 5).collect() == []


@pytest.mark.parametrize("block", [3, 1000])
def test_search_by_blocks_equals_brute_force(spark, monkeypatch, block):
    from kinledger.operators import scored

    monkeypatch.setattr(scored, "BLOCK_ENTITIES", block)
    monkeypatch.setattr(retrieve, "NGRAM_BELOW", 4)
    names = ["ARO BELA", "ARO BELA", "ARO CITU", "DEMA CITU", "DEMA BELA ARO", "BELACITU", "XELA", "AROBELA"]
    listed = [(i, n + " LIMITED", n, [], None, []) for i, n in enumerate(names)]
    asked = {1: "ARO BELA", 2: "CITU", 3: "BELAC", 4: "ZZZ", 5: "ARO DEMA BELA"}
    claims = spark.createDataFrame([(k, n, n) for k, n in asked.items()], "claim_id int, name_normalized string, name_core string")
    got = {(r.claim_id, r["rank"]): (r.pos, r.score) for r in retrieve.search_candidates(claims, "claim_id", entities(spark, listed), 2).collect()}
    grams = lambda n: {n.replace(" ", "")[i : i + 3] for i in range(max(1, len(n.replace(" ", "")) - 2))}
    idf = lambda t: math.log((len(names) + 1) / (sum(t in n.split() for n in names) + 1)) + 1
    want = {}
    for k, q in asked.items():
        w = {i: sum(idf(t) for t in set(q.split()) & set(n.split())) for i, n in enumerate(names)}
        thin = sum(x > 0 for x in w.values()) < 4
        full = {i: round(x + (0.35 * len(grams(q) & grams(names[i])) if thin else 0) + 1000 * (q == names[i]), 6) for i, x in w.items()}
        best = sorted((-x, i) for i, x in full.items() if x > 0)[:2]
        want |= {(k, r + 1): (i, pytest.approx(-x)) for r, (x, i) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("block", [3, 1000])
def test_whole_search_follows_every_word_and_gram(spark, monkeypatch, block):
    from kinledger.operators import scored

    monkeypatch.setattr(scored, "BLOCK_ENTITIES", block)
    monkeypatch.setattr(retrieve, "NGRAM_BELOW", 2)
    monkeypatch.setattr(corpus, "CEILING_LEAST", 1)
    names = ["ARO BELA", "ARO BELA", "ARO CITU", "DEMA CITU", "DEMA BELA ARO", "BELACITU", "XELA", "AROBELA"]
    listed = [(i, n + " LIMITED", n, [], None, []) for i, n in enumerate(names)]
    asked = {1: "ARO BELA", 2: "CITU", 3: "BELAC", 4: "ZZZ", 5: "ARO DEMA BELA"}
    claims = spark.createDataFrame([(k, n, n) for k, n in asked.items()], "claim_id int, name_normalized string, name_core string")
    rows = lambda df: {(r.claim_id, r.pos): (r["rank"], r.score) for r in df.collect()}
    grams = lambda n: {n.replace(" ", "")[i : i + 3] for i in range(max(1, len(n.replace(" ", "")) - 2))}
    idf = lambda t: math.log((len(names) + 1) / (sum(t in n.split() for n in names) + 1)) + 1
    want = {}
    for k, q in asked.items():
        full = {i: round(sum(idf(t) for t in set(q.split()) & set(n.split())) + 0.35 * len(grams(q) & grams(n)) + 1000 * (q == n), 6) for i, n in enumerate(names)}
        want |= {(k, i): (r + 1, pytest.approx(-x)) for r, (x, i) in enumerate(sorted((-x, i) for i, x in full.items() if x > 0))}
    assert rows(retrieve.search_candidates(claims, "claim_id", entities(spark, listed), 8, scan_cap=1, whole=True)) == want
    assert rows(retrieve.search_candidates(claims, "claim_id", entities(spark, listed), 8, scan_cap=1)) != want


def test_fuzzy_search_equals_brute_force(spark):
    from kinledger.functions.similarity import pg_similarity

    words = ["agro", "agri", "finance", "financial", "gold", "golden", "loans"]
    names = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words)], "n_id int, name string")
    queries = spark.createDataFrame([(1, "agro finanse"), (2, "gold"), (3, None), (4, "!!")], "q_id int, q string")
    fast = {(r.q_id, r.n_id) for r in retrieve.fuzzy_search(queries, "q_id", "q", names, "n_id", "name", limit=1000).collect()}
    slow = queries.where("q is not null").crossJoin(names).where(pg_similarity(F.col("q"), F.col("name")) >= F.lit(0.3).cast("float"))
    assert fast == {(r.q_id, r.n_id) for r in slow.collect()} and fast


def test_metrics_against_brute_force(spark):
    rows = [(i, (i * 7) % 3 == 0, ((i * 37) % 50) / 50) for i in range(300)]
    df = spark.createDataFrame([(i, int(y), s) for i, y, s in rows], "id int, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    levels = sorted({s for *_, s in rows}, reverse=True)
    ap = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for *_, s in rows) for t in levels)
    m = evaluate.ranking_metrics(df, "y", "s").first()
    assert m.roc_auc == pytest.approx(auc, abs=1e-6) and m.average_precision == pytest.approx(ap, abs=1e-6)
    one = evaluate.ranking_metrics(df.where("y = 1"), "y", "s").first()
    assert one.roc_auc is None and one.average_precision is None
    sweep = evaluate.confusion_sweep(df, "y", "s")
    at = sweep.where("abs(threshold - 0.5) < 1e-9").first()
    assert (at.tp, at.fp) == (sum(p >= 0.5 for p in pos), sum(n >= 0.5 for n in neg))
    assert evaluate.choose_threshold(sweep).first().cost_primary == min(r.cost_primary for r in sweep.collect())


def test_scorers(spark):
    df = spark.createDataFrame([(0.4, 1.0), (0.5, 0.0)], "a double, b double")
    tree = {"feature": "a", "threshold": 0.4, "left": {"value": 0.1}, "right": {"value": 0.9}}
    assert [r.x for r in df.select(model.forest_score([tree, tree]).alias("x")).collect()] == [0.1, 0.9]
    big = df.select(model.logistic_score({"a": 1e6}, 0.0).alias("x"), model.sigmoid(F.lit(-800.0)).alias("y")).first()
    assert big.x == 1 and big.y == 0


def test_variants_and_split(spark):
    df = spark.createDataFrame([(1, "Alpha Beta & Gamma Private Limited"), (2, "Zed"), (3, None)], "id int, name string")
    got = {(r.id, r.variant_id): r.query_text for r in pairs.query_variants(df, "id", "name").collect()}
    assert got[1, "legal_form_dropped"] == "Alpha Beta & Gamma" and got[1, "legal_form_swapped"] == "Alpha Beta & Gamma Pvt Ltd" and got[1, "initialism_with_legal_form"] == "ABGPL" and got[2, "verbatim"] == "Zed"
    assert (2, "initialism") not in got and got[1, "single_character_typo"] != got[1, "verbatim"]
    h = 20260629
    for ch in "DELHI":
        h = ((h ^ ord(ch)) * 16777619) % 2**32
    assert df.limit(1).select(pairs.group_hash(F.lit("DELHI")).alias("h")).first().h == h / 2**32


def test_ingest(spark):
    sheet = spark.createDataFrame([(1, ["added list"] * 3), (2, ["1", "a", None]), (3, [None, " ", None]), (4, ["removed list", None, None]), (5, ["2", "b", "c"])], "row_number int, cells array<string>")
    marks = sheet.select("row_number", ingest.is_blank_row(F.col("cells")).alias("b"), ingest.is_banner_row(F.col("cells")).alias("t")).collect()
    assert [r.row_number for r in marks if r.b] == [3] and [r.row_number for r in marks if r.t] == [1, 4]
    section = F.when(ingest.is_banner_row(F.col("cells")), ingest.section_of(F.get("cells", F.lit(0))))
    filled = ingest.fill_forward(sheet.withColumn("s", F.lit("x")), ["s"], ["row_number"], section, "section").collect()
    assert [r.section for r in filled] == ["added_to_list"] * 3 + ["removed_from_list"] * 2
    assert sheet.select(ingest.as_of_text(F.lit("List (as on June 30, 2026)")).alias("x")).first().x == "June 30, 2026"
    ingest.assert_headers(sheet.where("row_number = 5"), "cells", ["2", "B"]).collect()
    with pytest.raises(Exception, match="unexpected header"):
        ingest.assert_headers(sheet.where("row_number = 5"), "cells", ["Sl"]).collect()


def test_upsert_is_idempotent_and_prunes(spark):
    schema = "k int, v string, at int, f string, s string"
    old = spark.createDataFrame([(1, "a", 1, "f", "s"), (2, "b", 1, "f", "s"), (None, "legacy", 1, None, None)], schema)
    new = spark.createDataFrame([(2, "B", 2, "f", "s"), (2, "B2", 3, "f", "s"), (3, "c", 2, "f", "s")], schema)
    once = ingest.upsert(old, new, ["k"], "at")
    assert sorted((r.k or 0, r.v) for r in once.collect()) == [(0, "legacy"), (1, "a"), (2, "B2"), (3, "c")]
    assert sorted(map(str, ingest.upsert(once, new, ["k"], "at").collect())) == sorted(map(str, once.collect()))
    loaded = spark.createDataFrame([("f", "s", 2)], "file string, sheet string, run_at int")
    assert sorted(r.v for r in ingest.prune_stale(once, "f", "s", loaded, "at").collect()) == ["B2", "c", "legacy"]
    assert ingest.legacy_rows(once, "f").count() == 1


def test_limiters(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1, 0, 0, 30)
    at = [0, 10, 20, 30, 60, 61, 200]
    rows = [("c", t0 + dt.timedelta(seconds=s)) for s in at] + [("d", t0)]
    df = spark.createDataFrame(rows, "client string, ts timestamp")
    got = {r.client: (r.n_requests, r.n_allowed, r.n_windows) for r in limits.anchored_window(df, "client", "ts", 3, 60).collect()}
    assert got == {"c": (7, 6, 3), "d": (1, 1, 1)}
    assert limits.fixed_window(df, "client", "ts", 3, 60).where("allowed").count() == 8
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.limiter(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "client", "ts", 3, 60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    out = spark.sql("select * from limited").collect()
    assert sum(r.allowed for r in out) == 7 and [r.retry_after_s for r in out if not r.allowed] == [30]


def test_windows(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(minutes=m), "k", 1) for m in (0, 5, 70, 75)], "ts timestamp, kind string, user int")
    assert sorted(r.n for r in windows.tumbling_counts(df, "ts", "kind", "1 hour", "5 minutes").collect()) == [2, 2]
    assert sorted(r.n for r in windows.session_counts(df, "ts", "user", "10 minutes", "5 minutes").collect()) == [2, 2]


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>12</v></c><c r="B3" s="1"><v>44316</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#VALUE!</v></c><c r="E3" t="str"><f>A1</f><v>res</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    workbook(path)
    spark.dataSource.register(xlsx.XlsxSource)
    rows = spark.read.format("xlsx_sheet").option("sheet", "One").load(path).orderBy("row_number").collect()
    assert [(r.row_number, r.cells) for r in rows] == [(1, ["Name", None, "Rich text"]), (2, []), (3, ["12", "2021-04-30 00:00:00", "Yes", None, "res"])]
    assert {r.sheet for r in spark.read.format("xlsx_sheet").option("mode", "sheets").load(path).collect()} == {"One", "Two"}
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("xlsx_sheet").option("sheet", "Three").load(path).collect()


def test_html_directory(spark):
    page = "<h2>Small Banks</h2><table><tr><td>1. <a href='https://a.example'>Alpha Bank*</a></td></tr><tr><td>Beta Bank,<br>12 Road<br>Town</td></tr></table><h3>Foreign</h3><table><tr><td><a href='https://a.example'>Alpha Bank</a></td><td></td></tr><tr><td><a href='https://a.example'>ALPHA BANK</a></td></tr></table>"
    spark.udtf.register("directory_entries", html_directory.DirectoryEntries)
    spark.createDataFrame([(page,), (None,), ("",)], "html string").createOrReplaceTempView("directory_pages")
    got = [tuple(r) for r in spark.sql("select e.* from directory_pages, lateral directory_entries(html) e").collect()]
    assert got == [("Small Banks", "Alpha Bank", "https://a.example", None), ("Small Banks", "Beta Bank", None, "12 Road, Town"), ("Foreign", "Alpha Bank", "https://a.example", None)]


def test_merge_profile_report(spark):
    df = spark.createDataFrame([("A", "Alpha", "X", None), ("A", "Alpha Bank", "Y", "addr"), (None, "z", None, None)], "core string, name string, cat string, address string")
    r = ingest.merge_by_core(df, "core", "name", "cat", {"Y": 0, "X": 1}, "address").first()
    assert (r["name"], r.names, r.categories, r.category, r.address) == ("Alpha Bank", ["Alpha", "Alpha Bank"], ["X", "Y"], "Y", "addr")
    p = {x.column_name: (x.n_rows, x.n_null, x.n_distinct) for x in ingest.profile(df, ["core", "cat"]).collect()}
    assert p == {"core": (3, 1, 1), "cat": (3, 1, 2)}


def test_nearest_names_against_all_pairs(monkeypatch):
    """The kernel of the fuzzy name search, with few and with many common words, over ties, repeated and empty sides."""
    import random

    import pyarrow as pa

    from kinledger.operators import scored

    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    schema = pa.schema([("kind", pa.int32()), ("text", pa.string()), ("id", pa.int32()), ("similarity", pa.float32())])
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    tails = ["gold loans limited", "gold limited", "finance private limited", ""]
    texts = sorted({f"{word()} {rng.choice(tails)}".strip() for _ in range(150)})
    names = [(i, rng.choice(texts[:60]) if i % 3 else f"{word()} {rng.choice(tails)}".strip()) for i in range(200)]
    names.append((200, ""))
    for share in (0.0, 0.02, 0.2, 2.0):
        monkeypatch.setattr(scored, "COMMON_WORD", share)
        held = pa.table({"id": pa.array([i for i, _ in names], pa.int32()), "sort_name": [f"n{i % 7}" for i, _ in names], "words": [t for _, t in names]})
        asked = pa.table({"kind": pa.array([0] * len(texts), pa.int32()), "text": texts, "words": texts})
        got = {}
        for r in scored.nearest(5, 0.3, schema)(asked, held).to_pylist():
            got.setdefault(r["text"], []).append((round(r["similarity"], 5), r["id"]))
        for t in texts:
            sims = [(len(grams(t) & grams(x)) / len(grams(t) | grams(x)), f"n{i % 7}", i) for i, x in names]
            assert got.get(t, []) == [(round(s, 5), i) for s, _, i in sorted((x for x in sims if x[0] >= 0.3), key=lambda x: (-x[0], *x[1:]))[:5]], (share, t)
        assert scored.nearest(5, 0.3, schema)(asked, held.slice(0, 0)).num_rows == scored.nearest(5, 0.3, schema)(asked.slice(0, 0), held).num_rows == 0


def test_scoring_meets_only_what_a_claim_shares(monkeypatch):
    """Blocking scores against plain sums; a claim's work follows its postings, no array of all places is made for it."""
    import random

    import numpy as np
    import pyarrow as pa

    from kinledger.operators import scored

    rng = random.Random(5)
    schema = pa.schema([("k", pa.int64()), ("pos", pa.int64()), ("w", pa.float64()), ("by_grams", pa.bool_()), ("n1", pa.int64())])
    posts = [(kind, f"{kind}{i}", rng.random() + 0.5 if kind == "w" else None, sorted(rng.sample(range(1000, 1400), rng.randrange(1, 60)))) for kind in "wg" for i in range(30)]
    posts[3][3].append(posts[3][3][0])  # a place of two rows counts twice
    posts[40][3].append(posts[40][3][0])
    index = pa.table({"kind": [p[0] for p in posts], "term": [p[1] for p in posts], "idf": pa.array([p[2] for p in posts], pa.float64()), "at": pa.array([p[3] for p in posts], pa.list_(pa.int64()))})
    asked = [(i, rng.sample([f"w{j}" for j in range(40)], i % 5), rng.sample([f"g{j}" for j in range(40)], 2 * (i % 4)), rng.sample(range(990, 1400), i % 3)) for i in range(40)]
    claims = pa.table({"k": [a[0] for a in asked], "words": pa.array([a[1] for a in asked], pa.list_(pa.string())), "grams": pa.array([a[2] for a in asked], pa.list_(pa.string())), "sure": pa.array([a[3] for a in asked], pa.list_(pa.int64()))})
    by_term = {p[1]: p for p in posts}
    dense = []
    real = np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: dense.append(1) or real(*a, **k))
    for blocks, below in ((1, 60), (2, 60), (1, 0), (1, 10_000)):
        got = {}
        for r in scored.scoring("k", 7, below, 0.35, blocks, schema)(claims, index).to_pylist():
            if r["pos"] is not None:
                assert got.setdefault((r["k"], r["by_grams"]), {}).setdefault(r["pos"], r["w"]) == r["w"]
            else:
                got[r["k"], "n1"] = r["n1"]
        for key, ws, gs, sure in asked:
            w, n_grams = {}, {}
            for t in ws:
                for pos in by_term[t][3] if t in by_term else []:
                    w[pos] = w.get(pos, 0.0) + by_term[t][2]
            n1 = len(w)
            for t in gs:
                for pos in by_term[t][3] if t in by_term else []:
                    n_grams[pos] = n_grams.get(pos, 0) + 1
            whole = {pos: w.get(pos, 0.0) + 0.35 * n_grams.get(pos, 0) for pos in {*w, *n_grams}}
            for by_grams, sums in ((False, w), (True, whole)):
                if (by_grams and n1 >= below) or (not by_grams and blocks == 1 and n1 < below):
                    assert (key, by_grams) not in got
                    continue
                first = sorted(sums, key=lambda pos: (-round(sums[pos] * 1e6), pos))[: max(7, len(sure))]
                assert got.get((key, by_grams), {}) == pytest.approx({pos: sums[pos] for pos in {*first, *(x for x in sure if x in sums)}})
            assert blocks == 1 or got[key, "n1"] == n1
    assert not dense
