import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinledger.operators import parsing, snapshots, timestamps

NBFC = "1,Name,Office,Yes,ICC,U1,Base,Addr,a@b.example"
LINES = [
    (NBFC, "registered_nbfc", "data", None),
    (NBFC + "\r", "registered_nbfc", "data", None),
    (NBFC + "\r\n", "registered_nbfc", "rejected", "line break outside quotes"),
    ('1,"Na""me, Ltd",Office,,ICC,,,"Addr\nline 2",', "registered_nbfc", "data", None),
    ('1,"Name"x,Office,Yes,ICC,U1,Base,Addr,a', "registered_nbfc", "rejected", "text after closing quote"),
    ('1,Na"me,Office,Yes,ICC,U1,Base,Addr,a', "registered_nbfc", "rejected", "quote inside unquoted cell"),
    ('1,"Name,Office', "registered_nbfc", "rejected", "quote never closed"),
    ("1,Name,Office", "registered_nbfc", "rejected", "3 cells instead of 9"),
    (NBFC.replace("Office", "Off\x07ice"), "registered_nbfc", "rejected", "control character"),
    (NBFC.replace("Office", "Off�ice"), "registered_nbfc", "rejected", "control character"),
    ("　,,,,,,,,", "registered_nbfc", "furniture", None),
    ("Heading only,,,,,,,,", "registered_nbfc", "furniture", None),
    ("SL. NO,Name,x,,,,,,", "registered_nbfc", "furniture", None),
    ("१२,Name,Office,Yes,ICC,U1,Base,Addr,a", "registered_nbfc", "rejected", "serial is not a number"),
    ("1,  ,Office,Yes,ICC,U1,Base,Addr,a", "registered_nbfc", "rejected", "no name"),
    ("1,Name,Office,Maybe,ICC,U1,Base,Addr,a", "registered_nbfc", "rejected", "deposits neither yes nor no"),
    ("7,C,Name,O,K,Cl,N,2001-02-03 00:00:00,3 Feb 2001,R", "cancelled_record", "data", None),
    ("7,C,Name,O,K,Cl,N,36000,\"February 3, 2001\",R", "cancelled_record", "data", None),
    ("7,C,Name,O,K,Cl,N,30/02/2001,,R", "cancelled_record", "rejected", "not a calendar date"),
    (None, "cancelled_record", "rejected", "no line"),
    ("1,a", None, "rejected", "unknown layout"),
    ("", "cancelled_company", "rejected", "1 cells instead of 4"),
    ('1,"' + "y" * 100_000 + '",o,a', "cancelled_company", "data", None),
]


@pytest.mark.parametrize("line, dataset, kind, reason", LINES)
def test_sheet_lines(line, dataset, kind, reason):
    got = parsing.read_sheet_line(line, dataset)
    assert (got["kind"], got["reason"]) == (kind, reason)


def test_grammar_resumes_at_record_starts():
    text = '1,"broken,x\n2,fine,y\nfree text\n3,"ok",z\n'
    records = list(parsing.SheetGrammar(text).file())
    assert [(r.error, r.cells) for r in records] == [("text after closing quote", ["1"]), (None, ["2", "fine", "y"]), (None, ["free text"]), (None, ["3", "ok", "z"])]
    assert text[records[0].error_at :].startswith('ok"')


NOTES = {
    '{"messages": [], "truncated": false, "failure": null}': None,
    ' {"failure":"x","truncated":true,"messages":["a\\n\\u00e9"]}\n': None,
    '{"messages": [], "truncated": 0, "failure": null}': "truncated is not a boolean",
    '{"messages": [1], "truncated": false, "failure": null}': "messages is not an array of strings",
    '{"messages": [], "truncated": false}': "other keys than messages, truncated, failure",
    '{"messages": [], "messages": [], "truncated": false, "failure": null}': "other keys than messages, truncated, failure",
    '{"messages": ["a\nb"], "truncated": false, "failure": null}': "bad string",
    '{"messages": [], "truncated": False, "failure": null}': "unexpected character",
    '{"messages": [,], "truncated": false, "failure": null}': "unexpected character",
    '{"messages": [], "truncated": false, "failure": null}}': "text after the value",
    "null": "not an object",
    "": "unexpected character",
    "[" * 500: "nested too deeply",
}


@pytest.mark.parametrize("notes, reason", NOTES.items())
def test_notes(notes, reason):
    assert parsing.read_notes(notes)["reason"] == reason


def test_failed_rows(spark):
    sheet = spark.createDataFrame([(i, *x[:2], "p") for i, x in enumerate(LINES)], "line_id long, line string, dataset_key string, parsed string")
    runs = spark.createDataFrame([(1, None), (2, "null"), (3, next(iter(NOTES)))], "run_id long, notes string")
    got = {(r.table_name, r.row_key) for r in parsing.failed_rows(sheet, runs).collect()}
    assert got == {("sheet_rows", i) for i, x in enumerate(LINES) if x[2] == "rejected"} | {("import_runs", 2)}
    assert parsing.failed_rows(sheet.limit(0), runs.limit(0)).collect() == []
    good, bad = parsing.split_sheet_rows(sheet)
    assert good.count() == sum(x[2] == "data" for x in LINES) and bad.where("reason is null").count() == 0


def register(spark, rows):
    cols = "dataset_as_of date, source_row_number int, last_imported_at timestamp_ntz, cin_normalized string, name string, regional_office string, public_deposits string, classification string, layer string, address string, email string, key string, as_of string"
    return spark.createDataFrame([(d, n, t, c, name, None, None, None, None, a, None, "clash", "clash") for d, n, t, c, name, a in rows], cols)


def test_snapshot_changes(spark):
    d1, d2, d3 = dt.date(2025, 1, 1), dt.date(2025, 4, 1), dt.date(2025, 7, 1)
    t1, t2 = dt.datetime(2025, 1, 2), dt.datetime(2025, 2, 2)
    rows = [
        (d1, 1, t1, "A", "a", ""), (d2, 9, t1, "A", " a ", None), (d3, 1, t1, "A", "a", None),  # spelling of blanks
        (d1, 2, t1, "B", "b", "x"), (d2, 2, t1, "B", "b2", "x"),  # changed, then removed
        (d2, 3, t1, "C", "c", None), (d3, 3, t1, "C", "c", None), (d3, 3, t1, "C", "c", None),  # added; delivered twice
        (d1, 4, t1, "D", "old", None), (d1, 4, t2, "D", "new", None), (d2, 4, t1, "D", "new", None), (d3, 4, t1, "D", "new", None),  # late import counts
        (d1, 5, t1, None, "n", None), (d2, 5, t1, None, "m", None),  # no key
        (d1, 6, t1, "E", "e", None), (d1, 7, t1, "E", "e", None), (d2, 6, t1, "E", "e", None), (d3, 6, t1, "E", "e", None),  # one of two rows gone
    ]
    got = sorted(tuple(r) for r in snapshots.register_changes(register(spark, rows)).collect())
    assert got == [("2025-04-01", "B", "changed"), ("2025-04-01", "C", "added"), ("2025-04-01", "E", "changed"), ("2025-07-01", "B", "removed")]
    assert snapshots.register_changes(register(spark, [])).collect() == []
    assert snapshots.current_list(register(spark, rows), ["source_row_number", "name"]).count() == 4


TIMES = {
    ("2001-02-03", None): "2001-02-02T18:30:00.000000Z",
    (" 03/02/2001 \n", "Europe/London"): "2001-02-03T00:00:00.000000Z",
    ("3-feb-70", "UTC"): "1970-02-03T00:00:00.000000Z",
    ("3-Feb-69", "UTC"): "2069-02-03T00:00:00.000000Z",
    ("Sep. 5, 2020", ""): "2020-09-04T18:30:00.000000Z",
    ("2020-02-03T04:05:06.1234567+0530", "America/New_York"): "2020-02-02T22:35:06.123456Z",
    ("2020-02-03 04:05:06[Australia/Sydney]", None): "2020-02-02T17:05:06.000000Z",
    ("Thu, 10 Nov 2022 17:25:58 +0545", None): "2022-11-10T11:40:58.000000Z",
    ("22-Oct-2020 02:59 EST", "Asia/Dubai"): "2020-10-22T07:59:00.000000Z",
    ("17 May 2017 12:29 a.m.", "UTC"): "2017-05-17T00:29:00.000000Z",
    ("17 May 2017 13:29 PM", "UTC"): None,
    ("2021-03-14 02:30:00", "America/New_York"): None,
    ("2021-11-07 01:30:00", "America/New_York"): "2021-11-07T05:30:00.000000Z",
    ("20131222T094629Z", None): "2013-12-22T09:46:29.000000Z",
    ("20130222", "UTC"): "2013-02-22T00:00:00.000000Z",
    ("20130230", "UTC"): None,
    ("43212.52083333", "UTC"): "2018-04-22T12:30:00.000000Z",
    ("44316", None): "2021-04-29T18:30:00.000000Z",
    ("1759177586", None): "2025-09-29T20:26:26.000000Z",
    ("1562078393368", None): "2019-07-02T14:39:53.368000Z",
    ("1610225111202316", None): "2021-01-09T20:45:11.202316Z",
    ("31-Jun-1992", None): None,
    ("Dec-2013", None): None,
    ("24-Apr-", None): None,
    ("2020-01-01 24:00:00", "UTC"): None,
    ("2020-01-01 10:00:00", "Mars/Phobos"): None,
    ("29/02/2019", None): None,
    ("x" * 50_000, None): None,
    ("", None): None,
    (None, None): None,
}


def test_timestamps(spark):
    rows = [(i, text, None, zone, "clash") for i, (text, zone) in enumerate(TIMES)]
    df = spark.createDataFrame(rows, "record_id long, issuance string, cancellation string, source_zone string, text string")
    dates = timestamps.record_dates(df, timestamps.DAY_FIRST).where("field_name = 'issuance'").select("record_id", timestamps.iso_utc(F.col("micros")).alias("t"))
    got = {r.record_id: r.t for r in dates.collect()}
    for i, (case, want) in enumerate(TIMES.items()):
        assert got[i] == want, case
    assert timestamps.record_dates(df.limit(0), timestamps.DAY_FIRST).collect() == []


def test_mixture_settles_by_source_or_marks(spark):
    rows = [(i, f"{13 + i % 15:02d}/0{1 + i % 9}/2020", "desk a") for i in range(40)] + [(100, "03/04/2020", "desk a"), (101, "03/04/2020", "desk b"), (102, "05/05/2020", "desk b")]
    df = spark.createDataFrame([(a, b, c, "UTC") for a, b, c in rows], "id long, text string, desk string, zone string")
    got = {r.id: r for r in timestamps.normalize_timestamps(df, ["id"], "text", "zone", "desk", timestamps.ANY_ORDER).collect()}
    assert got[100].format == "dmy" and not got[100].unresolved and got[100].posterior > 0.9
    assert got[101].unresolved and got[101].micros is None
    assert not got[102].unresolved and got[102].micros is not None


def test_mixture_weighs_month_first_against_nothing(spark):
    rows = [(1, "03/04/2020", "UTC"), (2, "03/13/2020", "UTC"), (3, "13/03/2020", "UTC")]
    df = spark.createDataFrame(rows, "id long, text string, zone string")
    got = {r.id: r for r in timestamps.normalize_timestamps(df, ["id"], "text", "zone", "zone", timestamps.DAY_FIRST).collect()}
    assert got[1].format == "dmy" and got[1].n_readings == 2 and got[1].posterior > 0.99 and timestamps.NOTHING == got[2].format and got[2].micros is None and got[3].format == "dmy"


def test_records_recovered_behind_errors(spark):
    bad = '7,"Sutazi" Gold Loans,Dhanoli,Town Road\n8,Makano Finance,Dhanoli,Hill Road\nSl. No,name\n9,,Dhanoli,x'
    rows = [(1, "cancelled_company", bad), (2, "cancelled_company", "5,Fine,Dhanoli,Road"), (3, None, bad), (4, "cancelled_company", None), (5, "cancelled_company", "")]
    df = spark.createDataFrame(rows, "line_id long, dataset_key string, line string")
    got = [(r.row_key, r.record_no, r.reason, r.error_at, r.cells) for r in parsing.recovered_records(df).orderBy("record_no").collect()]
    assert got[0] == (1, 0, "text after closing quote", 10, None) and got[1][:3] == (1, 1, None) and got[1][4][1] == "Makano Finance"
    assert [g[2] for g in got[2:]] == ["2 cells instead of 4", "no name"]
    assert parsing.recovered_records(df.limit(0)).collect() == []
