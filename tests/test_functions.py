import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinledger.functions import dates, html, similarity, text, urls


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_and_core(spark):
    got = column(spark, ["A.C. Choksi & Co.", "Sánchez Finance", None, "  x　y ", "ﬁnance"], text.normalize_name)
    assert got == ["A C CHOKSI AND CO", "SANCHEZ FINANCE", "", "X Y", "FINANCE"]
    cores = column(spark, ["A C CHOKSI AND CO PVT LTD", "PRIVATE LIMITED", "LTD", "BAJAJ FINANCE LIMITED", ""], text.name_core)
    assert cores == ["A C CHOKSI", "PRIVATE LIMITED", "LTD", "BAJAJ FINANCE", ""]


def test_cluster_tokens_cin(spark):
    assert column(spark, ["THE DELHI STATE CO OPERATIVE BANK", "A C CHOKSI", "THE", "", "MUTHOOTFINCORP"], text.cluster_key) == ["DELHI", "A_C", "THE", "__empty__", "MUTHOOTF"]
    assert column(spark, ["ab", "abcd", "", "aaaa"], lambda c: text.char_ngrams(c)) == [["ab"], ["abc", "bcd"], [], ["aaa"]]
    assert column(spark, [" l65910-mh1995plc123456 ", "x", None], lambda c: text.is_valid_cin(text.normalize_cin(c))) == [True, False, False]
    assert column(spark, ["YES", " n ", "maybe", None], text.parse_yes_no) == [True, False, None, None]


def test_emails_and_hosts(spark):
    got = column(spark, ["a@x.example; B@y.example;", "g@adi. com", "o[at]g[dot]com", "'s@e.com'", "-NA-", None], urls.parse_emails)
    assert got == [["a@x.example", "b@y.example"], ["g@adi.com"], ["o@g.com"], ["s@e.com"], [], []]
    assert column(spark, ["WWW.Example.CO.IN.", "localhost", "a b.com", None], urls.normalize_hostname) == ["example.co.in", None, None, None]
    assert column(spark, ["https://www.a.example/x?y", "mailto:x@y.com", "a.example:8080/p", "ftp://a.b", "two words.com"], urls.extract_hostname) == ["a.example", None, "a.example", None, None]
    assert column(spark, ["bajajfinserv.co.in", "a.b.com", "com", None], urls.domain_label) == ["bajajfinserv", "b", None, None]
    assert [[p.domain for p in x] for x in column(spark, ["a.b.co.in"], urls.parent_domains)] == [["a.b.co.in", "b.co.in", "co.in"]]
    assert column(spark, ["gmail.com", "x.example", None], urls.is_mail_provider) == [True, False, False]


def test_dates_and_amounts(spark):
    got = column(spark, ["27-Mar-1998", "September 14, 2018", "2018-06-21 00:00:00", "31/02/2001", "44316", "junk", None], dates.parse_flexible_date)
    assert got == ["1998-03-27", "2018-09-14", "2018-06-21", "2001-02-31", "2021-04-30", None, None]
    assert column(spark, ["₹ 1,50,000", "2 lakh", "1.5 crore", "3k", "-5", "x", "2e9 ", None], dates.parse_amount) == [150000.0, 200000.0, 15000000.0, 3000.0, None, None, None, None]


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><style>x{}</style></head><body>Hi<script>no()</script> <!-- c -->there &nbsp;<a href='/faq#x'>F <b>AQ</b></a><a href=\"https://other.com/z\">o</a><a href='https://m.site.example/p'>p</a><a href='mailto:q@r.example'>m</a></body></html>"
    df = spark.createDataFrame([(page, "site.example"), (None, None)], "h string, host string")
    row, none = df.select(html.page_title(F.col("h")).alias("t"), html.page_text(F.col("h")).alias("x"), html.page_links(F.col("h"), F.col("host")).alias("l"), html.page_emails(F.col("h")).alias("e")).collect()
    assert row.t == "A & B" and row.x == "A & B Hi there F AQ o p m" and [(x.url, x.label) for x in row.l] == [("https://site.example/faq", "F AQ"), ("https://m.site.example/p", "p")] and row.e == ["q@r.example"]
    assert none.t is None and none.x is None


def test_similarities(spark):
    df = spark.createDataFrame([("FINANCE", "FINANCF"), ("", ""), ("A B", "B A"), ("AB CD", "AB")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(similarity.edit_similarity(a, b).alias("e"), similarity.token_jaccard(a, b).alias("j"), similarity.token_containment(a, b).alias("c"), similarity.trigram_similarity(a, b).alias("t"), similarity.pg_similarity(a, b).alias("p"), similarity.jaro_winkler(a, b).alias("w")).collect()
    assert rows[0].e == pytest.approx(6 / 7) and rows[1].e == 1 and rows[2].j == 1 and rows[3].c == 1 and rows[2].p == 1 and rows[2].t < 1
    assert rows[1].w == 1 and rows[0].w == pytest.approx(0.9428571)


WORD = st.text("ABCDE", max_size=9)


@given(WORD, WORD)
def test_jaro_winkler_is_bounded(a, b):
    s = similarity.jaro_winkler_text(a, b)
    assert 0 <= s <= 1 + 1e-9
    if a == b:
        assert s == 1
    if not set(a) & set(b) and (a or b):
        assert s == 0


def test_similarity_of_pairs_equals_the_expressions(spark):
    from kinledger.functions.similarity import name_similarity, token_jaccard, trigram_similarity

    texts = ["", "A", "ARO BELA", "BELA  ARO", " ARO", "AROBELA LOANS", "ÅRO bela"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = pairs.select("a", "b", name_similarity("a", "b").alias("got"), F.greatest(token_jaccard(F.col("a"), F.col("b")), trigram_similarity(F.col("a"), F.col("b"))).alias("want")).collect()
    assert [(r.a, r.b, r.got) for r in rows] == [(r.a, r.b, r.want) for r in rows]
