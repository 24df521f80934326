"""What a free text or a form asks for, as expressions over a batch of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.functions.text import clean, is_valid_cin, normalize_cin
from kinledger.functions.urls import EMAIL_SHAPE, email_domain, extract_hostname

# Bounds of a request, the loose shape of a company number, and suffixes of two labels of a site's name.
LONGEST = 300
LOOSE_CIN = "^[LU][A-Z0-9]{20}$"
SITE_SUFFIXES = ["co.in", "net.in", "org.in", "co.uk", "com.au", "bank.in"]
EMPTY = "Enter the lender's name, or a CIN, e-mail address or website, to run a check."


def bare_host(c: Column) -> Column:
    """:func:`extract_hostname`, but without a scheme only for a plain domain."""
    x = clean(c)
    first = F.lower(F.substring_index(x, "/", 1))
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    plain = x.rlike("(?i)^[a-z][a-z0-9+.-]*://") | first.rlike(f"^{label}(?:\\.{label})+$")
    return F.when(plain, extract_hostname(x))


def kind_of_text(c: Column) -> Column:
    """'cin', 'email', 'website' or 'company_name', tried in this order; null for a blank text."""
    x = clean(c)
    mail = F.contains(x, F.lit("@")) & ~F.contains(x, F.lit(" "))
    return F.when(x == "", None).when(normalize_cin(c).rlike(LOOSE_CIN), "cin").when(mail, "email").when(bare_host(c).isNotNull(), "website").otherwise("company_name")


def name_from_host(host: Column) -> Column:
    """The label left of a site's suffix, if it has at least three letters."""
    parts = F.filter(F.split(host, "\\."), lambda p: p != "")
    n = F.size(parts)
    two = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    at = F.when(two.isin(SITE_SUFFIXES), n - 3).otherwise(n - 2)
    label = F.when((n >= 2) & (at >= 0), F.get(parts, at))
    return F.when(F.length(label) >= 3, label)


def reduced_claim(c: Column) -> Column:
    """Upper case without one trailing legal form: weaker than a core name."""
    x = F.regexp_replace(F.regexp_replace(F.upper(c), "&", " AND "), "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(x, "\\s+(?:PRIVATE\\s+LIMITED|PVT\\s*LTD|LIMITED|LTD|LLP|INC|CORP)\\s*$", ""))


def is_public_address(c: Column) -> Column:
    """Whether an IP address is reachable from anywhere; false for names, null and malformed addresses."""
    x = F.lower(F.coalesce(c, F.lit("")))
    four = F.regexp_replace(x, "^::ffff:(?=\\d+\\.\\d+\\.\\d+\\.\\d+$)", "")
    octets = F.transform(F.split(four, "\\."), lambda o: o.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    is4 = four.rlike("^(?:0|[1-9]\\d{0,2})(?:\\.(?:0|[1-9]\\d{0,2})){3}$") & F.forall(octets, lambda o: o.between(0, 255))
    closed = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    colons = F.length(x) - F.length(F.regexp_replace(x, ":", ""))
    is6 = x.rlike("^[0-9a-f:]+$") & ~x.rlike(":::|::.*::|[0-9a-f]{5}") & ((colons == 7) | (F.contains(x, F.lit("::")) & (colons <= 7)))
    local = x.isin("::", "::1") | x.rlike("^(?:fe80|fc|fd)")
    return F.when(is4, ~closed).when(is6, ~local).otherwise(F.lit(False))


def parse_requests(df: DataFrame, keys: list[str], query: str | None, name: str, cin: str, website: str, email: str) -> DataFrame:
    """``keys`` plus error, kind, company_name, cin, cin_looks_malformed, email, hostname.

    A field of its own beats the free text ``query`` (a column or None); the host falls back to that of the mail address.
    The first rule a request breaks is its ``error``, and all its other columns are null then. Null fields are blank.
    """
    fields = {"q": F.col(query) if query else F.lit(""), "n": F.col(name), "c": F.col(cin), "w": F.col(website), "m": F.col(email)}
    labels = {"q": "Search text", "n": "Lender name", "c": "CIN", "w": "Website", "m": "E-mail"}
    x = df.select(*keys, *[clean(v).alias(f"_{k}") for k, v in fields.items()])
    x = x.select("*", kind_of_text(F.col("_q")).alias("_kind"), bare_host(F.when(F.col("_w") != "", F.col("_w")).when(kind_of_text(F.col("_q")) == "website", F.col("_q"))).alias("_host"))
    has = lambda k: F.col(f"_{k}") != ""
    problems = []
    for k, label in labels.items():
        problems.append(F.when(F.col(f"_{k}").rlike("\\p{Cc}"), f"{label} contains characters that are not allowed."))
        problems.append(F.when(F.length(f"_{k}") > LONGEST, f"{label} is too long (limit {LONGEST} characters)."))
    problems.append(F.when(~(has("q") | has("n") | has("c") | has("w") | has("m")), EMPTY))
    problems.append(F.when(has("m") & ~F.lower("_m").rlike(EMAIL_SHAPE), F.concat(F.lit('"'), "_m", F.lit('" is not an e-mail address this form can read.'))))
    problems.append(F.when(has("w") & F.col("_host").isNull(), F.concat(F.lit('"'), "_w", F.lit('" is not a website address this form can read.'))))
    x = x.withColumn("error", F.coalesce(*problems))
    mail = F.when(has("m"), F.lower("_m")).when(F.col("_kind") == "email", F.lower("_q"))
    number = normalize_cin(F.when(has("c"), F.col("_c")).when(F.col("_kind") == "cin", F.col("_q")))
    kind = F.when(has("n"), "company_name").when(has("c"), "cin").when(has("w"), "website").when(has("m"), "email").otherwise(F.col("_kind"))
    made = {
        "kind": kind,
        "company_name": F.when(has("n"), F.col("_n")).when(F.col("_kind") == "company_name", F.col("_q")),
        "cin": number,
        "cin_looks_malformed": F.when(number.isNotNull(), ~is_valid_cin(number)).otherwise(F.lit(False)),
        "email": mail,
        "hostname": F.coalesce("_host", email_domain(mail)),
    }
    return x.select(*keys, "error", *[F.when(F.col("error").isNull(), v).alias(k) for k, v in made.items()])
