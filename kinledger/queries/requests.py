"""Queries on requests, labels and sheets, and on the state of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinledger.functions import labels, requests
from kinledger.operators import ingest, parsing
from kinledger.runtime import table

TABLES = ["registered_nbfc", "cancelled_record", "company_input", "pairs", "sheet_rows", "import_runs", "documents", "town_reference", "office_reference"]
REFERENCE = ["office", "former_office"]


def request_parsing(spark, d):
    """Claims read as verification requests: what they ask for, or the first rule they break."""
    return requests.parse_requests(table(spark, d, "company_input"), ["claim_id"], None, "claimed_name", "cin", "website", "email")


def free_text_kinds(spark, d):
    """What each claim's web or mail address would be taken for as a free text, and the name its host suggests."""
    text = F.coalesce("website", "email", "cin", "claimed_name")
    return table(spark, d, "company_input").select("claim_id", requests.kind_of_text(text).alias("kind"), requests.name_from_host(requests.bare_host(text)).alias("host_name"))


def claim_texts(spark, d):
    """Claims as the sanitiser and the weaker comparison of names see them."""
    name = F.col("claimed_name")
    return table(spark, d, "company_input").where("claimed_name is not null").select(
        "claim_id", labels.without_fillers(name, 40).alias("line"), labels.shorten(labels.clean(name), 20).alias("short"), labels.letters_and_digits(name).alias("compact"), requests.reduced_claim(name).alias("reduced")
    )


def heading_categories(spark, d):
    """Lines of the sheets that name a kind of bank."""
    rows = table(spark, d, "sheet_rows").select(labels.bank_category(F.col("line")).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def delivery_labels(spark, d):
    """Deliveries of the register as displayed."""
    days = table(spark, d, "registered_nbfc").groupBy("dataset_as_of").agg(F.count("*").alias("n"))
    return days.select(labels.as_of_text(F.col("dataset_as_of")).alias("as_of"), "n")


def repeated_row_numbers(spark, d):
    found = ingest.repeated_row_numbers(table(spark, d, "registered_nbfc"), ["dataset_as_of"], "source_row_number")
    return found.groupBy("dataset_as_of").agg(F.count("*").alias("row_numbers"), F.sum("n").alias("n_rows"))


def reference_unpivot(spark, d):
    """The office reference as a sheet with one field per column, a column more than it has groups."""
    t = table(spark, d, "office_reference")
    rows = t.select(F.ascii("regional_office").alias("row_number"), F.array("regional_office", "former_office", F.upper("regional_office")).alias("cells"))
    return ingest.unpivot_cells(rows, "row_number", "cells", REFERENCE)


def listed_values(spark, d):
    return ingest.listed_values(table(spark, d, "registered_nbfc"), ["regional_office", "classification", "layer", "public_deposits", "name", "source_sheet"])


def table_status(spark, d):
    """Rows of every table of the domain."""
    out = None
    for name in TABLES:
        row = table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def sheet_records(spark, d):
    """The valid lines of the register's sheets as typed rows."""
    good, _ = parsing.split_sheet_rows(table(spark, d, "sheet_rows"))
    rows = ingest.typed_rows(good.where("dataset_key = 'registered_nbfc'"), "registered_nbfc", "cells", ["row_key"])
    return rows.select("row_key", "sl_no", "display_name", F.array_join("alternate_names", "|").alias("former_names"), "name_core", "accepts_public_deposits", "classification_code", "has_factoring_cor", "cin_normalized", "cin_is_valid", F.array_join("emails", ",").alias("emails"))


QUERIES = {f.__name__: f for f in (request_parsing, free_text_kinds, claim_texts, heading_categories, delivery_labels, repeated_row_numbers, reference_unpivot, listed_values, table_status, sheet_records)}


def _sql() -> dict[str, str]:
    from kinledger.queries.names import _MAIL, sql_clean, sql_web_host

    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    bare = lambda c: f"CASE WHEN regexp_matches({sql_clean(c)}, '^(?i)[a-z][a-z0-9+.-]*://') OR regexp_matches(lower(split_part({sql_clean(c)}, '/', 1)), '^{label}(?:\\.{label})+$') THEN {sql_web_host(c)} END"
    number = lambda c: f"nullif(regexp_replace(upper({sql_clean(c)}), '[^A-Z0-9]', '', 'g'), '')"
    kind = lambda c: f"CASE WHEN {sql_clean(c)} = '' THEN NULL WHEN regexp_matches(coalesce({number(c)}, ''), '^[LU][A-Z0-9]{{20}}$') THEN 'cin' WHEN contains({sql_clean(c)}, '@') AND NOT contains({sql_clean(c)}, ' ') THEN 'email' WHEN {bare(c)} IS NOT NULL THEN 'website' ELSE 'company_name' END"
    rules = []
    for c, name in (("n", "Lender name"), ("c", "CIN"), ("w", "Website"), ("m", "E-mail")):
        rules += [f"WHEN regexp_matches({c}, '\\p{{Cc}}') THEN '{name} contains characters that are not allowed.'", f"WHEN length({c}) > 300 THEN '{name} is too long (limit 300 characters).'"]
    empty = requests.EMPTY.replace("'", "''")
    cats = " ".join(f"WHEN contains(lower(line), '{w}') THEN '{v}'" for w, v in labels.HEADING_CATEGORIES)
    return {
        "request_parsing": f"""
WITH x AS (SELECT claim_id, {sql_clean('claimed_name')} AS n, {sql_clean('cin')} AS c, {sql_clean('website')} AS w, {sql_clean('email')} AS m FROM company_input),
h AS (SELECT *, CASE WHEN w <> '' THEN {bare('w')} END AS host, {number('c')} AS num FROM x),
e AS (SELECT *, CASE {' '.join(rules)} WHEN n = '' AND c = '' AND w = '' AND m = '' THEN '{empty}' WHEN m <> '' AND NOT regexp_matches(lower(m), '^[^\\s@,;<>()\\[\\]]+@[^\\s@,;<>()\\[\\]]+\\.[A-Za-z]{{2,}}$') THEN '"' || m || '" is not an e-mail address this form can read.'
  WHEN w <> '' AND host IS NULL THEN '"' || w || '" is not a website address this form can read.' END AS error FROM h)
SELECT claim_id, error, CASE WHEN error IS NULL THEN CASE WHEN n <> '' THEN 'company_name' WHEN c <> '' THEN 'cin' WHEN w <> '' THEN 'website' ELSE 'email' END END AS kind, CASE WHEN error IS NULL THEN nullif(n, '') END AS company_name,
  CASE WHEN error IS NULL THEN num END AS cin, CASE WHEN error IS NULL THEN num IS NOT NULL AND NOT regexp_matches(num, '^[LU][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}$') END AS cin_looks_malformed,
  CASE WHEN error IS NULL THEN nullif(lower(m), '') END AS email, CASE WHEN error IS NULL THEN coalesce(host, {_MAIL.format(c='lower(m)')}) END AS hostname FROM e""",
        "free_text_kinds": f"""
WITH t AS (SELECT claim_id, coalesce(website, email, cin, claimed_name) AS t FROM company_input), h AS (SELECT claim_id, {kind('t')} AS kind, list_filter(string_split({bare('t')}, '.'), lambda p: p <> '') AS p FROM t),
l AS (SELECT *, CASE WHEN len(p) >= 2 THEN CASE WHEN p[-2] || '.' || p[-1] IN ('co.in', 'net.in', 'org.in', 'co.uk', 'com.au', 'bank.in') THEN CASE WHEN len(p) > 2 THEN p[-3] END ELSE p[-2] END END AS l FROM h)
SELECT claim_id, kind, CASE WHEN length(l) >= 3 THEN l END AS host_name FROM l""",
        "claim_texts": f"""
SELECT claim_id, CASE WHEN {sql_clean('claimed_name')} <> '' AND lower({sql_clean('claimed_name')}) NOT IN ('null', 'n/a', 'none') THEN left({sql_clean('claimed_name')}, 40) END AS line,
  CASE WHEN length({sql_clean('claimed_name')}) <= 20 THEN {sql_clean('claimed_name')} ELSE left({sql_clean('claimed_name')}, 19) || '…' END AS short, regexp_replace(lower(claimed_name), '[^a-z0-9]', '', 'g') AS compact,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(claimed_name), '&', ' AND ', 'g'), '[^A-Z0-9]+', ' ', 'g'), '\\s+(?:PRIVATE\\s+LIMITED|PVT\\s*LTD|LIMITED|LTD|LLP|INC|CORP)\\s*$', '')) AS reduced
FROM company_input WHERE claimed_name IS NOT NULL""",
        "heading_categories": f"SELECT CASE {cats} END AS category, count(*) AS n FROM sheet_rows GROUP BY 1",
        "delivery_labels": "SELECT coalesce(strftime(dataset_as_of, '%-d %B %Y'), 'date unavailable') AS as_of, count(*) AS n FROM registered_nbfc GROUP BY 1",
        "repeated_row_numbers": "WITH r AS (SELECT dataset_as_of, source_row_number, count(*) AS n FROM registered_nbfc GROUP BY 1, 2 HAVING n > 1) SELECT dataset_as_of, count(*) AS row_numbers, sum(n)::BIGINT AS n_rows FROM r GROUP BY 1",
        "reference_unpivot": "WITH u AS (SELECT ascii(regional_office) AS row_number, unnest([1, 2, 3]) AS source_column, unnest(['office', 'former_office', 'column_3']) AS field_group, unnest([regional_office, former_office, upper(regional_office)]) AS value FROM office_reference) SELECT * FROM u WHERE trim(coalesce(value, '')) <> ''",
        "listed_values": "WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM registered_nbfc WHERE {c} IS NOT NULL GROUP BY 2" for c in ("regional_office", "classification", "layer", "public_deposits", "name", "source_sheet")) + ") SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY column_name) <= 50",
        "table_status": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    }


SQL = _sql()
