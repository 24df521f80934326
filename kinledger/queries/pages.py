"""Queries on pages, ingest, limits, audit and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinledger.functions import html
from kinledger.functions.urls import normalize_hostname, parse_emails
from kinledger.operators import ingest, limits
from kinledger.runtime import table
from kinledger.streaming import windows

HTML = "text rlike '(?i)<html'"
# Words of a link and how much they promise.
HINTS = {
    3: ["grievance", "nodal", "ombudsman", "partner", "lending-partner", "nbfc", "licence", "license", "regulat", "compliance"],
    2: ["privacy", "terms", "t-and-c", "tnc", "legal", "disclosure", "disclaimer", "policy"],
    1: ["about", "company", "corporate", "who-we-are", "contact", "imprint"],
}
CLASS_RANKS = {"CIC": 0, "HFC": 1, "MFI": 2, "Factor": 3, "ICC": 4}


def _pages(spark, d):
    return table(spark, d, "documents").where(HTML)


def page_title(spark, d):
    return _pages(spark, d).select("doc_id", html.page_title(F.col("text")).alias("title"))


def page_text_head_tail(spark, d):
    return _pages(spark, d).select("doc_id", F.md5(html.page_text(F.col("text"))).alias("text_md5"), F.length(html.page_text(F.col("text"))).alias("n_chars"))


def page_links(spark, d):
    links = html.page_links(F.col("text"), normalize_hostname(F.col("hostname")))
    return _pages(spark, d).select("doc_id", F.explode(links).alias("l")).select("doc_id", "l.url", "l.label")


def choose_pages(spark, d):
    """The two links of each page with the heaviest hints, the earlier first among equals."""
    links = html.page_links(F.col("text"), normalize_hostname(F.col("hostname")))
    each = _pages(spark, d).select("doc_id", F.posexplode(links).alias("i", "l")).select("doc_id", "i", F.col("l.url").alias("url"), F.lower(F.concat_ws(" ", "l.url", "l.label")).alias("t"))
    weight = F.lit(0)
    for n in sorted(HINTS):
        weight = F.when(F.col("t").rlike("|".join(HINTS[n])), n).otherwise(weight)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "i"))
    return each.withColumn("weight", weight).where("weight > 0").withColumn("rank", rank).where("rank <= 2").select("doc_id", "url", "weight", "rank")


def document_emails(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(parse_emails(F.col("text"))).alias("address"))


def page_contacts(spark, d):
    """Description and mail addresses of pages, those of mailto links first."""
    text = F.col("text")
    return _pages(spark, d).select("doc_id", html.page_meta(text, "description").alias("description"), F.array_join(html.page_emails(text), ",").alias("addresses"))


def company_mentions(spark, d):
    """Companies a document names, in order, at most twelve."""
    found = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(html.company_names(F.col("text"))).alias("i", "name"))
    return found.select("doc_id", (F.col("i") + 1).alias("nth"), "name")


def ingest_fill_forward(spark, d):
    """Each sheet line of the stacked sheet under the last section heading of its delivery."""
    rows = table(spark, d, "sheet_rows").where("dataset_key = 'cancelled_record' and line is not null")
    banner = F.when(F.col("line").startswith("List of"), ingest.section_of(F.col("line")))
    filled = ingest.fill_forward(rows, ["delivery_id", "source_sheet"], ["source_row_number", "line_id"], banner, "section")
    return filled.select("line_id", "section")


def stacked_sheet(spark, d):
    """Data lines of the stacked sheet by section."""
    rows = table(spark, d, "sheet_rows").where("dataset_key = 'cancelled_record' and line is not null")
    banner = F.when(F.col("line").startswith("List of"), ingest.section_of(F.col("line")))
    header = F.lower(F.col("line")).rlike("^\\W*s[lr]\\.? no")
    kept = ingest.stacked_rows(rows, ["delivery_id", "source_sheet"], ["source_row_number", "line_id"], banner, header, "section")
    return kept.select("line_id", "section")


def ingest_rollup(spark, d):
    return ingest.run_report(table(spark, d, "import_runs"))


def upsert_merge(spark, d):
    """The register after the latest delivery is merged into all earlier ones by row number."""
    rows = table(spark, d, "registered_nbfc").select("row_id", "source_row_number", "dataset_as_of", "name", "last_imported_at")
    latest = rows.agg(F.max("dataset_as_of").alias("dataset_as_of"))
    new = rows.join(F.broadcast(latest), "dataset_as_of", "left_semi")
    old = rows.join(F.broadcast(latest), "dataset_as_of", "left_anti")
    merged = ingest.upsert(old, new.withColumn("_", F.lit(1)).drop("_"), ["source_row_number"], "last_imported_at")
    return merged.groupBy("dataset_as_of").agg(F.count("*").alias("n"), F.count_distinct("source_row_number").alias("n_rows"))


def prune_stale(spark, d):
    """Rows that survive when every sheet's last import is taken as the run."""
    rows = table(spark, d, "registered_nbfc")
    loaded = rows.where("dataset_as_of is not null").groupBy(F.col("source_file").alias("file"), F.col("source_sheet").alias("sheet")).agg(F.max("dataset_as_of").cast("timestamp_ntz").alias("run_at"))
    kept = ingest.prune_stale(rows, "source_file", "source_sheet", loaded, "last_imported_at")
    return kept.groupBy("dataset_as_of").agg(F.count("*").alias("n"))


def profile_nulls(spark, d):
    return ingest.profile(table(spark, d, "registered_nbfc"), ["name", "regional_office", "classification", "cin_normalized", "layer", "address", "email"])


def merge_by_core(spark, d):
    rows = table(spark, d, "registered_nbfc").select("row_id", "name_core", "display_name", F.regexp_replace("classification", "\\*", "").alias("class"), "address")
    merged = ingest.merge_by_core(rows, "name_core", "display_name", "class", CLASS_RANKS, "address", "row_id")
    return merged.select("core", "name", F.size("names").alias("n_names"), F.array_join("categories", ",").alias("categories"), "category", "address")


def rate_limit_fixed(spark, d):
    decided = limits.fixed_window(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 3, 3600)
    return decided.groupBy("user_id").agg(F.count("*").alias("n_requests"), F.count_if("allowed").alias("n_allowed"))


def rate_limit_anchored(spark, d):
    return limits.anchored_window(table(spark, d, "events"), "user_id", "ts", 3, 3600)


def audit_digest(spark, d):
    return limits.audit_digest(table(spark, d, "company_input").where("claimed_name is not null").select("claim_id", "claimed_name"), "claimed_name", "pepper")


def event_windows(spark, d):
    return windows.tumbling_counts(table(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


QUERIES = {f.__name__: f for f in (page_title, page_text_head_tail, page_links, choose_pages, document_emails, page_contacts, company_mentions, ingest_fill_forward, stacked_sheet, ingest_rollup, upsert_merge, prune_stale, profile_nulls, merge_by_core, rate_limit_fixed, rate_limit_anchored, audit_digest, event_windows)}


def _sql() -> dict[str, str]:
    def visible(x: str) -> str:
        for tag in ("script", "style", "noscript", "svg"):
            x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
        return visible_text(f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")

    def visible_text(x: str) -> str:
        for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "''"), ("&nbsp;", " ")]:
            x = f"regexp_replace({x}, '(?i){a}', '{b}', 'g')"
        x = f"list_reduce([{x}] || list_distinct(regexp_extract_all({x}, '&#[0-9]{{2,5}};')), lambda acc, r: replace(acc, r, CASE WHEN r[3:-2]::INT > 31 AND r[3:-2]::INT NOT BETWEEN 55296 AND 57343 THEN chr(r[3:-2]::INT) ELSE ' ' END))"
        return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

    inner = "regexp_extract(text, '(?is)<title\\b[^>]*>(.*?)</title>', 1)"
    title = f"CASE WHEN length({inner}) <= 300 THEN {inner} END"
    hints = {n: "|".join(words) for n, words in HINTS.items()}
    from kinledger.queries.names import _ADDRESSES, sql_host

    pattern = "\\b((?:[A-Z][\\w&.''-]*\\s+){1,5}(?:Private\\s+|Pvt\\.?\\s+)?(?:Limited|Ltd\\.?))"
    pages = "pages AS (SELECT * FROM documents WHERE regexp_matches(text, '(?i)<html'))"
    attr = lambda n: f"(?is)\\b{n}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')"
    value = lambda tag, n: f"(regexp_extract({tag}, '{attr(n)}', 1) || regexp_extract({tag}, '{attr(n)}', 2))"
    links = f"""
h AS (SELECT doc_id, {sql_host('hostname')} AS host, regexp_split_to_array(text, '(?i)<a\\s')[2:] AS rest FROM pages),
u AS (SELECT doc_id, host, unnest(rest) AS x, generate_subscripts(rest, 1) AS i FROM h),
a AS (SELECT doc_id, host, i, {value("regexp_extract(x, '^[^>]*')", 'href')} AS h, regexp_extract(x, '(?is)^[^>]*>(.{{0,200}}?)</a>', 1) AS l FROM u WHERE regexp_matches(x, '(?is)^[^>]*>.{{0,200}}?</a>')),
e AS (SELECT * FROM a WHERE h <> '' AND NOT starts_with(h, '#')),
r AS (SELECT doc_id, i, host, regexp_replace(CASE WHEN regexp_matches(h, '^(?i)https?://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN 'https://' || host || h WHEN regexp_matches(h, '^(?i)[a-z][a-z0-9+.-]*:') THEN NULL ELSE 'https://' || host || '/' || h END, '#.*$', '') AS url, left({visible('l')}, 80) AS label FROM e),
o AS (SELECT *, regexp_extract(lower(url), '^https?://(?:www\\.)?([^/:?]*)', 1) AS own FROM r WHERE url IS NOT NULL),
links AS (SELECT doc_id, url, CASE WHEN label <> '' THEN label ELSE coalesce(nullif(regexp_extract(regexp_replace(url, '^(?i)https?://[^/?]*', ''), '^[^?]*'), ''), '/') END AS label, i FROM o WHERE own = host OR ends_with(own, '.' || host) OR ends_with(host, '.' || own) QUALIFY row_number() OVER (PARTITION BY doc_id, url ORDER BY i) = 1)"""
    return {
        "page_title": f"WITH {pages} SELECT doc_id, nullif(left({visible(title)}, 200), '') AS title FROM pages",
        "page_text_head_tail": f"WITH {pages}, v AS (SELECT doc_id, {visible('text')} AS v FROM pages), t AS (SELECT doc_id, CASE WHEN length(v) <= 6000 THEN v ELSE left(v, 3000) || ' […] ' || right(v, 3000) END AS t FROM v) SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS n_chars FROM t",
        "page_links": f"WITH {pages}, {links} SELECT doc_id, url, label FROM links",
        "choose_pages": f"""WITH {pages}, {links}, w AS (SELECT *, CASE WHEN regexp_matches(lower(url || ' ' || label), '{hints[3]}') THEN 3 WHEN regexp_matches(lower(url || ' ' || label), '{hints[2]}') THEN 2 WHEN regexp_matches(lower(url || ' ' || label), '{hints[1]}') THEN 1 ELSE 0 END AS weight FROM links)
SELECT doc_id, url, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, i)::INT AS rank FROM w WHERE weight > 0 QUALIFY rank <= 2""",
        "company_mentions": f"""
WITH f AS (SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS f FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(list_transform(f, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS name, generate_subscripts(f, 1) AS i FROM f),
k AS (SELECT doc_id, name, i FROM n WHERE length(name) BETWEEN 8 AND 120 QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') ORDER BY i) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS nth, name FROM k QUALIFY nth <= 12""",
        "document_emails": f"SELECT doc_id, unnest({_ADDRESSES.replace('coalesce(email', 'coalesce(text')}) AS address FROM documents WHERE text IS NOT NULL",
        "page_contacts": f"""
WITH {pages}, m AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '(?is)<meta\\s[^>]*>'), lambda t: lower({value('t', 'name')}) = 'description' OR lower({value('t', 'property')}) = 'description')[1] AS tag FROM pages),
a AS (SELECT doc_id, tag, array_to_string(regexp_extract_all(text, '(?i)mailto:([^"''?>\\s]+)', 1), ' ') || ' ' || {visible('text')} AS t FROM m)
SELECT doc_id, nullif(left({visible_text(value('tag', 'content'))}, 300), '') AS description, array_to_string(({_ADDRESSES.replace('coalesce(email', 'coalesce(t')})[:10], ',') AS addresses FROM a""",
        "ingest_fill_forward": """
WITH b AS (SELECT *, CASE WHEN starts_with(line, 'List of') THEN CASE WHEN contains(lower(line), 'removed') THEN 'removed_from_list' WHEN contains(lower(line), 'added') THEN 'added_to_list' END END AS banner FROM sheet_rows WHERE dataset_key = 'cancelled_record' AND line IS NOT NULL)
SELECT line_id, last_value(banner IGNORE NULLS) OVER (PARTITION BY delivery_id, source_sheet ORDER BY source_row_number, line_id ROWS UNBOUNDED PRECEDING) AS section FROM b""",
        "stacked_sheet": """
WITH b AS (SELECT *, CASE WHEN starts_with(line, 'List of') THEN CASE WHEN contains(lower(line), 'removed') THEN 'removed_from_list' WHEN contains(lower(line), 'added') THEN 'added_to_list' END END AS banner FROM sheet_rows WHERE dataset_key = 'cancelled_record' AND line IS NOT NULL),
f AS (SELECT line_id, line, banner, last_value(banner IGNORE NULLS) OVER (PARTITION BY delivery_id, source_sheet ORDER BY source_row_number, line_id ROWS UNBOUNDED PRECEDING) AS section FROM b)
SELECT line_id, section FROM f WHERE banner IS NULL AND section IS NOT NULL AND NOT regexp_matches(lower(line), '^\\W*s[lr]\\.? no')""",
        "ingest_rollup": "SELECT source_sheet, count(*) AS runs, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("rows_read", "rows_imported", "rows_skipped", "rows_missing_cin", "rows_invalid_cin", "rows_missing_email")) + " FROM import_runs GROUP BY ROLLUP (source_sheet)",
        "upsert_merge": """
WITH m AS (SELECT max(dataset_as_of) AS m FROM registered_nbfc), new AS (SELECT r.* FROM registered_nbfc r, m WHERE dataset_as_of = m AND source_row_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_row_number ORDER BY last_imported_at DESC) = 1),
merged AS (SELECT dataset_as_of, source_row_number FROM new UNION ALL SELECT dataset_as_of, source_row_number FROM registered_nbfc r, m WHERE dataset_as_of < m AND NOT EXISTS (SELECT 1 FROM new WHERE new.source_row_number = r.source_row_number))
SELECT dataset_as_of, count(*) AS n, count(DISTINCT source_row_number) AS n_rows FROM merged GROUP BY 1""",
        "prune_stale": """
WITH run AS (SELECT source_file, source_sheet, max(dataset_as_of)::TIMESTAMP AS run_at FROM registered_nbfc WHERE dataset_as_of IS NOT NULL GROUP BY 1, 2)
SELECT dataset_as_of, count(*) AS n FROM registered_nbfc LEFT JOIN run USING (source_file, source_sheet) WHERE run_at IS NULL OR last_imported_at >= run_at GROUP BY 1""",
        "profile_nulls": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM registered_nbfc" for c in ("name", "regional_office", "classification", "cin_normalized", "layer", "address", "email")),
        "merge_by_core": """
WITH r AS (SELECT row_id, name_core, display_name AS n, replace(classification, '*', '') AS c, address FROM registered_nbfc WHERE name_core IS NOT NULL)
SELECT name_core AS core, max_by(n, (length(n), n)) AS name, count(DISTINCT n)::INT AS n_names, array_to_string(list_sort(list(DISTINCT c)), ',') AS categories,
  min_by(c, (CASE c WHEN 'CIC' THEN 0 WHEN 'HFC' THEN 1 WHEN 'MFI' THEN 2 WHEN 'Factor' THEN 3 WHEN 'ICC' THEN 4 ELSE 5 END, c)) AS category, arg_min(address, row_id) FILTER (address IS NOT NULL) AS address FROM r GROUP BY 1""",
        "rate_limit_fixed": """
WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id) <= 3 AS allowed FROM events)
SELECT user_id, count(*) AS n_requests, count(*) FILTER (allowed) AS n_allowed FROM w GROUP BY 1""",
        "rate_limit_anchored": """
WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
s AS (
  SELECT user_id, i, t AS start, 1 AS count, 1 AS allowed, 1 AS windows FROM t WHERE i = 1
  UNION ALL
  SELECT s.user_id, t.i, CASE WHEN t.t - start >= 3600000000 THEN t.t ELSE start END, CASE WHEN t.t - start >= 3600000000 THEN 1 ELSE count + 1 END,
    allowed + (CASE WHEN t.t - start >= 3600000000 THEN 1 ELSE count + 1 END <= 3)::INT, windows + (t.t - start >= 3600000000)::INT
  FROM s JOIN t ON t.user_id = s.user_id AND t.i = s.i + 1
)
SELECT user_id, max(i)::INT AS n_requests, max(allowed)::INT AS n_allowed, max(windows)::INT AS n_windows FROM s GROUP BY 1""",
        "audit_digest": "SELECT claim_id, sha256('pepper ' || lower(claimed_name)) AS name_digest FROM company_input WHERE claimed_name IS NOT NULL",
        "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    }


SQL = _sql()
