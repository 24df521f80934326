"""Queries on names, identifiers, hosts and dates, and on similarity of labelled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinledger.functions import dates, similarity, text, urls
from kinledger.operators import pairs as pair_ops
from kinledger.operators.snapshots import current_list
from kinledger.runtime import table


def name_normalize(spark, d):
    return table(spark, d, "company_input").select("claim_id", text.normalize_name(F.coalesce("claimed_name", F.lit(""))).alias("name_normalized"))


def name_core(spark, d):
    return table(spark, d, "registered_nbfc").select("row_id", text.name_core(text.normalize_name_folded(F.col("display_name"))).alias("core"))


def cluster_key(spark, d):
    return table(spark, d, "registered_nbfc").select("row_id", text.cluster_key(F.coalesce("name_core", F.lit(""))).alias("cluster_key"))


def name_tokens(spark, d):
    t = text.tokens(F.coalesce("name_core", F.lit("")))
    return table(spark, d, "registered_nbfc").select("row_id", F.array_join(t, "|").alias("words"), text.acronym(t).alias("acronym"))


def cin_valid(spark, d):
    cin = text.normalize_cin(F.col("cin"))
    return table(spark, d, "registered_nbfc").select("row_id", cin.alias("cin_compact"), text.is_valid_cin(cin).alias("is_valid"))


def sheet_emails(spark, d):
    found = urls.parse_emails(F.col("email"))
    return table(spark, d, "registered_nbfc").select("row_id", F.explode(found).alias("address")).select("row_id", "address", urls.email_domain(F.col("address")).alias("domain"), urls.is_mail_provider(urls.email_domain(F.col("address"))).alias("is_provider"))


def email_domain_counts(spark, d):
    return table(spark, d, "registered_nbfc").select(F.explode(urls.parse_emails(F.col("email"))).alias("e")).groupBy(urls.email_domain(F.col("e")).alias("domain")).agg(F.count("*").alias("n"))


def host_extract(spark, d):
    host = urls.extract_hostname(F.col("website"))
    return table(spark, d, "company_input").select("claim_id", host.alias("host"), urls.domain_label(host).alias("label"))


def host_related(spark, d):
    """Claims whose site and mail domain belong together."""
    host, mail = urls.extract_hostname(F.col("website")), urls.normalize_hostname(urls.email_domain(F.col("email")))
    return table(spark, d, "company_input").select("claim_id", urls.domains_related(host, mail).alias("related"))


def flexible_dates(spark, d):
    # one parser for both columns; two side by side outgrow a generated method
    both = F.transform(F.array("issuance", "cancellation"), dates.parse_flexible_date)
    return table(spark, d, "cancelled_record").select("record_id", both.alias("on")).select("record_id", F.col("on")[0].alias("issued_on"), F.col("on")[1].alias("cancelled_on"))


def split_assignment(spark, d):
    key = F.coalesce(F.upper(F.trim("cluster_key")), F.lit("__empty__"))
    keyed = table(spark, d, "pairs").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return keyed.groupBy(pair_ops.group_split(F.col("k")).alias("split_name")).agg(F.sum("n").alias("n"), F.count("*").alias("groups"))


def _pairs(spark, d):
    """(query, listed name) texts of the labelled pairs; an entity is a row of the current list."""
    current = current_list(table(spark, d, "registered_nbfc"), ["source_row_number", "name_core", "name"]).where("name_core is not null")
    names = current.select(F.concat(F.lit("registered_nbfc:"), F.col("source_row_number")).alias("id"), F.col("name_core").alias("e"))
    q = table(spark, d, "pairs").where("query_text is not null").select("pair_id", F.lower(F.trim("entity_id")).alias("id"), text.normalize_name_folded(F.col("query_text")).alias("q"))
    return q.join(names, "id")


def pair_similarities(spark, d):
    q, e = F.col("q"), F.col("e")
    sims = {"trigram": similarity.jaccard(F.col("gq"), F.col("ge")), "token_jaccard": similarity.token_jaccard(q, e), "token_containment": similarity.token_containment(q, e), "edit_similarity": similarity.edit_similarity(q, e), "length_ratio": similarity.length_ratio(q, e)}
    made = _pairs(spark, d).select("pair_id", "q", "e", similarity.trigrams(q).alias("gq"), similarity.trigrams(e).alias("ge"))
    return made.select("pair_id", *[F.round(v, 6).alias(k) for k, v in sims.items()])


def jaro_winkler_pairs(spark, d):
    return _pairs(spark, d).select("pair_id", F.round(similarity.jaro_winkler("q", "e"), 6).alias("jaro_winkler"))


def company_aliases(spark, d):
    """Former names lifted out of the listed name cells."""
    parsed = text.parse_company_name(F.col("name"))
    return table(spark, d, "registered_nbfc").select("row_id", parsed.alias("p")).select("row_id", "p.display_name", F.array_join("p.alternate_names", "|").alias("former_names"))


def query_variants(spark, d):
    names = table(spark, d, "registered_nbfc").select("row_id", "display_name", "alternate_names")
    return pair_ops.query_variants(names, "row_id", "display_name", "alternate_names")


def query_variant_counts(spark, d):
    return query_variants(spark, d).groupBy("variant_id").agg(F.count("*").alias("n"))


def stratified_sample(spark, d):
    return pair_ops.stratified_sample(table(spark, d, "documents").where("source is not null"), "source", "doc_id", 200).select("doc_id", "source")


QUERIES = {f.__name__: f for f in (name_normalize, name_core, cluster_key, name_tokens, cin_valid, sheet_emails, email_domain_counts, host_extract, host_related, flexible_dates, split_assignment, pair_similarities, jaro_winkler_pairs, query_variants, query_variant_counts, stratified_sample, company_aliases)}

SPACES = "'[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x0b\\x1c-\\x1f]+'"


def sql_clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {SPACES}, ' ', 'g'))"


def sql_normalize(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper({sql_clean(c)}), '&', ' AND ', 'g'), '[^A-Z0-9]+', ' ', 'g'))"


_FORMS = "|".join(text.LEGAL_FORMS)


def sql_core(x: str) -> str:
    step = f"regexp_replace(CASE WHEN regexp_matches(acc, '^({_FORMS})$') THEN acc ELSE regexp_replace(acc, '^(.*?) ({_FORMS})$', '\\1') END, ' AND$', '')"
    return f"list_reduce([{x}] || string_split({x}, ' '), lambda acc, ignored: {step})"


def sql_host(c: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({sql_clean(c)}), '\\.+$', ''), '^www\\.', '')"
    return f"CASE WHEN regexp_matches({x}, '^[a-z0-9.-]+$') AND contains({x}, '.') THEN {x} END"


def sql_web_host(c: str) -> str:
    rest = f"regexp_replace({sql_clean(c)}, '^(?i)https?://', '')"
    host = f"regexp_extract({rest}, '^(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    return f"CASE WHEN contains({sql_clean(c)}, ' ') OR regexp_matches({rest}, '^(?i)[a-z][a-z0-9+.-]*:(?:[^0-9]|$)') THEN NULL ELSE {sql_host(host)} END"


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({p}) - 1, 2)), lambda i: substr({p}, i, 3)))"
_MAIL = "CASE WHEN contains({c}, '@') THEN nullif(lower(trim(split_part({c}, '@', -1))), '') END"
_ADDRESSES = """list_distinct(list_filter(list_transform(regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(%s, '\\s*\\.\\s*', '.', 'g'), '(?i)\\[\\s*at\\s*\\]|\\(\\s*at\\s*\\)', '@', 'g'), '(?i)\\[\\s*dot\\s*\\]|\\(\\s*dot\\s*\\)', '.', 'g'),
  '[;,\\s]+'), lambda e: regexp_replace(regexp_replace(lower(trim(e)), '^["''<(]+', ''), '["''>).,;]+$', '')),
  lambda e: regexp_matches(e, '^[^\\s@,;<>()\\[\\]]+@[^\\s@,;<>()\\[\\]]+\\.[A-Za-z]{2,}$')))""" % sql_clean("email")
_REMARK = "(?i)\\(\\s*(?:formerly(?:\\s*known\\s+as)?|name\\s+as\\s+per\\s+mca)\\s*[:–-]?\\s*([^)]+)\\)"
_STOPS = ", ".join(f"'{w}'" for w in text.CLUSTER_STOP_WORDS)
_PROVIDERS = ", ".join(f"'{w}'" for w in urls.MAIL_PROVIDERS)
_TWO = ", ".join(f"'{w}'" for w in urls.TWO_PART_SUFFIXES)
_MONTHS = "'janfebmaraprmayjunjulaugsepoctnovdec'"

SQL = {
    "stratified_sample": f"""
WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT source, n, least(n, ceil(200 / count(*) OVER ())) AS taken FROM c),
q AS (SELECT source, taken + least(n - taken, greatest(greatest(200 - sum(taken) OVER (), 0) - coalesce(sum(n - taken) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS quota FROM t),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{pair_ops.SEED}:' || doc_id), doc_id) AS nth FROM documents WHERE source IS NOT NULL)
SELECT doc_id, source FROM r JOIN q USING (source) WHERE nth <= quota""",
    "name_normalize": f"SELECT claim_id, {sql_normalize('strip_accents(claimed_name)')} AS name_normalized FROM company_input",
    "name_core": f"WITH n AS (SELECT row_id, {sql_normalize('display_name')} AS n FROM registered_nbfc) SELECT row_id, {sql_core('n')} AS core FROM n",
    "cluster_key": f"""
WITH RECURSIVE w AS (
  SELECT row_id, list_filter(string_split(coalesce(name_core, ''), ' '), lambda t: t <> '') AS t FROM registered_nbfc
  UNION ALL
  SELECT row_id, t[2:] FROM w WHERE len(t) > 1 AND t[1] IN ({_STOPS})
), last AS (SELECT row_id, arg_min(t, len(t)) AS t FROM w GROUP BY row_id)
SELECT row_id, coalesce(CASE WHEN len(t[1]) <= 2 AND t[2] IS NOT NULL THEN t[1] || '_' || left(t[2], 8) ELSE left(t[1], 8) END, '__empty__') AS cluster_key FROM last""",
    "company_aliases": f"""
WITH r AS (SELECT row_id, {sql_clean('name')} AS raw FROM registered_nbfc),
g AS (SELECT row_id, raw, regexp_extract_all(raw, '{_REMARK}', 1) AS found FROM r),
s AS (SELECT row_id, unnest(found) AS f, generate_subscripts(found, 1) AS i FROM g),
cutup AS (SELECT row_id, i, string_split(regexp_replace(f, '(?i)\\b(limited|ltd\\.?|llp|plc|corp\\.?|inc\\.?|co\\.?|company|corporation)\\s+and\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM s),
names AS (SELECT row_id, i, unnest(list_transform(parts, lambda p: {sql_clean('p')})) AS n, generate_subscripts(parts, 1) AS j FROM cutup),
firsts AS (SELECT row_id, i, j, n FROM names WHERE {sql_normalize('n')} <> '' QUALIFY row_number() OVER (PARTITION BY row_id, {sql_normalize('n')} ORDER BY i, j) = 1)
SELECT row_id, CASE WHEN b = '' THEN raw ELSE b END AS display_name, coalesce((SELECT string_agg(n, '|' ORDER BY i, j) FROM firsts WHERE firsts.row_id = x.row_id), '') AS former_names
FROM (SELECT row_id, raw, trim(regexp_replace(regexp_replace(raw, '{_REMARK}', ' ', 'g'), '\\s+', ' ', 'g')) AS b FROM r) x""",
    "name_tokens": """
WITH w AS (SELECT row_id, list_filter(string_split(coalesce(name_core, ''), ' '), lambda t: t <> '') AS t FROM registered_nbfc)
SELECT row_id, array_to_string(t, '|') AS words, array_to_string(list_transform(t, lambda x: x[1]), '') AS acronym FROM w""",
    "cin_valid": f"""
WITH c AS (SELECT row_id, nullif(regexp_replace(upper({sql_clean('cin')}), '[^A-Z0-9]', '', 'g'), '') AS cin_compact FROM registered_nbfc)
SELECT row_id, cin_compact, coalesce(regexp_matches(cin_compact, '{text.CIN_SHAPE}'), false) AS is_valid FROM c""",
    "sheet_emails": f"""
WITH e AS (SELECT row_id, unnest({_ADDRESSES}) AS address FROM registered_nbfc),
d AS (SELECT row_id, address, {_MAIL.format(c='address')} AS domain FROM e)
SELECT row_id, address, domain, coalesce({sql_host('domain')} IN ({_PROVIDERS}), false) AS is_provider FROM d""",
    "email_domain_counts": f"WITH e AS (SELECT unnest({_ADDRESSES}) AS address FROM registered_nbfc) SELECT {_MAIL.format(c='address')} AS domain, count(*) AS n FROM e GROUP BY 1",
    "host_extract": f"""
WITH h AS (SELECT claim_id, {sql_web_host('website')} AS host FROM company_input),
p AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS p FROM h)
SELECT claim_id, host, CASE WHEN len(p) >= 2 THEN CASE WHEN p[-2] || '.' || p[-1] IN ({_TWO}) THEN CASE WHEN len(p) > 2 THEN p[-3] END ELSE p[-2] END END AS label FROM p""",
    "host_related": f"""
WITH h AS (SELECT claim_id, {sql_web_host('website')} AS a, {sql_host(_MAIL.format(c='email'))} AS b FROM company_input)
SELECT claim_id, coalesce(a = b OR ends_with(a, '.' || b) OR ends_with(b, '.' || a), false) AS related FROM h""",
    "flexible_dates": f"""
WITH t AS (SELECT record_id, f, {sql_clean('x')} AS t FROM (SELECT record_id, unnest(['issued_on', 'cancelled_on']) AS f, unnest([issuance, cancellation]) AS x FROM cancelled_record)),
p AS (SELECT record_id, f, t,
  CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T].*)?$') THEN [t[1:4], t[6:7], t[9:10]]
       WHEN regexp_matches(t, '^[0-9]{{1,2}}[-/ ]([A-Za-z]{{3,}}|[0-9]{{1,2}})[-/ ][0-9]{{4}}$') THEN list_reverse(regexp_split_to_array(t, '[-/ ]'))
       WHEN regexp_matches(t, '^[A-Za-z]{{3,}}\\s+[0-9]{{1,2}},?\\s+[0-9]{{4}}$') THEN [split_part(t, ' ', 3), split_part(t, ' ', 1), replace(split_part(t, ' ', 2), ',', '')] END AS p FROM t),
m AS (SELECT record_id, f, t, try_cast(p[1] AS INT) AS y, try_cast(p[3] AS INT) AS d,
  CASE WHEN regexp_matches(p[2], '^[0-9]+$') THEN try_cast(p[2] AS INT) WHEN instr({_MONTHS}, lower(left(p[2], 3))) > 0 THEN (instr({_MONTHS}, lower(left(p[2], 3))) + 2) // 3 END AS m FROM p),
v AS (SELECT record_id, f, CASE WHEN regexp_matches(t, '^[0-9]{{5}}$') THEN strftime(DATE '1899-12-30' + try_cast(t AS INT), '%Y-%m-%d')
  WHEN y BETWEEN 1900 AND 2200 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN format('{{}}-{{:02d}}-{{:02d}}', y, m, d) END AS v FROM m)
SELECT record_id, max(v) FILTER (f = 'issued_on') AS issued_on, max(v) FILTER (f = 'cancelled_on') AS cancelled_on FROM v GROUP BY record_id""",
    "split_assignment": f"""
WITH k AS (SELECT coalesce(upper(trim(cluster_key)), '__empty__') AS k, count(*) AS n FROM pairs GROUP BY 1),
h AS (SELECT k, n, list_reduce([{pair_ops.SEED}::BIGINT] || list_transform(list_filter(string_split(k, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT), lambda acc, c: (xor(acc, c) * 16777619) % 4294967296) / 4294967296.0 AS h FROM k)
SELECT CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.85 THEN 'validation' ELSE 'test' END AS split_name, sum(n)::BIGINT AS n, count(*) AS groups FROM h GROUP BY 1""",
    "pair_similarities": f"""
WITH names AS (SELECT 'registered_nbfc:' || source_row_number AS id, name_core AS e FROM registered_nbfc WHERE dataset_as_of = (SELECT max(dataset_as_of) FROM registered_nbfc)
  QUALIFY row_number() OVER (PARTITION BY source_row_number ORDER BY last_imported_at DESC, row_id) = 1),
q AS (SELECT pair_id, {sql_normalize('query_text')} AS q, e FROM pairs JOIN names ON names.id = lower(trim(entity_id)) WHERE query_text IS NOT NULL AND e IS NOT NULL),
g AS (SELECT *, '  ' || lower(q) || ' ' AS pq, '  ' || lower(e) || ' ' AS pe, list_distinct(list_filter(string_split(q, ' '), lambda t: t <> '')) AS tq, list_distinct(list_filter(string_split(e, ' '), lambda t: t <> '')) AS te FROM q),
s AS (SELECT *, {_GRAMS.format(p='pq')} AS gq, {_GRAMS.format(p='pe')} AS ge FROM g),
c AS (SELECT *, len(list_intersect(gq, ge)) AS sg, len(list_intersect(tq, te)) AS st FROM s)
SELECT pair_id, round(sg / (len(gq) + len(ge) - sg), 6) AS trigram,
  round(CASE WHEN len(tq) = 0 OR len(te) = 0 THEN 0 ELSE st / (len(tq) + len(te) - st) END, 6) AS token_jaccard,
  round(CASE WHEN len(tq) = 0 OR len(te) = 0 THEN 0 ELSE st / least(len(tq), len(te)) END, 6) AS token_containment,
  round(CASE WHEN greatest(length(q), length(e)) = 0 THEN 1 ELSE 1 - levenshtein(q, e) / greatest(length(q), length(e)) END, 6) AS edit_similarity,
  round(CASE WHEN greatest(length(q), length(e)) = 0 THEN 0 ELSE least(length(q), length(e)) / greatest(length(q), length(e)) END, 6) AS length_ratio
FROM c""",
}
