"""Queries on the corpus: statistics, lookups, candidate retrieval, features, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinledger.functions import labels
from kinledger.functions.urls import normalize_hostname
from kinledger.operators import corpus, evaluate, features, ingest, model, pairs, parsing, retrieve, snapshots
from kinledger.plans import search, training
from kinledger.runtime import cut, table

LIMIT = 10
def _entities(spark, d):
    return cut(corpus.build_entities(table(spark, d, "registered_nbfc"), table(spark, d, "cancelled_record")))


def entities(spark, d):
    return corpus.build_entities(table(spark, d, "registered_nbfc"), table(spark, d, "cancelled_record")).select("id", "source", "standing", "name_core", "cin")


def standing_counts(spark, d):
    e = corpus.build_entities(table(spark, d, "registered_nbfc"), table(spark, d, "cancelled_record"))
    counts = e.groupBy("source", "standing").agg(F.count("*").alias("n"), F.count_distinct("cluster_key").alias("clusters"))
    return counts.withColumn("label", labels.source_label(F.col("source"))).withColumn("meaning", labels.standing_label(F.col("standing")))


def term_idf(spark, d):
    e = _entities(spark, d)
    stats = corpus.term_stats(corpus.postings(e), corpus.entity_count(e))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"), "kept")


def cin_lookup(spark, d):
    e = _entities(spark, d)
    claims = search.claim_profiles(table(spark, d, "company_input"))
    hits = retrieve.lookup(claims, "claim_id", F.col("cin"), "cin", corpus.entity_keys(e))
    return hits.join(e.select("pos", "id"), "pos").select("claim_id", F.col("id").alias("entity_id"))


def name_lookup(spark, d):
    e = _entities(spark, d)
    claims = search.claim_profiles(table(spark, d, "company_input"))
    keys = corpus.entity_keys(e)
    exact = retrieve.lookup(claims, "claim_id", F.col("name_normalized"), "name", keys).withColumn("route", F.lit("exact_name"))
    alias = retrieve.lookup(claims, "claim_id", F.col("name_normalized"), "alias", keys).withColumn("route", F.lit("former_name"))
    return exact.unionByName(alias).join(e.select("pos", "id"), "pos").select("claim_id", F.col("id").alias("entity_id"), "route")


def parent_domain_lookup(spark, d):
    """Hosts of documents against contact domains of the list, nearest parent first."""
    e = _entities(spark, d)
    docs = table(spark, d, "documents").select("doc_id", normalize_hostname(F.col("hostname")).alias("host"))
    hits = retrieve.parent_lookup(docs, "doc_id", F.col("host"), "email_domain", corpus.entity_keys(e))
    return hits.groupBy("doc_id", "level").agg(F.count("*").alias("n_entities"))


def identifier_lookup(spark, d):
    e = _entities(spark, d)
    claims = cut(search.claim_profiles(table(spark, d, "company_input")))
    hits = retrieve.identify(claims, "claim_id", corpus.entity_keys(e), e.select("pos", "id"))
    return hits.select("claim_id", F.col("id").alias("entity_id"), "identified_by", F.array_join("routes", ",").alias("routes"))


def search_candidates(spark, d):
    return search.search(table(spark, d, "company_input"), _entities(spark, d), LIMIT)


def search_registered(spark, d):
    """A search among registered companies: the source filter stands above the 80 candidates retrieved, then ten are shown."""
    found = search.served_search(table(spark, d, "company_input"), _entities(spark, d), "registered_nbfc", LIMIT)
    return found.select("claim_id", "entity_id", "score", "rank")


def ranked_matches(spark, d):
    return search.ranked_matches(table(spark, d, "company_input"), _entities(spark, d))


def known_entities(spark, d):
    return search.known_entities(table(spark, d, "company_input"), _entities(spark, d))


def pg_trigram_search(spark, d):
    e = _entities(spark, d)
    claims = cut(search.claim_profiles(table(spark, d, "company_input")).select("claim_id", "name_normalized", "name_core"))
    found = retrieve.fuzzy_name_search(claims, "claim_id", e, "id")
    return found.select("claim_id", F.col("id").alias("entity_id"), F.round(F.col("similarity").cast("double"), 5).alias("similarity"), "matched_on", "rank")


def _features(spark, d, with_jaro=False):
    return search.featured_pairs(table(spark, d, "pairs"), _entities(spark, d), with_jaro)


def feature_vector(spark, d):
    f = _features(spark, d)
    return f.select("pair_id", "label", *[F.round(c, 6).alias(c) for c in features.NATIVE])


def feature_vector_full(spark, d):
    return _features(spark, d, with_jaro=True)


def _recorded(spark, d):
    """All features of the recorded pairs with their split; pairs with an empty query or an unknown entity have none."""
    recorded = table(spark, d, "pairs").where("label is not null")
    made = search.featured_pairs(recorded, _entities(spark, d), with_jaro=True)
    splits = recorded.select("pair_id", F.lower(F.trim("split")).alias("split"))
    return cut(made.join(splits, "pair_id").select("pair_id", "split", F.col("label").cast("double").alias("label"), *features.FEATURES))


def _exported(data):
    """The logistic model fitted on the train split, and its coefficients on the unscaled features."""
    fitted = model.fit_logistic(data.where("split = 'train'"), features.FEATURES, "label")
    return fitted, *model.export_logistic(fitted, features.FEATURES)


def scores(spark, d):
    """Match probability of the recorded pairs by the fitted and exported model, as one native expression."""
    data = _recorded(spark, d)
    _, weights, bias = _exported(data)
    return data.select("pair_id", "split", F.round(model.logistic_score(weights, bias), 6).alias("probability"))


def export_parity(spark, d):
    """Largest difference between the fitted model and its exported expression; must stay below 1e-9."""
    data = _recorded(spark, d)
    fitted, weights, bias = _exported(data)
    by_model = model.score_with(fitted, data).select("pair_id", "p")
    by_export = data.select("pair_id", model.logistic_score(weights, bias).alias("p"))
    return model.max_difference(by_model, by_export, "pair_id", "p").select((F.col("max_difference") <= 1e-9).alias("within_bound"))


def _scored(spark, d):
    """Recorded labels and a recorded feature of the pairs table as score."""
    return table(spark, d, "pairs").select("pair_id", "label", F.col("token_jaccard").alias("score"), "variant_id")


def confusion_sweep(spark, d):
    return evaluate.confusion_sweep(_scored(spark, d), "label", "score")


def choose_threshold(spark, d):
    return evaluate.choose_threshold(confusion_sweep(spark, d))


def ranking_metrics(spark, d):
    return evaluate.ranking_metrics(_scored(spark, d), "label", "score")


def recall_by_variant(spark, d):
    return evaluate.recall_by(_scored(spark, d).where("variant_id is not null"), "label", "score", "variant_id", 0.6)


def recall_by_entity(spark, d):
    """Recall by the source an entity comes from."""
    scored = table(spark, d, "pairs").select("label", F.col("token_jaccard").alias("score"), "entity_source")
    return evaluate.recall_by(scored.where("entity_source is not null"), "label", "score", "entity_source", 0.6)


def pair_counts(spark, d):
    return evaluate.pair_counts(table(spark, d, "pairs"), ["split", "variant_id"], "label")


RECORDED = ["token_jaccard", "token_containment", "prefix_share", "length_ratio"]


def model_selection(spark, d):
    """Which recorded feature alone would serve best as a score: least cost at its own threshold, then average precision."""
    out = None
    for name in RECORDED:
        scored = table(spark, d, "pairs").select("label", F.col(name).alias("score"))
        best = evaluate.choose_threshold(evaluate.confusion_sweep(scored, "label", "score")).select("threshold", "cost_primary")
        row = best.crossJoin(evaluate.ranking_metrics(scored, "label", "score")).select(F.lit(name).alias("model"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return evaluate.select_model(out, "cost_primary", "average_precision")


def sweep_shown(spark, d):
    sweep = cut(confusion_sweep(spark, d))
    return evaluate.shown_thresholds(sweep, evaluate.choose_threshold(sweep).select("threshold"))


def training_pairs(spark, d):
    """Pairs of quoted names and entities, built from the corpus itself."""
    return training.labelled_pairs(_entities(spark, d)).select("split", "cluster_key", "variant_id", "query_text", "entity_id", "label")


def corpus_sources(spark, d):
    """Entities by source, with the reconstruction companies and cancelled companies that the sheet lines give."""
    good, _ = parsing.split_sheet_rows(table(spark, d, "sheet_rows"))
    place = table(spark, d, "sheet_rows").select(F.col("line_id").alias("row_key"), "source_row_number")
    rows = cut(good.join(place, "row_key"))
    latest = lambda key: snapshots.counting_rows(ingest.typed_rows(rows.where(F.col("dataset_key") == key), key, "cells", ["row_key", "source_row_number"]), ["source_row_number"], "row_key", SHEET_COLUMNS[key])
    more = {key: latest(key) for key in SHEET_COLUMNS}
    e = corpus.build_entities(table(spark, d, "registered_nbfc"), table(spark, d, "cancelled_record"), **more)
    return e.groupBy("source", "standing").agg(F.count("*").alias("n"), F.count_distinct("name_core").alias("names"))


SHEET_COLUMNS = {
    "registered_arc": ["name", "name_normalized", "name_core", "alternate_names", "cin_normalized", "email_domains", "regional_office"],
    "cancelled_company": ["name", "name_normalized", "name_core", "regional_office"],
}


def split_summary(spark, d):
    return evaluate.split_summary(table(spark, d, "pairs"), "split", "cluster_key", "label")


def leaking_clusters(spark, d):
    return evaluate.leaking_groups(table(spark, d, "pairs"), "split", "cluster_key")


def hard_negatives(spark, d):
    """Closest wrong entities of claims that give a listed company number."""
    e = _entities(spark, d)
    profiles = cut(search.claim_profiles(table(spark, d, "company_input")))
    truth = retrieve.lookup(profiles, "claim_id", F.col("cin"), "cin", corpus.entity_keys(e))
    found = retrieve.search_candidates(profiles.join(truth.select("claim_id").distinct(), "claim_id", "left_semi"), "claim_id", e, 40)
    return pairs.hard_negatives(found, truth, "claim_id").join(e.select("pos", F.col("id").alias("entity_id")), "pos").select("claim_id", "entity_id", "nth")


def train_models(spark, d):
    """Three models on all features of the recorded train split, each with the threshold chosen on validation; metrics on test.

    Pairs with an empty query or an unknown entity have no features and are left out.
    """
    data = _recorded(spark, d)
    fitted = model.fit_models(data.where("split = 'train'"), features.FEATURES, "label")
    out = None
    for name, m in fitted.items():
        scored = cut(model.score_with(m, data.where("split in ('validation', 'test')")).select("split", F.col("label").cast("int").alias("label"), "p"))
        chosen = evaluate.choose_threshold(evaluate.confusion_sweep(scored.where("split = 'validation'"), "label", "p")).select("threshold")
        ranked = evaluate.ranking_metrics(scored.where("split = 'test'"), "label", "p")
        row = chosen.crossJoin(ranked).select(F.lit(name).alias("model"), "threshold", "roc_auc", "average_precision")
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (entities, standing_counts, term_idf, cin_lookup, name_lookup, parent_domain_lookup, identifier_lookup, search_candidates, search_registered, ranked_matches, known_entities, pg_trigram_search, feature_vector, feature_vector_full, scores, export_parity, confusion_sweep, choose_threshold, ranking_metrics, recall_by_variant, recall_by_entity, pair_counts, model_selection, sweep_shown, training_pairs, corpus_sources, split_summary, leaking_clusters, hard_negatives, train_models)}


def _sql() -> dict[str, str]:
    from kinledger.queries.names import _MAIL, _PROVIDERS, _STOPS, sql_clean, sql_core, sql_host, sql_normalize, sql_web_host

    ents = f"""
listed AS (
  SELECT * FROM registered_nbfc WHERE dataset_as_of = (SELECT max(dataset_as_of) FROM registered_nbfc)
  QUALIFY row_number() OVER (PARTITION BY source_row_number ORDER BY last_imported_at DESC, row_id) = 1
), sheet AS (
  SELECT * FROM cancelled_record
  QUALIFY row_number() OVER (PARTITION BY dataset_as_of, source_row_number ORDER BY last_imported_at DESC, record_id) = 1
), raw AS (
  SELECT 'registered_nbfc' AS source, 'registered' AS standing, source_row_number AS r, 0 AS o, coalesce(name_normalized, {sql_normalize('name')}) AS name_normalized, name_core, cin_normalized AS cin,
    list_distinct(list_transform(coalesce(alternate_names, []), lambda a: {sql_normalize('a')})) AS aliases,
    list_distinct(list_filter(list_transform(coalesce(email_domains, []), lambda h: {sql_host('h')}), lambda h: h IS NOT NULL)) AS domains FROM listed
  UNION ALL
  SELECT 'cancelled_record', 'cancellation_record', source_row_number, 1, coalesce(company_name_normalized, {sql_normalize('company_name')}), company_name_core, NULL, [], [] FROM sheet
), ents AS (
  SELECT source || ':' || r AS id, source, standing, o::BIGINT * 1000000000000 + r AS pos, name_normalized, coalesce(nullif(name_core, ''), {sql_core('name_normalized')}) AS name_core, cin, aliases, domains
  FROM raw WHERE nullif(name_normalized, '') IS NOT NULL AND r IS NOT NULL
)"""
    claims = f"""
claims0 AS (SELECT claim_id, cin, website, email, {sql_normalize('strip_accents(claimed_name)')} AS n FROM company_input),
claims AS (SELECT claim_id, nullif(n, '') AS name_normalized, nullif({sql_core('n')}, '') AS name_core, nullif(regexp_replace(upper({sql_clean('cin')}), '[^A-Z0-9]', '', 'g'), '') AS cin,
  {sql_web_host('website')} AS host, {_MAIL.format(c='email')} AS email_host FROM claims0)"""
    toks = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    post = f"post AS (SELECT DISTINCT unnest(list_concat([name_core], aliases).list_transform(lambda c: {toks('c')}).flatten()) AS term, pos FROM ents), total AS (SELECT count(*) AS n FROM ents), stats AS (SELECT term, count(*) AS df, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf, count(*) <= greatest(20, ceil(max(n) * 0.02)) AS kept FROM post, total GROUP BY term)"
    x = "replace({c}, ' ', '')"
    grams = lambda c: f"CASE WHEN length({x.format(c=c)}) = 0 THEN [] WHEN length({x.format(c=c)}) <= 3 THEN [{x.format(c=c)}] ELSE list_distinct(list_transform(range(1, length({x.format(c=c)}) - 1), lambda i: substr({x.format(c=c)}, i, 3))) END"
    def candidates(limit: int) -> str:
        return f"""
named AS (SELECT claim_id, name_normalized, coalesce(name_core, name_normalized) AS name_core FROM claims WHERE length(name_normalized) >= 2),
s1 AS (SELECT claim_id, pos, sum(idf) AS w FROM (SELECT claim_id, unnest(list_distinct({toks('name_core')})) AS term FROM named) JOIN (SELECT * FROM stats WHERE kept AND df <= 4000) USING (term) JOIN post USING (term) GROUP BY 1, 2),
thin AS (SELECT * FROM named WHERE claim_id NOT IN (SELECT claim_id FROM s1 GROUP BY 1 HAVING count(*) >= 200)),
gp AS (SELECT pos, unnest({grams('name_core')}) AS term FROM ents), gd AS (SELECT term FROM gp GROUP BY 1 HAVING count(*) <= 4000),
s2 AS (SELECT claim_id, pos, count(*) * 0.35 AS w FROM (SELECT claim_id, unnest({grams('name_core')}) AS term FROM thin) JOIN gd USING (term) JOIN gp USING (term) GROUP BY 1, 2),
sure AS (SELECT claim_id, pos, 1000.0 AS w FROM named JOIN ents USING (name_normalized) UNION ALL SELECT claim_id, pos, 1000.0 FROM named JOIN ents USING (name_core)
  UNION ALL SELECT DISTINCT claim_id, pos, 1000.0 FROM named JOIN (SELECT pos, unnest(aliases) AS a FROM ents) ON a = name_normalized),
pooled AS (SELECT claim_id, pos, round(sum(w), 6) AS score, max(sure) AS sure FROM (SELECT *, 0 AS sure FROM s1 UNION ALL SELECT *, 0 FROM s2 UNION ALL SELECT *, 1 FROM sure) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, pos)::INT AS rank, sum(sure) OVER (PARTITION BY claim_id) AS n_sure FROM pooled),
found AS (SELECT claim_id, id AS entity_id, score, rank FROM ranked JOIN ents USING (pos) WHERE rank <= greatest({limit}, n_sure))"""

    sweep = """
grid AS (SELECT unnest(range(1, 100)) AS step), b AS (SELECT label, least(greatest(floor(round(token_jaccard * 100, 9)), 0), 100) AS b FROM pairs WHERE token_jaccard IS NOT NULL AND label IS NOT NULL),
c AS (SELECT step, count(*) FILTER (label = 1 AND b >= step) AS tp, count(*) FILTER (label = 0 AND b >= step) AS fp, count(*) FILTER (label = 0 AND b < step) AS tn, count(*) FILTER (label = 1 AND b < step) AS fn FROM b, grid GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r, tp + fp + tn + fn AS total FROM c),
sweep AS (SELECT step / 100 AS threshold, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round((tp + tn) / total, 6) AS accuracy, round((fp * 10 + fn) / total, 6) AS cost_primary, round((fp + fn * 10) / total, 6) AS cost_alternate FROM m)"""
    word_similarity = lambda c: f"list_distinct(flatten(list_transform(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    whole_grams = lambda c: f"list_distinct(list_filter(list_transform(range(1, greatest(length({c}) + 2, 2)), lambda i: substr('  ' || lower({c}) || ' ', i, 3)), lambda y: length(y) = 3))"
    jac = lambda a, b: f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    first = lambda c: f"array_to_string(list_transform({toks(c)}, lambda y: y[1]), '')"
    initials = lambda c, other: f"(length({first(c)}) >= 2 AND {first(c)} = {other})"
    claims0 = claims.replace("claims AS (", "all_claims AS (")
    ways = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.IDENTIFIED_LABELS.items())
    identified = f"""
levels AS (SELECT claim_id, level, array_to_string(p[level + 1:], '.') AS key FROM (SELECT claim_id, p, unnest(range(0, len(p) - 1)) AS level FROM (SELECT claim_id, string_split(email_host, '.') AS p FROM claims WHERE email_host IS NOT NULL AND coalesce({sql_host('email_host')} NOT IN ({_PROVIDERS}), true)) WHERE len(p) >= 2)),
domain_hits AS (SELECT DISTINCT claim_id, level, id FROM levels JOIN (SELECT id, unnest(domains) AS key FROM ents) USING (key)),
routes AS (
  SELECT DISTINCT claim_id, id, 1 AS n, 'cin' AS route FROM claims JOIN ents USING (cin)
  UNION ALL SELECT DISTINCT claim_id, id, 2, 'exact_name' FROM claims JOIN ents USING (name_normalized)
  UNION ALL SELECT DISTINCT claim_id, id, 3, 'former_name' FROM claims JOIN (SELECT id, unnest(aliases) AS a FROM ents) ON a = name_normalized
  UNION ALL SELECT claim_id, id, 5, 'contact_domain' FROM domain_hits WHERE (claim_id, level) IN (SELECT (claim_id, min(level)) FROM domain_hits GROUP BY claim_id)),
identified AS (SELECT claim_id, id, arg_min(route, n) AS identified_by, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes FROM routes GROUP BY 1, 2)"""

    def ranked(claims: str) -> str:
        return f"""
WITH {ents}, {claims}, {post}, {candidates(60)}, {identified},
pool AS (SELECT claim_id, id, max(identified_by) AS identified_by FROM (SELECT claim_id, id, identified_by FROM identified UNION ALL SELECT claim_id, entity_id, NULL FROM found) GROUP BY 1, 2),
n AS (SELECT claim_id, p.id, identified_by, pos, standing, coalesce(c.name_core, c.name_normalized, '') AS q, e.name_core AS e FROM pool p JOIN ents e USING (id) JOIN claims c USING (claim_id)),
g AS (SELECT *, list_distinct({toks('q')}) AS tq, list_distinct({toks('e')}) AS te, {whole_grams('q')} AS gq, {whole_grams('e')} AS ge FROM n),
p AS (SELECT *, identified_by IS NOT NULL AS identified, CASE WHEN q = '' THEN 0 ELSE round(greatest({jac('tq', 'te')}, {jac('gq', 'ge')}), 6) END AS probability FROM g),
s AS (SELECT *, count(*) FILTER (identified OR probability >= 0.05) OVER (PARTITION BY claim_id) AS n_shown, row_number() OVER (PARTITION BY claim_id ORDER BY probability DESC, pos) AS best FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY identified DESC, floor(probability * 1000) DESC, CASE standing WHEN 'registered' THEN 0 WHEN 'bank' THEN 0 WHEN 'cancelled' THEN 1 ELSE 2 END, pos)::INT AS rank FROM s WHERE identified OR probability >= 0.05 OR (n_shown = 0 AND best = 1))
SELECT claim_id, id AS entity_id, identified_by, probability, identified OR probability >= 0.9 AS accepted,
  CASE identified_by {ways} ELSE CASE WHEN probability >= 0.9 THEN 'very likely the same institution' WHEN probability >= 0.6 THEN 'possibly the same institution' ELSE 'similar name only' END END AS label, rank FROM r WHERE rank <= 12"""

    one_question = claims.replace("FROM company_input", f"FROM (SELECT claim_id, claimed_name, cin, CASE WHEN {sql_clean('claimed_name')} = '' THEN website END AS website, CASE WHEN {sql_clean('claimed_name')} = '' THEN email END AS email FROM company_input)")
    return {
        "entities": f"WITH {ents} SELECT id, source, standing, name_core, cin FROM ents",
        "term_idf": f"WITH {ents}, {post} SELECT term, df, round(idf, 6) AS idf, kept FROM stats",
        "cin_lookup": f"WITH {ents}, {claims} SELECT DISTINCT claim_id, id AS entity_id FROM claims JOIN ents USING (cin)",
        "name_lookup": f"WITH {ents}, {claims} SELECT claim_id, id AS entity_id, 'exact_name' AS route FROM claims JOIN ents USING (name_normalized) UNION ALL SELECT DISTINCT claim_id, id, 'former_name' FROM claims JOIN (SELECT id, unnest(aliases) AS a FROM ents) ON a = name_normalized",
        "parent_domain_lookup": f"""
WITH {ents}, docs AS (SELECT doc_id, {sql_host('hostname')} AS host FROM documents), p AS (SELECT doc_id, string_split(host, '.') AS p FROM docs WHERE host IS NOT NULL),
lv AS (SELECT doc_id, p, unnest(range(0, len(p) - 1)) AS level FROM p WHERE len(p) >= 2), k AS (SELECT doc_id, level, array_to_string(p[level + 1:], '.') AS key FROM lv),
hits AS (SELECT DISTINCT doc_id, level, id FROM k JOIN (SELECT id, unnest(domains) AS key FROM ents) USING (key))
SELECT doc_id, level::INT AS level, count(*) AS n_entities FROM hits WHERE (doc_id, level) IN (SELECT (doc_id, min(level)) FROM hits GROUP BY doc_id) GROUP BY 1, 2""",
        "search_candidates": f"WITH {ents}, {claims}, {post}, {candidates(LIMIT)} SELECT * FROM found",
        "search_registered": f"WITH {ents}, {claims}, {post}, {candidates(80)} SELECT claim_id, entity_id, score, nth AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, rank)::INT AS nth FROM found WHERE starts_with(entity_id, 'registered_nbfc:')) WHERE nth <= {LIMIT}",
        "ranked_matches": ranked(claims),
        "known_entities": f"SELECT claim_id, entity_id, label, row_number() OVER (PARTITION BY claim_id ORDER BY rank)::INT AS nth FROM ({ranked(one_question)}) WHERE accepted QUALIFY nth <= 3",
        "identifier_lookup": f"WITH {ents}, {claims}, {identified} SELECT claim_id, id AS entity_id, identified_by, routes FROM identified",
        "standing_counts": f"""
WITH RECURSIVE {ents}, w AS (SELECT id, list_filter(string_split(name_core, ' '), lambda t: t <> '') AS t FROM ents UNION ALL SELECT id, t[2:] FROM w WHERE len(t) > 1 AND t[1] IN ({_STOPS})),
k AS (SELECT id, arg_min(t, len(t)) AS t FROM w GROUP BY id), c AS (SELECT id, coalesce(CASE WHEN len(t[1]) <= 2 AND t[2] IS NOT NULL THEN t[1] || '_' || left(t[2], 8) ELSE left(t[1], 8) END, '__empty__') AS k FROM k)
SELECT source, standing, count(*) AS n, count(DISTINCT k) AS clusters, CASE source WHEN 'registered_nbfc' THEN 'RBI list of registered NBFCs' ELSE 'RBI cancellation / restoration record' END AS label,
  CASE standing WHEN 'registered' THEN 'Certificate of Registration on record' ELSE 'Appears in the cancellation / restoration record' END AS meaning FROM ents JOIN c USING (id) GROUP BY 1, 2""",
        "hard_negatives": f"""
WITH {ents}, {claims0}, truth AS (SELECT DISTINCT claim_id, pos FROM all_claims JOIN ents USING (cin)), claims AS (SELECT * FROM all_claims WHERE claim_id IN (SELECT claim_id FROM truth)), {post}, {candidates(40)},
w AS (SELECT claim_id, entity_id, rank FROM found JOIN ents ON id = entity_id WHERE (claim_id, pos) NOT IN (SELECT (claim_id, pos) FROM truth))
SELECT claim_id, entity_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank)::INT AS nth FROM w QUALIFY nth <= 5""",
        "feature_vector": f"""
WITH {ents}, {post},
q AS (SELECT pair_id, label, lower(trim(entity_id)) AS id, {sql_normalize('strip_accents(query_text)')} AS qn FROM pairs WHERE query_text IS NOT NULL AND entity_id IS NOT NULL),
n AS (SELECT pair_id, label, qn, {sql_core('qn')} AS qc, name_normalized AS en, name_core AS ec, aliases FROM q JOIN ents USING (id) WHERE qn <> ''),
t AS (SELECT *, {toks('qc')} AS qt, {toks('ec')} AS et, replace(qc, ' ', '') AS qx, replace(ec, ' ', '') AS ex FROM n),
d AS (SELECT *, list_distinct(qt) AS qs, list_distinct(et) AS es FROM t),
top AS (SELECT ln((count(*) + 1) / 2) + 1 AS top FROM ents),
u AS (SELECT pair_id, unnest(list_distinct(list_concat(qs, es))) AS term, qs, es FROM d),
v AS (SELECT pair_id, list_contains(qs, term) AS inq, list_contains(es, term) AS ine, coalesce(idf, top) AS w, least(1, coalesce(idf, top) / top) AS rare FROM u LEFT JOIN stats USING (term), top),
a AS (SELECT pair_id, sum(w) AS uw, coalesce(sum(w) FILTER (inq AND ine), 0) AS sw, coalesce(max(rare) FILTER (inq AND ine), 0) AS sr, coalesce(max(rare) FILTER (inq AND NOT ine), 0) AS qr, coalesce(max(rare) FILTER (ine AND NOT inq), 0) AS er FROM v GROUP BY 1),
g AS (SELECT *, {whole_grams('qc')} AS gqc, {whole_grams('ec')} AS gec, {whole_grams('qn')} AS gqn, {whole_grams('en')} AS gen, list_filter(qt, lambda x: regexp_matches(x, '[0-9]')) AS qd, list_filter(et, lambda x: regexp_matches(x, '[0-9]')) AS ed FROM d)
SELECT pair_id, label, (qn = en)::DOUBLE AS exact_normalized_match, (qc = ec)::DOUBLE AS exact_core_match, list_contains(aliases, qn)::DOUBLE AS alternate_name_match,
  round({jac('qs', 'es')}, 6) AS token_jaccard, round(CASE WHEN least(len(qs), len(es)) = 0 THEN 0 ELSE len(list_intersect(qs, es)) / least(len(qs), len(es)) END, 6) AS token_containment,
  round(CASE WHEN len(qs) = 0 OR len(es) = 0 OR uw <= 0 THEN 0 ELSE sw / uw END, 6) AS idf_weighted_overlap, round({jac('gqc', 'gec')}, 6) AS trigram_core, round({jac('gqn', 'gen')}, 6) AS trigram_full,
  round(CASE WHEN greatest(length(qx), length(ex)) = 0 THEN 1 ELSE 1 - levenshtein(qx, ex) / greatest(length(qx), length(ex)) END, 6) AS edit_similarity,
  round(CASE WHEN least(length(qx), length(ex)) = 0 THEN 0 ELSE coalesce(len(list_filter(range(1, least(length(qx), length(ex)) + 1), lambda i: left(qx, i) = left(ex, i))), 0) / least(length(qx), length(ex)) END, 6) AS prefix_ratio,
  round(CASE WHEN greatest(length(qx), length(ex)) = 0 THEN 0 ELSE least(length(qx), length(ex)) / greatest(length(qx), length(ex)) END, 6) AS length_ratio,
  round(least(1, abs(len(qt) - len(et)) / 5), 6) AS token_count_gap, coalesce(qt[1] = et[1], false)::DOUBLE AS first_token_match,
  ({initials('qc', 'ex')} OR {initials('qn', 'ex')} OR {initials('ec', 'qx')} OR {initials('en', 'qx')})::DOUBLE AS acronym_match,
  round(sr, 6) AS shared_rare_token, round(qr, 6) AS unmatched_rare_query_token, round(er, 6) AS unmatched_rare_entity_token,
  round(CASE WHEN len(qd) = 0 AND len(ed) = 0 THEN 1 WHEN len(qd) = 0 OR len(ed) = 0 THEN 0 ELSE len(list_filter(qd, lambda x: list_contains(ed, x))) / greatest(len(qd), len(ed)) END, 6) AS digit_token_agreement
FROM g LEFT JOIN a USING (pair_id)""",
        "recall_by_entity": "SELECT entity_source, count(*) AS positives, count(*) FILTER (token_jaccard >= 0.6) AS found, round(count(*) FILTER (token_jaccard >= 0.6) / count(*), 6) AS recall FROM pairs WHERE label = 1 AND entity_source IS NOT NULL GROUP BY 1",
        "pair_counts": "SELECT lower(trim(split)) AS split, lower(trim(variant_id)) AS variant_id, count(*) AS n, count(*) FILTER (label = 1) AS positives, round(count(*) FILTER (label = 1) / count(*), 6) AS share FROM pairs GROUP BY 1, 2",
        "model_selection": "WITH " + ", ".join(f"m_{c} AS (WITH {sweep.replace('token_jaccard', c)}, s AS (SELECT {c} AS s, sum(label) AS pos, sum(1 - label) AS neg FROM pairs WHERE {c} IS NOT NULL AND label IS NOT NULL GROUP BY 1), k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY s DESC)), r AS (SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM k), t AS (SELECT threshold, cost_primary FROM sweep ORDER BY cost_primary, f1 DESC, threshold LIMIT 1) SELECT '{c}' AS model, threshold, cost_primary, roc_auc, average_precision FROM t, r)" for c in RECORDED) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM m_{c}" for c in RECORDED) + ") ORDER BY cost_primary, average_precision DESC, model LIMIT 1",
        "sweep_shown": f"WITH {sweep}, best AS (SELECT threshold AS t FROM sweep ORDER BY cost_primary, f1 DESC, threshold LIMIT 1) SELECT sweep.* FROM sweep, best WHERE round(threshold * 100)::INT % 5 = 0 OR threshold = t",
        "pg_trigram_search": f"""
WITH {ents}, {claims}, t AS (SELECT DISTINCT c.x AS q FROM (SELECT name_core AS x FROM claims UNION SELECT name_normalized FROM claims) c WHERE x IS NOT NULL), u AS (SELECT name_core AS n FROM ents UNION SELECT name_normalized FROM ents),
qg AS (SELECT q, {word_similarity('q')} AS g FROM t), ng AS (SELECT n, {word_similarity('n')} AS g FROM u),
shared AS (SELECT q, n, count(*) AS s FROM (SELECT q, unnest(g) AS y FROM qg) JOIN (SELECT n, unnest(g) AS y FROM ng) USING (y) GROUP BY 1, 2),
sim AS (SELECT q, n, (s / (len(qg.g) + len(ng.g) - s))::FLOAT AS sim FROM shared JOIN qg USING (q) JOIN ng USING (n) WHERE (s / (len(qg.g) + len(ng.g) - s))::FLOAT >= 0.30::FLOAT),
b AS (SELECT claim_id, id, sim AS full_sim, 0::FLOAT AS core_sim FROM sim JOIN claims ON claims.name_normalized = q JOIN ents ON ents.name_normalized = n UNION ALL SELECT claim_id, id, 0, sim FROM sim JOIN claims ON claims.name_core = q JOIN ents ON ents.name_core = n),
m AS (SELECT claim_id, id, max(full_sim) AS a, max(core_sim) AS c FROM b GROUP BY 1, 2),
r AS (SELECT claim_id, id AS entity_id, greatest(a, c) AS similarity, CASE WHEN a >= c THEN 'full_name' ELSE 'core_name' END AS matched_on, row_number() OVER (PARTITION BY claim_id ORDER BY greatest(a, c) DESC, name_normalized, id)::INT AS rank FROM m JOIN ents USING (id))
SELECT claim_id, entity_id, round(similarity::DOUBLE, 5) AS similarity, matched_on, rank FROM r WHERE rank <= 10""",
        "confusion_sweep": f"WITH {sweep} SELECT * FROM sweep",
        "choose_threshold": f"WITH {sweep} SELECT * FROM sweep ORDER BY cost_primary, f1 DESC, threshold LIMIT 1",
        "ranking_metrics": """
WITH s AS (SELECT token_jaccard AS s, sum(label) AS pos, sum(1 - label) AS neg FROM pairs WHERE token_jaccard IS NOT NULL AND label IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY s DESC))
SELECT round(sum(neg * (tp - pos + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c""",
        "recall_by_variant": "SELECT variant_id, count(*) AS positives, count(*) FILTER (token_jaccard >= 0.6) AS found, round(count(*) FILTER (token_jaccard >= 0.6) / count(*), 6) AS recall FROM pairs WHERE label = 1 AND variant_id IS NOT NULL GROUP BY 1",
        "split_summary": "SELECT lower(trim(split)) AS split, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(DISTINCT lower(trim(cluster_key))) AS groups FROM pairs GROUP BY 1",
        "leaking_clusters": "SELECT lower(trim(cluster_key)) AS group_key, count(DISTINCT lower(trim(split))) AS n_splits FROM pairs WHERE cluster_key IS NOT NULL GROUP BY 1 HAVING n_splits > 1",
    }


SQL = _sql()
