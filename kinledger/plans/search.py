"""Name search and pair scoring over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinledger.functions.labels import confidence_label
from kinledger.functions.similarity import name_similarity
from kinledger.functions.text import clean, name_core, normalize_cin, normalize_name
from kinledger.functions.urls import email_domain, extract_hostname
from kinledger.operators import corpus, features, retrieve
from kinledger.runtime import cut

SHOWN, MOST_SHOWN = 10, 25
# Candidates retrieved for a search and for a verification, matches returned, display floor, acceptance
# without a model, and the order of standings.
RETRIEVED, POOLED, MATCHES, KNOWN = 80, 60, 12, 3
FLOOR, ACCEPTED = 0.05, 0.9
STANDING_RANKS = {"registered": 0, "bank": 0, "cancelled": 1, "cancellation_record": 2}


def claim_profiles(claims: DataFrame) -> DataFrame:
    """Claims with their normalised name, core, number and hosts; null and empty fields become null."""
    named = cut(claims.select("claim_id", "cin", "website", "email", normalize_name(F.coalesce("claimed_name", F.lit(""))).alias("n")))
    return named.select(
        "claim_id",
        F.nullif("n", F.lit("")).alias("name_normalized"),
        F.nullif(name_core(F.col("n")), F.lit("")).alias("name_core"),
        normalize_cin(F.col("cin")).alias("cin"),
        extract_hostname(F.col("website")).alias("host"),
        email_domain(F.col("email")).alias("email_host"),
    )


def search(claims: DataFrame, entities: DataFrame, limit: int = SHOWN, whole: bool = False) -> DataFrame:
    """(claim_id, entity_id, score, rank) of the best candidates of each claim; with ``whole`` no word or 3-gram is left out."""
    found = retrieve.search_candidates(claim_profiles(claims), "claim_id", entities, limit, whole=whole)
    return found.join(entities.select("pos", F.col("id").alias("entity_id")), "pos").select("claim_id", "entity_id", "score", "rank")


def served_search(claims: DataFrame, entities: DataFrame, source: str = "all", limit: int = SHOWN, scorer=None, whole: bool = False) -> DataFrame:
    """(claim_id, entity_id, score, probability, rank) as a search is served.

    RETRIEVED candidates are retrieved, then filtered by source, then ordered by the probability that ``scorer`` (a
    function from the features' DataFrame to a Column) gives, or by blocking score without one, then cut to 1..25.
    With ``whole`` every candidate of the source takes part: no word or 3-gram is left out, and nothing is cut before the
    source is chosen and, with a scorer, before all are scored.
    """
    limit = min(max(int(limit), 1), MOST_SHOWN)
    profiles = cut(claim_profiles(claims))
    listed = entities if source == "all" else entities.where(F.col("source") == source)
    if whole:
        # without a scorer the best by blocking score are those shown
        found = retrieve.search_candidates(profiles, "claim_id", entities, limit if scorer is None else None, whole=True, among=listed)
    else:
        found = retrieve.search_candidates(profiles, "claim_id", entities, RETRIEVED)
    kept = found.join(listed.select("pos", F.col("id").alias("entity_id")), "pos").select("claim_id", "entity_id", "score", F.col("rank").alias("place"))
    if scorer is None:
        scored = kept.withColumn("probability", F.lit(None).cast("double"))
    else:
        kept = cut(kept.withColumn("pair_id", F.concat_ws("|", "claim_id", "entity_id")))
        named = kept.join(profiles.select("claim_id", F.col("name_normalized").alias("q_normalized"), F.coalesce("name_core", "name_normalized").alias("q_core")), "claim_id")
        featured = with_features(named, "pair_id", entities, True)
        scored = featured.select("claim_id", "entity_id", "score", "place", scorer(featured).alias("probability"))
    order = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc(F.coalesce("probability", "score")), "place"))
    return scored.withColumn("rank", order).where(F.col("rank") <= limit).select("claim_id", "entity_id", "score", "probability", "rank")


def ranked_matches(claims: DataFrame, entities: DataFrame, accept: float = ACCEPTED, accepted_only: bool = False, whole: bool = False) -> DataFrame:
    """(claim_id, entity_id, identified_by, probability, accepted, label, rank): at most MATCHES of each claim.

    Identified entities and POOLED candidates are pooled. Without a model the probability is the larger of word overlap
    and trigram similarity of the core names. What is neither identified nor above FLOOR is not shown, but the best one
    is where nothing else is left. Identified ones first, then probability in steps of a thousandth, then standing.
    With ``accepted_only`` the others, which come behind (``accept`` is in whole thousandths), are not ranked or given.
    With ``whole`` every entity that shares a word or a 3-gram is in the pool.
    """
    profiles = cut(claim_profiles(claims))
    standing = F.coalesce(*[F.when(F.col("standing") == s, r) for s, r in STANDING_RANKS.items()], F.lit(3))
    texts = entities.select("pos", F.col("name_core").alias("text"), standing.alias("place"))
    hits = retrieve.identified_best(profiles.withColumn("text", F.coalesce("name_core", "name_normalized")), "claim_id", corpus.entity_keys(entities), texts, MATCHES)
    found = retrieve.whole_pool(profiles, "claim_id", entities, standing, MATCHES, FLOOR) if whole else retrieve.search_candidates(profiles, "claim_id", entities, POOLED)
    found = found.select("claim_id", "pos", F.lit(None).cast("string").alias("identified_by"))
    pool = hits.unionByName(found).groupBy("claim_id", "pos").agg(F.max("identified_by").alias("identified_by"))
    listed = entities.select("pos", F.col("id").alias("entity_id"), "standing", F.col("name_core").alias("e_core"))
    named = pool.join(profiles.select("claim_id", F.coalesce("name_core", "name_normalized").alias("q_core")), "claim_id").join(listed, "pos")
    similar = F.round(name_similarity(F.col("q_core"), F.col("e_core")), 6)
    scored = named.withColumn("probability", F.when(F.coalesce("q_core", F.lit("")) == "", 0.0).otherwise(similar)).withColumn("identified", F.col("identified_by").isNotNull())
    accepted = F.col("identified") | (F.col("probability") >= accept)
    scored = scored.where(accepted) if accepted_only else scored
    order = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("identified"), F.desc(F.floor(F.col("probability") * 1000)), standing, "pos"))
    shown = F.col("identified") | (F.col("probability") >= FLOOR)
    n_shown = F.count_if(shown).over(Window.partitionBy("claim_id"))
    best = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("probability"), "pos"))
    kept = scored.withColumn("n_shown", n_shown).withColumn("best", best).where(shown | ((F.col("n_shown") == 0) & (F.col("best") == 1)))
    ranked = kept.withColumn("rank", order).where(F.col("rank") <= MATCHES)
    return ranked.select("claim_id", "entity_id", "identified_by", "probability", accepted.alias("accepted"), confidence_label(F.col("identified_by"), F.col("probability")).alias("label"), "rank")


def known_entities(claims: DataFrame, entities: DataFrame, whole: bool = False) -> DataFrame:
    """The first KNOWN accepted matches of each claim: a question for a name and one for a domain are never blended.

    Site and mail domain identify only where no name is given. ``whole`` as in :func:`ranked_matches`.
    """
    nameless = clean(F.col("claimed_name")) == ""
    asked = claims.select("claim_id", "claimed_name", "cin", F.when(nameless, F.col("website")).alias("website"), F.when(nameless, F.col("email")).alias("email"))
    accepted = ranked_matches(asked, entities, accepted_only=True, whole=whole)
    nth = F.row_number().over(Window.partitionBy("claim_id").orderBy("rank"))
    return accepted.withColumn("nth", nth).where(F.col("nth") <= KNOWN).select("claim_id", "entity_id", "label", "nth")


def named_pairs(pairs: DataFrame, entities: DataFrame, with_aliases: bool = True) -> DataFrame:
    """Labelled pairs beside both names: pair_id, label, q_normalized, q_core, e_normalized, e_core, e_aliases.

    Rows with an empty query or an unknown entity are left out.
    """
    typed = pairs.where("query_text is not null and entity_id is not null").select("pair_id", "label", "query_text", F.lower(F.trim("entity_id")).alias("id"))
    # names are normalised once a text
    texts = cut(typed.select("query_text").distinct().select("query_text", normalize_name(F.col("query_text")).alias("q_normalized")).where("q_normalized <> ''"))
    texts = cut(texts.withColumn("q_core", name_core(F.col("q_normalized"))))
    listed = entities.select("id", F.col("name_normalized").alias("e_normalized"), F.col("name_core").alias("e_core"), F.col("alternate_names").alias("e_aliases"))
    return typed.join(listed, "id").join(texts, "query_text").drop("query_text")


def with_features(pairs: DataFrame, key: str, entities: DataFrame, with_jaro: bool = True) -> DataFrame:
    """``pairs`` (key, entity_id, q_normalized, q_core) plus the names of the entity and all features; IDF of the whole corpus."""
    listed = entities.select(F.col("id").alias("entity_id"), F.col("name_normalized").alias("e_normalized"), F.col("name_core").alias("e_core"), F.col("alternate_names").alias("e_aliases"))
    return _weighed(cut(pairs.join(listed, "entity_id")), entities, with_jaro)


def _weighed(named: DataFrame, entities: DataFrame, with_jaro: bool) -> DataFrame:
    n = corpus.entity_count(entities)
    stats = corpus.term_stats(corpus.postings(entities), n)
    cores = named.select(F.col("q_core").alias("core")).unionByName(entities.select(F.col("name_core").alias("core")))
    weights = cut(features.text_weights(cores, "core", stats))
    top = n.select((F.log((F.col("n") + 1) / 2) + 1).alias("top"))
    joined = named
    for side in ("q", "e"):
        joined = joined.join(weights.select(F.col("core").alias(f"{side}_core"), F.col("idf").alias(f"{side}_idf")), f"{side}_core", "left")
    return features.pair_features(joined.select(*named.columns, "q_idf", "e_idf").crossJoin(F.broadcast(top)), with_jaro)


def featured_pairs(pairs: DataFrame, entities: DataFrame, with_jaro: bool = True) -> DataFrame:
    made = _weighed(cut(named_pairs(pairs, entities)), entities, with_jaro)
    return made.select("pair_id", "label", *[f for f in features.FEATURES if f in made.columns])
