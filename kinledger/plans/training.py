"""Labelled pairs for training, built from the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinledger.functions.text import name_core, normalize_name_folded
from kinledger.operators import pairs, retrieve
from kinledger.plans.search import with_features
from kinledger.runtime import cut

# Entities that give queries, and candidates looked at for each.
SAMPLE, POOL = 6_000, 40
SPLITS = ("train", "validation", "test")


def labelled_pairs(entities: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(split, cluster_key, variant_id, query_text, entity_id, entity_source, label): pairs of quoted names and entities.

    Entities are split by cluster; a query meets only the entities of its own split, so that no negative leaks. The
    entity behind a query is always a positive, even where retrieval missed it; the first candidates that are another
    institution and one drawn at random are negatives. A (split, query, entity) stands once, its first variant counts.
    """
    held = cut(entities.withColumn("split", pairs.group_split(F.col("cluster_key"))))
    sizes = {r.split: r.n for r in held.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    drawn = pairs.stratified_sample(held, "source", "id", size)
    quoted = cut(pairs.query_variants(drawn, "id", "name", "alternate_names").join(drawn.select("id", "split", "cluster_key", "pos"), "id"))
    quoted = cut(quoted.withColumn("name_normalized", normalize_name_folded(F.col("query_text"))).withColumn("q_id", F.concat_ws("|", "id", "variant_id", "name_normalized")).dropDuplicates(["q_id"]))
    chosen = None
    for split in [s for s in SPLITS if sizes.get(s)]:
        own, asked = held.where(F.col("split") == split), quoted.where(F.col("split") == split)
        profiles = asked.select("q_id", "name_normalized", name_core(F.col("name_normalized")).alias("name_core"))
        found = retrieve.search_candidates(profiles, "q_id", own, POOL).select("q_id", "pos", "rank")
        extra = pairs.random_negative(asked, "q_id", own, sizes[split]).withColumn("rank", F.lit(-1))
        truth = asked.select("q_id", "pos", F.lit(0).alias("rank"))
        each = found.unionByName(truth).unionByName(extra)
        chosen = each if chosen is None else chosen.unionByName(each)
    if chosen is None:
        chosen = quoted.select("q_id", "pos", F.lit(0).alias("rank")).limit(0)
    face = lambda p: F.struct("id", "cin", "name_normalized").alias(p)
    meant = held.select(F.col("id").alias("true_id"), face("a"))
    other = held.select("pos", F.col("id").alias("entity_id"), F.col("source").alias("entity_source"), face("b"))
    judged = chosen.join(quoted.select("q_id", F.col("id").alias("true_id"), "split", "cluster_key", "variant_id", "query_text", F.col("name_normalized").alias("q_normalized")), "q_id").join(meant, "true_id").join(other, "pos")
    judged = judged.withColumn("same", pairs.same_institution("a", "b"))
    kept = pairs.first_negatives(cut(judged.drop("a", "b")), "q_id")
    order = F.struct(F.lit(1) - F.col("label"), F.col("variant_id"), F.col("q_id"))
    first = kept.groupBy("split", "q_normalized", "entity_id").agg(F.min_by(F.struct("cluster_key", "variant_id", "query_text", "entity_source", "label"), order).alias("p"))
    return first.select("split", "q_normalized", "entity_id", "p.*")


def featured(labelled: DataFrame, entities: DataFrame) -> DataFrame:
    """``labelled`` plus all features; word weights of the whole corpus."""
    keyed = labelled.withColumn("q_core", name_core(F.col("q_normalized"))).withColumn("pair_key", F.concat_ws("|", "split", "q_normalized", "entity_id"))
    return with_features(keyed, "pair_key", entities).drop("pair_key")
