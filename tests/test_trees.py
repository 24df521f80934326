import random

from pyspark.sql import functions as F

from kinledger.functions.similarity import jaro
from kinledger.operators import features, model


def test_trees_grow_in_a_few_jobs_over_all_rows(spark):
    rng = random.Random(7)
    rows = [(i, rng.random(), rng.choice([0.0, 1.0]), 7.0) for i in range(1500)]
    df = spark.createDataFrame([(*r, float((r[1] > 0.6) != (r[2] > 0.5))) for r in rows], "k int, a double, b double, c double, label double").repartition(3).cache()
    df.count()
    spark.sparkContext.setJobGroup("trees", "")
    fitted = model.fit_models(df, ["a", "b", "c"], "label", trees=8, rounds=60)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # MLlib's boosting runs jobs for every level of every round
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("trees")) < 60
    forest, boosted = fitted["forest"], fitted["boosted"]
    assert len(forest.trees) == 8 and len(boosted.trees) == 60
    for m, p in ((forest, model.forest_score(forest.plain())), (boosted, model.boosted_score(boosted.plain()[:20], boosted.base, boosted.rate))):
        scored = model.score_with(m, df).select("k", "p", "label")
        assert scored.where((F.col("p") > 0.5) != (F.col("label") > 0.5)).count() < 40
        if m is forest:
            assert model.max_difference(scored, df.select("k", p.alias("p")), "k", "p").first()[0] < 1e-9
    few = type(boosted)(boosted.features, boosted.edges, boosted.trees[:20], boosted.base, boosted.rate)
    assert model.max_difference(model.score_with(few, df).select("k", "p"), df.select("k", p.alias("p")), "k", "p").first()[0] < 1e-9


def test_equal_rows_count_as_often_as_they_stand(spark):
    rows = [(0.0, 0.0)] * 30 + [(0.0, 1.0)] * 10 + [(1.0, 1.0)] * 45 + [(1.0, 0.0)] * 5
    df = spark.createDataFrame(rows, "a double, label double").repartition(4)
    boosted = model.grow(df, ["a"], "label", 1, {"trees": 1, "depth": 2, "least": 1}, {"rounds": 300, "depth": 3, "rate": 0.1})["boosted"]
    p = {r.a: r.p for r in model.score_with(boosted, df).select("a", "p").distinct().collect()}
    assert abs(p[0.0] - 0.25) < 1e-6 and abs(p[1.0] - 0.9) < 1e-6


def test_jaro_of_plain_text_is_that_of_any_text():
    def slow(a, b):  # the same letters outside ASCII take the other way
        return jaro("".join(chr(ord(c) + 1000) for c in a), "".join(chr(ord(c) + 1000) for c in b))

    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("AB C1") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert jaro(a, b) == slow(a, b)


def test_features_of_odd_pairs():
    row = dict(zip(features.FEATURES, features.pair_row("", "A", "", "A", None, None, 2.0, 1, 0.0, True), strict=True))
    assert row["edit_similarity"] == 0 and row["token_jaccard"] == row["idf_weighted_overlap"] == row["prefix_ratio"] == 0 and row["unmatched_rare_entity_token"] == 1
    row = dict(zip(features.FEATURES, features.pair_row("AB AB 7", "AB 7", "AB AB 7", "AB 7", [1.0, None], [1.0, None], 4.0, 2, 0.0, True), strict=True))
    assert row["token_jaccard"] == 1 and row["idf_weighted_overlap"] == 1 and row["shared_rare_token"] == 1 and row["digit_token_agreement"] == 1 and row["token_count_gap"] == 0.2
