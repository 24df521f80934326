"""Metrics of a scored, labelled table; all from aggregates over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 99
COSTS = {"primary": (10, 1), "alternate": (1, 10)}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion_sweep(scored: DataFrame, label: str, score: str, steps: int = STEPS) -> DataFrame:
    """One row per threshold 1/(steps+1) ..: counts, precision, recall, F1, accuracy and both relative costs.

    Rows are first counted per threshold bucket, so the sweep multiplies buckets (steps + 1 rows), never data.
    """
    bucket = F.least(F.greatest(F.floor(F.round(F.col(score) * (steps + 1), 9)), F.lit(0)), F.lit(steps + 1)).cast("int")
    counted = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(bucket.alias("b"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    grid = scored.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("step"))
    hit = F.col("b") >= F.col("step")
    cell = lambda y, h: F.coalesce(F.sum(F.when((F.col("y") == y) & h, F.col("n"))), F.lit(0))
    c = counted.join(F.broadcast(grid)).groupBy("step").agg(cell(1, hit).alias("tp"), cell(0, hit).alias("fp"), cell(0, ~hit).alias("tn"), cell(1, ~hit).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r, total = _ratio(tp, tp + fp), _ratio(tp, tp + fn), tp + fp + tn + fn
    return c.select(
        (F.col("step") / (steps + 1)).alias("threshold"), "tp", "fp", "tn", "fn",
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"), F.round(_ratio(tp + tn, total), 6).alias("accuracy"),
        *[F.round(_ratio(fp * a + fn * b, total), 6).alias(f"cost_{name}") for name, (a, b) in COSTS.items()],
    )


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """The row of least primary cost; ties go to the larger F1, then to the smaller threshold."""
    row = F.struct(*sweep.columns)
    return sweep.agg(F.min_by(row, F.struct("cost_primary", -F.col("f1"), "threshold")).alias("r")).select("r.*")


def _cumulated(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, and both summed from the top) per distinct score.

    The running sums go over score buckets first (a thousand rows in one ordered partition) and then inside each.
    """
    by = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    by = by.withColumn("b", F.floor(F.col("s") * 1000))
    down = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    above = by.groupBy("b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select("b", F.coalesce(F.sum("p").over(down), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("b").orderBy(F.desc("s"))
    return by.join(above, "b").select("s", "pos", "neg", (F.col("p0") + F.sum("pos").over(inside)).alias("tp"), (F.col("n0") + F.sum("neg").over(inside)).alias("fp"))


def ranking_metrics(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row: roc_auc (ties count half) and average_precision (steps, not trapezoids); null with one class only."""
    c = _cumulated(scored, label, score)
    total_p, total_n = F.sum("pos"), F.sum("neg")
    # a negative is beaten by every positive above it and by half of those level with it
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    area = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (total_p > 0) & (total_n > 0)
    return c.agg(F.round(F.when(both, won / (total_p * total_n)), 6).alias("roc_auc"), F.round(F.when(both, area / total_p), 6).alias("average_precision"))


def recall_by(scored: DataFrame, label: str, score: str, group: str, threshold: float) -> DataFrame:
    """(group, positives, found, recall) at a threshold."""
    pos = scored.where(F.col(label) == 1)
    found = F.count_if(F.col(score) >= threshold)
    return pos.groupBy(group).agg(F.count("*").alias("positives"), found.alias("found"), F.round(found / F.count("*"), 6).alias("recall"))


def split_summary(pairs: DataFrame, split: str, group: str, label: str) -> DataFrame:
    return pairs.groupBy(F.lower(F.trim(split)).alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.count_distinct(F.lower(F.trim(group))).alias("groups"))


def leaking_groups(pairs: DataFrame, split: str, group: str) -> DataFrame:
    """Groups recorded in more than one split, with how many: must be empty before training."""
    return pairs.where(f"{group} is not null").groupBy(F.lower(F.trim(group)).alias("group_key")).agg(F.count_distinct(F.lower(F.trim(split))).alias("n_splits")).where("n_splits > 1")


def pair_counts(pairs: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, n, positives, share): size and share of positive labels, keys without regard to letter case and outer blanks."""
    positives = F.count_if(F.col(label) == 1)
    return pairs.groupBy(*[F.lower(F.trim(k)).alias(k) for k in keys]).agg(F.count("*").alias("n"), positives.alias("positives"), F.round(positives / F.count("*"), 6).alias("share"))


def select_model(metrics: DataFrame, cost: str, precision: str) -> DataFrame:
    """The row of least ``cost``; ties go to the larger ``precision``, then to the first name."""
    row = F.struct(*metrics.columns)
    return metrics.agg(F.min_by(row, F.struct(F.col(cost), -F.col(precision), F.col("model"))).alias("r")).select("r.*")


def shown_thresholds(sweep: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of a sweep at multiples of 0.05 and at the chosen threshold (one row)."""
    at = F.round(F.col("threshold") * 100).cast("int")
    picked = F.broadcast(chosen.select(F.round(F.col("threshold") * 100).cast("int").alias("_at")))  # one row
    return sweep.join(picked, (at % 5 == 0) | (at == F.col("_at"))).drop("_at")
