"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinledger.runtime import broadcast_if_small, cut

HOT_ROWS = 100_000
KEY_BYTES = 512


def fans(counts: DataFrame, key: str, n: str = "n", limit: int = HOT_ROWS) -> DataFrame | None:
    """(key, fan) of the keys with more than ``limit`` rows, None if there is none.

    The list has its own count: it is broadcast only while that keeps below the limit, else joined by shuffle.
    """
    hot, seen = cut(counts.where(F.col(n) > limit).select(F.col(key).alias("_k"), F.ceil(F.col(n) / limit).cast("int").alias("_fan")), rows=F.count(F.lit(1)))
    return broadcast_if_small(hot, seen.rows, KEY_BYTES) if seen.rows else None


def salt(df: DataFrame, hot: DataFrame | None, key: str, by: Column, out: str = "_salt") -> DataFrame:
    """``df`` plus ``out``: 0, or for a hot key one of its ``fan`` salts, chosen by the hash of ``by``."""
    if hot is None:
        return df.withColumn(out, F.lit(0))
    salted = df.join(hot, F.col(key) == F.col("_k"), "left")
    return salted.withColumn(out, F.coalesce(F.pmod(F.xxhash64(by), F.col("_fan")), F.lit(0)).cast("int")).drop("_k", "_fan")


def spread(unique: DataFrame, hot: DataFrame | None, key: str, out: str = "_salt") -> DataFrame:
    """The side with unique keys, its hot rows repeated once per salt (sum of fans: total/limit rows at most)."""
    if hot is None:
        return unique.withColumn(out, F.lit(0))
    every = unique.join(hot, F.col(key) == F.col("_k"), "left")
    return every.withColumn(out, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1))).drop("_k", "_fan")


def skew_join(big: DataFrame, unique: DataFrame, key: str, by: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``big`` joined to ``unique`` on ``key``, hot keys over several tasks."""
    if hot is None:
        return big.join(unique, key, how)
    return salt(big, hot, key, by).join(spread(unique, hot, key), [key, "_salt"], how).drop("_salt")


def workers(df: DataFrame, rows: int, by: str, per_task: int = 50_000) -> DataFrame:
    """``df`` over enough tasks for a stage of Python: two a core, more where ``rows`` asks for them.

    The number is given, so that adaptive execution does not fold a few megabytes of costly rows into one task.
    """
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    return df.repartition(n, by)
