"""Counting rows of a re-imported register and the differences between its full deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinledger.functions.text import clean

COMPARED = ["name", "regional_office", "public_deposits", "classification", "layer", "address", "email"]


def counting_rows(df: DataFrame, keys: list[str], version: str, keep: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the latest ``version``; ties are settled by a hash of the kept values.

    An aggregate (``max_by`` with map-side combine) instead of a window, so that a key with many versions
    is never gathered in one task. Rows with a null version lose to any other; an empty table stays empty.
    """
    rest = [c for c in keep if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(version).isNotNull(), F.col(version), F.xxhash64(*rest)))
    return df.groupBy(*keys).agg(newest.alias("_kept")).select(*keys, *[F.col("_kept")[c].alias(c) for c in rest])


def digest(columns: list[str]) -> Column:
    """MD5 of the cleaned values, each with its length in front, so that no two rows run together."""
    cleaned = [clean(F.col(c).cast("string")) for c in columns]
    return F.md5(F.concat_ws("|", *[x for c in cleaned for x in (F.length(c).cast("string"), c)]))


def snapshot_changes(df: DataFrame, as_of: str, key: str, compared: list[str]) -> DataFrame:
    """Additions, removals and changes between consecutive full snapshots in one table.

    Every delivery is laid beside its successor (the list of dates is tiny and joined by broadcast); EXCEPT ALL both
    ways removes the rows that are identical, the residues are joined in full by key: left only is a removal, right
    only an addition, both a change. A key that occurs several times counts as present while one row of it remains,
    and as changed when its rows differ as a bag. Rows with a null key or date take no part. Null equals empty, and
    white space is trimmed and collapsed. What is compared, and shuffled, is a digest of the values. Result: ``as_of`` (of the later delivery), the key, ``change_kind``.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).select(F.col(as_of).alias("as_of"), F.col(key).alias("key"), digest(compared).alias("v"))
    dates = df.where(F.col(as_of).isNotNull()).select(F.col(as_of).alias("as_of")).distinct()
    # one row per delivery: a single ordered partition of dates, not of data
    order = dates.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("next"), F.lag("as_of").over(Window.orderBy("as_of")).alias("prior"))
    steps = F.broadcast(order)  # one row per delivery
    before = rows.join(steps, "as_of").where("next is not null").select(F.col("next").alias("as_of"), *rows.columns[1:])
    after = rows.join(steps, "as_of").where("prior is not null").select(*rows.columns)
    gone = before.exceptAll(after).select("as_of", "key").distinct().withColumn("in_before", F.lit(True))
    new = after.exceptAll(before).select("as_of", "key").distinct().withColumn("in_after", F.lit(True))
    residue = gone.join(new, ["as_of", "key"], "full")
    # A residue on one side only may still be a change of multiplicity: the key then lives on in the other delivery.
    one_sided = residue.where(F.col("in_before").isNull() | F.col("in_after").isNull())
    alive_before = one_sided.where("in_before is null").join(before.select("as_of", "key").distinct(), ["as_of", "key"], "left_semi").select("as_of", "key", F.lit(True).alias("lives"))
    alive_after = one_sided.where("in_after is null").join(after.select("as_of", "key").distinct(), ["as_of", "key"], "left_semi").select("as_of", "key", F.lit(True).alias("lives"))
    lives = alive_before.unionByName(alive_after)
    kind = F.when((F.col("in_before") & F.col("in_after")) | F.col("lives"), "changed").when(F.col("in_before"), "removed").otherwise("added")
    return residue.join(lives, ["as_of", "key"], "left").select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), F.col("key").alias(key), kind.alias("change_kind"))


def register_changes(register: DataFrame) -> DataFrame:
    """:func:`snapshot_changes` of the registered list, over its counting rows."""
    narrow = register.select("dataset_as_of", "source_row_number", "last_imported_at", "cin_normalized", digest(COMPARED).alias("content"))
    rows = counting_rows(narrow, ["dataset_as_of", "source_row_number"], "last_imported_at", ["cin_normalized", "content"])
    return snapshot_changes(rows, "dataset_as_of", "cin_normalized", ["content"])


def current_list(register: DataFrame, keep: list[str]) -> DataFrame:
    """Counting rows of the latest delivery."""
    latest = register.agg(F.max("dataset_as_of").alias("dataset_as_of"))
    rows = register.join(F.broadcast(latest), "dataset_as_of", "left_semi")
    return counting_rows(rows, ["source_row_number"], "last_imported_at", keep)
