"""Filling fixed-capacity containers: best fit is planned over the histogram of lengths, rows then take their slots."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.runtime import broadcast_if_small, cut

RANK_ROWS = 500_000


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(runs, number of containers) of best-fit decreasing.

    A run (length, first rank, first container, q) says that from that rank on the items of the length go to
    consecutive containers, q to each, until the next run of the length. Containers in the same state are handled as
    one range, so the work follows the number of distinct lengths (at most ``capacity``), not of items.
    """
    runs: list[tuple[int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first container, how many)
    rooms: list[int] = []
    total = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first = capacity, total
                n = -(-left // (capacity // length))
                total += n
            q = room // length
            full = min(n, left // q)
            if full:
                runs.append((length, rank, first, q))
                put(room - q * length, first, full)
                rank, left = rank + full * q, left - full * q
            if full < n:
                if left:
                    runs.append((length, rank, first + full, left))
                    put(room - left * length, first + full, 1)
                    put(room, first + full + 1, n - full - 1)
                    left = 0
                else:
                    put(room, first + full, n - full)
    return runs, total


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, size, container_id): every item in one container, parts of longer items in one each.

    An item above ``capacity`` is cut into full containers and a remainder. Items of size 0 or null take no room and
    have container_id null. Ties and repeated keys are kept, each row has its own slot. Only the histogram (at most
    ``capacity`` rows) reaches the driver; ranks within a hot length are taken in sub-buckets with known offsets.
    """
    parts = F.greatest(F.ceil(F.col(size) / F.lit(capacity)), F.lit(1))
    cutup = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)).cast("int") - 1)).alias("part"))
    sized = cut(cutup.select(key, "part", F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).alias("length")))
    histogram = {r.length: r.n for r in sized.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    subs = int(max(8, max(histogram.values(), default=0) // RANK_ROWS))
    runs, _ = plan(histogram, capacity)
    runs.sort()
    starts = np.array([(r[0] << 40) + r[1] for r in runs], dtype="int64")
    ranks, firsts, qs = (np.array([r[i] for r in runs], dtype="int64") for i in (1, 2, 3))

    @F.pandas_udf(T.LongType())
    def slot(length: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, (length.to_numpy() << 40) + rank.to_numpy(), side="right") - 1
        return pd.Series(firsts[at] + (rank.to_numpy() - ranks[at]) // qs[at])

    held = sized.where("length > 0").withColumn("sub", F.pmod(F.xxhash64(key, "part"), F.lit(subs)).cast("int"))
    sub_counts = held.groupBy("length", "sub").agg(F.count("*").alias("n"))
    offsets = sub_counts.select("length", "sub", (F.sum("n").over(Window.partitionBy("length").orderBy("sub")) - F.col("n")).alias("offset"))
    ranked = held.withColumn("within", F.row_number().over(Window.partitionBy("length", "sub").orderBy(key, "part")) - 1)
    placed = ranked.join(broadcast_if_small(offsets, len(histogram) * subs, 40), ["length", "sub"]).select(
        key, "part", F.col("length").alias(size), slot("length", (F.col("offset") + F.col("within")).cast("long")).alias("container_id")
    )
    empty = sized.where("length <= 0").select(key, "part", F.col("length").alias(size), F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty)
