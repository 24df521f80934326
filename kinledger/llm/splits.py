"""Splits that keep related records together.

Keys (entities, clusters) are the nodes and every row is an edge, so the graph has one edge per distinct key pair.
Components come from a frontier breadth-first search: adjacency is hash-partitioned, every node that comes before all
its neighbours (more neighbours first, by powers of two, then by hash) is a seed, all seeds expand at once, and where
two seeds meet an edge of the (much smaller) seed graph arises, which is treated the same way. A round at least halves
the nodes that have neighbours, hubs swallow their leaves at once, and chains of random hashes have seeds within
O(log n) hops, so rounds and levels stay few on any graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinledger.functions.text import SPACE_CLASS
from kinledger.llm.skew import fans, salt, skew_join, spread
from kinledger.runtime import cut

RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
BIG_SHARE = 0.005
BUCKETS = 4096


def _prepare(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(edges a, b, _salt of a, rank of a; hot nodes; number of edges): all distinct edges in both directions."""
    apart = pairs.where("a <> b")
    edges, seen = cut(apart.select("a", "b").union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows=F.count(F.lit(1)))
    if not seen.rows:
        return edges, None, 0
    degree = edges.groupBy("a").agg(F.count("*").alias("n"))
    hot = fans(degree, "a")
    ranks = degree.select("a", F.struct((-F.floor(F.log2("n"))).alias("d"), F.xxhash64("a").alias("h"), F.col("a").alias("k")).alias("rank"))
    return cut(salt(skew_join(edges, ranks, "a", F.col("b"), hot), hot, "a", F.col("b"))), hot, seen.rows


def _search(g: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(node, seed) of all nodes of ``g``, each with a seed of its component that reaches it first.

    Every level writes only the nodes it reaches for the first time; these are the next frontier. Every node is reached,
    since the first of a component's nodes is a seed.
    """
    # every edge also stands the other way round, so the ranks of a node's neighbours meet at b
    lowest = g.groupBy("b").agg(F.min("rank").alias("low")).withColumnRenamed("b", "a")
    seeds = g.select("a", "rank").distinct().join(lowest, "a").where(F.col("rank") < F.col("low"))
    labels = frontier = cut(seeds.select(F.col("a").alias("node"), F.col("a").alias("seed")))
    while True:
        reach = g.select("a", "b", "_salt").join(spread(frontier.withColumnRenamed("node", "a"), hot, "a"), ["a", "_salt"])
        best = reach.groupBy(F.col("b").alias("node")).agg(F.min_by("seed", F.struct(F.xxhash64("seed"), F.col("seed"))).alias("seed"))
        frontier, seen = cut(best.join(labels.select("node"), "node", "left_anti"), n=F.count(F.lit(1)))
        if not seen.n:
            return labels
        labels = labels.unionByName(frontier)


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node in ``pairs`` (a, b); a node paired with itself or with null stands alone.

    An empty table gives no rows.
    """
    result = pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("component", F.col("node"))
    g, hot, n_edges = _prepare(pairs.where("a is not null and b is not null"))
    while n_edges:
        labels = _search(g, hot)
        result = cut(result.join(labels.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("seed", "component").alias("component")))
        ends = g.where("a < b").select("a", "b", "_salt").join(spread(labels.withColumnRenamed("node", "a"), hot, "a"), ["a", "_salt"])
        ends = ends.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("seed").alias("sa"))
        met = skew_join(ends, labels, "node", F.col("other"), hot)
        g, hot, n_edges = _prepare(met.select(F.col("sa").alias("a"), F.col("seed").alias("b")))
    return result


def _bare(c: Column) -> Column:
    """Without outer blanks and letter case."""
    return F.lower(F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""))


def _key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), _bare(c))


def related_rows(pairs: DataFrame, key: str, entity: str, cluster: str) -> tuple[DataFrame, DataFrame]:
    """(rows: key, node; components: node, component, n = rows at the node).

    A row hangs on its entity, without one on its cluster, without either on itself.
    """
    keyed = pairs.select("*", _key("e:", F.col(entity)).alias("_e"), _key("c:", F.col(cluster)).alias("_c"))
    keyed = keyed.withColumn("node", F.coalesce("_e", "_c", F.concat(F.lit("r:"), F.col(key).cast("string"))))
    edges = keyed.groupBy(F.col("node").alias("a"), F.coalesce("_c", "node").alias("b")).agg(F.count("*").alias("n"))
    edges = cut(edges)
    components = connected_components(edges).join(edges.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "node")
    return keyed, cut(components)


def assign_splits(sizes: DataFrame, ratios: dict[str, float], seed: int = 0) -> DataFrame:
    """(component, split) from (component, n), row shares as near to ``ratios`` as the components allow.

    Components above BIG_SHARE of the rows (by arithmetic at most 1/BIG_SHARE of them) take the emptiest split, largest
    first. All others follow in hash order and fill what is left; only per-bucket sums (BUCKETS rows) reach the driver.
    """
    sizes = sizes.withColumn("h", F.xxhash64(F.lit(seed), "component")).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)).cast("int"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    big = sizes.where(F.col("n") > total * BIG_SHARE)
    open_ = {s: r * total for s, r in ratios.items()}
    placed = {}
    for row in sorted(big.select("component", "n").collect(), key=lambda r: (-r.n, r.component)):
        s = max(open_, key=lambda k: open_[k])
        placed[row.component] = s
        open_[s] -= row.n
    small = sizes.where(F.col("n") <= total * BIG_SHARE)
    sums = {r.bucket: r.n for r in small.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    # Where each bucket starts on the line of all small rows, and where the splits end on it.
    starts, at = [], 0
    for b in range(BUCKETS):
        starts.append(at)
        at += sums.get(b, 0)
    room = {s: max(v, 0) for s, v in open_.items()}
    scale = at / sum(room.values()) if sum(room.values()) else 0
    ends, edge = [], 0.0
    for s in ratios:
        edge += room[s] * scale
        ends.append((s, edge))
    spark = sizes.sparkSession
    offsets = F.broadcast(spark.createDataFrame(list(enumerate(starts)), "bucket int, start long"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("h", "component")) - F.col("n")
    middle = F.col("start") + before + F.col("n") / 2
    choice = F.lit(ends[-1][0])
    for s, e in reversed(ends[:-1]):
        choice = F.when(middle < e, s).otherwise(choice)
    spread_out = small.join(offsets, "bucket").select("component", choice.alias("split"))
    fixed = spark.createDataFrame(list(placed.items()), "component string, split string")
    return spread_out.unionByName(fixed)


def split_rows(pairs: DataFrame, key: str = "pair_id", entity: str = "entity_id", cluster: str = "cluster_key", ratios: dict[str, float] | None = None) -> DataFrame:
    """(key, component, split): related rows share a split. Repeated rows stay repeated; an empty table stays empty."""
    rows, components = related_rows(pairs.select(key, entity, cluster), key, entity, cluster)
    splits = assign_splits(components.groupBy("component").agg(F.sum("n").alias("n")), ratios or RATIOS)
    # splits may be many and components may be hot: both sides are one row per node or component
    hot_components = fans(components.groupBy("component").agg(F.count("*").alias("n")), "component")
    by_node = skew_join(components, splits, "component", F.col("node"), hot_components)
    hot = fans(components, "node")
    return skew_join(rows.select(key, "node"), by_node.select("node", "component", "split"), "node", F.col(key), hot).select(key, "component", "split")


def leaking_rows(pairs: DataFrame, key: str = "pair_id", entity: str = "entity_id", cluster: str = "cluster_key", split: str = "split") -> DataFrame:
    """Keys of the rows whose component carries more than one recorded split (letter case and outer blanks ignored)."""
    rows, components = related_rows(pairs.select(key, entity, cluster, split), key, entity, cluster)
    at_node = rows.groupBy("node").agg(F.min(_bare(F.col(split))).alias("lo"), F.max(_bare(F.col(split))).alias("hi"))
    verdict = components.join(at_node, "node").groupBy("component").agg((F.min("lo") < F.max("hi")).alias("leaks")).where("leaks")
    hot_components = fans(components.groupBy("component").agg(F.count("*").alias("n")), "component")
    leaking = skew_join(components, verdict, "component", F.col("node"), hot_components).select("node")
    hot = fans(components, "node")
    return skew_join(rows.select(key, "node"), leaking, "node", F.col(key), hot).select(key)
