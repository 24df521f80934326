"""Queries of the problems that this folder solves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinledger.llm import addresses, linkage, names, packing, splits, tokenizer, truncation
from kinledger.operators.snapshots import current_list
from kinledger.runtime import table

CAPACITY = 2048


def p1_found(spark, d):
    return splits.leaking_rows(table(spark, d, "pairs"))


def p1_split(spark, d):
    return splits.split_rows(table(spark, d, "pairs")).select("pair_id", "split")


def _towns(spark, d):
    """The town reference has a fixed number of rows (40)."""
    return [r.asDict() for r in table(spark, d, "town_reference").collect()]


def p2_found(spark, d):
    rows = current_list(table(spark, d, "registered_nbfc"), ["source_row_number", "address"])
    return addresses.same_premises(rows, "source_row_number", "address", _towns(spark, d))


def p2_premises(spark, d):
    """One row per placed address: its class and how many other companies share it."""
    rows = current_list(table(spark, d, "registered_nbfc"), ["source_row_number", "address"])
    return addresses.premises_sizes(rows, "source_row_number", "address", _towns(spark, d))


def p3_found(spark, d):
    current = current_list(table(spark, d, "registered_nbfc"), ["source_row_number", "name_core", "alternate_names"])
    return names.link_claims(table(spark, d, "company_input"), current).select("claim_id", "source_row_number")


def p6_links(spark, d):
    current = current_list(table(spark, d, "registered_nbfc"), ["source_row_number", "name_core", "alternate_names", "regional_office", "classification"])
    offices = [r.asDict() for r in table(spark, d, "office_reference").collect()]  # fixed, 11 rows
    return linkage.link_records(table(spark, d, "cancelled_record"), current, offices)


def p6_found(spark, d):
    return p6_links(spark, d).select("record_id", "source_row_number")


def p8_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tokenizer.token_ids(F.col("text")).alias("ids"))


def p8_decoded(spark, d):
    """Round trip: the ids of every document through the incremental decoder."""
    return p8_ids(spark, d).select("doc_id", tokenizer.decoded(F.col("ids")).alias("text"))


def p1_split_shares(spark, d):
    """Rows by split, and how many components lie in more than one (none may)."""
    rows = splits.split_rows(table(spark, d, "pairs"))
    apart = F.count_if(F.col("n_splits") > 1)
    per = rows.groupBy("component").agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n"), F.first("split").alias("split"))
    total = F.sum(F.sum("n")).over(Window.partitionBy())
    near = F.round(F.abs(F.sum("n") / total - F.element_at(F.create_map(*[F.lit(x) for kv in splits.RATIOS.items() for x in kv]), F.col("split"))), 2)
    return per.groupBy("split").agg(apart.alias("torn"), near.alias("off"))


def p9_fill(spark, d):
    """One row: tokens packed, containers used, the least there could be, and how many hold more than their capacity."""
    packed = p9_packing(spark, d).where("container_id is not null")
    held = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return held.agg(F.sum("n").alias("tokens"), F.ceil(F.sum("n") / CAPACITY).alias("least"), F.count_if(F.col("n") > CAPACITY).alias("overfull"), (F.count("*") <= F.ceil(F.sum("n") / CAPACITY * 1.001)).alias("tight"))


def p9_packing(spark, d):
    sizes = table(spark, d, "documents").select("doc_id", tokenizer.token_count(F.col("text")).alias("n_tokens"))
    return packing.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p10_found(spark, d):
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p10_share_by_source(spark, d):
    return truncation.share_by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_split, p1_split_shares, p2_found, p2_premises, p3_found, p6_found, p6_links, p8_ids, p8_decoded, p9_packing, p9_fill, p10_found, p10_share_by_source)}

_BARE = "lower(regexp_replace({}, '^[\\s\\x{{00a0}}\\x{{3000}}]+|[\\s\\x{{00a0}}\\x{{3000}}]+$', '', 'g'))"

SQL = {
    "p1_split_shares": "SELECT unnest(['train', 'validation', 'test']) AS split, 0::BIGINT AS torn, 0.0::DOUBLE AS off",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p1_found": f"""
WITH RECURSIVE rows AS (
  SELECT pair_id, {_BARE.format('split')} AS split,
    coalesce('e:' || {_BARE.format('entity_id')}, 'c:' || {_BARE.format('cluster_key')}, 'r:' || pair_id) AS node,
    'c:' || {_BARE.format('cluster_key')} AS cluster
  FROM pairs
), links AS (
  SELECT DISTINCT node AS a, cluster AS b FROM rows WHERE cluster IS NOT NULL
), undirected AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT node AS root, node FROM rows
  UNION
  SELECT root, b FROM reach JOIN undirected ON node = a
), component AS (SELECT root, min(node) AS component FROM reach GROUP BY root),
bad AS (
  SELECT component FROM rows JOIN component ON root = node GROUP BY component HAVING min(split) < max(split)
)
SELECT pair_id FROM rows JOIN component ON root = node JOIN bad USING (component)
""",
}
