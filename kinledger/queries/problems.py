"""Queries of the general data problems: rows that fail to parse, snapshot changes, timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinledger.operators import parsing, snapshots, timestamps
from kinledger.runtime import table


def p4_found(spark, d):
    return parsing.failed_rows(table(spark, d, "sheet_rows"), table(spark, d, "import_runs")).select("table_name", "row_key")


def p4_reasons(spark, d):
    found = parsing.failed_rows(table(spark, d, "sheet_rows"), table(spark, d, "import_runs"))
    return found.groupBy("table_name", "reason").agg(F.count("*").alias("n"))


def p4_loaded(spark, d):
    return parsing.split_sheet_rows(table(spark, d, "sheet_rows"))[0].select("row_key", "dataset_key", "serial", "name", "regional_office", "deposits")


def p4_recovered(spark, d):
    """Records read behind a broken quote or a stray line break, and the errors located before them."""
    found = parsing.recovered_records(table(spark, d, "sheet_rows"))
    return found.select("row_key", "dataset_key", "record_no", "starts_at", F.get("cells", F.lit(0)).alias("serial"), F.get("cells", F.lit(1)).alias("second_cell"), "reason", "error_at")


def p5_found(spark, d):
    return snapshots.register_changes(table(spark, d, "registered_nbfc"))


def p7_found(spark, d):
    dates = timestamps.record_dates(table(spark, d, "cancelled_record"), timestamps.DAY_FIRST)
    return dates.where("micros is not null").select("record_id", "field_name", timestamps.iso_utc(F.col("micros")).alias("instant_utc"))


def p7_ambiguity(spark, d):
    """Without the day-first convention: how many dates of each order the mixture settles or leaves open."""
    dates = timestamps.record_dates(table(spark, d, "cancelled_record"), timestamps.ANY_ORDER)
    kept = dates.where("n_readings > 1")
    return kept.groupBy("field_name", "format", "unresolved").agg(F.count("*").alias("n"), F.round(F.avg("posterior"), 6).alias("mean_posterior"))


QUERIES = {f.__name__: f for f in (p4_found, p4_reasons, p4_loaded, p4_recovered, p5_found, p7_found, p7_ambiguity)}

_SPACES = "'[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x0b\\x1c-\\x1f]+'"
_ROW = ", ".join(f"trim(regexp_replace(coalesce({c}, ''), {_SPACES}, ' ', 'g'))" for c in snapshots.COMPARED)

SQL = {
    "p5_found": f"""
WITH counting AS (
  SELECT dataset_as_of, cin_normalized, md5(concat_ws(chr(1), {_ROW})) AS content
  FROM registered_nbfc
  QUALIFY row_number() OVER (PARTITION BY dataset_as_of, source_row_number ORDER BY last_imported_at DESC NULLS LAST, row_id) = 1
), rows AS (
  SELECT dataset_as_of, cin_normalized, list_sort(list(content)) AS content
  FROM counting WHERE cin_normalized IS NOT NULL AND dataset_as_of IS NOT NULL GROUP BY 1, 2
), steps AS (
  SELECT dataset_as_of AS later, lag(dataset_as_of) OVER (ORDER BY dataset_as_of) AS earlier
  FROM (SELECT DISTINCT dataset_as_of FROM registered_nbfc WHERE dataset_as_of IS NOT NULL)
), a AS (SELECT later, cin_normalized, content FROM rows JOIN steps ON dataset_as_of = earlier),
b AS (SELECT later, cin_normalized, content FROM rows JOIN steps ON dataset_as_of = later WHERE earlier IS NOT NULL)
SELECT strftime(later, '%Y-%m-%d') AS as_of, cin_normalized,
  CASE WHEN a.content IS NULL THEN 'added' WHEN b.content IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b USING (later, cin_normalized)
WHERE a.content IS DISTINCT FROM b.content
""",
}
