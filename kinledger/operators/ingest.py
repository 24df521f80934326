"""Idempotent ingest: headers, banners, fill-forward, upsert, pruning, reports and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinledger.functions.dates import parse_flexible_date
from kinledger.functions.text import clean, clean_or_null, is_valid_cin, name_core, normalize_cin, normalize_name_folded, parse_company_name, parse_integer, parse_yes_no
from kinledger.functions.urls import email_domain, parse_emails

NOTES_CAP = 200


def nonblank(cells: Column) -> Column:
    return F.filter(F.transform(cells, clean), lambda c: c != "")


def is_blank_row(cells: Column) -> Column:
    return F.size(nonblank(cells)) == 0


def is_banner_row(cells: Column) -> Column:
    """First cell filled and all filled cells alike (merged ranges repeat their text)."""
    return (clean(F.get(cells, F.lit(0))) != "") & (F.size(F.array_distinct(nonblank(cells))) == 1)


def as_of_text(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, "(?i)as on\\s+([^)]+)", 1), F.lit(""))


def assert_headers(df: DataFrame, cells: str, expected: list[str]) -> DataFrame:
    """``df`` unchanged, but its evaluation fails where a header cell doesn't begin as expected (any letter case)."""
    ok = F.lit(True)
    for i, want in enumerate(expected):
        ok = ok & F.lower(clean(F.get(cells, F.lit(i)))).startswith(want.lower())
    return df.where(F.assert_true(ok, F.concat(F.lit("unexpected header: "), F.array_join(cells, " | "))).isNull())


def section_of(banner: Column) -> Column:
    """Section named by a banner; order matters, 'removed' also contains no 'added'."""
    x = F.lower(clean(banner))
    return F.when(F.contains(x, F.lit("removed")), "removed_from_list").when(F.contains(x, F.lit("added")), "added_to_list")


def fill_forward(df: DataFrame, partition: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` plus the last non-null ``value`` at or before each row of its sheet (a sheet is one ordered partition)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def stacked_rows(df: DataFrame, partition: list[str], order: list[str], banner: Column, header: Column, section: str) -> DataFrame:
    """Data rows of a sheet of several tables, each with its ``section``: banners, repeated headers and rows before any section left out."""
    filled = fill_forward(df.select("*", banner.alias("_banner"), F.coalesce(header, F.lit(False)).alias("_header")), partition, order, F.col("_banner"), section)
    return filled.where(F.col("_banner").isNull() & ~F.col("_header") & F.col(section).isNotNull()).drop("_banner", "_header")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; several new rows of a key: the latest counts.

    Equals a MERGE rewrite: new UNION ALL (old ANTI JOIN new). Null keys never match and are kept.
    """
    rest = [c for c in old.columns if c not in keys]
    latest = new.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.to_json(F.struct(*rest)))).alias("_r"))
    latest = latest.select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in old.columns])
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest)


def prune_stale(df: DataFrame, file: str, sheet: str, loaded: DataFrame, imported: str) -> DataFrame:
    """Rows of re-loaded sheets whose last import predates the run (or is unknown) are left out.

    ``loaded`` has file, sheet and run_at, one row per sheet of the run; whether it is broadcast is left to its size.
    """
    runs = loaded.select(F.col("file").alias("_f"), F.col("sheet").alias("_s"), "run_at")
    joined = df.join(runs, (F.col(file) == F.col("_f")) & (F.col(sheet) == F.col("_s")), "left")
    return joined.where(F.col("run_at").isNull() | (F.col(imported) >= F.col("run_at"))).select(*df.columns)


def legacy_rows(df: DataFrame, file: str) -> DataFrame:
    return df.where(F.col(file).isNull())


def run_report(runs: DataFrame) -> DataFrame:
    """Counters per sheet with a grand total (sheet null)."""
    cols = ["rows_read", "rows_imported", "rows_skipped", "rows_missing_cin", "rows_invalid_cin", "rows_missing_email"]
    return runs.rollup("source_sheet").agg(F.count("*").alias("runs"), *[F.sum(F.col(c).cast("long")).alias(c) for c in cols])


def ledger_row(notes: DataFrame) -> DataFrame:
    """Notes (run_id, at, note) as one capped list per run, in order of ``at``."""
    w = Window.partitionBy("run_id").orderBy("at", "note")
    kept = notes.withColumn("i", F.row_number().over(w)).where(F.col("i") <= NOTES_CAP)
    return kept.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "note"))), lambda s: s["note"]).alias("notes"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_null, n_distinct) of each column, in one pass and an unpivot."""
    sums = [F.count("*").alias("n_rows")]
    for c in columns:
        sums += [F.count_if(F.col(c).isNull()).alias(f"null_{c}"), F.count_distinct(F.col(c)).alias(f"distinct_{c}")]
    row = df.agg(*sums)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), "n_rows", F.col(f"null_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct")) for c in columns]))
    return row.select(each.alias("p")).select("p.*")


def merge_by_core(df: DataFrame, core: str, name: str, category: str, ranks: dict[str, int], address: str, order: str | None = None) -> DataFrame:
    """One row per core name: longest spelling, all spellings and categories, the most specific category, an address.

    The address is the first one given in the order of ``order``, without it the least.
    """
    rank = F.coalesce(*[F.when(F.col(category) == k, v) for k, v in ranks.items()], F.lit(len(ranks)))
    return df.where(F.col(core).isNotNull()).groupBy(F.col(core).alias("core")).agg(
        F.max_by(name, F.struct(F.length(name), F.col(name))).alias("name"),
        F.array_sort(F.collect_set(name)).alias("names"),
        F.array_sort(F.collect_set(category)).alias("categories"),
        F.min_by(category, F.struct(rank, F.col(category))).alias("category"),
        F.min_by(address, F.when(F.col(address).isNotNull(), F.struct(order, address))).alias("address") if order else F.min(address).alias("address"),
    )


def sheet_header(rows: DataFrame, sheet: list[str], row_number: str, cells: str) -> DataFrame:
    """(sheet, title, as_of, headers): row 1 has the title with its date, row 2 the headers."""
    top = rows.where(F.col(row_number).isin(1, 2)).groupBy(*sheet)
    one = top.agg(F.max(F.when(F.col(row_number) == 1, clean(F.get(cells, F.lit(0))))).alias("title"), F.max(F.when(F.col(row_number) == 2, F.transform(cells, clean))).alias("headers"))
    return one.select(*sheet, "title", parse_flexible_date(as_of_text(F.col("title"))).alias("as_of"), "headers")


def data_rows(rows: DataFrame, row_number: str, cells: str) -> DataFrame:
    """Rows below the headers without blank and banner rows."""
    return rows.where((F.col(row_number) >= 3) & ~is_blank_row(F.col(cells)) & ~is_banner_row(F.col(cells)))


def inherit_as_of(headers: DataFrame, workbook: list[str]) -> DataFrame:
    """``headers`` with the earliest dated sheet's date in sheets of the workbook that have none."""
    own = headers.groupBy(*workbook).agg(F.min("as_of").alias("_as_of"))
    return headers.join(own, workbook, "left").withColumn("as_of", F.coalesce("as_of", "_as_of")).drop("_as_of")


def _names(cell: Column) -> dict[str, Column]:
    parsed = parse_company_name(cell)
    normalized = normalize_name_folded(parsed["display_name"])
    return {"name": clean(cell), "display_name": parsed["display_name"], "alternate_names": parsed["alternate_names"], "name_normalized": normalized, "name_core": name_core(normalized)}


def typed_rows(df: DataFrame, dataset: str, cells: str, keep: list[str]) -> DataFrame:
    """Rows of one layout as typed columns, ``keep`` in front; rows without a name are left out (they are counted as skipped).

    ``dataset`` is registered_nbfc, registered_arc, cancelled_company or cancelled_record.
    """
    at = lambda i: F.get(cells, F.lit(i))
    text = lambda i: clean_or_null(at(i))
    numbered = lambda i: {"cin": text(i), "cin_normalized": normalize_cin(at(i)), "cin_is_valid": is_valid_cin(normalize_cin(at(i)))}
    mails = lambda i: {"email": text(i), "emails": parse_emails(at(i)), "email_domains": F.array_distinct(F.transform(parse_emails(at(i)), email_domain))}
    if dataset == "registered_nbfc":
        made = {"sl_no": parse_integer(at(0)), **_names(at(1)), "regional_office": text(2), "public_deposits": text(3), "accepts_public_deposits": parse_yes_no(at(3)), "classification": text(4)}
        made |= {"classification_code": F.nullif(clean(F.regexp_replace(at(4), "\\*", "")), F.lit("")), "has_factoring_cor": F.coalesce(F.contains(at(4), F.lit("*")), F.lit(False)), **numbered(5), "layer": text(6), "address": text(7), **mails(8)}
        named = at(1)
    elif dataset == "registered_arc":
        made = {"sl_no": parse_integer(at(0)), **_names(at(1)), "regional_office": text(2), **numbered(3), "address": text(4), **mails(5)}
        named = at(1)
    elif dataset == "cancelled_company":
        plain = normalize_name_folded(at(1))
        made = {"sl_no": parse_integer(at(0)), "name": clean(at(1)), "name_normalized": plain, "name_core": name_core(plain), "regional_office": text(2), "address": text(3)}
        named = at(1)
    else:
        plain = normalize_name_folded(at(2))
        made = {"sr_no": parse_integer(at(0)), "nbfc_code": text(1), "company_name": clean(at(2)), "company_name_normalized": plain, "company_name_core": name_core(plain), "regional_office": text(3), "category": text(4), "classification": text(5), "cor_number": text(6)}
        made |= {"cor_issuance_date": parse_flexible_date(at(7)), "cor_issuance_date_raw": text(7), "cor_cancellation_date": parse_flexible_date(at(8)), "cor_cancellation_date_raw": text(8), "reason": text(9)}
        named = at(2)
    return df.where(clean(named) != "").select(*keep, *[v.alias(k) for k, v in made.items()])


def repeated_row_numbers(df: DataFrame, sheet: list[str], row_number: str) -> DataFrame:
    """(sheet, row_number, n) of row numbers that occur more than once in a sheet: the later value wins."""
    return df.groupBy(*sheet, row_number).agg(F.count("*").alias("n")).where("n > 1")


def unpivot_cells(df: DataFrame, row_number: str, cells: str, groups: list[str]) -> DataFrame:
    """(row_number, source_column, field_group, value) of every filled cell of a sheet with one field per column."""
    each = df.select(row_number, F.posexplode(cells).alias("i", "cell")).where(clean("cell") != "")
    group = F.coalesce(F.get(F.array(*[F.lit(g) for g in groups]), F.col("i")), F.concat(F.lit("column_"), (F.col("i") + 1).cast("string")))
    return each.select(row_number, (F.col("i") + 1).alias("source_column"), group.alias("field_group"), clean("cell").alias("value"))


def listed_values(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """(column_name, value, n) of the columns that have at most ``most`` different values, nulls left out."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c")).select("c.*")
    counts = each.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("column_name").agg(F.count("*").alias("values")).where(F.col("values") <= most)
    return counts.join(few.select("column_name"), "column_name", "left_semi")


def refuse_small(df: DataFrame, least: int, sites: str, least_sites: int) -> DataFrame:
    """``df`` itself, if it has at least ``least`` rows and ``least_sites`` rows with a site; else the write is refused."""
    seen = df.agg(F.count("*").alias("n"), F.count_if(F.size(sites) > 0).alias("s")).first()
    if seen.n < least or seen.s < least_sites:
        raise ValueError(f"{seen.n} rows, {seen.s} of them with a site: fewer than {least} and {least_sites}, nothing is written")
    return df
