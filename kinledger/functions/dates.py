"""Lenient dates and amounts of sheets and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinledger.functions.text import clean

MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def parse_flexible_date(c: Column) -> Column:
    """ISO text of a date in one of the sheet's shapes, else null; days run to 31 in every month, years 1900 to 2200."""
    t = clean(c)
    g = lambda p, i: F.regexp_extract(t, p, i)
    iso, day, mon = "^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T].*)?$", "^([0-9]{1,2})[-/ ]([A-Za-z]{3,}|[0-9]{1,2})[-/ ]([0-9]{4})$", "^([A-Za-z]{3,})\\s+([0-9]{1,2}),?\\s+([0-9]{4})$"
    serial = "^[0-9]{5}$"
    named = lambda m: F.when(m.rlike("^[0-9]+$"), m.try_cast("int")).otherwise(((F.nullif(F.instr(F.lit(MONTHS), F.lower(F.substring(m, 1, 3))), F.lit(0)) + 2) / 3).cast("int"))
    parts = (
        F.when(t.rlike(iso), F.struct(g(iso, 1).try_cast("int").alias("y"), g(iso, 2).try_cast("int").alias("m"), g(iso, 3).try_cast("int").alias("d")))
        .when(t.rlike(day), F.struct(g(day, 3).try_cast("int").alias("y"), named(g(day, 2)).alias("m"), g(day, 1).try_cast("int").alias("d")))
        .when(t.rlike(mon), F.struct(g(mon, 3).try_cast("int").alias("y"), named(g(mon, 1)).alias("m"), g(mon, 2).try_cast("int").alias("d")))
    )
    ok = parts["y"].between(1900, 2200) & parts["m"].between(1, 12) & parts["d"].between(1, 31)
    text = F.concat_ws("-", parts["y"].cast("string"), F.lpad(parts["m"].cast("string"), 2, "0"), F.lpad(parts["d"].cast("string"), 2, "0"))
    from_serial = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), t.try_cast("int")), "yyyy-MM-dd")
    return F.when(t.rlike(serial), from_serial).when(ok, text)


def parse_amount(c: Column, cap: float = 1e9) -> Column:
    """Number of rupees in a text with signs, grouping and lakh, crore or k; null if unreadable, negative or above cap."""
    x = F.lower(F.regexp_replace(clean(c), "₹|\\$|,|%|(?i)\\brs\\.?|(?i)\\binr\\b", ""))
    pattern = "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(lakhs?|lacs?|crores?|cr|k)?\\s*$"
    unit = F.regexp_extract(x, pattern, 2)
    times = F.when(unit.rlike("^la"), 1e5).when(unit.rlike("^cr"), 1e7).when(unit == "k", 1e3).otherwise(1.0)
    value = F.regexp_extract(x, pattern, 1).try_cast("double") * times
    return F.when(value <= cap, value)
