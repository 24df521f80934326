"""Mixed timestamp texts to one UTC instant: every valid reading under a set of formats, and a mixture that chooses.

Each text is read under every format whose shape it has and whose fields are real (native expressions only). Per source
an expectation-maximisation over format weights runs on pre-aggregated counts of *format sets* (a handful of rows per
source, however hot the source is); the posteriors choose between readings, and what stays between them is marked.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinledger.functions.text import SPACE_CLASS
from kinledger.runtime import cut

# Month names and zone abbreviations with their offsets in minutes.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ist": 330, "est": -300, "edt": -240}
DEFAULT_ZONE = "Asia/Kolkata"

MON = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = "(?:(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday),? )?"
TIME = "(?:(?:,? |t| t ?)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?(?: ?([ap])\\.?m\\.?(?![a-z]))?)?"
BASIC_TIME = "(?:[t ]([0-9]{2})([0-9]{2})([0-9]{2})(?:[.,]([0-9]+))?)?()"
ZONE = "(?: ?(z|utc|gmt|ist|est|edt))?(?: ?(?:utc|gmt)?([+-][0-9]{2}(?::?[0-9]{2})?))?(?: ?\\[?([a-z]+(?:[/_+-][a-z0-9_+-]+)+)\\]?)?"

# name: (date pattern, positions of year, month, day among its groups, time pattern)
CALENDAR_FORMATS = {
    "ymd": ("([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", (1, 2, 3), TIME),
    "ymd_basic": ("([0-9]{4})([0-9]{2})([0-9]{2})", (1, 2, 3), BASIC_TIME),
    "dmy": ("([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{4}|[0-9]{2})", (3, 2, 1), TIME),
    "mdy": ("([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{4}|[0-9]{2})", (3, 1, 2), TIME),
    "d_mon_y": ("([0-9]{1,2})(?:st|nd|rd|th)?[-/. ]? ?" + MON + "\\.?[-/., ]? ?([0-9]{4}|[0-9]{2})", (3, 2, 1), TIME),
    "mon_d_y": (MON + "\\.? ([0-9]{1,2})(?:st|nd|rd|th)?,? ([0-9]{4}|[0-9]{2})", (3, 1, 2), TIME),
}
NUMERIC_FORMATS = {
    "spreadsheet_day": "[0-9]{5}(?:\\.[0-9]+)?",
    "unix_s": "[0-9]{10}",
    "unix_ms": "[0-9]{13}",
    "unix_us": "[0-9]{16}",
}
FORMATS = [*CALENDAR_FORMATS, *NUMERIC_FORMATS]
#: The explanation that a text denotes nothing stands beside every reading.
NOTHING = "nothing"
#: Prior odds of the explanations. Without a convention all formats are alike; the delivered data's convention is that
#: all-numeric dates are day first, so that month first is less likely than that a text denotes nothing.
ANY_ORDER = {f: 1.0 for f in FORMATS} | {NOTHING: 1e-3}
DAY_FIRST = ANY_ORDER | {"mdy": 1e-9}


def zone_names(spark: SparkSession) -> dict[str, str]:
    """Lower-case name to IANA name of every region the runtime knows (about 600)."""
    ids = spark._jvm.java.util.ArrayList(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return {z.lower(): z for z in ids}


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _zone_map(zones: dict[str, str]) -> Column:
    low, proper = F.lit(",".join(zones)), F.lit(",".join(zones.values()))
    return F.map_from_arrays(F.split(low, ","), F.split(proper, ","))


def _in_zone(wall: Column, zone: Column) -> Column:
    """UTC microseconds of wall-clock microseconds; the earlier of two instants, null where the clock never shows it.

    ``to_utc_timestamp`` takes the earlier offset at overlaps and shifts forward over gaps, which the way back reveals.
    """
    instant = F.to_utc_timestamp(F.timestamp_micros(wall), zone)
    return F.when(F.unix_micros(F.from_utc_timestamp(instant, zone)) == wall, F.unix_micros(instant))


def _fields(text: Column, name: str) -> Column:
    """All groups of a calendar format by one match, as an array of 11; a single element where it doesn't match."""
    date, _, time = CALENDAR_FORMATS[name]
    groups = "\u0001".join(f"${i}" for i in range(1, 12))
    return F.split(F.regexp_replace(text, "^" + DAY + date + time + ZONE + "$", groups), "\u0001")


def _calendar_reading(fields: Column, name: str, home: Column, named: Column) -> Column:
    iy, im, id_ = CALENDAR_FORMATS[name][1]
    g = lambda i: F.get(fields, F.lit(i - 1))
    year, month = g(iy), g(im)
    y = F.when(F.length(year) == 2, _int(year) + F.when(_int(year) >= 70, 1900).otherwise(2000)).otherwise(_int(year))
    if "mon" in name:
        firsts = "".join(m[:3] for m in MONTH_NAMES)
        month = ((F.instr(F.lit(firsts), F.substring(month, 1, 3)) + 2) / 3).cast("int")
    else:
        month = _int(month)
    hour, minute, second, half = _int(g(4)), F.coalesce(_int(g(5)), F.lit(0)), F.coalesce(_int(g(6)), F.lit(0)), g(8)
    hour24 = F.when(half == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    micros = F.when(g(7) != "", F.rpad(F.substring(g(7), 1, 6), 6, "0").cast("int")).otherwise(0)
    day_start = F.unix_micros(F.call_function("try_make_timestamp", y, month, _int(g(id_)), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC")))
    wall = day_start + ((hour24 * 60 + minute) * 60 + second).cast("bigint") * 1_000_000 + micros
    wall = F.when((F.size(fields) == 11) & (hour24 < 24) & (minute < 60) & (second < 60) & (y >= 1), wall)
    short, region, offset = g(9), g(11), F.regexp_replace(g(10), ":", "")
    off_hours, off_rest = _int(F.substring(offset, 2, 2)), F.coalesce(_int(F.substring(offset, 4, 2)), F.lit(0))
    off_minutes = F.when((off_hours <= 18) & (off_rest < 60), (off_hours * 60 + off_rest) * F.when(offset.startswith("-"), -1).otherwise(1))
    short_minutes = F.coalesce(*[F.when(short == k, v) for k, v in ABBREVIATIONS.items()])
    fixed = F.when(offset != "", off_minutes).otherwise(short_minutes)
    zone = F.when(region != "", named).otherwise(home)
    return F.when((offset != "") | (short != ""), wall - fixed.cast("bigint") * 60_000_000).otherwise(_in_zone(wall, zone))


def _numeric_reading(text: Column, name: str, home: Column) -> Column:
    shape = text.rlike(f"^{NUMERIC_FORMATS[name]}$")
    if name == "spreadsheet_day":
        days = F.when(shape, text.try_cast("decimal(38,18)"))
        seconds = F.round(days * 86_400, 0).cast("bigint")
        wall = (seconds - 25_569 * 86_400) * 1_000_000
        return _in_zone(wall, home)
    scale = {"unix_s": 1_000_000, "unix_ms": 1_000, "unix_us": 1}[name]
    return F.when(shape, text.cast("bigint")) * scale


def with_readings(df: DataFrame, text: str, zone: str, formats: list[str]) -> DataFrame:
    """``df`` plus ``r``, ARRAY<STRUCT<format, micros>> of all valid readings of ``text``; unreadable or null gives none.

    ``zone`` counts where the text names none; null or blank means DEFAULT_ZONE, an unknown name reads as nothing.
    Projections are stacked so that each match is made once and every later step refers to it.
    """
    zones = _zone_map(zone_names(df.sparkSession))
    squeezed = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_CLASS + "+", " ")))
    desk = F.lower(F.trim(F.coalesce(F.col(zone), F.lit(""))))
    staged = df.select("*", squeezed.alias("_t"), desk.alias("_desk"))
    staged = staged.select("*", F.regexp_extract("_t", "([a-z]+(?:[/_+-][a-z0-9_+-]+)+)\\]?$", 1).alias("_region"))
    staged = staged.select(
        "*",
        F.when(F.col("_desk") == "", F.lit(DEFAULT_ZONE)).otherwise(F.try_element_at(zones, F.col("_desk"))).alias("_home"),
        F.try_element_at(zones, F.col("_region")).alias("_named"),
        *[_fields(F.col("_t"), f).alias(f"_f_{f}") for f in formats if f in CALENDAR_FORMATS],
    )
    home, named = F.col("_home"), F.col("_named")
    found = [(_calendar_reading(F.col(f"_f_{f}"), f, home, named) if f in CALENDAR_FORMATS else _numeric_reading(F.col("_t"), f, home)).alias(f"_m_{f}") for f in formats]
    staged = staged.select(*df.columns, *found)
    all_readings = F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"_m_{f}").alias("micros")) for f in formats])
    return staged.select(*df.columns, F.filter(all_readings, lambda r: r["micros"].isNotNull()).alias("r"))


DECISION_TYPE = T.StructType().add("source", "string").add("format_set", "string").add("format", "string").add("posterior", "double")


def _mixture(pdf: pd.DataFrame, prior: dict[str, float]) -> pd.DataFrame:
    """EM over the explanations of one source's texts; rows are (format set, how many texts have exactly it).

    Every text may also denote nothing. A format's share is estimated, its prior odds are given.
    """
    sets = [[*s.split("|"), NOTHING] for s in pdf["format_set"]]
    counts = pdf["n"].tolist()
    names = sorted({f for s in sets for f in s})
    weight = dict.fromkeys(names, 1.0 / len(names))
    odds = lambda f: weight[f] * prior[f]
    for _ in range(200):
        gained = dict.fromkeys(names, 0.0)
        for s, n in zip(sets, counts, strict=True):
            total = sum(map(odds, s))
            for f in s:
                gained[f] += n * odds(f) / total
        # half a pseudo-count per explanation keeps an unseen one possible
        new = {f: (gained[f] + 0.5) / (sum(counts) + 0.5 * len(names)) for f in names}
        moved = max(abs(new[f] - weight[f]) for f in names)
        weight = new
        if moved < 1e-9:
            break
    rows = []
    for s in sets:
        total = sum(map(odds, s))
        best = max(s, key=lambda f: (odds(f), f))
        rows.append((pdf["source"].iloc[0], "|".join(s[:-1]), best, odds(best) / total))
    return pd.DataFrame(rows, columns=["source", "format_set", "format", "posterior"])


def normalize_timestamps(df: DataFrame, keys: list[str], text: str, zone: str, source: str, prior: dict[str, float], accept: float = 0.9) -> DataFrame:
    """``df`` plus ``format``, ``posterior``, ``n_readings``, ``micros`` (UTC) and ``unresolved``.

    ``prior`` gives each format (and NOTHING) its prior odds. The source's mixture chooses for every text, also for one
    with a single reading, which then competes with denoting nothing. Below ``accept`` a row is ``unresolved`` and denotes
    no instant, unless all its readings agree on the instant. Null sources form one source.
    """
    src = F.coalesce(F.col(source), F.lit("")) if source else F.lit("")
    formats = [f for f in FORMATS if f in prior]
    read = with_readings(df.select(*keys, src.alias("source"), F.col(text).alias("text"), F.col(zone).alias("zone")), "text", "zone", formats)
    read = read.withColumn("format_set", F.array_join(F.array_sort(F.transform("r", lambda r: r["format"])), "|"))
    # read twice below, and a barrier against predicates that would be pushed into (and repeat) every match
    read = cut(read)
    # at most one row per source and set of formats, however many texts a source has
    counts = read.where("size(r) > 0").groupBy("source", "format_set").agg(F.count("*").alias("n"))
    decided = counts.groupBy("source").applyInPandas(lambda pdf: _mixture(pdf, prior), DECISION_TYPE)
    joined = read.join(decided, ["source", "format_set"], "left")
    chosen = F.try_element_at(F.filter("r", lambda r: r["format"] == F.col("format")), F.lit(1))["micros"]
    agree = F.size(F.array_distinct(F.transform("r", lambda r: r["micros"]))) == 1
    unresolved = (F.size("r") > 0) & (F.col("posterior") < accept) & ~((F.size("r") > 1) & agree)
    return joined.select(*keys, "format", "posterior", F.size("r").alias("n_readings"), F.when(~unresolved, chosen).alias("micros"), unresolved.alias("unresolved"))


def iso_utc(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ of UTC microseconds, independent of the session's zone."""
    seconds = F.floor(micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint")
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    text = wall.cast("string")
    fraction = F.lpad((micros - seconds * 1_000_000).cast("string"), 6, "0")
    return F.when(micros.isNotNull(), F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), fraction, F.lit("Z")))


def record_dates(records: DataFrame, prior: dict[str, float]) -> DataFrame:
    """Both date columns of the Record sheet as rows (record_id, field_name, ...) of :func:`normalize_timestamps`."""
    fields = ["issuance", "cancellation"]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields]))
    long = records.select("record_id", "source_zone", pairs.alias("p")).select("record_id", "source_zone", "p.field_name", "p.text")
    return normalize_timestamps(long, ["record_id", "field_name"], "text", "source_zone", "source_zone", prior)
