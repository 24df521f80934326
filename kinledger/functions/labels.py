"""Labels, categories and display texts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinledger.functions.text import clean

# Words of a heading and the bank category they name; the first that occurs counts.
HEADING_CATEGORIES = [
    ("small finance", "small_finance_bank"),
    ("payments bank", "payments_bank"),
    ("local area bank", "local_area_bank"),
    ("regional rural", "regional_rural_bank"),
    ("name of rrb", "regional_rural_bank"),
    ("name of the rrb", "regional_rural_bank"),
    ("co-operative", "state_cooperative_bank"),
    ("cooperative", "state_cooperative_bank"),
    ("financial institution", "financial_institution"),
    ("financial  institution", "financial_institution"),
    ("wholly owned banking subsidiary", "foreign_bank_subsidiary"),
    ("foreign bank", "foreign_bank"),
    ("private sector", "private_sector_bank"),
    ("nationalised", "public_sector_bank"),
    ("state bank of india", "public_sector_bank"),
    ("public sector", "public_sector_bank"),
]
# Display labels of sources, standings and ways of identification.
SOURCE_LABELS = {
    "registered_nbfc": "RBI list of registered NBFCs",
    "registered_arc": "RBI list of registered ARCs",
    "cancelled_company": "RBI cancelled-registration list",
    "cancelled_record": "RBI cancellation / restoration record",
    "bank": "RBI Banks in India",
}
STANDING_LABELS = {
    "registered": "Certificate of Registration on record",
    "cancelled": "Certificate of Registration cancelled",
    "cancellation_record": "Appears in the cancellation / restoration record",
    "bank": "Listed by the RBI as a bank operating in India",
}
IDENTIFIED_LABELS = {
    "cin": "identified by CIN",
    "official_website": "identified by the RBI-published website",
    "contact_domain": "identified by the contact address the RBI publishes for this company",
    "exact_name": "exact name match",
    "former_name": "matches a former name on the RBI record",
}
CONFIDENCE_LABELS = [(0.9, "very likely the same institution"), (0.6, "possibly the same institution"), (0.0, "similar name only")]


def _lookup(c: Column, values: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, v) for k, v in values.items()])


def bank_category(heading: Column) -> Column:
    """Category a directory heading stands for; null where it names none."""
    x = F.lower(heading)
    return F.coalesce(*[F.when(F.contains(x, F.lit(words)), name) for words, name in HEADING_CATEGORIES])


def source_label(source: Column) -> Column:
    return _lookup(source, SOURCE_LABELS)


def standing_label(standing: Column) -> Column:
    return _lookup(standing, STANDING_LABELS)


def confidence_label(identified_by: Column, probability: Column) -> Column:
    """How sure a match is, in words: the way it was identified, else the band of its probability."""
    return F.coalesce(_lookup(identified_by, IDENTIFIED_LABELS), *[F.when(probability >= least, label) for least, label in CONFIDENCE_LABELS], F.lit(CONFIDENCE_LABELS[-1][1]))


def slug(core: Column) -> Column:
    """Lower case, every run of other signs one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(core), "[^a-z0-9]+", "_"), "^_|_$", "")


def shorten(c: Column, size: int) -> Column:
    """At most ``size`` characters, the last of them an ellipsis where something was left out."""
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size - 1), F.lit("…")))


def as_of_text(day: Column) -> Column:
    """A date as '5 March 2026'; a missing one is said to be unavailable."""
    return F.coalesce(F.date_format(day, "d MMMM yyyy"), F.lit("date unavailable"))


def without_fillers(c: Column, size: int) -> Column:
    """Cleaned text cut to ``size``; blank texts and words for 'nothing' are null."""
    x = clean(c)
    return F.when((x != "") & ~F.lower(x).isin("null", "n/a", "none"), F.substring(x, 1, size))


def url_key(c: Column) -> Column:
    """Host without www. and path without closing slashes, lower case; null unless it is a web address."""
    host, path = F.try_parse_url(c, F.lit("HOST")), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    web = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https")
    return F.when(web & host.isNotNull(), F.lower(F.concat(F.regexp_replace(F.lower(host), "^www\\.", ""), F.regexp_replace(path, "/+$", ""))))


def letters_and_digits(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
