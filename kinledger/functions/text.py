"""Text, name and identifier expressions (JVM-side Columns unless stated)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters treated as white space.
SPACE_CLASS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\x0b\\x1c-\\x1f]"

# Legal-form endings of company names, longest first.
LEGAL_FORMS = [
    "LIMITED LIABILITY PARTNERSHIP",
    "PRIVATE LIMITED",
    "PRIVATE LTD",
    "PVT LIMITED",
    "PVT LTD",
    "AND COMPANY",
    "AND CO",
    "INCORPORATED",
    "CORPORATION",
    "COMPANY",
    "LIMITED",
    "PUBLIC",
    "PRIVATE",
    "CORP",
    "LLP",
    "PLC",
    "PVT",
    "LTD",
    "INC",
    "CO",
]
# Leading words that never identify a brand.
CLUSTER_STOP_WORDS = ["THE", "M", "MS", "SHRI", "SHREE", "SRI", "NEW", "INDIAN", "INDIA"]
# Fixed value: shape of a company number.
CIN_SHAPE = "^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$"
# Fixed value: remarks in a name that give former names.
ALIAS_REMARK = "(?i)\\(\\s*(?:formerly(?:\\s*known\\s+as)?|name\\s+as\\s+per\\s+mca)\\s*[:\u2013-]?\\s*([^)]+)\\)"


def clean(c: Column) -> Column:
    """White space (Unicode included) collapsed and trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_CLASS + "+", " "))


def clean_or_null(c: Column) -> Column:
    x = clean(c)
    return F.when(F.length(x) > 0, x)


def fold_ascii(s: str | None) -> str | None:
    """Compatibility decomposition without combining marks."""
    if s is None or s.isascii():
        return s
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not "̀" <= ch <= "ͯ")


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Diacritics off; null stays null. Needed only where ``is_ascii`` fails, see :func:`normalize_name`."""
    return s.map(fold_ascii, na_action="ignore")


def normalize_name_folded(c: Column) -> Column:
    """Upper case, '&' spelled out, everything but A-Z0-9 a single space; expects marks already stripped."""
    x = F.regexp_replace(F.upper(clean(c)), "&", " AND ")
    return F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))


def normalize_name(c: Column) -> Column:
    """:func:`normalize_name_folded` with the Arrow fold in front, for text that may hold accents."""
    return normalize_name_folded(strip_marks(c))


def name_core(normalized: Column) -> Column:
    """Trailing legal forms and a dangling AND removed until nothing changes: each round takes a word, so words bound rounds."""
    forms = "|".join(LEGAL_FORMS)

    def step(acc: Column, _: Column) -> Column:
        shorter = F.regexp_replace(acc, f"^(.*?) (?:{forms})$", "$1")
        return F.regexp_replace(F.when(acc.rlike(f"^(?:{forms})$"), acc).otherwise(shorter), " AND$", "")

    return F.aggregate(F.split(normalized, " "), normalized, step)


def tokens(c: Column) -> Column:
    """Blank-separated words; '' gives no word."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct grams in order of first occurrence; a string of at most ``n`` characters is its own gram."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(grams))


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def cluster_key(core: Column) -> Column:
    """First significant word of a core name, cut to 8 letters; a head of at most 2 letters joins the next word."""
    words = tokens(core)
    stop = F.array(*[F.lit(w) for w in CLUSTER_STOP_WORDS])

    def skip(acc: Column, _: Column) -> Column:
        return F.when((F.size(acc) > 1) & F.array_contains(stop, F.element_at(acc, 1)), F.slice(acc, 2, 1_000_000)).otherwise(acc)

    rest = F.aggregate(words, words, skip)
    head = F.try_element_at(rest, F.lit(1))
    second = F.try_element_at(rest, F.lit(2))
    joined = F.concat_ws("_", head, F.substring(second, 1, 8))
    key = F.when((F.length(head) <= 2) & second.isNotNull(), joined).otherwise(F.substring(head, 1, 8))
    return F.coalesce(key, F.lit("__empty__"))


def normalize_cin(c: Column) -> Column:
    x = F.regexp_replace(F.upper(clean(c)), "[^A-Z0-9]", "")
    return F.when(F.length(x) > 0, x)


def is_valid_cin(c: Column) -> Column:
    return F.coalesce(c.rlike(CIN_SHAPE), F.lit(False))


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    flags = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first_diff = F.array_position(flags, F.lit(True))
    return F.when(n == 0, F.lit(0)).when(first_diff > 0, first_diff.cast("int") - 1).otherwise(n)


def parse_yes_no(c: Column) -> Column:
    x = F.lower(clean(c))
    return F.when(x.isin("yes", "y", "true"), F.lit(True)).when(x.isin("no", "n", "false"), F.lit(False))


def parse_integer(c: Column) -> Column:
    """Whole number of a cell, everything but digits and signs left out; null where none remains."""
    digits = F.regexp_extract(F.regexp_replace(clean(c), "[^0-9-]", ""), "^-?[0-9]+", 0)
    return digits.try_cast("long")


def ends_in_legal_form(normalized: Column) -> Column:
    return normalized.rlike(f"(?:^| )(?:{'|'.join(LEGAL_FORMS)})$")


def split_names(joined: Column) -> Column:
    """Names joined by 'and': a name ends only behind a legal form, so that an 'and' inside a name stays."""
    start = F.struct(F.lit("").alias("held"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        text = F.when(acc["held"] == "", part).otherwise(F.concat(acc["held"], F.lit(" and "), part))
        whole = ends_in_legal_form(normalize_name_folded(text))
        return F.struct(F.when(whole, "").otherwise(text).alias("held"), F.when(whole, F.concat(acc["done"], F.array(clean(text)))).otherwise(acc["done"]).alias("done"))

    folded = F.aggregate(F.split(joined, "(?i)\\s+and\\s+"), start, step)
    return F.filter(F.concat(folded["done"], F.array(clean(folded["held"]))), lambda n: n != "")


def parse_company_name(c: Column) -> Column:
    """STRUCT<display_name, alternate_names>: former names lifted out of a name cell, other parentheses left alone.

    Former names are distinct by their normalised form, the first spelling stays. Null gives '' and no names.
    """
    raw = clean(c)
    found = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(ALIAS_REMARK), 1), split_names))
    bare = clean(F.regexp_replace(raw, ALIAS_REMARK, " "))
    keyed = F.filter(F.transform(found, lambda n: F.struct(normalize_name_folded(n).alias("k"), n.alias("n"))), lambda s: s["k"] != "")
    keys = F.array_distinct(F.transform(keyed, lambda s: s["k"]))
    first = F.transform(keys, lambda k: F.element_at(F.filter(keyed, lambda s: s["k"] == k), 1)["n"])
    return F.struct(F.when(bare == "", raw).otherwise(bare).alias("display_name"), first.alias("alternate_names"))
